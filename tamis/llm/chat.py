"""Chat formatting with minimum-cost repair of the roles.

A legal conversation is a path of an automaton over roles: system first if at all, then user and assistant in turn, an
assistant's turn possibly followed by a tool's answer and another turn of its own, and the assistant last. A sequence of turns
is made legal by merging a turn into the one before it, by giving it another role, or by inserting empty turns; each has a cost,
and dynamic programming over the automaton's states finds the cheapest repair. Among equals it prefers, turn by turn from
the end, keeping to merging to relabelling, then the state that comes first in ``ROLES``.

Long conversations. What a run of turns does to the costs is a small matrix (from state, to state), and matrices of
consecutive runs combine by the min-plus product. Turns are sorted over range partitions; a conversation that spans several
of them, be it a third of all rows, is a few matrices, whose product fixes the states at the partition borders. Each
run is then repaired by itself. No conversation is ever gathered in one place.

Every input row gives one output row; the rendered conversation is the concatenation of ``rendered`` in the order of
``place``. Roles are trimmed and lower-cased, common other names are mapped; null and unknown roles fit any role at a small cost. Turns are
ordered by turn, then role, then text, nulls first; rows that repeat a turn number are turns of their own. A null conv_id is a
conversation like any other. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import stored

ROLES = ("system", "user", "assistant", "tool")
START = len(ROLES)
STATES = START + 1
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
LAST = ("assistant",)
OTHER_NAMES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant",
               "chatgpt": "assistant", "developer": "system", "instruction": "system", "function": "tool", "observation": "tool", "ipython": "tool"}
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 3.0
    insert: float = 2.0
    name: float = 0.5  # giving an unknown role a name


@dataclass(frozen=True)
class Template:
    """Where a turn begins and ends, and what joins merged turns. ``marker`` inside texts is broken up."""

    begin: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    joint: str = "\n"
    marker: str = "<|im_"
    broken: str = "<| im_"


def normal_role(role: str | None) -> str:
    name = (role or "").strip().lower()
    name = OTHER_NAMES.get(name, name)
    return name if name in ROLES else UNKNOWN


class Repair:
    """The dynamic programme for one set of costs."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        names = (*ROLES, "start")
        step = np.full((STATES, STATES), np.inf)
        for a in names:
            for b in NEXT[a]:
                step[names.index(a), names.index(b)] = 1
        self.legal = step < np.inf
        # cheapest insertions from state to state, and the first role inserted
        dist = np.where(self.legal, costs.insert, np.inf)
        np.fill_diagonal(dist, 0.0)
        self.hop = np.where(self.legal, np.arange(STATES)[None, :], -1)
        for k in range(STATES):
            through = dist[:, k:k + 1] + dist[k:k + 1]
            better = through < dist
            self.hop = np.where(better, self.hop[:, k:k + 1], self.hop)
            dist = np.minimum(dist, through)
        self.insert = dist
        self.matrices = {r: self._matrix(r) for r in (*ROLES, UNKNOWN)}
        self.closing = np.array([min(self.insert[s, ROLES.index(r)] for r in LAST) for s in range(STATES)])

    def label_cost(self, role: str, to: int) -> float:
        return 0.0 if role == ROLES[to] else self.costs.name if role == UNKNOWN else self.costs.relabel

    def moves(self, role: str, s: int, t: int) -> list[tuple[float, int, str, int]]:
        """Ways by which a turn of ``role`` leads from state s to t: cost, preference, kind, state before the turn itself."""
        label = self.label_cost(role, t)
        kept = role in (ROLES[t], UNKNOWN)
        out = []
        if s == t and s != START:
            out.append((self.costs.merge + label, 1 if kept else 3, "merge" if kept else "relabel+merge", s))
        for before in range(STATES):
            if self.legal[before, t] and self.insert[s, before] < np.inf:
                out.append((self.insert[s, before] + label, 0 if kept and before == s else 2, "keep" if kept else "relabel", before))
        return out

    def _matrix(self, role: str) -> np.ndarray:
        m = np.full((STATES, STATES), np.inf)
        for s in range(STATES):
            for t in range(START):
                ways = self.moves(role, s, t)
                m[s, t] = min((w[0] for w in ways), default=np.inf)
        return m

    def product(self, roles: list[str]) -> np.ndarray:
        m = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
        for r in roles:
            m = (m[:, :, None] + self.matrices[r][None]).min(axis=1)
        return m

    def borders(self, matrices: list[np.ndarray]) -> tuple[list[int], float]:
        """The states before, between and after runs of a whole conversation, and its cost."""
        cost = [np.where(np.arange(STATES) == START, 0.0, np.inf)]
        for m in matrices:
            cost.append((cost[-1][:, None] + m).min(axis=0))
        state = int(np.argmin(cost[-1] + self.closing))
        total, out = float(cost[-1][state] + self.closing[state]), [state]
        for m, c in zip(reversed(matrices), reversed(cost[:-1]), strict=True):
            state = int(np.argmin(c + m[:, state]))
            out.append(state)
        return out[::-1], total

    def run(self, roles: list[str], entry: int, leave: int) -> list[tuple[str, str, list[str], float]]:
        """The cheapest repair of a run between two states: per turn its kind, role, roles inserted before it, cost."""
        cost = [np.where(np.arange(STATES) == entry, 0.0, np.inf)]
        for r in roles:
            cost.append((cost[-1][:, None] + self.matrices[r]).min(axis=0))
        out, state = [], leave
        for r, c in zip(reversed(roles), reversed(cost[:-1]), strict=True):
            best = min(((c[s] + w[0], w[1], s, w) for s in range(STATES) if c[s] < np.inf for w in self.moves(r, s, state)), key=lambda x: x[:3] + x[3][:2])
            _, _, s, (price, _, kind, before) = best
            out.append((kind, ROLES[state], self.inserted(s, before), price))
            state = s
        return out[::-1]

    def inserted(self, s: int, to: int) -> list[str]:
        out = []
        while s != to:
            s = int(self.hop[s, to])
            out.append(ROLES[s])
        return out

    def closed(self, s: int) -> list[str]:
        """Roles inserted at the end of a conversation."""
        return self.inserted(s, min((ROLES.index(r) for r in LAST), key=lambda r: self.insert[s, r]))


def render(kind: str, role: str, inserted: list[str], text: str | None, first: bool, closing: list[str] | None, template: Template) -> str:
    """What a turn adds to the conversation: the end of the turn before, inserted turns, its own beginning or joint, its text; the
    last turn also what ends the conversation."""
    body = (text or "").replace(template.marker, template.broken)
    if kind.endswith("merge"):
        out = template.joint + body
    else:
        empty = "".join(template.begin.format(role=r) + template.end for r in inserted)
        out = ("" if first else template.end) + empty + template.begin.format(role=role) + body
    if closing is not None:
        out += template.end + "".join(template.begin.format(role=r) + template.end for r in closing)
    return out


TURNS = "kind string, conv_id {id}, part int, place bigint, turn {turn}, role string, text string, matrix array<double>"
OUT = "conv_id {id}, turn {turn}, place bigint, role string, repair string, repaired_role string, inserted array<string>, closing array<string>, cost double, rendered string"


def _types(df: DataFrame) -> dict[str, str]:
    return {"id": df.schema["conv_id"].dataType.simpleString(), "turn": df.schema["turn"].dataType.simpleString()}


def _runs(keys: list) -> list[tuple[int, int]]:
    out, start = [], 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            out.append((start, i))
            start = i
    return out


def formatted(conversations: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, turn, place (order in the conversation), role, repair (keep, merge, relabel, relabel+merge),
    repaired_role, inserted (roles of empty turns before it), closing (those after the last turn), cost, rendered."""
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kinds = _types(turns)
    schema = TURNS.format(**kinds)
    repair = Repair(costs)
    keys = ["conv_id", "turn", "role", "text"]
    in_order = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        open_id, product = None, None

        def piece() -> pa.RecordBatch:
            one = {"kind": ["piece"], "conv_id": [open_id], "part": [part], "place": [None], "turn": [None], "role": [None], "text": [None], "matrix": [product.ravel().tolist()]}
            return pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in one.items()})

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {"kind": pa.string(), "conv_id": batch.schema.field("conv_id").type, "part": pa.int32(), "place": pa.int64(),
                     "turn": batch.schema.field("turn").type, "role": pa.string(), "text": pa.string(), "matrix": pa.list_(pa.float64())}
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(["turn"] * n), batch.column("conv_id"), pa.array([part] * n, pa.int32()), pa.array(np.arange(n) + place + (part << 40)), batch.column("turn"),
                 batch.column("role"), batch.column("text"), pa.nulls(n, pa.list_(pa.float64()))], list(types))
            place += n
            ids, roles = batch.column("conv_id").to_pylist(), [normal_role(r) for r in batch.column("role").to_pylist()]
            for a, b in _runs(ids):
                if product is not None and ids[a] != open_id:
                    yield piece()
                    product = None
                open_id = ids[a]
                more = repair.product(roles[a:b])
                product = more if product is None else (product[:, :, None] + more[None]).min(axis=1)
        if product is not None:
            yield piece()

    both = stored(in_order.mapInArrow(split, schema), "turns", "kind")
    pieces = both.where("kind = 'piece'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "matrix"))).alias("pieces"))
    plan_schema = f"of_conv {kinds['id']}, of_part int, entry int, leave int, is_first boolean, is_last boolean"

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("of_conv", "of_part", "entry", "leave", "is_first", "is_last")}
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                states, _ = repair.borders([np.array(p["matrix"]).reshape(STATES, STATES) for p in found])
                for i, p in enumerate(found):
                    for k, v in zip(out, (conv, p["part"], states[i], states[i + 1], i == 0, i == len(found) - 1), strict=True):
                        out[k].append(v)
            kind = {"of_conv": batch.schema.field("conv_id").type, "of_part": pa.int32(), "entry": pa.int32(), "leave": pa.int32(), "is_first": pa.bool_(), "is_last": pa.bool_()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind[k]) for k, v in out.items()})

    plans = pieces.mapInArrow(plan, plan_schema)
    joined = both.where("kind = 'turn'").select("conv_id", "part", "place", "turn", "role", "text").join(
        plans, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")))
    grouped = joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").drop("of_conv", "of_part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            r = rows.to_pydict()
            roles = [normal_role(x) for x in r["role"]]
            out: dict[str, list] = {k: [] for k in ("repair", "repaired_role", "inserted", "closing", "cost", "rendered")}
            for a, b in _runs(list(zip(r["conv_id"], r["part"], strict=True))):
                steps = repair.run(roles[a:b], r["entry"][a], r["leave"][a])
                for i, (kind, role, inserted, price) in enumerate(steps, a):
                    closing = repair.closed(r["leave"][a]) if r["is_last"][a] and i == b - 1 else None
                    price += repair.costs.insert * len(closing or ())
                    text = render(kind, role, inserted, r["text"][i], r["is_first"][a] and i == a, closing, template)
                    for k, v in zip(out, (kind, role, inserted, closing or [], price, text), strict=True):
                        out[k].append(v)
            kind = {"inserted": pa.list_(pa.string()), "closing": pa.list_(pa.string()), "cost": pa.float64()}
            table = rows.select(["conv_id", "turn", "place", "role"]).combine_chunks()
            for k, v in out.items():
                table = table.append_column(k, pa.array(v, kind.get(k, pa.string())))
            return table

        def last_key(batch: pa.RecordBatch) -> tuple:
            return batch.column("conv_id")[-1].as_py(), batch.column("part")[-1].as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True))
            cut = _runs(keys)[-1][0]  # the last run may go on in the next batch
            if cut or (held and last_key(held[-1]) != keys[0]):
                held.append(batch.slice(0, cut))
                yield from done(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held)).to_batches()

    return grouped.mapInArrow(write, OUT.format(**kinds))
