"""Toxic spans by a linear-chain conditional random field with two states (clean, toxic).

Labelled tokens: labels are given per document only. A word or word beginning that occurs in labelled toxic documents far more
often than in labelled clean ones (by document frequency) is marked; the tokens of toxic documents that carry such a mark are labelled
toxic, all others clean. The field is fitted to these by its conditional likelihood. Features of a token are its word, its
first four and five characters, the words before and after it, and whether it is in capitals.

Forward-backward gives every token's probability of lying in a toxic span. A document's score is a logistic function, fitted on the
training documents, of its highest marginal, the expected number of toxic tokens and their density.

Forward and backward passes run over all tokens of a batch at once: the tokens are cut into blocks of equal length, the
matrix product of every block is formed side by side, the block products are chained, and the marginals follow from each
block's entry. The first token of a document ignores what precedes it, so documents need no padding.

Only the training sample is bounded: ``most`` labelled documents of each class for the frequencies, which Spark counts. All of
these take part in the fit, which runs on the driver, with ``most_bytes`` characters at most, half of them for each class: texts beyond
a common length, the largest that the sum allows, take part with the window of that length that holds most marked words, so
no long text displaces others. The logistic function is fitted on summaries of the whole texts. Every token of every document is scored.
Null, empty and blank texts have no tokens and get the score of a document without toxic tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from tamis.llm.tables import fold, sampled
from tamis.llm.textbytes import Words, by_bytes

#: Words for tagging: letters (a-z after lower-casing, all beyond ASCII) and apostrophes.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = LETTERS[0x80:] = LETTERS[0x27] = True
SLICE = 1 << 20
PREFIXES = (4, 5)
SPANS = "array<struct<start:bigint,end:bigint,marginal:double>>"


def chain(step: np.ndarray) -> np.ndarray:
    """``step``: (N, 2, 2) non-negative matrices. Row t of the result is proportional to (1, 1) @ step[0] @ ... @ step[t]."""
    n = len(step)
    if not n:
        return np.zeros((0, 2))
    length = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // length)
    padded = np.concatenate([step, np.broadcast_to(np.eye(2), (blocks * length - n, 2, 2))]).reshape(blocks, length, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for t in range(length):
        product = product @ padded[:, t]
        product = product / product.sum(axis=(1, 2), keepdims=True)
    entry = np.empty((blocks, 2))
    a, b = 0.5, 0.5
    for k, (p, q, r, s) in enumerate(product.reshape(blocks, 4).tolist()):
        entry[k] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out = np.empty((blocks, length, 2))
    state = entry
    for t in range(length):
        state = np.einsum("ki,kij->kj", state, padded[:, t])
        state = state / state.sum(axis=1, keepdims=True)
        out[:, t] = state
    return out.reshape(-1, 2)[:n]


@dataclass
class Tokens:
    """Tokens of a batch of texts with their feature numbers (-1: none) and places."""

    features: np.ndarray  # (tokens, kinds)
    of: np.ndarray
    words: Words


class Field:
    """Feature names, their weights per kind of feature, transitions and the document calibration."""

    def __init__(self, words: list[str], prefixes: list[str]):
        self.words, self.prefixes = words, prefixes
        self.kinds = 3 + len(PREFIXES) + 1
        w, p = len(words), len(prefixes)
        self.base = np.cumsum([0, w, w, w] + [p] * len(PREFIXES))  # own word, word before, word after, prefixes, capitals
        self.weights = np.zeros(int(self.base[-1]) + 1)
        self.bias = -3.0
        self.transition = np.array([[0.5, -0.5], [0.0, 0.0]])
        self.start = np.zeros(2)
        self.middle, self.calibration = np.zeros(3), np.array([-2.0, 0.0, 0.0, 0.0])

    def tokens(self, texts: pa.Array) -> Tokens:
        words = Words(texts, LETTERS, lower=False)
        vocabulary = pc.ascii_lower(words.vocabulary)
        own = _numbers(vocabulary, self.words)
        capital = pc.match_substring_regex(words.vocabulary, "^[A-Z]{2,}$").to_numpy(zero_copy_only=False)
        per_word = [np.where(capital, self.base[-1], -1)]
        for i, size in enumerate(PREFIXES):
            at = _numbers(pc.utf8_slice_codeunits(vocabulary, 0, size), self.prefixes)
            per_word.append(np.where(at >= 0, at + self.base[3 + i], -1))
        mine = own[words.codes]
        first = np.zeros(len(mine), dtype=bool)
        first[words.of[:-1][words.counts > 0]] = True
        before = np.full(len(mine), -1)
        before[1:] = np.where(first[1:], -1, mine[:-1])
        after = np.full(len(mine), -1)
        after[:-1] = np.where(first[1:], -1, mine[1:])
        columns = [mine, np.where(before >= 0, before + self.base[1], -1), np.where(after >= 0, after + self.base[2], -1)]
        return Tokens(np.column_stack(columns + [c[words.codes] for c in per_word]).astype(np.int32), words.of, words)

    def marginals(self, features: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the toxic state, joint probabilities of neighbouring states; zero at first tokens)."""
        n = len(features)
        emission = self.bias + np.append(self.weights, 0.0)[features].sum(axis=1)
        emission = np.clip(emission, -30, 30)
        e = np.stack([np.exp(-np.maximum(emission, 0)), np.exp(np.minimum(emission, 0))], axis=1)
        step = np.exp(self.transition)[None] * e[:, None, :]
        first = of[:-1][np.diff(of) > 0]
        step[first] = (np.exp(self.start) * e[first])[:, None, :]
        forward = chain(step)
        # backward: the vector after token t is step[t+1] applied to the one after t+1
        following = np.concatenate([step[1:], np.ones((1, 2, 2))]) if n else step
        backward = chain(following[::-1].transpose(0, 2, 1))[::-1]
        both = forward * backward
        toxic = both[:, 1] / both.sum(axis=1)
        joint = np.zeros((n, 2, 2))
        if n > 1:
            joint[1:] = forward[:-1, :, None] * step[1:] * backward[1:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            joint[first] = 0
        return toxic, joint

    def fit(self, features: np.ndarray, of: np.ndarray, label: np.ndarray, steps: int = 60, rate: float = 0.2, decay: float = 0.01) -> None:
        """Adam on the conditional log-likelihood of the token labels, with a ridge penalty."""
        n = max(len(label), 1)
        first = np.zeros(len(label), dtype=bool)
        first[of[:-1][np.diff(of) > 0]] = True
        pairs = np.zeros((2, 2))
        inner = np.flatnonzero(~first)
        np.add.at(pairs, (label[inner - 1], label[inner]), 1)
        starts = np.bincount(label[first], minlength=2).astype(float)
        size = len(self.weights)
        theta = np.concatenate([self.weights, [self.bias], self.transition.ravel(), self.start])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        flat = features.ravel()
        known = flat >= 0
        for t in range(1, steps + 1):
            toxic, joint = self.marginals(features, of)
            error = label - toxic
            spread = np.repeat(error, features.shape[1])[known]
            gradient = np.concatenate([
                np.bincount(flat[known], weights=spread, minlength=size), [error.sum()],
                (pairs - joint.sum(axis=0)).ravel(), starts - np.array([(1 - toxic[first]).sum(), toxic[first].sum()])]) / n * 1000
            gradient -= decay * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            self.weights, self.bias = theta[:size], float(theta[size])
            self.transition, self.start = theta[size + 1:size + 5].reshape(2, 2), theta[size + 5:]

    def summary(self, toxic: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Per document: highest marginal, log of the expected toxic tokens, density."""
        n = np.diff(of)
        total = np.diff(np.concatenate([[0.0], np.cumsum(toxic)])[of])
        most = np.zeros(len(n))
        if len(toxic):
            most[n > 0] = np.maximum.reduceat(toxic, of[:-1][n > 0])
        return np.column_stack([most, np.log1p(10 * np.maximum(total, 0)), np.sqrt(np.maximum(total, 0) / np.maximum(n, 1))])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression of the document labels on the summaries (Newton steps)."""
        self.middle = x.mean(axis=0)
        z = np.hstack([np.ones((len(x), 1)), x - self.middle])
        w = np.zeros(z.shape[1])
        ridge = np.diag([1e-6] + [0.01] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
            w = w + np.clip(np.linalg.solve(hessian, z.T @ (y - p) - ridge @ w), -3, 3)
        self.calibration = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + (x - self.middle) @ self.calibration[1:], -30, 30)))


def _numbers(values: pa.Array, names: list[str]) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def spans_of(tokens: Tokens, toxic: np.ndarray, least: float = 0.5) -> list[list[dict]]:
    """Per document the runs of tokens with a marginal of at least ``least``: start and end in characters (end
    exclusive) and the highest marginal."""
    words, out = tokens.words, [[] for _ in range(len(tokens.of) - 1)]
    hits = np.flatnonzero(toxic >= least)
    if not len(hits):
        return out
    chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    doc = np.searchsorted(tokens.of, hits, side="right") - 1
    begins = np.ones(len(hits), dtype=bool)
    begins[1:] = (np.diff(hits) > 1) | (np.diff(doc) > 0)
    for run in np.split(np.arange(len(hits)), np.flatnonzero(begins)[1:]):
        d, a, b = doc[run[0]], hits[run[0]], hits[run[-1]]
        at = chars[words.offsets[d]]
        out[d].append({"start": int(chars[words.starts[a]] - at), "end": int(chars[words.ends[b]] - at), "marginal": float(toxic[a:b + 1].max())})
    return out


def _frequencies(docs: DataFrame) -> DataFrame:
    """(kind, name, toxic, clean): in how many documents of each class a word or a word beginning occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                words = Words(part.column("text"), LETTERS, lower=False)
                vocabulary = pc.ascii_lower(words.vocabulary).to_pylist()
                for d, y in enumerate(part.column("toxic").to_pylist()):
                    own = {vocabulary[c] for c in np.unique(words.codes[words.of[d]:words.of[d + 1]])}
                    names = {("word", w) for w in own} | {("prefix", w[:k]) for w in own for k in PREFIXES if len(w) >= k}
                    found[y].update(names)
        names = list(found[0].keys() | found[1].keys())
        for i in range(0, len(names), 50_000):
            some = names[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in some]), pa.array([w for _, w in some]),
                 pa.array([found[1][x] for x in some], pa.int64()), pa.array([found[0][x] for x in some], pa.int64())], ["kind", "name", "toxic", "clean"])

    counts = docs.mapInArrow(run, "kind string, name string, toxic bigint, clean bigint")
    return counts.groupBy("kind", "name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _common_length(lengths: np.ndarray, room: int) -> int:
    """The largest number of characters to which all texts can be cut so that they fit into ``room``; one at least."""
    lengths = np.sort(lengths)
    left = room - np.concatenate([[0], np.cumsum(lengths)])[:-1]  # for a text and all longer ones
    each = left // np.arange(len(lengths), 0, -1)
    short = np.flatnonzero(each < lengths)
    return max(int(each[short[0]]) if len(short) else int(lengths[-1]), 1)


def _marked(tokens: Tokens) -> np.ndarray:
    """Whether a token's own word or its beginning is a mark."""
    return (tokens.features[:, [0, 4, 5]] >= 0).any(axis=1)


def _windows(sample: DataFrame, field: Field, most: dict[int, int]) -> DataFrame:
    """``sample`` with texts of at most ``most`` characters per class: of longer ones whole words from the window with most marks."""

    def window(text: str, size: int, starts: np.ndarray, ends: np.ndarray, marked: np.ndarray) -> str:
        at = 0
        if marked.any():
            first, last = starts[marked], ends[marked]
            beyond = np.searchsorted(last, first + size, side="right")
            best = int(np.argmax(beyond - np.arange(len(first))))
            spare = size - (int(last[max(beyond[best] - 1, best)]) - int(first[best]))
            at = min(max(int(first[best]) - max(spare, 0) // 2, 0), len(text) - size)
        whole = np.flatnonzero((starts >= at) & (ends <= at + size))
        return text[starts[whole[0]]:ends[whole[-1]]] if len(whole) else text[at:at + size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                sizes = [most[y] for y in part.column("toxic").to_pylist()]
                if any(t is not None and len(t) > n for t, n in zip(texts, sizes, strict=True)):
                    tokens = field.tokens(part.column("text"))
                    words, marked = tokens.words, _marked(tokens)
                    chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                    for d, (t, n) in enumerate(zip(texts, sizes, strict=True)):
                        if t is not None and len(t) > n:
                            own, at = slice(tokens.of[d], tokens.of[d + 1]), chars[words.offsets[d]]
                            texts[d] = window(t, n, chars[words.starts[own]] - at, chars[words.ends[own]] - at, marked[own])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("toxic")], ["doc_id", "text", "toxic"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, text string, toxic int")


def _summaries(sample: DataFrame, field: Field) -> DataFrame:
    """(doc_id, toxic, most, total, density): the summary of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                tokens = field.tokens(part.column("text"))
                found = field.summary(field.marginals(tokens.features, tokens.of)[0], tokens.of)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *[pa.array(found[:, i]) for i in range(3)]],
                                                 ["doc_id", "toxic", "most", "total", "density"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, toxic int, most double, total double, density double")


def train(docs: DataFrame, labels: DataFrame, most: int = 4_000, most_bytes: int = 6 << 20, features: int = 4_000, parts: int = 3, held: int = 1,
          steps: int = 60) -> Field:
    """Fit on at most ``most`` labelled documents of each class outside the held-out fold, with at most ``features`` words
    and word beginnings, the most telling ones. A document labelled twice is toxic if any label says so; null labels count
    as none. Without documents of both classes the field stays untrained and all scores are equal."""
    allowed = F.coalesce(fold("doc_id", parts) != held, F.lit(False))
    judged = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    chosen = sampled(judged.where("toxic = 1"), most).unionByName(sampled(judged.where("toxic = 0"), most))
    # bounded by 2 * most ids, and by a row per id, however many rows share it
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    lengths = sample.select("toxic", F.coalesce(F.length("text"), F.lit(0)).alias("n")).toPandas()  # at most 2 * most rows
    sizes = lengths.groupby("toxic")["n"].count().to_dict()
    if len(sizes) < 2:
        return Field([], [])
    # how much likelier a toxic document holds it, and how surely (a lower bound on the ratio by one deviation)
    rate = (F.col("toxic") - F.sqrt("toxic")) / sizes[1] / ((F.col("clean") + 0.5) / sizes[0])
    telling = _frequencies(sample).where((F.col("toxic") >= 4) & (rate > 6)).withColumn("telling", F.log(rate) * F.col("toxic"))
    names = telling.orderBy(F.desc("telling"), "kind", "name").limit(features).collect()
    field = Field([r["name"] for r in names if r["kind"] == "word"], [r["name"] for r in names if r["kind"] == "prefix"])
    # both classes alike; what the driver can hold
    room = {int(y): _common_length(n.to_numpy(dtype=np.int64), most_bytes // 2) for y, n in lengths.groupby("toxic")["n"]}
    texts = _windows(sample, field, room).toPandas().sort_values(["doc_id", "text"], kind="stable")
    tokens = field.tokens(pa.array(texts["text"], pa.string()))
    label = (_marked(tokens) & np.repeat(texts["toxic"].to_numpy() == 1, np.diff(tokens.of))).astype(np.int64)
    field.fit(tokens.features, tokens.of, label, steps)
    columns = ["most", "total", "density"]
    summaries = _summaries(sample, field).toPandas().sort_values(["doc_id", *columns], kind="stable")
    field.calibrate(summaries[columns].to_numpy(), summaries["toxic"].to_numpy())
    return field


def tag(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_spans``; all rows and columns stay, columns of these names that are
    already there are replaced."""
    columns = [c for c in docs.columns if c not in ("toxicity", "toxic_spans")]
    schema = StructType([*docs.select(*columns).schema.fields, *StructType.fromDDL(f"toxicity double, toxic_spans {SPANS}").fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                tokens = field.tokens(part.column("text"))
                toxic, _ = field.marginals(tokens.features, tokens.of)
                score = field.scores(field.summary(toxic, tokens.of))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score, pa.float64()), pa.array(spans_of(tokens, toxic, least), span_type)], [*part.schema.names, "toxicity", "toxic_spans"])

    return docs.select(*columns).mapInArrow(run, schema)
