"""Words of many texts at once: numpy over the bytes of an Arrow column.

Texts are UTF-8. All separators used here are ASCII, so a byte of 0x80 or more always belongs to a word, and cutting at
bytes cuts at characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of words that end at ASCII white space: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words of digits, a-z (after lower-casing) and all beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text, one row at least; bounds what is in memory, drops nothing."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a text column: ``of[i]:of[i+1]`` are those of row i; ``codes`` index ``vocabulary``."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True):
        data, offsets = raw(column)
        if lower:
            data = LOWER[data]
        inside = kind[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if len(inside):
            before[0] = after[-1] = False
            edges = offsets[1:-1]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets
        lengths = np.zeros(len(self.starts) + 1, dtype=np.int32)
        np.cumsum(self.ends - self.starts, out=lengths[1:])
        text = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(lengths), pa.py_buffer(data[inside].tobytes()))
        coded = text.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, the same in every task."""
        vocabulary = np.asarray(self.vocabulary.to_pylist(), dtype=object)
        return pd.util.hash_array(vocabulary, categorize=False)[self.codes] if len(vocabulary) else np.zeros(0, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
