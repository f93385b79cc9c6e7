"""Words and runs of words of a batch of texts, as numpy arrays over the UTF-8 bytes of the batch.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes have 64
bits: a polynomial over random byte values whose running sums give any word, or
any run of words, by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of ``kind`` and of its inverse modulo 2**64, at least ``n`` of each."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base = _BASES[kind]
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1), x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[kind] = (both[0], both[1])
    return _powers[kind]


def _spans(kind: str, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    power, inverse = _power(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


class Words:
    """``start`` and ``end`` of every word in ``data``; words ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[at[0]: at[-1]]
        self.text_at = at - at[0]
        if lower:
            self.data = _LOWER[self.data]
        word = ~_WHITE[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.text_at] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.text_at)
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = _spans("byte", _BYTE[self.data], self.start, self.end)
        return self._hash

    def runs(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hash of the ``length`` words from each of ``start``; runs may not cross texts."""
        return _spans("word", self.hash, start, start + length)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and text of every run of ``length`` words that lies within one text."""
        text = np.repeat(np.arange(len(self.first) - 1), self.counts)
        start = np.arange(len(self.start))
        inside = start + length <= self.first[1:][text]
        return start[inside], text[inside]

    def bytes(self, word: int) -> bytes:
        return self.data[self.start[word]: self.end[word]].tobytes()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of text, at least one row each.

    It bounds the memory of a task, whatever the session's batch size; no text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
