"""Vectorised text work on Arrow string columns: words, lines and 64-bit hashes without a Python object per word.

Words are maximal runs of bytes other than ASCII space and 0x09-0x0D; every whole text is used.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, _M, 256, dtype=U64, endpoint=True)


BYTES_A, BYTES_B = _table(11), _table(12)
LOWER_A = BYTES_A[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(self.n + 1, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_powers = {_P: _Powers(_P), _Q: _Powers(_Q)}


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = _P):
        n = len(values)
        up, self.down = _powers[base].get(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Raw:
    """A run of whole texts: their UTF-8 bytes and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.off = data, offsets
        self.n = len(offsets) - 1


class Texts(Raw):
    """Raw texts with their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        white = WHITE[data]
        self.dark = ~white
        start = self.dark.copy()
        start[1:] &= white[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[first] = self.dark[first]
        end = self.dark.copy()
        end[:-1] &= white[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[last] = self.dark[last]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word_off = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(self.word_off)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def per_doc_words(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a word) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.word_off[1:]] - sums[self.word_off[:-1]]

    def word_hashes(self, table: np.ndarray = BYTES_A) -> np.ndarray:
        return Rolling(table[self.data]).spans(self.start, self.end)

    def windows(self, k: int) -> np.ndarray:
        """Word positions at which k words of the same text begin."""
        at = np.arange(len(self.start))
        return at[at + k <= self.word_off[1:][self.word_doc]]

    def words(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def grams(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k values from each position on."""
    return Rolling(hashes, _Q).spans(at, at + k)


def repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row, whether another row of the same doc has its key."""
    joint = mix(key + mix(doc.astype(U64) + U64(1)))
    order = np.argsort(joint)
    s = joint[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(s), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = flag
    return out


def later_copies(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row, whether an earlier row of the same doc has its key."""
    joint = mix(key + mix(doc.astype(U64) + U64(1)))
    order = np.argsort(joint, kind="stable")
    s = joint[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers live on between tasks, next to each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20, form: type[Raw] = Texts) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows with about `limit` bytes of text each (a longer text is a run of its own); null counts as empty."""
    give_back()
    for batch in batches:
        text = batch.column(column)
        if text.null_count:
            text = text.fill_null("")
        text = text.cast(pa.large_string())
        n = len(text)
        if not n:
            continue
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            to = int(np.searchsorted(off, off[row] + limit, "right")) - 1
            to = min(n, max(row + 1, to))
            yield batch.slice(row, to - row), form(raw[off[row] : off[to]], off[row : to + 1] - off[row])
            row = to
        del batch, text, offsets, data, off, raw
    give_back()
