"""Token ids of whole texts from a public tokenizer's file, with a bounded cache of chunks.

A chunk begins at a text's start and at places that no pre-token of the vocabularies used here spans:

* a space that follows a character other than white space;
* between an ASCII letter or digit (or, before a mark, a Latin-1 letter) and an ASCII mark other than the apostrophe,
  whose contractions reach over it;
* around a single line feed between two characters other than white space.

Where that can't be told from a few bytes, chunks stay together. Chunks can therefore be encoded alone. A chunk of one
word of ASCII or Latin-1 letters is one pre-token, and goes to the tokenizer's own merge model; every other chunk
goes through the whole tokenizer. numpy finds the different chunks of a slice and puts their ids back in order.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np

from .arrowtext import BYTES_A, LOWER, U64, Raw, Rolling

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_SOLID = np.zeros(256, bool)  # lead bytes of characters that are no white space
_SOLID[[*(c for c in range(0x80) if not _SPACE[c]), *range(0xC3, 0xE0), *range(0xE4, 0xF8)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
KEPT_CHUNKS = 1_000_000  # about 30 bytes each
KEPT_BYTES = 64  # longer chunks are encoded each time


def _before(d: np.ndarray, j: int) -> np.ndarray:
    """The byte j places earlier, 0 where there is none."""
    return np.concatenate([np.zeros(min(j, len(d)), np.uint8), d[: max(0, len(d) - j)]])


def after_solid(d: np.ndarray) -> np.ndarray:
    """For each byte, whether the character before it surely is no white space."""
    one, two, three, four = (_before(d, j) for j in range(1, 5))
    # a character of several bytes counts if its lead byte begins no kind of space
    wide = (one >= 0x80) & (((two >= 0xC3) & (two < 0xE0)) | ((two < 0xC0) & (two >= 0x80) & (((three >= 0xE4) & (three < 0xF0)) | ((three < 0xC0) & (three >= 0x80) & (four >= 0xF0)))))
    return ((one < 0x80) & ~_SPACE[one]) | wide


def chunk_starts(texts: Raw) -> np.ndarray:
    """Byte positions at which chunks begin."""
    d = texts.data
    one, two = _before(d, 1), _before(d, 2)
    solid = after_solid(d)
    cut = (d == 0x20) & solid
    mark = _MARK[d]
    letter = _ALNUM[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
    cut |= (mark & letter) | (_MARK[one] & _ALNUM[d])
    feed = np.zeros(len(d), bool)
    feed[:-1] = (d[:-1] == 10) & solid[:-1] & _SOLID[d[1:]]
    feed[texts.off[:-1][texts.off[:-1] < texts.off[1:]]] = False
    feed[texts.off[1:][texts.off[1:] > texts.off[:-1]] - 1] = False
    cut |= feed
    cut[1:] |= feed[:-1]
    cut[texts.off[:-1][texts.off[:-1] < texts.off[1:]]] = True
    return np.flatnonzero(cut)


def space_starts(texts: Raw) -> np.ndarray:
    """Byte positions at which texts begin, or a space follows a character other than white space."""
    cut = (texts.data == 0x20) & after_solid(texts.data)
    cut[texts.off[:-1][texts.off[:-1] < texts.off[1:]]] = True
    return np.flatnonzero(cut)


def words(texts: Raw, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which chunks are a word of ASCII and Latin-1 letters, a space before it or not."""
    d = texts.data
    after = np.append(d[1:], np.uint8(0))
    lead = (d == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
    other = ~(_LETTER[d] | lead)
    other[1:] &= ~lead[:-1]
    count = np.concatenate([[0], np.cumsum(other)])
    body = start + (d[start] == 0x20)
    return (body < end) & (count[end] == count[body])


class ChunkCache:
    """Encodes texts as the concatenation of their chunks' encodings.

    Short chunks are held in arrays sorted by 64-bit hash, with their ids in one run of bytes; beyond `limit` chunks, the
    half met last stays.
    """

    def __init__(self, encode_many: Callable[[list[bytes], np.ndarray], list[bytes]], dtype: str, limit: int = KEPT_CHUNKS, fold: bool = False, starts: Callable[[Raw], np.ndarray] = chunk_starts):
        """encode_many takes chunks and which of them are words. fold: the tokenizer lower-cases, so ASCII texts may be lower-cased first."""
        self.encode_many, self.dtype, self.limit, self.fold, self.starts = encode_many, np.dtype(dtype), limit, fold, starts
        self.turn = 0
        self._hold(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype))

    def _hold(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray, met: np.ndarray, flat: np.ndarray) -> None:
        self.keys, self.begin, self.size, self.met, self.flat = keys, begin, size, met, flat

    def _shrink(self) -> None:
        """Keep half of `limit` chunks at most, those met last."""
        keep = self.met > np.partition(self.met, -(self.limit // 2) - 1)[-(self.limit // 2) - 1]
        size = self.size[keep]
        begin = np.cumsum(size, dtype=np.int64) - size
        flat = self.flat[np.repeat(self.begin[keep] - begin, size) + np.arange(size.sum(dtype=np.int64))]
        self._hold(self.keys[keep], begin, size, self.met[keep], flat)

    def lookup(self, texts: Raw, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different chunks of texts that begin and end there, in order of key: a run of ids, where each chunk's begin and how many."""
        if len(self.keys) > self.limit:
            self._shrink()
        self.turn += 1
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == key[inside]
        begin, size = np.empty(len(key), np.int64), np.empty(len(key), np.int32)
        held, new = at[known], np.flatnonzero(~known)
        begin[known], size[known] = self.begin[held], self.size[held]
        self.met[held] = self.turn
        flat = self.flat
        if len(new):
            short = end[new] - start[new] <= KEPT_BYTES
            new = np.concatenate([new[short], new[~short]])
            first, last, raw = start[new], end[new], texts.data.tobytes()
            found = self.encode_many([raw[a:b] for a, b in zip(first.tolist(), last.tolist())], words(texts, first, last))
            size[new] = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            begin[new] = len(self.flat) + np.cumsum(size[new], dtype=np.int64) - size[new]
            flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), self.dtype)])
            kept = new[: int(short.sum())]
            keys = np.concatenate([self.keys, key[kept]])
            order = np.argsort(keys, kind="stable")
            met = np.concatenate([self.met, np.full(len(kept), self.turn, np.int32)])
            end_kept = len(self.flat) + int(size[kept].sum(dtype=np.int64))
            self._hold(keys[order], np.concatenate([self.begin, begin[kept]])[order], np.concatenate([self.size, size[kept]])[order], met[order], flat[:end_kept])
        return flat, begin, size

    def encode(self, texts: Raw) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the last one's end)."""
        if self.fold:
            high = np.concatenate([[0], np.cumsum(texts.data >= 0x80)])
            plain = np.repeat(high[texts.off[1:]] == high[texts.off[:-1]], np.diff(texts.off))
            texts = Raw(np.where(plain, LOWER[texts.data], texts.data), texts.off)
        start = self.starts(texts)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(texts.n + 1, np.int64)
        end = np.append(start[1:], len(texts.data))
        key = Rolling(BYTES_A[texts.data]).spans(start, end) + (end - start).astype(U64)
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        flat, begin, size = self.lookup(texts, key, start[first], end[first])
        count = size[inverse].astype(np.int64)
        done = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begin[inverse] - done[:-1], count) + np.arange(done[-1])]
        return ids, done[np.searchsorted(start, texts.off)]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        ids, at = self.encode(Raw(np.frombuffer(b"".join(data), np.uint8), off))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


def byte_characters() -> dict[int, int]:
    """Latin-1 character of a byte -> the printable character that stands for it in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


_loaded: dict[str, ChunkCache] = {}


def library_encoder(path: str) -> ChunkCache:
    """Unsigned 16-bit ids by the tokenizers library; strings of special tokens in a text are ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        settings, characters = tokenizer.to_str().partition('"model"')[0], byte_characters()
        folds, spaces, merge = '"Lowercase"' in settings, '"Removed"' not in settings, tokenizer.model.tokenize
        gap = chr(characters[10])  # no word holds a line feed

        def encode_words(chunks: list[bytes]) -> list[bytes]:
            text = b"\n".join(chunks)
            if folds:
                text = text.decode().lower().encode()
            if not spaces:
                text = text.replace(b" ", b"")
            tokens = list(map(merge, text.decode("latin-1").translate(characters).split(gap)))
            raw = array("H", [t.id for word in tokens for t in word]).tobytes()
            end = list(accumulate(2 * len(word) for word in tokens))
            return [raw[a:b] for a, b in zip([0, *end], end)]

        def encode_many(chunks: list[bytes], plain: np.ndarray) -> list[bytes]:
            out: list[bytes] = [b""] * len(chunks)
            some, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
            for i, x in zip(some, encode_words([chunks[i] for i in some]) if some else ()):
                out[i] = x
            for i, e in zip(rest, tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)):
                out[i] = array("H", e.ids).tobytes()
            return out

        _loaded[path] = ChunkCache(encode_many, "<u2", fold=folds)
    return _loaded[path]


def encoded_rows(ids: np.ndarray, at: np.ndarray, end_id: int) -> list[bytes]:
    """Each text's ids as bytes, with end_id last."""
    end, raw, width = np.array([end_id], ids.dtype).tobytes(), ids.tobytes(), ids.dtype.itemsize
    return [raw[a * width : b * width] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
