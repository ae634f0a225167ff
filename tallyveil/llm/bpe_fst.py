"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes to itself and each adjacent
pair encodes to itself: merges inside two tokens run in the same relative order with or without neighbours, so the
first merge across a boundary would also happen in the pair alone. The nondeterministic transducer guesses token
boundaries along a trie of the vocabulary and checks pairs; subset construction keeps, for every live guess, the
output not yet emitted, and emits what all guesses share. No guess reaches back further than the longest token, so
the delay is bounded. States and transitions are built when first met and dropped when there are too many.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import Raw, text_slices
from .tokens import ChunkCache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the leftmost pair of lowest rank until none is left (used on short byte strings only)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 40
    cost = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while cost:
        best = min(cost)
        if best == none:
            break
        i = cost.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i:
            cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(cost):
            cost[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Deterministic on the fly: (state, byte) -> (state, tokens emitted)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000):
        self.ranks, self.most_states = ranks, most_states
        self.spell = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, (), 0),)
        self.states, self.ids, self.moves, self.ends = [start], {start: 0}, {}, {}

    def fits(self, last: int, token: int) -> bool:
        """Whether token may follow last (-1: nothing precedes)."""
        key = (last + 1) << 20 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            if last < 0:
                known = merge_by_rank(self.spell[token], self.ranks) == [token]
            else:
                both = self.spell[last] + self.spell[token]
                whole = self.ranks.get(both)
                known = self.fits(-1, token) and not (whole is not None and self.fits(-1, whole)) and merge_by_rank(both, self.ranks) == [last, token]
            self.pairs[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Builds a transition. Guesses stay in the order of their tokens' starts, so equal sets are equal tuples."""
        found, child, token_at, inner, pairs = [], self.child, self.token_at, self.inner, self.pairs
        for last, waiting, node in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                found.append((last, waiting, node))
            token = token_at[node]
            if token >= 0:
                known = pairs.get((last + 1) << 20 | token)
                if self.fits(last, token) if known is None else known:
                    root = token, (*waiting, token), 0
        found.append(root)
        n, out = 0, found[0][1]
        for _, w, _ in found:
            if len(w) < len(out):
                out = w
        for token in out:
            if any(w[n] != token for _, w, _ in found):
                break
            n += 1
        key = tuple((last, w[n:], node) for last, w, node in found) if n else tuple(found)
        out = out[:n]
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = to, out
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            step = moves.get(state << 8 | byte)
            state, emitted = step if step is not None else self._move(state, byte)
            if emitted:
                out += emitted
        tail = self.ends.get(state)
        if tail is None:
            tail = self.ends[state] = next(w for _, w, node in self.states[state] if node == 0)
        return out + list(tail)


class Utf8Stream:
    """Incremental UTF-8 decoding: the state is the begun character's bytes, of which at most three are held."""

    def __init__(self):
        self.begun = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Number of bytes at the end that may still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if need <= back:
                    return 0
                if back > 1:
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                    return back if low <= data[1 - back] <= high else 0
                return back
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data) - self._open_tail(data)
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.begun = self.begun, b""
        return data.decode("utf-8", "replace")


class ByteBPE:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.fst = Transducer(ranks)
        # white space as Unicode defines it, whatever \s means to the regex module
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.pack = [i.to_bytes(4, "little") for i in range(len(ranks))]
        self.cache = ChunkCache(self._encode_chunks, "<u4")
        spell = [self.fst.spell[i] for i in range(len(ranks))]
        self.flat = np.frombuffer(b"".join(spell), np.uint8)
        self.size = np.fromiter(map(len, spell), np.int64, len(spell))
        self.begin = np.cumsum(self.size) - self.size

    def _encode_chunks(self, chunks: list[bytes], plain: np.ndarray) -> list[bytes]:
        encode, find, pack = self.fst.encode, self.find, self.pack
        out = []
        for c in chunks:
            ids = []
            for piece in find(c.decode()):
                ids += encode(piece.encode())
            out.append(b"".join([pack[i] for i in ids]))
        return out

    def raw(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.begin[ids] - (ends - size), size)
        return self.flat[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids: np.ndarray, block: int = 65_536):
        """Text of the ids, in blocks."""
        stream = Utf8Stream()
        for at in range(0, len(ids), block):
            yield stream.feed(self.raw(ids[at : at + block]))
        yield stream.close()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    key = path, pattern
    if key not in _loaded:
        _loaded[key] = ByteBPE(path, pattern)
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit); null text counts as empty, every row gives a row."""

    def task(batches):
        bpe = load(path, pattern)
        for batch, texts in text_slices(batches, form=Raw):
            ids, at = bpe.cache.encode(texts)
            rows = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(rows, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def task(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode(np.frombuffer(x.as_py() or b"", "<u4"))) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes again in one pass over the texts."""

    def task(batches):
        bpe = load(path, pattern)
        for batch, texts in text_slices(batches, form=Raw):
            n, ids_sha, text_sha = [], [], []
            every, at = bpe.cache.encode(texts)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                ids, sha = every[a:b], hashlib.sha256()
                for part in bpe.decode(ids):
                    sha.update(part.encode())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(sha.hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
