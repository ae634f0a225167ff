"""Lexical retrieval packing: sequences filled with documents that BM25 finds similar to their seed.

Terms are token ids, so document frequencies of the whole corpus are a vector of the vocabulary's size. Documents are
routed by content: each goes to the cell whose centre is nearest to its tf-idf sketch, with as many cells as the corpus
has shards; a range shuffle by cell (cells in a chain of like ones) and by nearness in a cell brings like documents
together, and splits a large cell over several tasks. The inverted index is sharded along that order: a task indexes
about ``shard_tokens`` ids at a time with the corpus-wide statistics, and packs them. A window begins with what is left
of the last cut document, or with the next unused one; unused neighbours of that seed, scored by all of its terms, fill
it in order of score, the last being cut, so every sequence of a shard but its last is full. The pieces are written to
the shared folder, so that the range shuffle is done once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fetched, settle
from .arrowtext import U64, Raw, give_back, mix, text_slices
from .tokens import encoded_rows, library_encoder

TERMS = 1 << 16
K1, B = 1.2, 0.75
SKETCH = 256
SAMPLE = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit ids with end_id last; null text counts as empty."""

    def task(batches):
        encoder = library_encoder(tokenizer)
        for batch, texts in text_slices(batches, form=Raw):
            rows = encoded_rows(*encoder.encode(texts), end_id)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(rows, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids binary")


def corpus_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of each term, number of documents and their mean length, over all documents."""

    def task(batches):
        df, n, total = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                df[np.unique(ids)] += 1
                n, total = n + 1, total + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, [-1, -2]), "n": np.append(df[at], [n, total])})

    got = fetched(tokens.select("ids").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    found = dict(zip(got["term"].to_pylist(), got["n"].to_pylist()))
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(TERMS, np.int64)
    df[list(found)] = list(found.values())
    return df, n, total / max(n, 1)


def sketches(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf vectors, each term added with a fixed sign to one of SKETCH places."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    keys, tf = np.unique(np.concatenate(docs).astype(np.int64) | np.repeat(np.arange(len(docs)), size) << 16, return_counts=True)
    doc, term = keys >> 16, keys & 0xFFFF
    hashed = mix(term.astype(U64) + U64(1))
    weight = idf[term] * (1 + np.log(tf)) * np.where(hashed >> U64(63), 1, -1)
    out = np.bincount(doc * SKETCH + (hashed % U64(SKETCH)).astype(np.int64), weights=weight, minlength=len(docs) * SKETCH).reshape(-1, SKETCH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _runs(batches, limit: int = 1_000_000):
    """(doc_ids, ids) of runs of rows with about ``limit`` ids."""
    doc_ids, held, n = [], [], 0
    for batch in batches:
        for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            doc_ids.append(doc_id)
            held.append(np.frombuffer(x.as_py(), "<u2"))
            n += len(held[-1])
            if n >= limit:
                yield doc_ids, held
                doc_ids, held, n = [], [], 0
    if held:
        yield doc_ids, held


def centres(tokens: DataFrame, idf: np.ndarray, n: int, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means over about SAMPLE documents a cell, in a chain of like ones."""

    def task(batches):
        for _, held in _runs(batches):
            v = sketches(held, idf)
            yield pa.RecordBatch.from_pydict({"v": pa.array([r.tobytes() for r in v], pa.binary())})

    share = min(1.0, SAMPLE * cells / max(n, 1))
    some = tokens.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    got = sorted(fetched(some.mapInArrow(task, "v binary"))["v"].to_pylist())
    v = np.frombuffer(b"".join(got), np.float32).reshape(-1, SKETCH)
    if len(v) <= cells:
        c = v.copy() if len(v) else np.zeros((1, SKETCH), np.float32)
    else:
        c = v[np.random.default_rng(0).choice(len(v), cells, replace=False)]
        for _ in range(rounds):
            near = (v @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, v)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(length > 0, total / np.maximum(length, 1e-9), c)
    chain, left = [], np.ones(len(c), bool)
    at = 0
    while left.any():
        left[at] = False
        chain.append(at)
        at = int(np.where(left, c @ c[at], -np.inf).argmax())
    return c[chain]


def routed(tokens: DataFrame, idf: np.ndarray, cells: np.ndarray) -> DataFrame:
    """(doc_id, ids, cell, near): the cell of the most similar centre, and how similar."""
    shared = tokens.sparkSession.sparkContext.broadcast((idf, cells))  # a centre a shard

    def task(batches):
        idf, cells = shared.value
        for doc_ids, held in _runs(batches):
            like = sketches(held, idf) @ cells.T
            cell = like.argmax(1)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([h.tobytes() for h in held], pa.binary()), "cell": pa.array(cell, pa.int64()), "near": like[np.arange(len(held)), cell]})

    return tokens.mapInArrow(task, "doc_id long, ids binary, cell long, near float")


class Shard:
    """BM25 postings over a bounded set of documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        keys = np.sort(np.concatenate(docs).astype(np.uint32) | np.repeat(np.arange(len(docs), dtype=np.uint32), size) << np.uint32(16))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        tf = np.diff(np.append(first, len(keys))).astype(np.float32)
        doc, term = (keys[first] >> np.uint32(16)).astype(np.int32), (keys[first] & np.uint32(0xFFFF)).astype(np.uint16)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc].astype(np.float32) / mean))
        self.of_doc = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.of_term = np.searchsorted(term[order], np.arange(TERMS + 1))
        self.n = len(docs)
        # terms that many documents have are rows of weights
        common = np.flatnonzero(np.diff(self.of_term) > self.n / 8)
        self.row = np.full(TERMS, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for r, t in enumerate(common.tolist()):
            s = slice(self.of_term[t], self.of_term[t + 1])
            self.rows[r, self.post_doc[s]] = self.post_weight[s]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for all of the seed's terms."""
        terms = self.term[self.of_doc[seed] : self.of_doc[seed + 1]]
        rows = self.row[terms]
        out = np.zeros(self.n, np.float32)
        for r in rows[rows >= 0].tolist():
            out += self.rows[r]
        first = self.of_term[terms[rows < 0]]
        size = self.of_term[terms[rows < 0].astype(np.int64) + 1] - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        np.add.at(out, self.post_doc[at], self.post_weight[at])
        return out


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """(doc, start, length, sequence, offset) of each piece."""
    shard = Shard(docs, idf, mean)
    size = [len(d) for d in docs]
    begun, free = [0] * len(docs), np.ones(len(docs), bool)
    upcoming, seed, sequence = 0, -1, 0
    while True:
        if seed < 0:
            while upcoming < len(docs) and not free[upcoming]:
                upcoming += 1
            if upcoming == len(docs):
                return
            seed = upcoming
        room, doc, scores, cut = window, seed, None, -1
        while True:
            free[doc] = False
            take = min(room, size[doc] - begun[doc])
            yield doc, begun[doc], take, sequence, window - room
            begun[doc] += take
            room -= take
            if begun[doc] < size[doc]:
                cut = doc
            if not room:
                break
            if scores is None:
                scores = shard.scores(seed)
            scores[doc] = -1
            doc = int(np.where(free, scores, -1).argmax())
            if not free[doc]:
                break
        seed, sequence = cut, sequence + 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, shard_tokens: int = 4_000_000) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); repeated rows are packed each by itself."""
    tokens = settle(tokenised(docs, tokenizer, end_id), "pack-tokens")
    df, n, mean = corpus_statistics(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shards = max(1, -(-int(n * mean) // shard_tokens))
    like = settle(routed(tokens, idf, centres(tokens, idf, n, shards)), "pack-routed")
    discard(tokens)
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(mean, 1.0)))  # one float a term of the vocabulary

    def task(batches):
        idf, mean = shared.value
        base, ids, held, n = TaskContext.get().partitionId() << 32, [], [], 0

        def flush(ids, held):
            nonlocal base
            rows, last = [], -1
            for d, start, length, sequence, offset in pack(held, idf, mean, window):
                crc = zlib.crc32(held[d][start : start + length].astype("<u4").tobytes())
                rows.append((ids[d], start, length, crc, len(held[d]), base + sequence, offset))
                last = sequence
            base += last + 1
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids.append(doc_id)
                held.append(np.frombuffer(x.as_py(), "<u2"))
                n += len(held[-1])
                if n >= 1.5 * shard_tokens or len(held) == TERMS - 1:  # half a shard stays, so that the last is no scrap
                    cut = 1 + int(np.searchsorted(np.cumsum([len(h) for h in held]), shard_tokens))
                    yield flush(ids[:cut], held[:cut])
                    ids, held = ids[cut:], held[cut:]
                    n = sum(map(len, held))
                    give_back()
        if held:
            yield flush(ids, held)
        ids, held = [], []
        give_back()

    ordered = like.repartitionByRange(shards, "cell", "near", "doc_id").sortWithinPartitions("cell", "near", "doc_id", "ids")
    pieces = settle(ordered.drop("cell", "near").mapInArrow(task, PIECES), "pack-pieces")
    discard(like)
    return pieces
