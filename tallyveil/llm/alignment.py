"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and corpus-wide counts of linked ids.

Texts are encoded once, by cached chunks, and their ids kept as a table: encoding costs ten times an alignment. Ids and
the tokens' sizes give an alignment without the text: every stretch of bytes between neighbouring token ends is a link.

1. First pass: every task sums the links of its documents by id pair and writes them by bucket of the pair's hash.
2. The distinct pairs of each bucket get a minimal perfect hash; keys stay beside it, so every lookup is verified.
3. The tasks' sums become dense vectors indexed by that hash and are added as a tree.
4. Second pass: documents are aligned again and look their links' counts up. A table of at most ``BROADCAST_PAIRS``
   pairs is sent to the executors whole; a larger one reaches each chunk of documents by a join, its own pairs only.

Ids have 16 bits, so a bucket holds at most 2^32 / 256 pairs whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, Raw, give_back, mix, text_slices
from .shared import fetched, settle
from .tokens import ChunkCache, byte_characters, library_encoder, space_starts

BUCKETS = 256
FAN = 16
FLUSH_PAIRS = 1_000_000
BROADCAST_PAIRS = 1_000_000  # 12 bytes and under half a byte of hash each
CHUNK_BYTES = 64 << 20
SLICE_TOKENS = 300_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.astype(U64)) >> U64(56)).astype(np.int32)


class PerfectHash:
    """Minimal perfect hash of distinct 32-bit keys: a key sits in the first level where no other key shares its place.

    Its index is the number of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(U64) + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, rest = [], [], keys
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = cls._place(rest, len(sizes), size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            rest = rest[count[at] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for some of those that were not built in."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.base[level] + self._place(keys[rest], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            out[rest[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            rest = rest[~hit]
        return out

    def dumps(self) -> bytes:
        return np.array([len(self.sizes)], "<i8").tobytes() + self.sizes.astype("<i8").tobytes() + self.words.tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u8", -1, 8 + 8 * n))


class Vocabularies:
    """A byte-level tokenizer (A) and a piece tokenizer (B): encoders of whole texts, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, pieces = library_encoder(path_a), SentencePieceProcessor(model_file=path_b)
        back = {chr(c): b for b, c in byte_characters().items()}
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        n = pieces.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        names = [pieces.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece spans the start of a word, so words can't be encoded alone")
        self.bytes_a = self._table({i: bytes(back.get(c, 0) for c in token) for token, i in vocab.items()})
        self.bytes_b = self._table({i: bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)})
        space = [pieces.piece_to_id("▁")]

        def encode_many(chunks: list[bytes], _words) -> list[bytes]:
            # the tokenizer puts the first space back, but for an empty text
            return [array("H", x or space).tobytes() for x in pieces.encode([c[1:].decode() for c in chunks], num_threads=1)]

        self.b = ChunkCache(encode_many, "<u2", starts=space_starts)

    @staticmethod
    def _table(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' sizes, where each begins, and their bytes one after another."""
        names = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        size = np.fromiter(map(len, names), np.int64, len(names))
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(names), np.uint8)

    def encode(self, texts: Raw) -> tuple[list[bytes], list[bytes]]:
        """Both tokenizers' ids of each text with a space before it; none for a text that is not given back by both."""
        full = texts.off[:-1] < texts.off[1:]
        spaced = Raw(np.insert(texts.data, texts.off[:-1][full], 0x20), texts.off + np.concatenate([[0], np.cumsum(full)]))
        whole, out = full, []
        for cache, (size, begin, raw) in ((self.a, self.bytes_a), (self.b, self.bytes_b)):
            ids, at = cache.encode(spaced)
            n = size[ids]
            end = np.concatenate([[0], np.cumsum(n)])
            fits = np.diff(end[at]) == np.diff(spaced.off)
            some = np.flatnonzero(np.repeat(fits, np.diff(at)))  # tokens of texts that have as many bytes
            m = n[some]
            joined = raw[np.repeat(begin[ids[some]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            differs = np.zeros(len(spaced.data) + 1, np.int64)
            of_fit = np.repeat(fits, np.diff(spaced.off))
            differs[1:][of_fit] = joined != spaced.data[of_fit]
            differs = np.cumsum(differs)
            whole = whole & fits & (differs[spaced.off[1:]] == differs[spaced.off[:-1]])
            out.append((ids.astype("<u2").tobytes(), at.tolist()))
        return tuple([raw[2 * i : 2 * j] if ok else b"" for ok, i, j in zip(whole.tolist(), at, at[1:])] for raw, at in out)


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return _loaded.get((path_a, path_b)) or _loaded.setdefault((path_a, path_b), Vocabularies(path_a, path_b))


def _digits() -> tuple[np.ndarray, np.ndarray]:
    text = [b"%d" % i for i in range(1 << 16)]
    return np.frombuffer(b"".join(t.ljust(5) for t in text), np.uint8).reshape(-1, 5), np.fromiter(map(len, text), np.int64, len(text))


DIGITS, N_DIGITS = _digits()


class Aligned:
    """A run of texts' ids, aligned: every stretch of bytes between neighbouring token ends is a link."""

    def __init__(self, batch: pa.RecordBatch, by: Vocabularies):
        raw = [batch.column(c).to_pylist() for c in ("a", "b")]
        self.a, self.b = (np.frombuffer(b"".join(x), "<u2") for x in raw)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum([len(x) // 2 for x in side])]).astype(np.int64) for side in raw)
        self.n_a, self.n_b = np.diff(self.at_a), np.diff(self.at_b)
        end_a, end_b = np.cumsum(by.bytes_a[0][self.a]), np.cumsum(by.bytes_b[0][self.b])
        ends = np.concatenate([[0], end_a])[self.at_a]  # of texts; the same for both
        mark = np.zeros(int(ends[-1]) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        stops = np.flatnonzero(mark)
        kind = mark[stops]
        self.ends_a, self.ends_b, self.ends_both = (kind & 1).astype(bool), kind >= 2, kind == 3
        self.of_a, self.of_b = (np.cumsum(x) - x for x in (self.ends_a, self.ends_b))  # the link's tokens
        self.pairs = self.a[self.of_a].astype(np.uint32) << np.uint32(16) | self.b[self.of_b]
        self.at = np.searchsorted(stops, ends, "right")
        self.n_links, self.n_groups = np.diff(self.at), self.sums(self.ends_both)

    def sums(self, per_link: np.ndarray) -> np.ndarray:
        """Each text's sum over its links."""
        total = np.concatenate([[0], np.cumsum(per_link, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def digests(self) -> list[str]:
        """Groups as text, A ids before B ids, all texts written by numpy at once; the checksum of each text's part."""
        group = np.cumsum(self.ends_both) - self.ends_both
        group_a, group_b = group[self.ends_a], group[self.ends_b]
        n = int(self.ends_both.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        before = np.cumsum(in_a + in_b) - in_a - in_b
        # places of tokens when each group has its A ids first
        slot_a = np.arange(len(self.a)) + (before - (np.cumsum(in_a) - in_a))[group_a]
        slot_b = np.arange(len(self.b)) + (before + in_a - (np.cumsum(in_b) - in_b))[group_b]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[slot_a], ids[slot_b] = self.a, self.b
        after[before + in_a - 1], after[before + in_a + in_b - 1] = ord("|"), ord(";")
        size = N_DIGITS[ids]
        stop = np.cumsum(size + 1)
        out, begin = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8), stop - size - 1
        for d in range(5):
            some = np.flatnonzero(size > d) if d else slice(None)
            out[begin[some] + d] = DIGITS[ids[some], d]
        out[stop - 1] = after
        cut, raw = np.concatenate([[0], stop])[self.at_a + self.at_b].tolist(), memoryview(out)
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(cut, cut[1:])]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about SLICE_TOKENS ids."""
    give_back()
    for batch in batches:
        size = np.cumsum(pa.compute.binary_length(batch.column("a")).to_numpy())
        row = 0
        while row < batch.num_rows:
            done = int(size[row - 1]) if row else 0
            to = max(row + 1, int(np.searchsorted(size, done + 2 * SLICE_TOKENS, "right")))
            yield batch.slice(row, to - row)
            row = to
    give_back()


def _encode(path_a: str, path_b: str) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = vocabularies(path_a, path_b)
        for batch, texts in text_slices(batches, form=Raw):
            a, b = by.encode(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return task


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, inverse, counts)
    return keys, out


def _count(path_a: str, path_b: str) -> Callable:
    """Rows (bucket, part, keys, counts) of the linked pairs of a task's documents."""

    def rows(keys, counts):
        bucket, part = bucket_of(keys), TaskContext.get().partitionId()
        order = np.argsort(bucket, kind="stable")
        stop = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        mine = [b for b in range(BUCKETS) if stop[b] < stop[b + 1]]
        cut = [order[stop[b] : stop[b + 1]] for b in mine]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(mine, pa.int32()), "part": pa.array([part] * len(mine), pa.int32()), "keys": pa.array([keys[c].astype("<u4").tobytes() for c in cut], pa.binary()), "counts": pa.array([counts[c].astype("<i8").tobytes() for c in cut], pa.binary())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, keys, counts, loose = vocabularies(path_a, path_b), np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        for batch in slices(batches):
            pairs = np.sort(Aligned(batch, by).pairs)
            first = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
            loose.append((pairs[first], np.diff(np.append(first, len(pairs)))))
            if sum(len(k) for k, _ in loose) > FLUSH_PAIRS:
                keys, counts = _summed(np.concatenate([keys, *(k for k, _ in loose)]), np.concatenate([counts, *(c for _, c in loose)]))
                loose = []
                if len(keys) > FLUSH_PAIRS:
                    yield rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield rows(*_summed(np.concatenate([keys, *(k for k, _ in loose)]), np.concatenate([counts, *(c for _, c in loose)])))

    return task


def _row(**columns) -> pa.RecordBatch:
    kinds = {int: pa.int32(), bytes: pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds[type(v)]) for k, v in columns.items()})


def _union(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = np.zeros(0, "<u4")
    for b in batches:
        keys = np.unique(np.concatenate([keys, *(np.frombuffer(x, "<u4") for x in b.column("keys").to_pylist())]))
    yield _row(bucket=key[0].as_py(), part=key[1].as_py(), keys=keys.tobytes())


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("counts").to_pylist():
            total = np.frombuffer(x, "<i8").copy() if total is None else np.add(total, np.frombuffer(x, "<i8"), out=total)
    yield _row(bucket=key[0].as_py(), part=key[1].as_py(), counts=total.tobytes())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's perfect hash, with its keys in the hash's order."""
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
            keys = np.frombuffer(raw, "<u4")
            found = PerfectHash.build(keys)
            placed = np.empty_like(keys)
            placed[found.index(keys)] = keys
            yield _row(bucket=bucket, hash=found.dumps(), keys=placed.tobytes())


def verified(found: PerfectHash, placed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys that must all be there."""
    at = found.index(keys)
    if (at < 0).any() or (placed[at] != keys).any():
        raise ValueError("a pair is missing from the table of pairs")
    return at


def _dense(key, parts: pa.Table, model: pa.Table) -> pa.Table:
    """The dense count vector of some tasks' sums over a bucket."""
    found, placed = PerfectHash.loads(model["hash"][0].as_py()), np.frombuffer(model["keys"][0].as_py(), "<u4")
    out = np.zeros(len(placed), np.int64)
    for k, c in zip(parts["keys"].to_pylist(), parts["counts"].to_pylist()):
        out[verified(found, placed, np.frombuffer(k, "<u4"))] += np.frombuffer(c, "<i8")
    return pa.Table.from_batches([_row(bucket=key[0].as_py(), part=key[1].as_py(), counts=out.tobytes())])


def _tree(rows: DataFrame, parts: int, merge: Callable, column: str) -> DataFrame:
    """Merge each bucket's rows, FAN of them in a task at a time, until one is left."""
    while True:
        rows = rows.withColumn("part", F.expr(f"part DIV {FAN}").cast("int")).groupBy("bucket", "part").applyInArrow(merge, f"bucket int, part int, {column} binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            return rows.drop("part")


def count_pairs(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(bucket, hash, keys, counts): a row a bucket with the corpus-wide count of each linked pair, in the hash's order."""
    sums = settle(tokens.select("a", "b").mapInArrow(_count(path_a, path_b), "bucket int, part int, keys binary, counts binary"), "align-sums")
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    model = settle(_tree(sums.select("bucket", "part", "keys"), parts, _union, "keys").mapInArrow(_hashed, "bucket int, hash binary, keys binary"), "align-hashes")
    groups = -(-parts // FAN)
    grouped = sums.withColumn("part", F.expr(f"part DIV {FAN}").cast("int"))
    copies = model.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a group that has sums only of other buckets has no vector
    copies = copies.join(grouped.select("bucket", "part").distinct(), ["bucket", "part"], "left_semi")
    dense = grouped.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(_dense, "bucket int, part int, counts binary")
    return settle(model.join(_tree(dense, groups, _add, "counts"), "bucket"), "align-counts")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, c) of the buckets' vectors."""
    for b in batches:
        for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(np.frombuffer(k, "<u4").astype(np.int64)), "c": pa.array(np.frombuffer(c, "<i8"))})


def highest(pairs: DataFrame) -> np.ndarray:
    """The highest count of each B id: one value for each of the 65,536 possible ids."""
    rows = fetched(pairs.groupBy(F.expr("cast(pair % 65536 AS int)").alias("b")).agg(F.max("c").alias("c")))
    out = np.zeros(1 << 16, np.int64)
    out[rows["b"].to_numpy()] = rows["c"].to_numpy()
    return out


def _result(batch: pa.RecordBatch, some: Aligned, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """counts: of each link."""
    columns = {"n_a": some.n_a, "n_b": some.n_b, "n_groups": some.n_groups, "n_links": some.n_links}
    columns |= {"n_best": some.sums(best[some.b[some.of_b]] == counts), "count_sum": some.sums(counts)}
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "groups_sha256": pa.array(some.digests(), pa.string())})


def _counts_of(pairs: np.ndarray, tables: dict) -> np.ndarray:
    """Counts of pairs by the buckets' hashes; each different pair is looked up once."""
    keys = np.sort(pairs)
    keys = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]
    out, bucket = np.empty(len(keys), np.int64), bucket_of(keys)
    order = np.argsort(bucket, kind="stable")
    stop = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
    for b in np.flatnonzero(np.diff(stop)).tolist():
        mine = order[stop[b] : stop[b + 1]]
        found, placed, counts = tables[b]
        out[mine] = counts[verified(found, placed, keys[mine])]
    return out[np.searchsorted(keys, pairs)]


def _align_whole(tokens: DataFrame, table: DataFrame, best: np.ndarray, path_a: str, path_b: str) -> DataFrame:
    """The second pass where the table of pairs is small enough to be sent to every executor."""
    sc = tokens.sparkSession.sparkContext
    sent = sc.broadcast(([tuple(r.values()) for r in fetched(table.select("bucket", "hash", "keys", "counts")).to_pylist()], best))
    by_task: dict = {}

    def task(batches):
        rows, best = sent.value
        tables = by_task.get(0) or by_task.setdefault(0, {b: (PerfectHash.loads(h), np.frombuffer(k, "<u4"), np.frombuffer(c, "<i8")) for b, h, k, c in rows})
        by = vocabularies(path_a, path_b)
        for batch in slices(batches):
            some = Aligned(batch, by)
            yield _result(batch, some, _counts_of(some.pairs, tables), best)

    return tokens.mapInArrow(task, SCHEMA)


def _align_by_join(tokens: DataFrame, pairs: DataFrame, best: np.ndarray, path_a: str, path_b: str) -> DataFrame:
    """The second pass for any number of pairs: documents are dealt into chunks, and each gets its own pairs' counts."""
    size = tokens.agg(F.sum(F.octet_length("a"))).first()[0] or 0
    n = size // CHUNK_BYTES + 1
    # equal rows are dealt apart, too
    dealt = tokens.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "a", F.monotonically_increasing_id()), F.lit(n)).cast("int")).repartition(n, "chunk")

    def wanted(batches):
        by = vocabularies(path_a, path_b)
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            chunks = whole.column("chunk").to_numpy()
            for chunk in np.unique(chunks).tolist():
                for batch in slices([whole.filter(pa.array(chunks == chunk))]):
                    held[chunk] = np.union1d(held.get(chunk, np.zeros(0, np.uint32)), Aligned(batch, by).pairs)
        for chunk, k in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(k), chunk, np.int32)), "pair": pa.array(k.astype(np.int64))})

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, counts, by = found["pair"].to_numpy().astype(np.uint32), found["c"].to_numpy(), vocabularies(path_a, path_b)
        hashed = PerfectHash.build(keys)
        placed, dense, at = np.empty_like(keys), np.empty_like(counts), hashed.index(keys)
        placed[at], dense[at] = keys, counts
        out = []
        for batch in slices(docs.select(["doc_id", "a", "b"]).to_batches()):
            some = Aligned(batch, by)
            out.append(_result(batch, some, dense[verified(hashed, placed, some.pairs)], best))
        return pa.Table.from_batches(out)

    found = dealt.mapInArrow(wanted, "chunk int, pair long").join(pairs, "pair").select("chunk", "pair", "c")
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, SCHEMA)


def align(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: tokens, groups, links, and how often the corpus has its links.

    Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros and ''.
    Columns but ``doc_id`` and ``text`` are not read; null and repeated doc_ids are rows like any other.
    """
    tokens = settle(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b), "doc_id long, a binary, b binary"), "align-tokens")
    table = count_pairs(tokens, path_a, path_b)
    pairs = table.select("keys", "counts").mapInArrow(_listed, "pair long, c long")
    best = highest(pairs)
    n = table.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    if n // 4 <= broadcast_pairs:
        return _align_whole(tokens, table, best, path_a, path_b)
    return _align_by_join(tokens, pairs, best, path_a, path_b)
