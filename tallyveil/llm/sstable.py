"""Sorted-string-table shards of token ids, written and read by Spark on any file system it knows.

A shard is a file of segments, each followed by one byte 0x0A (Spark's text writer ends a value so; its commit protocol
makes a retried or speculative task leave one file):

* data blocks: zstd-compressed entries (shared key prefix, rest of key, value) in ascending key order; lengths are
  LEB128 varints, and the first key of a block is whole. A key is the 8-byte big-endian doc_id with its sign bit
  flipped, so that bytes sort as numbers; a null doc_id has the empty key and sorts first.
* the sparse index: for each block its first key, offset, length, entries and ids before it in the shard;
* a Bloom filter of the keys, 10 bits and 7 probes each;
* the footer: places of index and filter, number of documents and ids, width of an id, least and greatest key, magic.

Shards hold disjoint ascending ranges of doc_id, and the writer names files in that order. A lookup is a binary search
over shards, of which it reads footers, then over the index of one shard, then a read of the blocks that may hold the
key (one, unless rows repeat); all reads are of byte ranges.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh_path, settle, write_once
from .arrowtext import Raw, text_slices
from .tokens import encoded_rows, library_encoder

MAGIC = b"TVSST1\0\0"
FOOTER = struct.Struct("<QQQQQQQ9s9s8s")
ENTRY = struct.Struct("<8sBQIIQ")
BLOCK_BYTES = 1 << 16
PROBES = 7
LEAST_SHARD, MOST_SHARD, SHARDS = 32 << 20, 256 << 20, 100_000  # bytes of text in a shard, and how many there should be


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1


def _probes(first, second, bits: int):
    """Places of a key's bits, from its two hashes (integers or arrays of them)."""
    return [((first + i * second + i * i) & 0xFFFFFFFF) % bits for i in range(PROBES)]


def _packed(key: bytes) -> bytes:
    """A key of 0 or 8 bytes in a field of 9."""
    return bytes([len(key)]) + key.ljust(8, b"\0")


class ShardWriter:
    """Takes entries in key order, gives out segments as they fill."""

    def __init__(self, width: int = 2):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.width, self.offset, self.docs, self.ids = width, 0, 0, 0
        self.block, self.first, self.last, self.entries, self.ids_before = bytearray(), b"", b"", 0, 0
        self.index, self.hashes, self.least = bytearray(), (array("I"), array("I")), b""

    def add(self, key: bytes, value: bytes) -> bytes | None:
        if not self.entries:
            self.first, self.last, self.ids_before = key, b"", self.ids
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        self.block += _varint(same) + _varint(len(key) - same) + key[same:] + _varint(len(value)) + value
        self.least = self.least if self.docs else key
        self.last, self.entries, self.docs = key, self.entries + 1, self.docs + 1
        self.ids += len(value) // self.width
        for held, h in zip(self.hashes, _hashes(key)):
            held.append(h)
        return self._cut() if len(self.block) >= BLOCK_BYTES else None

    def _cut(self) -> bytes:
        data = self.compress(bytes(self.block))
        self.index += ENTRY.pack(self.first, len(self.first), self.offset, len(data), self.entries, self.ids_before)
        self.offset += len(data) + 1
        self.block, self.entries = bytearray(), 0
        return data

    def finish(self):
        if self.entries:
            yield self._cut()
        bits = max(64, 10 * self.docs)
        bloom = np.zeros(bits, bool)
        for places in _probes(*(np.array(h, np.int64) for h in self.hashes), bits):
            bloom[places] = True
        packed = np.packbits(bloom).tobytes()
        yield bytes(self.index)
        yield packed
        at = self.offset
        yield FOOTER.pack(at, len(self.index), at + len(self.index) + 1, bits, self.docs, self.ids, self.width, _packed(self.least), _packed(self.last), MAGIC)


class Shard:
    """A shard behind a function that reads a range of its bytes; footer, index and filter are read when first asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail = read(size - 1 - FOOTER.size, FOOTER.size)
        if tail[-8:] != MAGIC:
            raise ValueError("not a whole shard")
        self._at, self._size, self._bloom, self.bits, self.docs, self.ids, self.width, least, greatest, _ = FOOTER.unpack(tail)
        self.least, self.greatest = least[1 : 1 + least[0]], greatest[1 : 1 + greatest[0]]

    @cached_property
    def index(self) -> list[tuple]:
        return list(ENTRY.iter_unpack(self.read(self._at, self._size)))

    @cached_property
    def first_keys(self) -> list[bytes]:
        return [k[:n] for k, n, *_ in self.index]

    @cached_property
    def bloom(self) -> bytes:
        return self.read(self._bloom, (self.bits + 7) // 8)

    def entries(self, block: int):
        import zstandard

        _, _, offset, size, n, _ = self.index[block]
        raw = zstandard.ZstdDecompressor().decompress(self.read(offset, size))
        at, key = 0, b""
        for _ in range(n):
            same, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            key = key[:same] + raw[at : at + more]
            size, at = _read_varint(raw, at + more)
            yield key, raw[at : at + size]
            at += size

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & 128 >> (p & 7) for p in _probes(*_hashes(key), self.bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document by filter, binary search over the index, and one block; the first of repeated rows."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        block = max(0, bisect_left(self.first_keys, key) - 1)
        for b in range(block, bisect_right(self.first_keys, key)):
            for k, value in self.entries(b):
                if k == key:
                    return np.frombuffer(value, f"<u{self.width}")
        return None


def shard_count(docs: DataFrame) -> int:
    """Shards of at least LEAST_SHARD bytes of text, larger ones (to MOST_SHARD) where there would be over SHARDS of them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + size // min(MOST_SHARD, max(LEAST_SHARD, size // SHARDS))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encode every text (null: empty), append end_id, and write shards in ascending doc_id order under path."""

    def task(batches):
        encoder, writer = library_encoder(tokenizer), ShardWriter()
        for batch, texts in text_slices(batches, form=Raw):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded_rows(*encoder.encode(texts), end_id)):
                segment = writer.add(key_of(doc_id), ids)
                if segment is not None:
                    out.append(segment)
            if out:
                yield pa.RecordBatch.from_pydict({"segment": pa.array(out, pa.binary())})
        if writer.docs:
            yield pa.RecordBatch.from_pydict({"segment": pa.array(list(writer.finish()), pa.binary())})

    docs = docs.select("doc_id", "text")
    ranged = docs.repartitionByRange(shard_count(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    segments = ranged.mapInArrow(task, "segment binary")
    write_once(segments.select(F.col("segment").cast("string").alias("value")), path, "text", lineSep="\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def _blocks(batch: pa.RecordBatch):
    """(shard, number of a block, its doc_ids, its values, ids before it) of whole shards."""
    for content in batch.column("content"):
        data = content.as_buffer()
        shard = Shard(lambda at, n, data=data: data[at : at + n].to_pybytes(), len(data))
        for b in range(len(shard.index)):
            keys, values = zip(*shard.entries(b))
            yield shard, b, list(map(id_of, keys)), values, shard.index[b][5]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every entry."""

    def task(batches):
        for batch in batches:
            for _, _, doc_ids, values, _ in _blocks(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(values, pa.binary())})

    return _files(spark, path).mapInArrow(task, "doc_id long, ids binary")


class Table:
    """Lookups of single documents under path, on any file system that Spark knows. For many ids, join read_shards."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, folder = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files = [f for f in self.fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()]
        self.files = sorted(files, key=lambda f: f.getPath().getName())
        self.shards: dict[int, Shard] = {}
        self.reads: list[int] = []  # bytes of each range read

    def _read(self, file, at: int, n: int) -> bytes:
        self.reads.append(n)
        stream = self.fs.open(file.getPath())
        try:
            stream.seek(at)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def _shard(self, i: int) -> Shard:
        if i not in self.shards:
            self.shards[i] = Shard(partial(self._read, self.files[i]), self.files[i].getLen())
        return self.shards[i]

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document, None if it isn't there; the first of repeated rows."""
        key = key_of(doc_id)
        i = bisect_left(range(len(self.files)), key, key=lambda i: self._shard(i).greatest)
        return self._shard(i).get(doc_id) if i < len(self.files) and self._shard(i).least <= key else None


def digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as shards, read the files back: (doc_id, start, n_tokens, ids_crc32), one row per input row.

    Null text counts as empty; rows with a null doc_id come first. start sums over shards by their least keys, a table
    of one small row a shard.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "sst")
    write_shards(docs, tokenizer, end_id, path)

    def summarise(batches):
        for batch in batches:
            for shard, b, doc_ids, values, before in _blocks(batch):
                ids = [np.frombuffer(x, f"<u{shard.width}") for x in values]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.least] * len(ids), pa.binary()), "doc_id": pa.array(doc_ids, pa.int64()), "start": before + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    rows = settle(_files(spark, path).mapInArrow(summarise, "shard binary, doc_id long, start long, n_tokens long, ids_crc32 long"), "sst-rows")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
