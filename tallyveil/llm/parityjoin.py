"""N-gram Jaccard join by parity sketches.

Each document's set of word shingles is XOR-hashed: a shingle falls into one of s segments of a sketch and flips bits
there. Two sketches differ in at most as many segments (and, bit by bit, in at most as many bits) as the symmetric
difference of the sets has members, so a segment-wise or bit-wise distance above k rules a pair out.

Size bands: band i holds sets of l(i) to l(i+1)-1 members, l(i+2) > (l(i+1)-1)/t, so two sets of similarity t lie in
the same or in adjacent bands. Joins run once per band, over it and the next; there the symmetric difference is at most
k = (l(i+1)-1)(1-t)/t. With s = k + m segments at least m agree (pigeonhole), so a set may leave out up to m - 1 of
its segments: those without members, then those whose keys most sets have (as a passage shared by many documents makes
them). A set with too many of the former leaves none out. All keys have one order, by the number of their sets and then
by key, and a set leaves out its last ones: so of the m keys that a linked pair has in common, neither leaves out the
first. m - 1 is a quarter of k. Sets of a band with k = 0 must be equal.

Rows (segment key, set) that share a key are candidates. Map tasks merge rows of the same key first, so a key that a
third of all documents share sends one row a task. Inside a key no pairs are listed: every set is verified against the
key's most central set (the one most of whose segments are shared), links are joined to components, and only keys that
still hold more than one component are compared across components, in blocks, with sizes and bit sketches ruling pairs
out before sets are verified exactly. Of keys with the same sets only one is compared, and without its most central set,
whose pairs are known. A pair is compared in the lowest key that the lowest keys of both have; if these have none in
common, in each key that it shares. Equal sets are one node from the start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtext import BYTES_A, LOWER_A, U64, Texts, grams, mix, text_slices
from .components import connected
from .shared import discard, settle

SKETCH_LONGS = 8
SKETCH = [f"x{j}" for j in range(SKETCH_LONGS)]
BROADCAST_ROWS = 100_000
HOT = 1  # keys of no more sets are never left out
FLUSH_ROWS = 500_000
BLOCK = 256
LOWEST = 32
FIRST_MET = "coalesce(array_min(array_intersect(l_low, low)) >= key, true)"
SLICE = 1 << 19


@dataclass(frozen=True)
class Spec:
    """Words in a shingle, similarity in hundredths, and whether A-Z are lower-cased."""

    words: int = 5
    percent: int = 80
    lower: bool = True

    def most_apart(self, size: int) -> int:
        """Largest symmetric difference of a linked pair whose smaller set has `size` members."""
        return size * (100 - self.percent) // self.percent

    def bands(self, most: int) -> list[tuple[int, int, int]]:
        """(first size, k, segments) of each band, up to sets of `most` members."""
        edge = [1, 2]
        while edge[-1] <= most:
            edge.append(max(edge[-1] + 1, (edge[-1] - 1) * 100 // self.percent + 1))
        out = []
        for low, high in zip(edge, edge[1:]):
            k = self.most_apart(high - 1)
            s = k + 1 + k // 4
            out.append((low, k, s))
        return out


def shingle_sets(texts: Texts, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all texts one after another, and where each text's begin."""
    h = texts.word_hashes(LOWER_A if spec.lower else BYTES_A)
    at = texts.windows(spec.words)
    g, doc = grams(h, at, spec.words), texts.word_doc[at]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < spec.words))
    if len(short):
        parts = [grams(h, texts.word_off[i : i + 1], int(texts.n_words[i])) + U64(texts.n_words[i]) for i in short]
        g, doc = np.concatenate([g, *parts]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(texts.n + 1))


def _node_ids(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets have equal names."""
    sums = np.zeros(len(g) + 1, U64)
    np.cumsum(mix(g ^ U64(0x51ED2701)), out=sums[1:])
    return mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(U64)).view(np.int64)


def _segment_rows(g: np.ndarray, off: np.ndarray, node: np.ndarray, bands, lows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, info) rows of the sets, at their own band and the one below.

    info is 4 * (1 + how many more segments the set may leave out in this band, -1 if it leaves none out) + 2 * (band below).
    """
    size = np.diff(off)
    own = np.searchsorted(lows, size, "right") - 1
    doc = np.repeat(np.arange(len(size)), size)
    keys, nodes, infos = [], [], []
    k_of, s_of = np.array([b[1] for b in bands]), np.array([b[2] for b in bands])
    for down in (0, 1):
        band = own - down
        use = (size > 0) & (band >= 0) & (k_of[np.maximum(band, 0)] > 0)
        s = np.where(use, s_of[np.maximum(band, 0)], 0)
        base = np.cumsum(s) - s
        pick = use[doc]
        d, x = doc[pick], g[pick]
        spread = mix(x ^ mix(band[d].astype(U64) + U64(77)))
        seg = ((spread >> U64(32)) * s[d].astype(U64)) >> U64(32)
        slot = base[d] + seg.astype(np.int64)
        total = int(s.sum())
        value, count = np.zeros(total, U64), np.bincount(slot, minlength=total)
        np.bitwise_xor.at(value, slot, mix(spread))
        of = np.repeat(np.arange(len(size)), s)
        low = count < 1
        spare = s - k_of[np.maximum(band, 0)] - 1 - np.bincount(of[low], minlength=len(size))
        keep = ~low | (spare < 0)[of]
        within = np.arange(total) - base[of]
        place = mix((band[of].astype(U64) << U64(32)) + within.astype(U64) + U64(1))
        keys.append(mix(value ^ place)[keep])
        nodes.append(node[of[keep]])
        infos.append((4 * (1 + np.maximum(spare, -1)) + 2 * down).astype(np.int32)[of[keep]])
    return np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(infos)


def _merge(key: np.ndarray, node: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
    """One open row per key; keys met with several nodes also give a settled row (info odd) for each of these."""
    order = np.lexsort((node, key))
    key, node, info = key[order], node[order], info[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= node[1:] != node[:-1]
    key, node, info, new_key = key[new], node[new], info[new], new_key[new]
    first = np.flatnonzero(new_key)
    runs = np.diff(np.append(first, len(key)))
    several = np.repeat(runs > 1, runs)
    columns = (np.concatenate([x[first], y[several]]) for x, y in ((key, key), (node, node), (info, info + 1)))
    return pa.RecordBatch.from_pydict(dict(zip(("key", "node", "info"), columns)))


def _rows_task(spec: Spec):
    def task(batches):
        most, bands, lows, held, n = 0, [], None, [], 0
        for _, texts in text_slices(batches, limit=SLICE):
            g, off = shingle_sets(texts, spec)
            largest = int(np.diff(off).max(initial=0))
            if largest > most:
                most = max(largest, 4096) * 2
                bands = spec.bands(most)
                lows = np.array([b[0] for b in bands])
            if not largest:
                continue
            held.append(_segment_rows(g, off, _node_ids(g, off), bands, lows))
            n += len(held[-1][0])
            if n > FLUSH_ROWS:
                yield _merge(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield _merge(*map(np.concatenate, zip(*held)))

    return task


def _shared_task(batches):
    """Of rows sorted by key: those whose key has several nodes, and those known to be so."""
    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "info")]
        known = rows[2] & 1 == 1
        if known.any():
            yield _rows(*(x[known] for x in rows))
        rows = [x[~known] for x in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1])
        held = [x[last:] for x in rows]
        yield _several(*(x[:last] for x in rows))
    if held is not None:
        yield _several(*held)


def _rows(key, node, info) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": key, "node": node, "down": info >> 1 & 1, "spare": (info >> 2) - 1})


def _several(key, node, info) -> pa.RecordBatch:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(key)))
    differ = np.zeros(len(first), bool)
    if len(first):
        differ = np.maximum.reduceat(node, first) != np.minimum.reduceat(node, first)
    keep = np.repeat(differ, runs)
    return _rows(key[keep], node[keep], info[keep])


def _without_hot(shared: DataFrame) -> DataFrame:
    """(key, node) rows but for the keys of most sets, as many as their set may leave out, in one order of all keys."""
    counts = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    place = F.row_number().over(W.partitionBy("node", "down").orderBy(F.desc_nulls_last("n"), "key"))
    marked = shared.join(counts, "key", "left").withColumn("_n", place)
    return marked.where("n IS NULL OR _n > spare").select("key", "node")


def _sketches(texts: Texts, g: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Columns x0, x1, ... of each set's parity bits."""
    bits = np.zeros((texts.n, 64 * SKETCH_LONGS), np.uint8)
    place = (mix(g + U64(5)) % U64(64 * SKETCH_LONGS)).astype(np.int64)
    np.bitwise_xor.at(bits.reshape(-1), np.repeat(np.arange(texts.n), np.diff(off)) * 64 * SKETCH_LONGS + place, 1)
    longs = np.packbits(bits, axis=1).view(np.int64)
    return {x: np.ascontiguousarray(longs[:, j]) for j, x in enumerate(SKETCH)}


def _wide(g: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Each set's parity bits in a sketch of the least power of two (64 at least) that is no less than its size."""
    place, out = mix(g + U64(9)), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        bits = 1 << max(6, (b - a - 1).bit_length())
        odd = np.bincount((place[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def _near(pairs: DataFrame, first: DataFrame, spec: Spec) -> DataFrame:
    """The pairs whose wide sketches allow the similarity. The longer sketch is folded onto the shorter one's length."""

    def task(batches):
        for batch in batches:
            keep = []
            sizes = np.minimum(batch.column("sa").to_numpy(zero_copy_only=False), batch.column("sb").to_numpy(zero_copy_only=False)).tolist()
            for x, y, size in zip(batch.column("wa"), batch.column("wb"), sizes):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep.append(spec.percent * int(np.bitwise_count(x ^ y).sum()) <= (100 - spec.percent) * size)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    side = lambda c: first.select(F.col("node").alias(c), F.col("wide").alias(f"w{c}"), F.col("size").alias(f"s{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(task, "a long, b long")


def _sets_task(spec: Spec):
    def task(batches):
        for batch, texts in text_slices(batches, limit=SLICE):
            g, off = shingle_sets(texts, spec)
            raw = g.tobytes()
            members = [raw[a * 8 : b * 8] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            node, wanted = _node_ids(g, off), batch.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"node": node, "members": pa.array(members, pa.binary())}).filter(pa.array(node == wanted))

    return task


def _sets(docs: DataFrame, pairs: DataFrame, first: DataFrame, spec: Spec) -> DataFrame:
    """(node, members) of the nodes in pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = settle(nodes.join(first, "node").select("node", F.col("least").alias("doc_id")), "pj-wanted")
    if wanted.count() <= BROADCAST_ROWS:  # else both sides are dealt by doc_id
        wanted = F.broadcast(wanted)
    return settle(docs.join(wanted, "doc_id").mapInArrow(_sets_task(spec), "node long, members binary").dropDuplicates(["node"]), "pj-sets")


def _possible(spec: Spec, one: str, two: str) -> str:
    """SQL: sizes and bit sketches (with prefixes one and two) allow the similarity."""
    apart = " + ".join(f"bit_count({one}{x} ^ {two}{x})" for x in SKETCH)
    less = f"least({one}size, {two}size)"
    return f"{spec.percent} * greatest({one}size, {two}size) <= 100 * {less} AND {spec.percent} * ({apart}) <= {100 - spec.percent} * {less}"


def _verify(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= spec.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"m{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(task, "a long, b long")


def _linked(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, n_shingles, node) of docs(doc_id, text), and (node, root) of the nodes with shingles."""

    def name_task(batches):
        for batch, texts in text_slices(batches, limit=SLICE):
            g, off = shingle_sets(texts, spec)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_shingles": np.diff(off).astype(np.int64), "node": _node_ids(g, off), "wide": pa.array(_wide(g, off), pa.binary()), **_sketches(texts, g, off)})

    digested = docs.withColumn("digest", F.xxhash64("text"))
    named = settle(digested.mapInArrow(name_task, "doc_id long, digest long, n_shingles long, node long, wide binary, " + ", ".join(f"{x} long" for x in SKETCH)), "pj-named")
    first = named.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size"), F.max("wide").alias("wide"), *[F.max(x).alias(x) for x in SKETCH])
    first = settle(first, "pj-first")

    rows = docs.mapInArrow(_rows_task(spec), "key long, node long, info int")
    dealt = rows.repartition(F.when(F.expr("info % 2 = 1"), F.xxhash64("key", "node")).otherwise(F.col("key"))).sortWithinPartitions("key", "node")
    several = settle(dealt.mapInArrow(_shared_task, "key long, node long, down int, spare int").groupBy("key", "node").agg(F.max("down").alias("down"), F.max("spare").alias("spare")), "pj-several")
    shared = settle(_without_hot(several), "pj-shared")

    central = shared.groupBy("node").agg(F.count("*").alias("c"))
    hubs = settle(shared.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node")).alias("top")).select("key", F.col("top.node").alias("hub")), "pj-hubs")
    pairs = settle(shared.join(hubs, "key").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pj-pairs")
    side = lambda c: first.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("size", *SKETCH)])
    pairs = settle(pairs.join(side("a"), "a").join(side("b"), "b").where(_possible(spec, "a_", "b_")).select("a", "b"), "pj-possible")
    pairs = settle(_near(pairs, first, spec), "pj-near")
    links = settle(_verify(pairs, _sets(docs, pairs, first, spec), spec), "pj-links")
    comp = settle(connected(links), "pj-comp")

    rooted = settle(shared.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "pj-rooted")
    held = rooted.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    held = held.where("lo != hi AND n > 2").groupBy("members", "n", "lo", "hi").agg(F.min("key").alias("key"))
    open_keys = settle(held.join(hubs, "key").select("key", "hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "pj-open")
    rest = rooted.join(open_keys, "key").where("node != hub").drop("hub")
    lowest = rest.groupBy("node").agg(F.expr(f"slice(array_sort(collect_list(key)), 1, {LOWEST})").alias("low"))
    rest = settle(rest.join(lowest, "node").join(first.select("node", "size", *SKETCH), "node"), "pj-rest")
    left = rest.select("key", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), *[F.col(c).alias(f"l_{c}") for c in ("node", "root", "low", "size", *SKETCH)])
    right = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    more = left.join(right, ["key", "block"]).where(f"l_root < root AND {_possible(spec, 'l_', '')} AND {FIRST_MET}").select(F.col("l_node").alias("a"), F.col("node").alias("b")).distinct()
    more = settle(more, "pj-possible")
    more = settle(_near(more, first, spec), "pj-near")
    if not more.isEmpty():
        more = settle(_verify(more, _sets(docs, more, first, spec), spec), "pj-links")
        comp = settle(connected(links.unionByName(more)), "pj-comp")

    of_node = settle(first.join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "pj-of")
    discard(rest, rooted, several, shared, hubs, pairs)
    return named, of_node


def link_documents(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    component_id is the smallest doc_id reachable by links. Null and wordless texts have no shingles and only
    themselves; rows with equal sets are one node, whatever their doc_ids; a null doc_id is never the smallest.
    """
    named, of_node = _linked(docs.select("doc_id", "text"), spec)
    smallest = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = settle(of_node.join(smallest, "root").select("node", "component_id"), "pj-of")
    return named.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row of each group of linked rows: the one of smallest doc_id (null last), then least digest of its text.

    Rows are told apart by doc_id and the text's digest, so that rows sharing a doc_id are judged each by itself; of
    rows alike in both, one stays. Rows without shingles all stay.
    """
    named, of_node = _linked(docs.select("doc_id", "text"), spec)
    rows = settle(named.where("n_shingles > 0").join(of_node, "node").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")), "pj-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    judged = settle(rows.join(best, "root").select("doc_id", "digest", (order != F.col("best")).alias("gone"), "n"), "pj-judged")
    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"]) & (F.xxhash64(docs["text"]) == other["digest"])
    gone, twice = judged.where("gone"), judged.where("NOT gone AND n > 1")
    kept = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept
    once = docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same(twice), "left_anti").unionByName(once)
