"""Substring deduplication by level-wise doubling of repeated word windows.

Words covered by a window of 20 words that also starts earlier (in a smaller doc_id, or before in the same document)
are removed. Windows repeated at one length alone are looked at at twice that length:

* 5 words: of the sixteen 5-word windows inside a 20-word window, those of least hash are its anchors, so equal
  20-word windows have equal anchors and an eighth of all places suffices. Anchors met once end here.
* 10 words: a 20-word window around an anchor holds the ten words up to the anchor's end, or the ten from its start on.
  Anchors of which neither window of ten is repeated end here.
* 20 words: every window around a surviving anchor; all but the first of equal ones (128 hash bits) are removed.

Map tasks merge rows of equal windows before each shuffle, so a passage that a third of all documents share sends one
row a task, and no window's places are ever gathered.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BYTES_B, U64, Texts, grams, mix, text_slices
from .shared import discard, settle

LENGTH, SHORT = 20, 5
SPAN = LENGTH - SHORT + 1
FLUSH_ROWS = 1_000_000
MOST = U64((1 << 64) - 1)


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n] for each i that has n values."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _least(texts: Texts, hashes: np.ndarray):
    """Hash of the 5-word window at each word (MOST: none), valid 20-word starts, and each one's least 5-word hash."""
    x = np.full(len(hashes), MOST, U64)
    at = texts.windows(SHORT)
    x[at] = np.minimum(grams(hashes, at, SHORT), MOST - U64(1))
    starts = texts.windows(LENGTH)
    return x, starts, sliding(x, SPAN, np.minimum)[starts] if len(starts) else x[:0]


def anchors(texts: Texts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of all anchors, and their hashes."""
    x, starts, least = _least(texts, hashes)
    over = np.zeros(len(x) + SPAN - 1, U64)
    over[starts + SPAN - 1] = least
    at = np.flatnonzero((sliding(over, SPAN, np.maximum) == x) & (x < MOST)) if len(x) else starts
    return at, x[at]


def _anchor_task(batches):
    for batch, texts in text_slices(batches):
        h = texts.word_hashes()
        at, key = anchors(texts, h)
        if not len(at):
            continue
        doc = texts.word_doc[at]
        lo, hi = texts.word_off[:-1][doc], texts.word_off[1:][doc]
        before, after = at + SHORT - 2 * SHORT, at + 2 * SHORT
        left, right = np.zeros(len(at), U64), np.zeros(len(at), U64)
        ok = before >= lo
        left[ok] = grams(h, before[ok], 2 * SHORT)
        ok = after <= hi
        right[ok] = grams(h, at[ok], 2 * SHORT)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
        pos = at - lo
        yield _batch(key=key.view(np.int64), ident=mix(mix(ids.astype(U64)) + pos.astype(U64)).view(np.int64), doc_id=ids.astype(np.int64), pos=pos.astype(np.int32), before=left.view(np.int64), after=right.view(np.int64))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _local_merge(batches):
    """Marks rows whose key has several idents in this task as known; of those, only the least and the greatest ident's also stay open,
    so that a task that has met one ident alone learns of another."""

    def merge(held):
        t = pa.Table.from_batches(held).combine_chunks()
        key, ident = t["key"].to_numpy(), t["ident"].to_numpy()
        order = np.lexsort((ident, key))
        key, ident = key[order], ident[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        runs = np.diff(np.append(first, len(key)))
        least = np.repeat(ident[first], runs)
        greatest = np.repeat(ident[first + runs - 1], runs)
        several = least != greatest
        open_ = (ident == least) | (ident == greatest)
        pick = np.concatenate([order[open_], order[several]])
        return t.take(pa.array(pick)).append_column("known", pa.array(np.arange(len(pick)) >= open_.sum())).to_batches()

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n > FLUSH_ROWS:
            yield from merge(held)
            held, n = [], 0
    if held:
        yield from merge(held)


def _global_merge(payload: list[str]):
    def several(t):
        key, ident = t["key"].to_numpy(), t["ident"].to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        runs = np.diff(np.append(first, len(key)))
        keep = np.repeat(np.maximum.reduceat(ident, first) != np.minimum.reduceat(ident, first), runs)
        return t.filter(pa.array(keep)).select(payload).combine_chunks().to_batches()

    def task(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            known = b.column("known").to_numpy(zero_copy_only=False)
            if known.any():
                yield from t.filter(pa.array(known)).select(payload).to_batches()
            t = t.filter(pa.array(~known))
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from several(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from several(held)

    return task


def keep_repeated(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Payload of the rows (key, ident, ...) whose key occurs with several idents; a row may come twice."""
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    merged = rows.mapInArrow(_local_merge, fields + ", known boolean")
    dealt = merged.repartition(F.when(F.col("known"), F.xxhash64("key", "ident")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return dealt.mapInArrow(_global_merge(payload), ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in payload))


def _window_task(batches):
    """Rows of 20-word windows around anchors: known removals as runs of starts, and one open row per window and task."""
    held, n = [], 0

    def merge():
        h1, h2, ids, pos = map(np.concatenate, zip(*held))
        order = np.lexsort((pos, ids, h2, h1))
        h1, h2, ids, pos = h1[order], h2[order], ids[order], pos[order]
        first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.zeros(0, bool)
        o = np.flatnonzero(first)
        yield _batch(h1=h1[o].view(np.int64), h2=h2[o].view(np.int64), doc_id=ids[o], pos=pos[o], upto=pos[o] + np.int32(1), known=pa.array(np.zeros(len(o), bool)))
        gone = np.flatnonzero(~first)
        if len(gone):
            gone = gone[np.lexsort((pos[gone], ids[gone]))]
            d, p = ids[gone], pos[gone]
            new = np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(d)) - 1
            z = np.zeros(len(begin), np.int64)
            yield _batch(h1=z, h2=z, doc_id=d[begin], pos=p[begin], upto=p[end] + np.int32(1), known=pa.array(np.ones(len(begin), bool)))

    for batch, texts in text_slices(batches):
        h = texts.word_hashes()
        x, starts, least = _least(texts, h)
        if not len(starts):
            continue
        lists = batch.column("at")
        count = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(texts.word_off[:-1], count)
        alive = np.full(len(x), MOST, U64)
        at = at[at < len(x)]
        alive[at] = x[at]
        starts = starts[sliding(alive, SPAN, np.minimum)[starts] == least]
        doc = texts.word_doc[starts]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        held.append((grams(h, starts, LENGTH), grams(texts.word_hashes(BYTES_B), starts, LENGTH), ids, (starts - texts.word_off[:-1][doc]).astype(np.int32)))
        n += len(starts)
        if n > FLUSH_ROWS:
            yield from merge()
            held, n = [], 0
    if n:
        yield from merge()


def _later_task(batches):
    """Of rows sorted by window and place: all but the first of each window, and the known ones."""
    last = None
    for b in batches:
        h1, h2, known = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "known"))
        o = np.flatnonzero(~known)
        later = np.zeros(len(o), bool)
        if len(o):
            a, c = h1[o], h2[o]
            later[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            later[0] = last == (a[0], c[0])
            last = a[-1], c[-1]
        keep = known.copy()
        keep[o[later]] = True
        yield b.filter(pa.array(keep)).select(["doc_id", "pos", "upto"])


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, runs of (pos, upto)): starts of the windows of each document that also start earlier."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    found = docs.mapInArrow(_anchor_task, "key long, ident long, doc_id long, pos int, before long, after long")
    five = settle(keep_repeated(found, ["doc_id", "pos", "before", "after"]), "ss-five")
    pair = "inline(array(named_struct('key', before, 'start', pos - 5), named_struct('key', after, 'start', pos)))"
    wide = five.selectExpr("doc_id", "pos", pair).where("key != 0").selectExpr("key", "xxhash64(doc_id, start) AS ident", "doc_id", "pos")
    ten = keep_repeated(wide, ["doc_id", "pos"])
    at = settle(ten.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "ss-ten")
    rows = docs.join(at, "doc_id").mapInArrow(_window_task, "h1 long, h2 long, doc_id long, pos int, upto int, known boolean")
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("doc_id", "pos")).otherwise(F.col("h1"))).sortWithinPartitions("h1", "h2", "doc_id", "pos")
    later = dealt.mapInArrow(_later_task, "doc_id long, pos int, upto int")
    runs = settle(later.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "upto")).alias("runs")), "ss-runs")
    discard(five, at)
    return runs


def _covered(runs, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(runs.field("pos").to_numpy(), n), 1)  # a shorter row of the same doc_id may end before
    np.add.at(step, np.minimum(runs.field("upto").to_numpy() + LENGTH - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row; kept words are joined by one space.

    Null text: no words. Rows with a null doc_id lose nothing and precede nothing. Rows that share a doc_id are taken
    as one place: what is removed at a position of one of them is removed at that position of all that reach it.
    """

    def task(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n.append(len(words))
                if runs.is_valid and words:
                    covered = _covered(runs.values, len(words))
                    gone.append(int(covered.sum()))
                    words = compress(words, (~covered).tolist())
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    runs = removed_windows(docs)
    return docs.select("doc_id", "text").join(runs, "doc_id", "left").mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
