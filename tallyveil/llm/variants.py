"""Spelling variants: words one edit apart, found by Gram matrices of letter-count blocks.

One inserted, deleted or replaced letter changes the counts of at most two letters, so the squared distance of two
near words' letter counts is at most two. Blocks that can hold such pairs share the counts of all but two of S letter
sets: an edit touches two sets at most, so some choice of S - 2 sets has the same counts in both words. Every word goes
to the S (S - 1) / 2 blocks of its choices; within a block, words are ordered by length, and numpy multiplies the
letter-count matrices of each length with itself and the next one. Pairs at a distance of at most two are checked letter
by letter, and kept in the first block that has both. S grows with the vocabulary; a block of more than ``BLOCK`` words
is dealt into pairs of tiles, so that no task gets more than two tiles.

Words are runs of ASCII letters and U+00C0 to U+00FF, of which only A to Z are lower-cased.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, U64, BYTES_A, Raw, Rolling, mix, text_slices
from .shared import discard, fetched, settle

LEAST = 7  # code points of a word
LETTERS = 26 + 64
BLOCK = 8192  # words of a block that one task takes whole
TILE = 2048  # rows of one product
TILE_CELLS = 1 << 24
FLUSH_WORDS = 300_000
RATIO = 10  # a form is so many times as frequent as the word

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def runs(texts: Raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and code points of the maximal runs of letters; U+00C0 to U+00FF are 0xC3 and one byte more."""
    d = texts.data
    lead = d == 0xC3
    inside = _LETTER[d]
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(d) + 1, bool)
    edge[texts.off] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (leads[end] - leads[start])


def slip(run: bytes, doc: bytes) -> bytes:
    """The run, or one code point less if its checksum with the document says so."""
    h = zlib.crc32(run, zlib.crc32(doc))
    if h % 31:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def flush():
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch, texts in text_slices(batches, form=Raw):
        docs = [b"%d:" % i if i is not None else b":" for i in batch.column("doc_id").to_pylist()]
        start, end, size = runs(texts)
        long = size >= LEAST
        start, end = start[long], end[long]
        low = Raw(LOWER[texts.data], texts.off)
        doc = np.searchsorted(texts.off, start, "right") - 1
        key = mix(Rolling(BYTES_A[low.data]).spans(start, end) + mix(doc.astype(U64) + U64(1)))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        raw = low.data.tobytes()
        for a, b, i, n in zip(start[first].tolist(), end[first].tolist(), doc[first].tolist(), count.tolist()):
            word = slip(raw[a:b], docs[i])
            held[word] = held.get(word, 0) + n
        if len(held) > FLUSH_WORDS:
            yield flush()
    yield flush()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of at least LEAST code points that occur twice or more."""
    rows = docs.select("doc_id", "text").mapInArrow(_count_task, "word string, n long")
    return rows.where(F.length("word") >= LEAST).groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


class Spelled:
    """Words as letter numbers from 1 on, one word after another."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        cp = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.letters = np.where(cp < 128, cp - 96, cp - 0xC0 + 27).astype(np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, self.n)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.repeat(np.arange(self.n), self.size)

    def counts(self, rows: np.ndarray | None = None, dtype=np.float32) -> np.ndarray:
        """Letter counts of the given rows (ascending), or of all."""
        if rows is None:
            flat = np.bincount(self.row * LETTERS + self.letters - 1, minlength=self.n * LETTERS)
            return flat.reshape(self.n, LETTERS).astype(dtype)
        flat, n = self.of(rows)
        return np.bincount(np.repeat(np.arange(len(rows)), n) * LETTERS + flat - 1, minlength=len(rows) * LETTERS).reshape(-1, LETTERS).astype(dtype)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[rows]
        at = np.cumsum(n) - n
        return self.letters[np.repeat(self.off[rows] - at, n) + np.arange(n.sum())], n

    def square(self, rows: np.ndarray) -> np.ndarray:
        """Letters of rows of one length."""
        return self.of(rows)[0].reshape(len(rows), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a are one edit from the rows of b; b's are as long, or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], 1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= a.shape[1]


def near_pairs(spelled: Spelled, left: np.ndarray, right: np.ndarray, longer: tuple[int, ...] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) one edit apart, i of left and j of right, j's word as many letters longer as `longer` says.

    Both are ascending, and either the same rows or none in common.
    """
    shared = left is right
    exact = np.float32 if spelled.size.max(initial=0) < 1000 else np.float64  # squares stay whole numbers
    by_size = [{n: rows[spelled.size[rows] == n] for n in np.unique(spelled.size[rows]).tolist()} for rows in (left, right)]
    for n, rows in by_size[0].items():
        step = int(max(1, min(TILE, TILE_CELLS // (n + 1))))
        for more in longer:
            others = by_size[1].get(n + more)
            if others is None:
                continue
            for i in range(0, len(rows), step):
                a = rows[i : i + step]
                u = spelled.counts(a, exact)
                for j in range(i if shared and not more else 0, len(others), step):
                    b = others[j : j + step]
                    v = spelled.counts(b, exact)
                    distance = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T)
                    x, y = np.nonzero(distance <= 2)
                    x, y = a[x], b[y]
                    for k in range(0, len(x), max(1, TILE_CELLS // (n + 1))):
                        p, q = x[k : k + max(1, TILE_CELLS // (n + 1))], y[k : k + max(1, TILE_CELLS // (n + 1))]
                        ok = one_edit(spelled.square(p), spelled.square(q))
                        yield p[ok], q[ok]


def letter_sets(weights: np.ndarray, s: int) -> np.ndarray:
    """A set for each letter, of about equal weight: the heaviest letters first, each to the lightest set."""
    load, out = np.zeros(s), np.zeros(LETTERS, np.int64)
    for letter in np.argsort(-weights, kind="stable").tolist():
        out[letter] = load.argmin()
        load[out[letter]] += weights[letter] + 1e-9
    return out


def sets_for(n_words: int) -> int:
    """Three sets, and one more for each hundredfold vocabulary above 100,000 words."""
    return 3 + (n_words > 100_000) + (n_words > 10_000_000) + (n_words > 1_000_000_000)


def _weights_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS, np.int64)
    for b in batches:
        total += np.bincount(Spelled(b.column("word").to_pylist()).letters - 1, minlength=LETTERS).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"letter": pa.array(np.arange(LETTERS, dtype=np.int32)), "n": pa.array(total)})


def _choices(sets: np.ndarray) -> list[np.ndarray]:
    """For each choice of all but two sets, which letters it holds."""
    s = int(sets.max()) + 1
    return [~np.isin(sets, left_out) for left_out in combinations(range(s), 2)]


def _keys_task(sets: np.ndarray) -> Callable:
    table = np.random.Generator(np.random.PCG64(17)).integers(1, 1 << 63, LETTERS, dtype=U64)
    masks = _choices(sets)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                part = b.slice(i, 10_000)
                counts = Spelled(part.column("word").to_pylist()).counts(dtype=np.int64).astype(U64)
                for c, mask in enumerate(masks):
                    key = mix((counts * (table * mask)).sum(1, dtype=U64) + U64(c))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), c, np.int32)), part.column("word"), part.column("n")], ["key", "choice", "word", "n"])

    return task


def _near_task(sets: np.ndarray) -> Callable:
    masks = np.stack(_choices(sets), 1).astype(np.int64)

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        words, n, tile = block["word"].to_pylist(), block["n"].to_numpy(), block["tile"].to_numpy()
        choice, low, high = block["choice"][0].as_py(), key[1].as_py(), key[2].as_py()
        spelled = Spelled(words)
        one = np.flatnonzero(tile == low)
        if low == high:
            found = list(near_pairs(spelled, one, one))
        else:
            two = np.flatnonzero(tile == high)
            found = [*near_pairs(spelled, one, two), *near_pairs(spelled, two, one, (1,))]
        x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        # a product of a tile with itself has its pairs of one length both ways; in all, both ways once
        pair = np.unique(np.concatenate([x * len(words) + y, y * len(words) + x]))
        x, y = pair // max(1, len(words)), pair % max(1, len(words))
        keep = np.zeros(len(x), bool)
        for i in range(0, len(x), 100_000):
            part = slice(i, i + 100_000)
            differs = _apart(spelled, x[part], y[part])
            keep[part] = ((differs @ masks) == 0).argmax(1) == choice  # the first block that holds both words
        x, y = x[keep], y[keep]
        # one row a word: its near words and the best of them
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        best = np.lexsort((rank[y], -n[y], x))
        x, y = x[best], y[best]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        count = np.diff(np.append(first, len(x)))
        at, of = x[first], y[first]
        form = n[of] >= RATIO * n[at]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([words[i] for i in at.tolist()], pa.string()), "n_near": pa.array(count, pa.int64()),
            "less": pa.array(-n[of], pa.int64(), mask=~form), "form": pa.array([words[i] if ok else None for i, ok in zip(of.tolist(), form.tolist())], pa.string()),
        })

    return task


def _apart(spelled: Spelled, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Absolute differences of letter counts."""
    rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    counts = spelled.counts(rows, np.int64)
    return np.abs(counts[at[: len(x)]] - counts[at[len(x) :]])


def near_words(words: DataFrame, sets: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(word, n_near, less, form): words with near ones, how many, and the most frequent if it is RATIO times as frequent.

    less: its count with the sign changed.
    """
    keyed = settle(words.select("word", "n").mapInArrow(_keys_task(sets), "key long, choice int, word string, n long"), "spelling-keys")
    sizes = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / (block // 2)).cast("int").alias("tiles"))
    dealt = keyed.join(sizes, "key", "left").selectExpr("key", "choice", "word", "n", "coalesce(tiles, 1) AS tiles").withColumn("tile", F.expr("cast(pmod(xxhash64(word), tiles) AS int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.expr("tiles - 1")))).selectExpr("key", "choice", "word", "n", "tile", "least(tile, other) AS low", "greatest(tile, other) AS high")
    found = dealt.groupBy("key", "low", "high").applyInArrow(_near_task(sets), "word string, n_near long, less long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form"))).alias("best")).select("word", "n_near", "best.less", "best.form")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling. Chains end: a form is more frequent."""
    links = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = settle(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(links)
        links = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return links


def group_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per word of at least LEAST code points and two occurrences: its near words, form and root.

    Null and empty texts have no words; a null doc_id counts as an empty one. Equal rows count as often as they come.
    Other columns are not read.
    """
    words = settle(count_words(docs), "spelling-words")
    weights = fetched(words.mapInArrow(_weights_task, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy("letter"))
    weights = weights["n"].to_numpy() if weights.num_rows else np.zeros(LETTERS)
    near = settle(near_words(words, letter_sets(weights, sets_for(words.count())), block), "spelling-near")
    roots = last_forms(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.selectExpr("word", "form", "coalesce(root, word) AS root", "n", "coalesce(n_near, 0L) AS n_near", "-less AS form_n")
