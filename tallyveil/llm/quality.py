"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics are vectorised over Arrow batches; trees are grown by numpy on a bounded sample of labelled rows
(``sample`` rows, chosen by a hash of doc_id), flattened into arrays and traversed for a whole batch at once. Rows
whose crc32(doc_id as text) is divisible by 5 are held out of training. Labels, language, source and doc_id are no
inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import SYMBOL, Texts, text_slices
from .perplexity import base_counts
from .shared import fetched

SLICE = 1 << 19
FEATURES = ("log_bytes", "log_words", "word_bytes", "white", "upper", "digit", "punct", "symbol", "bang", "high", "lines", "dup_lines", "repeat3", "repeat1", "short_words", "long_words", "capital_words", "stop_words", "pipes", "upper_words")


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


UPPER, DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
PUNCT, BANG, PIPE, STOP = _flags(b".,;:!?\"'()-"), _flags(b"!"), _flags(b"|"), _flags(b".!?")
HIGH = _flags(bytes(range(128, 256)))


def statistics(texts: Texts) -> np.ndarray:
    """One row of FEATURES per text; an empty text gives finite values."""
    d = texts.data
    size = np.diff(texts.off)
    words, bytes_ = np.maximum(texts.n_words, 1), np.maximum(size, 1)
    share = lambda table: texts.per_doc(table[d]) / bytes_
    base = base_counts(texts)
    length = texts.end - texts.start
    if len(length):
        u = np.unique(texts.word_hashes() + texts.word_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        distinct = np.bincount(texts.word_doc[u], minlength=texts.n)
        first, last = d[texts.start], d[texts.end - 1]
        second = d[np.minimum(texts.start + 1, texts.end - 1)]
    else:
        distinct = np.zeros(texts.n)
        first = last = second = d[:0]
    by_word = lambda flags: texts.per_doc_words(flags) / words
    lines = texts.per_doc(d == 10) + 1
    return np.stack([
        np.log1p(size), np.log1p(texts.n_words), texts.per_doc(texts.dark) / words, 1 - texts.per_doc(texts.dark) / bytes_,
        share(UPPER), share(DIGIT), share(PUNCT), share(SYMBOL), share(BANG), share(HIGH), lines / words,
        base["n_dup_lines"] / lines, base["n_repeat_words"] / words, 1 - distinct / words, by_word(length <= 3), by_word(length > 15),
        by_word(UPPER[first]), by_word(STOP[last]), share(PIPE), by_word(UPPER[first] & UPPER[second]),
    ], 1)


@dataclass
class Trees:
    """Boosted trees as arrays: node i splits on feature[i] at threshold[i], or is a leaf (feature -1) of value[i]."""

    base: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature, np.int64), np.array(self.threshold)
        left, value = np.array(self.left, np.int64), np.array(self.value)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := feature[node] >= 0).any():
                right = x[rows, np.maximum(feature[node], 0)] > threshold[node]
                node = np.where(inner, left[node] + right, node)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 5) -> Trees:
    """Histogram boosting on the logistic loss: each level adds gradients by (node, feature, bin) and takes the best cuts."""
    trees = Trees()
    if not len(y):
        return trees
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    trees.base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    n_features = x.shape[1]
    score = np.full(len(y), trees.base)

    def add(value: float = 0.0) -> int:
        trees.feature.append(-1)
        trees.threshold.append(0.0)
        trees.left.append(-1)
        trees.value.append(value)
        return len(trees.feature) - 1

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        root = add()
        trees.roots.append(root)
        of, open_nodes = np.full(len(y), root), [root]
        for level in range(depth + 1):
            grown = []
            for node in open_nodes:
                rows = np.flatnonzero(of == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                trees.value[node] = float(rate * gs / (hs + ridge))
                if level == depth or len(rows) < 2 * least:
                    continue
                slot = (binned[rows] + np.arange(n_features) * bins).ravel()
                hist = [np.bincount(slot, np.repeat(v, n_features), n_features * bins).reshape(n_features, bins).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                trees.feature[node], trees.threshold[node] = int(f), float(cuts[f][b])
                trees.left[node] = add()
                add()
                of[rows] = trees.left[node] + (binned[rows, f] > b)
                grown += [trees.left[node], trees.left[node] + 1]
            open_nodes = grown
        score += np.array(trees.value)[of]
    return trees


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Null doc_id: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `sample` training rows; a document with several labels has their rounded mean."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("_label"))
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    few = spark.createDataFrame(rows, chosen.schema)

    def task(batches):
        for batch, texts in text_slices(batches):
            flat = pa.array(statistics(texts).ravel())
            yield pa.RecordBatch.from_pydict({"x": pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64())), "y": batch.column("_label"), "d": batch.column("doc_id")})

    got = fetched(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").mapInArrow(task, "x array<double>, y int, d long"))
    order = np.argsort(got["d"].to_numpy(), kind="stable")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return x, got["y"].to_numpy()[order].astype(float)


def score_documents(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def task(batches):
        for batch, texts in text_slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": shared.value.score(statistics(texts))})

    scored = docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    return grow(*labelled_sample(docs, labels, sample))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """Rows of docs that the classifier accepts, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def task(batches):
        for batch, texts in text_slices(batches, limit=SLICE):
            yield batch.filter(pa.array(shared.value.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(task, docs.schema)
