"""Quality rules with an N-gram perplexity verdict.

Model: modified Kneser-Ney over the characters of words, order 5, one for each language. Every word of every text is
counted, padded with begin and end marks; Spark sums the 5-gram counts, derives the continuation counts of the lower
orders, the discounts from the counts of counts, and interpolated probabilities and backoff weights. The model stays a
table with a row an n-gram, keyed by 64 bits of (language, order, characters), and grows with the corpus. Documents are
dealt into chunks by a hash; each chunk's different 5-grams get their log-probabilities by a shuffle join. Every text
scored is counted, so its 5-grams are all in the model and no lower order is looked up.

A text's score is the mean log-probability of its characters. Bands are per language: quartiles of the
log-perplexity of texts with at least 50 words, widened by ``reach`` interquartile ranges; a text outside is rejected.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BYTES_A, SYMBOL, U64, Rolling, Texts, later_copies, mix, repeated, grams, text_slices
from .shared import settle

ORDER = 5
BEGIN, END = "\t", " "  # no word has white space
FLUSH_WORDS = 200_000
_A = 0xD6E8FEB86659FD93


def _seed(lang: str | None, order: int) -> int:
    return (zlib.crc32((lang or "").encode()) << 8 | order) * 0x9E3779B97F4A7C15 % (1 << 64)


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words one after another, and the places of those to be predicted."""
    begin = BEGIN * (ORDER - 1)
    text = begin + (END + begin).encode().join(words).decode("utf-8", "replace") + END if words else ""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return cp, np.flatnonzero(cp != ord(BEGIN))


def _strings(gram: np.ndarray) -> list[str]:
    """The grams with the NULs at their ends, which numpy drops."""
    text = gram.tobytes().decode("utf-32-le")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _tails(cp: np.ndarray, at: np.ndarray, most: int):
    """Unmixed hashes of the 0, 1, ... most characters that end at each place."""
    h, a = np.zeros(len(at), U64), 1
    yield h
    for j in range(most):
        h = h + cp[at - j].astype(U64) * U64(a)
        a = a * _A % (1 << 64)
        yield h


def gram_keys(grams_: list[str], langs: list[str], orders: list[int]) -> np.ndarray:
    """64-bit keys of grams, each with the seed of its language and order."""
    seed_of: dict[tuple[str, int], int] = {}
    seeds = np.array([seed_of.get(k) or seed_of.setdefault(k, _seed(*k)) for k in zip(langs, orders)], U64)
    size = np.fromiter(map(len, grams_), np.int64, len(grams_))
    out = np.zeros(len(grams_), U64)
    cp = np.frombuffer("".join(grams_).encode("utf-32-le"), np.uint32)
    end = np.cumsum(size)
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        *_, h = _tails(cp, end[of] - 1, n)
        out[of] = h
    return mix(out + seeds)


def word_keys(words: list[bytes], lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 5-grams of the padded words one after another, and where each word's begin."""
    cp, at = _padded(words)
    *_, h = _tails(cp, at, ORDER)
    ends = np.flatnonzero(cp[at] == ord(END))
    return mix(h + U64(_seed(lang, ORDER))), np.concatenate([[0], ends + 1])


def _count_task(batches):
    """Rows (lang, gram, c): 5-gram counts of the words of a task, summed for every FLUSH_WORDS different words."""
    held: dict[str, dict[bytes, int]] = {}

    def flush(lang):
        words = held.pop(lang)
        cp, at = _padded(list(words))
        weight = np.fromiter(words.values(), np.int64, len(words))
        ends = np.flatnonzero(cp[at] == ord(END))
        weight = np.repeat(weight, np.diff(np.concatenate([[-1], ends])))
        wide = np.stack([cp[at - ORDER + 1 + j] for j in range(ORDER)], 1).astype("<u4")
        text = np.ascontiguousarray(wide).view(f"<U{ORDER}")[:, 0]
        gram, inverse = np.unique(text, return_inverse=True)
        c = np.bincount(inverse, weights=weight, minlength=len(gram)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(_strings(gram), pa.string()), "c": c})

    for batch, texts in text_slices(batches):
        langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
        hashes = texts.word_hashes()
        for lang in set(langs.tolist()):
            mine = np.flatnonzero((langs == lang)[texts.word_doc])
            if len(mine):
                _, first, count = np.unique(hashes[mine], return_index=True, return_counts=True)
                words = held.setdefault(lang, {})
                for w, k in zip(texts.words(mine[first]), count.tolist()):
                    words[w] = words.get(w, 0) + k
                if len(words) > FLUSH_WORDS:
                    yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all documents; null language and null text count as empty."""
    rows = docs.select("lang", "text").mapInArrow(_count_task, "lang string, gram string, c long")
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n, gram, logp) and (lang, n, ctx, logb) of the interpolated model, by SQL aggregates and joins."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
    every = settle(reduce(DataFrame.unionByName, (t.select("lang", F.lit(n).alias("n"), "gram", "c", F.expr(f"substring(gram, 1, {n - 1})").alias("ctx")) for n, t in levels.items())), "kn-levels")
    of = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = "n1 / nullif(n1 + 2 * n2, 0)"  # null where a language has no gram of count 1 or 2: 0.5 below
    discount = every.groupBy("lang", "n").agg(*of, F.count("*").alias("types")).selectExpr(
        "lang", "n", "types",
        *(f"least({k}D, greatest(0.1D, coalesce({k} - {k + 1} * ({y}) * n{k + 1} / nullif(n{k}, 0), 0.5D))) AS d{k}" for k in (1, 2, 3)),
    )
    context = every.groupBy("lang", "n", "ctx").agg(F.sum("c").cast("double").alias("total"), *(F.sum(F.when((F.col("c") == k) if k < 3 else F.col("c") >= 3, 1).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3)))
    context = context.join(discount, ["lang", "n"]).selectExpr("lang", "n", "ctx", "total", "d1", "d2", "d3", "(d1 * t1 + d2 * t2 + d3 * t3) / total AS b", "types")
    context = settle(context, "kn-contexts")
    own = settle(every.join(context, ["lang", "n", "ctx"]).selectExpr("lang", "n", "gram", "substring(gram, 2) AS suffix", "b", "types", "greatest(0, c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total AS own"), "kn-own")
    p = settle(own.where("n = 1").selectExpr("lang", "n", "gram", "own + b / types AS p"), "kn-p")
    done = [p]
    for n in range(2, ORDER + 1):
        lower = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        p = settle(own.where(F.col("n") == n).join(lower, ["lang", "suffix"]).selectExpr("lang", "n", "gram", "own + b * q AS p"), "kn-p")
        done.append(p)
    probs = reduce(DataFrame.unionByName, done).selectExpr("lang", "n", "gram", "ln(p) AS logp")
    return probs, context.selectExpr("lang", "n", "ctx AS gram", "CASE WHEN n = 1 THEN ln(b / types) ELSE ln(b) END AS logb")


def keyed(probs: DataFrame) -> DataFrame:
    """(k, logp): the log-probability of each 5-gram by its key."""

    def task(batches):
        for b in batches:
            d = b.to_pydict()
            keys = gram_keys(d["gram"], d["lang"], d["n"]) if d["n"] else np.zeros(0, U64)
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys.view(np.int64)), "logp": pa.array(d["logp"], pa.float64())})

    return probs.where(F.col("n") == ORDER).mapInArrow(task, "k long, logp double")


def train(docs: DataFrame) -> DataFrame:
    """Count all documents and build the model."""
    probs, _ = kneser_ney(settle(count_grams(docs), "kn-counts"))
    return settle(keyed(probs), "kn-model")


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    lead = (texts.data & 0xC0) != 0x80
    three = texts.windows(3)
    hashes = texts.word_hashes()
    rep = np.zeros(len(hashes) + 2, bool)
    at = three[repeated(texts.word_doc[three], grams(hashes, three, 3))] if len(three) else three
    for j in range(3):
        rep[at + j] = True
    ends = np.flatnonzero(texts.data == 10)
    begin = np.union1d(texts.off[:-1], ends + 1)
    begin = begin[begin < len(texts.data)]
    stop = np.append(begin[1:], len(texts.data))
    body = np.where(texts.data[stop - 1] == 10, stop - 1, stop) if len(begin) else stop
    dark = np.concatenate([[0], np.cumsum(texts.dark)])
    keep = dark[body] > dark[begin] if len(begin) else np.zeros(0, bool)
    begin, body = begin[keep], body[keep]
    doc = np.searchsorted(texts.off, begin, "right") - 1
    dup = later_copies(doc, Rolling(BYTES_A[texts.data]).spans(begin, body) + (body - begin).astype(U64)) if len(begin) else np.zeros(0, bool)
    return {
        "n_words": texts.n_words.astype(np.int64),
        "word_chars": texts.per_doc(lead & texts.dark),
        "n_symbols": texts.per_doc(SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(doc[dup], minlength=texts.n).astype(np.int64),
        "n_repeat_words": texts.per_doc_words(rep[: len(hashes)]),
    }


SCORE_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
CHUNK_BYTES = 64 << 20


def _words_of(batch, texts: Texts):
    """(lang, places of the words in that language, different words, index of each place's word)."""
    langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
    hashes = texts.word_hashes()
    for lang in sorted(set(langs.tolist())):
        mine = np.flatnonzero((langs == lang)[texts.word_doc])
        if len(mine):
            _, first, inverse = np.unique(hashes[mine], return_index=True, return_inverse=True)
            yield lang, mine, texts.words(mine[first]), inverse


def _lookup_task(batches):
    """Rows (chunk, k): the different 5-grams of each chunk; all rows of a chunk are in one task."""
    held: dict[int, np.ndarray] = {}
    for whole in batches:
        chunks = whole.column("chunk").to_numpy()
        for chunk in np.unique(chunks).tolist():
            some = whole.filter(pa.array(chunks == chunk))
            found = [word_keys(words, lang)[0] for batch, texts in text_slices([some]) for lang, _, words, _ in _words_of(batch, texts)]
            held[chunk] = np.unique(np.concatenate([held.get(chunk, np.zeros(0, U64)), *found]))
    for chunk, k in held.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(k), chunk, np.int32)), "k": pa.array(k.view(np.int64))})


def _score_chunk(docs: pa.Table, model: pa.Table) -> pa.Table:
    k, v = model["k"].to_numpy().view(U64), model["logp"].to_numpy().astype(np.float64)
    order = np.argsort(k)
    k, v = k[order], v[order]
    out = []
    for batch, texts in text_slices(docs.to_batches()):
        logp, chars = np.zeros(texts.n), np.zeros(texts.n)
        for lang, mine, words, inverse in _words_of(batch, texts):
            keys, stops = word_keys(words, lang)
            at = np.searchsorted(k, keys)
            sums = np.concatenate([[0.0], np.cumsum(v[at])])
            logp += np.bincount(texts.word_doc[mine], weights=(sums[stops[1:]] - sums[stops[:-1]])[inverse], minlength=texts.n)
            chars += np.bincount(texts.word_doc[mine], weights=np.diff(stops)[inverse], minlength=texts.n)
        lp = np.where(chars > 0, -logp / np.maximum(chars, 1), np.nan)
        out.append(pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), **base_counts(texts), "log_perplexity": pa.array(lp, from_pandas=True)}))
    return pa.Table.from_batches(out)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Base counts and log_perplexity of each document; the model has all of their 5-grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // CHUNK_BYTES + 1
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    wanted = dealt.mapInArrow(_lookup_task, "chunk int, k long")
    found = wanted.join(model, "k").select("chunk", "k", F.col("logp").cast("float").alias("logp"))
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_score_chunk, SCORE_SCHEMA)


def quality_rules(docs: DataFrame, reach: float = 4.0) -> DataFrame:
    """One row per document with base counts, log_perplexity, band and verdict.

    Null or wordless text: zero counts, null log_perplexity, base_failed. Null language: a language of its own.
    A language whose texts all have fewer than 50 words has no band, and the base rules alone decide.
    """
    docs = docs.select("doc_id", "text", "lang")
    scores = settle(score(docs, train(docs)), "kn-scores").withColumn("lang", F.coalesce("lang", F.lit("")))
    quart = scores.where("n_words >= 50").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"))
    band = quart.selectExpr("lang", "q[0] - greatest(q[1] - q[0], 0.02D * q[1]) * {r} AS lower_band".format(r=reach), "q[1] + greatest(q[1] - q[0], 0.02D * q[1]) * {r} AS upper_band".format(r=reach))
    band = settle(band, "kn-bands")
    if band.count() <= 10_000:  # a row a language: one language may hold most rows, so don't deal them by language
        band = F.broadcast(band)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    inside = "coalesce(log_perplexity BETWEEN lower_band AND upper_band, true)"
    return scores.join(band, "lang", "left").selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{failed} AS base_failed", f"NOT {failed} AND {inside} AS kept", "log_perplexity", "lower_band", "upper_band")
