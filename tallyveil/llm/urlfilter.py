"""URL filter: rules on host and path, and gradient-boosted trees on lexical features, in DataFrame operations only.

A rule decides the URLs it fits. The trees decide the others; they are trained on labelled URLs, by default those
that a rule has judged, of which a sample of at most ``sample`` rows (by hash of page_id) is used.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

Rule = tuple[str, str]  # (verdict, host/path)
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_log_count", "has_fragment"]


def parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for null and for urls without '://'."""
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    return pages.select(
        "page_id", "url",
        F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def matched_rule(rules: list[Rule]) -> Column:
    """The longest rule that fits host (or a parent of it) and the start of path, as a struct (rule, verdict); else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: str, char: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(char), F.lit("")))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that come from the url alone; a null url has zeros."""
    url = F.coalesce("url", F.lit(""))
    entropy = F.expr(
        "aggregate(array_distinct(split(_u, '')), 0D, (a, c) -> a - CASE WHEN c = '' THEN 0D ELSE "
        "((length(_u) - length(replace(_u, c, ''))) / length(_u)) * log2((length(_u) - length(replace(_u, c, ''))) / length(_u)) END)"
    )
    rows = rows.withColumn("_u", url)
    return rows.select(
        *[c for c in rows.columns if c != "_u"],
        F.length("_u").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        _count("path", "/").cast("double").alias("depth"), _count("host", ".").cast("double").alias("labels"),
        F.expr("coalesce((length(_u) - length(translate(_u, '0123456789', ''))) / nullif(length(_u), 0), 0D)").alias("digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"), (_count("_u", "&") + F.when(F.col("_u").contains("?"), 1).otherwise(0)).cast("double").alias("parameters"),
        _count("host", "-").cast("double").alias("hyphens"), F.when(F.col("_u").contains("#"), 1.0).otherwise(0.0).alias("has_fragment"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


def classify(pages: DataFrame, rules: list[Rule], sample: int = 20_000, rounds: int = 10, depth: int = 3) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every page, repeated and null rows included.

    With labels of one class only, that class is the trees' verdict (allow if there are none), and the probability null.
    """
    judged = lexical(parts(pages)).withColumn("match", matched_rule(rules))
    labelled = judged.where("match IS NOT NULL").withColumn("label", F.when(F.col("match.verdict") == "block", 1.0).otherwise(0.0))
    chosen = settle(labelled.orderBy(F.xxhash64("page_id", "url"), "page_id").limit(sample).drop("match"), "url-sample")
    # at most one row for each of the `sample` labelled rows
    suffixes = settle(chosen.groupBy("suffix").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_rate"), F.log1p(F.count("*").cast("double")).alias("suffix_log_count")), "url-suffixes")

    def vectors(rows: DataFrame) -> DataFrame:
        known = rows.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_log_count": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)

    classes = [r.label for r in chosen.select("label").distinct().collect()]
    out = ["page_id", "host", "path", F.col("match.rule").alias("rule")]
    if len(classes) < 2:
        only = "block" if classes == [1.0] else "allow"
        return judged.select(*out, F.coalesce("match.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(vectors(chosen).select("features", "label").coalesce(1))
    p = vector_to_array("probability")[1]
    scored = trees.transform(vectors(judged))
    return scored.select(*out, F.coalesce("match.verdict", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("block_probability"))
