"""Histogram reports of a whole registry as one plan, whose parameters are columns of the registry's rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encoding, estimate
from ..operators.registry import TAG, VALUES, n_categories
from ..operators.rows import METRIC, PROFILE, null_safe_join

VALUE = ("kind", *VALUES)
ENCODING = ("customer_id", "project_id", "encoding_config_id")


def bucket_of(v: str) -> Column:
    """Bucket of an integer by the columns bucket_kind, floor, n_buckets, step, multiplier; 0 is underflow."""
    rate = F.when(F.col("bucket_kind") == "linear", F.lit(1)).otherwise(F.col("multiplier"))
    linear = S.linear_bucket(v, F.col("floor"), F.col("n_buckets"), F.col("step"))
    widths = F.transform(F.sequence(F.lit(0), F.col("n_buckets").cast("int") - 1), lambda i: F.col("floor") + F.col("step") * F.pow(rate, i))
    exponential = F.size(F.filter(F.concat(F.array(F.col("floor").cast("double")), widths), lambda x: x <= F.col(v)))
    return F.when(F.col("bucket_kind") == "linear", linear).otherwise(exponential).cast("long")


def _null(*but: str) -> list[Column]:
    kinds = {"kind": "string", "s": "string", "i": "long", "idx": "long", "d": "double"}
    return [F.lit(None).cast(kinds[c]).alias(c) for c in VALUE if c not in but]


class Inputs:
    """Observations of the reports' metrics, parts and days, with their encodings, each group of one encoding only."""

    def __init__(self, obs: DataFrame, reports: DataFrame, parts: DataFrame, encodings: DataFrame):
        of_part = parts.select(*METRIC, "part_name", "bucket_kind", "floor", "n_buckets", "step", "multiplier")
        asked = reports.join(of_part, [*METRIC, "part_name"])
        rows = obs.join(asked, [*METRIC, "part_name"]).where(F.col("day_index").between(F.col("first_day"), F.col("last_day")))
        kinds = encodings.select("customer_id", "project_id", F.col("id").alias("encoding_config_id"), F.col("kind").alias("encoding_kind"))
        rows = rows.join(kinds, list(ENCODING)).where("payload_kind = encoding_kind")  # inconsistent observations go
        self.profile = [f for f in PROFILE if f in obs.columns]
        self.group = ["report_id", *self.profile]
        self.rows = rows.withColumns({f: F.when(F.array_contains("report_fields", f), F.col(f)) for f in self.profile})
        self.encodings = encodings.withColumnRenamed("id", "encoding_config_id").drop("kind")
        mixed = estimate.heterogeneous_groups(self.rows, self.group)
        self.mixed = mixed.groupBy("report_id").agg(F.min(F.struct("lo", "hi")).alias("ids"))
        self.by = [*self.group, *ENCODING]

    def of(self, kind: str) -> DataFrame:
        return self.rows.where((F.col("payload_kind") == kind) & F.col("bucket_kind").isNull())

    def with_parameters(self, df: DataFrame, *columns: str) -> DataFrame:
        return df.join(self.encodings.select(*ENCODING, *columns), list(ENCODING))


def _noop(of: Inputs) -> DataFrame:
    """Exact counts of all values."""
    counts = of.of("noop").groupBy(*of.group, *VALUE).agg(F.count("*").cast("double").alias("count_estimate"))
    return counts.withColumn("std_error", F.lit(0.0))


def _buckets(of: Inputs) -> DataFrame:
    """Integer buckets; the value is the bucket's index."""
    rows = of.rows.where("payload_kind = 'noop' AND bucket_kind IS NOT NULL AND i IS NOT NULL")
    counts = rows.groupBy(*of.group, bucket_of("i").alias("idx")).agg(F.count("*").cast("double").alias("count_estimate"))
    return counts.select(*of.group, F.lit("index").alias("kind"), "idx", *_null("kind", "idx"), "count_estimate", F.lit(0.0).alias("std_error"))


def _basic_rappor(of: Inputs) -> DataFrame:
    rows = of.with_parameters(of.of("basic_rappor"), "categories", "first", "last", "num_categories").withColumn("n_bits", n_categories())
    counts = of.with_parameters(estimate.bit_counts(rows, "n_bits", [*of.by, "n_bits"]), "p", "q", "categories", "first")
    named, ranged = F.col("categories").isNotNull(), F.col("first").isNotNull()
    value = [
        F.when(named, "string").when(ranged, "int").otherwise("index").alias("kind"), F.get("categories", F.col("bit")).alias("s"), F.when(~named, F.col("first") + F.col("bit")).alias("i"),
        F.when(~named & ~ranged, F.col("bit").cast("long")).alias("idx"),
    ]
    return estimate.basic_rappor_estimate(counts, F.col("p"), F.col("q")).select(*of.group, *value, F.lit(None).cast("double").alias("d"), "count_estimate", "std_error")


def _threshold(of: Inputs) -> DataFrame:
    rows = of.with_parameters(of.of("threshold"), "threshold")
    plain = encoding.threshold_decrypt(rows, "threshold", (*of.group, "threshold"))
    tag, text = F.substring("plaintext", 1, 1), F.expr("substring(plaintext, 3)")
    kind = F.coalesce(*[F.when(tag == t, k) for k, t in TAG.items()])
    value = [kind.alias("kind"), F.when(tag == "s", text).alias("s"), F.when(tag == "i", text.try_cast("long")).alias("i"), F.when(tag == "x", text.try_cast("long")).alias("idx")]
    return plain.select(*of.group, *value, F.lit(None).cast("double").alias("d"), F.col("total").cast("double").alias("count_estimate"), F.lit(0.0).alias("std_error"))


def _rappor(of: Inputs, candidates: DataFrame) -> DataFrame:
    """With epochs and converged; a group whose report has no candidates has one row without one."""
    rows = of.with_parameters(of.of("rappor"), "k", "h", "m", "p", "q").where(F.col("cohort").between(0, F.col("m") - 1))
    by = [*of.by, "k", "h", "m", "p", "q"]
    counts = estimate.bit_counts(rows, "k", [*by, "cohort"])
    sizes = counts.where("bit = 0").groupBy(*by).agg(F.sum("n").alias("n_all"))
    ratios = null_safe_join(estimate.basic_rappor_estimate(counts, F.col("p"), F.col("q")), sizes, by).withColumn("ratio", F.col("count_estimate") / F.col("n"))
    matrix = sizes.select(*by).join(candidates, "report_id").select(*by, "candidate", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("cohort"))
    matrix = matrix.select(*by, "candidate", "cohort", F.explode(encoding.bloom_bits("candidate", F.col("cohort"), F.col("k"), F.col("h"))).alias("bit"))
    key = [*of.group, "encoding_config_id"]
    solved = estimate.grouped_rappor_estimate(ratios.select(*key, "cohort", "bit", "k", "m", "ratio", "n_all"), matrix.select(*key, "candidate", "cohort", "bit"), key)
    none = sizes.join(candidates.select("report_id").distinct(), "report_id", "left_anti").select(*of.group, F.lit(None).cast("string").alias("candidate"), F.lit(None).cast("double").alias("count_estimate"), F.lit(None).cast("boolean").alias("converged"))
    return solved.select(*of.group, "candidate", "count_estimate", "converged").unionByName(none)


#: The extension seam: from the observations of one kind to (group, value columns, count_estimate, std_error).
ESTIMATORS: dict[str, Callable[[Inputs], DataFrame]] = {"noop": _noop, "buckets": _buckets, "basic_rappor": _basic_rappor, "threshold": _threshold}


def histogram_reports(obs: DataFrame, reports: DataFrame, parts: DataFrame, encodings: DataFrame, labels: DataFrame, candidates: DataFrame, estimators: dict[str, Callable[[Inputs], DataFrame]] = ESTIMATORS) -> DataFrame:
    """(report_id, profile, kind, s, i, idx, d, label, count_estimate, std_error, status, message) of all reports.

    reports(report_id, customer_id, project_id, metric_id, part_name, first_day, last_day, report_fields): one variable
    and a range of days each; profile fields that it doesn't ask for are null. Each group of a report has an estimator by
    the kind of its encoding: exact counts, integer buckets, basic and string RAPPOR, thresholds. A report that fails
    has one row with its status: several encodings in a group (UNIMPLEMENTED), string RAPPOR without candidates
    (INVALID_ARGUMENT) or without convergence (INTERNAL). Strings have no standard error under string RAPPOR. A new kind
    of encoding takes an estimator more.
    """
    of = Inputs(obs, reports, parts, encodings)
    strings = _rappor(of, candidates)
    of_strings = strings.select(*of.group, F.lit("string").alias("kind"), F.col("candidate").alias("s"), *_null("kind", "s"), "count_estimate", F.lit(0.0).alias("std_error"))
    good = reduce(DataFrame.unionByName, [estimator(of) for estimator in estimators.values()], of_strings)
    mixed = of.mixed.select("report_id", F.lit("UNIMPLEMENTED").alias("status"), F.format_string("encodings %d and %d in one group", "ids.lo", "ids.hi").alias("message"))
    unsettled = strings.where("converged IS NULL OR NOT converged").select("report_id", F.when(F.col("converged").isNull(), "INVALID_ARGUMENT").otherwise("INTERNAL").alias("status"), F.when(F.col("converged").isNull(), "no candidates").otherwise("no convergence").alias("message"))
    failed = mixed.unionByName(unsettled).groupBy("report_id").agg(F.max(F.struct("status", "message")).alias("f")).select("report_id", "f.status", "f.message")
    named = good.join(failed.select("report_id"), "report_id", "left_anti").join(labels, ["report_id", "idx"], "left")
    columns = [*of.group, *VALUE, "label", "count_estimate", "std_error", "status", "message"]
    named = named.withColumns({"status": F.lit("OK"), "message": F.lit(None).cast("string")}).select(*columns)
    return named.unionByName(failed, allowMissingColumns=True)
