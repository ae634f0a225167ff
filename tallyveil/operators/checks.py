"""Validation of values against the registry, and of registries themselves. Each returns the offending rows with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODABLE = {"threshold": ("string", "blob"), "rappor": ("string",), "basic_rappor": ("string", "int", "index"), "noop": ("string", "int", "index", "double", "blob", "dist")}
KEY = ["customer_id", "project_id", "id"]
METRIC = ["customer_id", "project_id", "metric_id"]


def validate_values(values: DataFrame, parts: DataFrame) -> DataFrame:
    """values(obs_id, customer_id, project_id, metric_id, part_name, kind, is_set) with a reason, null where good.

    Parts are found by customer, project and metric. An empty part name means the metric's only part.
    """
    of_metric = parts.groupBy(*METRIC).agg(F.count("*").alias("n_parts"), F.min("part_name").alias("only_part"))
    sent = values.groupBy("obs_id").agg(F.count("*").alias("n_sent"))
    rows = values.join(of_metric, METRIC, "left").join(sent, "obs_id")
    rows = rows.withColumn("part_name", F.when((F.col("part_name") == "") & (F.col("n_parts") == 1), F.col("only_part")).otherwise(F.col("part_name")))
    rows = rows.join(parts.select(*METRIC, "part_name", "data_type"), [*METRIC, "part_name"], "left")
    reason = (
        F.when(F.col("n_parts").isNull(), "unknown metric")
        .when(F.col("n_sent") != F.col("n_parts"), "wrong number of parts")
        .when(F.col("data_type").isNull(), "unknown part")
        .when(~F.col("is_set"), "unset value")
        .when(F.col("kind") != F.col("data_type"), "wrong type")
    )
    return rows.select("obs_id", *METRIC, "part_name", "kind", reason.alias("reason"))


def valid_distributions(df: DataFrame, n_buckets: int | None) -> DataFrame:
    """Adds valid: the part has buckets, and every index of dist is below n + 2."""
    ok = F.lit(False) if n_buckets is None else F.forall(F.map_keys("dist"), lambda k: (k >= 0) & (k < n_buckets + 2))
    return df.withColumn("valid", ok)


def valid_encoding_types(df: DataFrame) -> DataFrame:
    """Adds valid: the encoding takes values of this kind."""
    pairs = [F.concat(F.lit(e), F.lit("/"), F.lit(k)) for e, kinds in ENCODABLE.items() for k in kinds]
    return df.withColumn("valid", F.array_contains(F.array(*pairs), F.concat_ws("/", "encoding", "kind")))


def duplicate_ids(registry: DataFrame) -> DataFrame:
    """Keys with id 0 or more than one row."""
    return registry.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1 OR id = 0")


def dangling_reports(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    of = metrics.select("customer_id", "project_id", F.col("id").alias("metric_id"))
    return reports.join(of, ["customer_id", "project_id", "metric_id"], "left_anti")


def invalid_variables(variables: DataFrame, parts: DataFrame) -> DataFrame:
    rows = variables.join(parts.select(*METRIC, "part_name", "data_type"), [*METRIC, "part_name"], "left")
    reason = (
        F.when(F.col("data_type").isNull(), "no such part")
        .when(F.col("has_labels") & (F.col("data_type") != "index"), "labels on a part that is no index")
        .when(F.col("has_candidates") & (F.col("data_type") != "string"), "candidates on a part that is no string")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def invalid_profile_fields(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fields that a report asks for and its metric does not supply."""
    of = metrics.select("customer_id", "project_id", F.col("id").alias("metric_id"), F.col("profile_fields").alias("supplied"))
    rows = reports.join(of, ["customer_id", "project_id", "metric_id"])
    return rows.withColumn("missing", F.array_except("profile_fields", "supplied")).where(F.size("missing") > 0)


def expired_metrics(metrics: DataFrame, today) -> DataFrame:
    """Expiry dates that are missing, malformed, over a year off or past, or within three months; projects from 100 on."""
    date = F.try_to_timestamp(F.col("expires_after"), F.lit("yyyy/MM/dd")).cast("date")
    now = F.lit(today).cast("date")
    problem = (
        F.when(F.coalesce(F.col("expires_after"), F.lit("")) == "", "error: missing")
        .when(date.isNull(), "error: malformed")
        .when(date > F.add_months(now, 12), "error: more than a year away")
        .when(date <= now, "warning: expired")
        .when(date <= F.add_months(now, 3), "warning: expires soon")
    )
    return metrics.where("project_id >= 100").withColumn("problem", problem).where("problem IS NOT NULL")


def invalid_part_names(parts: DataFrame) -> DataFrame:
    return parts.where(~F.col("part_name").rlike(r"^[a-zA-Z][_a-zA-Z0-9\- ]+$"))


def invalid_rappor(encodings: DataFrame) -> DataFrame:
    bad = "NOT (p BETWEEN 0 AND 1) OR NOT (q BETWEEN 0 AND 1) OR p = q OR f != 0 OR NOT (k > 1 AND k <= 1024 AND bit_count(k) = 1) OR NOT (h BETWEEN 1 AND 8 AND h < k) OR NOT (m BETWEEN 1 AND 1024)"
    return encodings.where(bad)


def invalid_basic_rappor(encodings: DataFrame) -> DataFrame:
    """kind string (categories), int (first, last) or index (num_categories)."""
    strings = "kind = 'string' AND (size(categories) < 2 OR size(categories) >= 1024 OR exists(categories, c -> c = '') OR size(array_distinct(categories)) < size(categories))"
    ints = "kind = 'int' AND (last <= first OR last - first + 1 >= 1024)"
    return encodings.where(f"({strings}) OR ({ints}) OR (kind = 'index' AND NOT (num_categories BETWEEN 1 AND 1023))")


def invalid_threshold(encodings: DataFrame) -> DataFrame:
    return encodings.where("NOT (threshold >= 2 AND threshold < 1000000)")


def invalid_report_shape(reports: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("n_variables") < 1, "no variable")
        .when((F.col("report_type") == "HISTOGRAM") & (F.col("n_variables") != 1), "a histogram has one variable")
        .when((F.col("report_type") == "JOINT") & (F.col("n_variables") != 2), "a joint report has two variables")
        .when(F.col("finalization_days") > 20, "more than 20 finalization days")
        .when(F.col("has_export") & ~(F.col("has_serialization") & F.col("has_location")), "incomplete export")
    )
    return reports.withColumn("reason", reason).where("reason IS NOT NULL")
