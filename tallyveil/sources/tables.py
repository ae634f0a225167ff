"""Observation, registry and report tables: scans, idempotent appends, pages, exports and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OBSERVATION_KEY = ["customer_id", "project_id", "metric_id", "day_index", "random_id"]
ENTRIES = "user_id int, name string, city string, hour int, rating int, help_query string, url string"
RAPPOR_PARAMS = "k int, h int, m int, p double, q double, f double"
PARTITIONS = OBSERVATION_KEY[:4]  # of stored observations
MANIFEST_METRICS = 10_000
REPORT_ROW_LIMIT = 5000
REPORT_BUCKETS = 64  # folders of a report store
ROW_TYPES = ("HISTOGRAM", "JOINT")  # of reports that are stored


def events_as_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as observations of three metrics: a string, an integer, a double and an index part each."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS obs_id", "user_id AS client_id", "CAST(1 AS BIGINT) AS customer_id", "CAST(1 AS BIGINT) AS project_id",
        "1 + user_id % 3 AS metric_id", "date_diff(to_date(ts), DATE'1970-01-01') AS day_index", "event_id AS random_id", "ts",
        "event_type AS s", "CAST(floor(value) AS BIGINT) AS i", "value AS d", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS idx",
        "concat('board', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4) AS board",
    )


def scan_observations(obs: DataFrame, customer: int, project: int, metric: int, first_day: int, last_day: int, columns: list[str]) -> DataFrame:
    """Inclusive day-range scan of one metric, chosen columns only."""
    if first_day > last_day:
        raise ValueError("first day after last day")
    here = (F.col("customer_id") == customer) & (F.col("project_id") == project) & (F.col("metric_id") == metric)
    return obs.where(here & F.col("day_index").between(first_day, last_day)).select(*columns)


def content_hash(df: DataFrame) -> DataFrame:
    rest = sorted(c for c in df.columns if c not in OBSERVATION_KEY)
    return df.withColumn("content_hash", F.xxhash64(*rest))


def append_observations(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of new that are not stored yet, each (metadata, random id, content) once."""
    key = [*OBSERVATION_KEY, "content_hash"]
    fresh = content_hash(new).dropDuplicates(key)
    if stored is not None:
        fresh = fresh.join(content_hash(stored).select(*key), key, "left_anti")
    return fresh.drop("content_hash")


def touched(new: DataFrame) -> Column:
    """A predicate on partition columns that holds for every stored partition that new has rows for.

    The manifest has a row a metric, with its days; a batch of more than MANIFEST_METRICS metrics is told by its range of
    days alone. Either way the predicate reaches the scan as a partition filter.
    """
    metrics = PARTITIONS[:3]
    manifest = new.groupBy(*metrics).agg(F.sort_array(F.collect_set("day_index")).alias("days"))
    rows = manifest.limit(MANIFEST_METRICS + 1).collect()
    if len(rows) > MANIFEST_METRICS:
        low, high = new.agg(F.min("day_index"), F.max("day_index")).first()
        return F.col("day_index").between(low, high)
    # metrics with equal days share a term
    by_days: dict = {}
    for r in rows:
        by_days.setdefault(tuple(r.days), []).append([r[m] for m in metrics])
    terms = []
    for days, of in by_days.items():
        own = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(v) for m, v in zip(metrics, key)]) for key in of])
        terms.append(own & F.col("day_index").isin(*days))
    return reduce(lambda x, y: x | y, terms, F.lit(False))


def stored_observations(spark: SparkSession, path: str) -> DataFrame | None:
    """What is stored; None where nothing is."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_observations(new: DataFrame, path: str) -> None:
    """Append the rows that are not stored yet; only partitions that the batch touches are read or written."""
    stored = stored_observations(new.sparkSession, path)
    if stored is not None:
        stored = stored.select(*new.columns).where(touched(new))
    fresh = append_observations(new, stored)
    fresh.repartition(*PARTITIONS, F.pmod(F.xxhash64("random_id"), F.lit(8))).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def drop_partitions(spark: SparkSession, path: str, **key) -> bool:
    """Delete the folders of one value of leading partition columns, such as a metric's; no file of another is touched."""
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in key.items()]]))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_rows(spark: SparkSession, path: str, gone: Column, partitions: list[str], scratch: str) -> None:
    """Delete the rows of a partitioned table for which gone holds: partitions without any such row stay as they are.

    What remains of the others is written to scratch, then put in their place; emptied partitions are dropped.
    """
    table = spark.read.parquet(path)
    gone = F.coalesce(gone, F.lit(False))
    hit = table.where(gone).groupBy(*partitions).agg(F.count("*").alias("_n"))
    whole = table.join(hit.select(*partitions), partitions, "left_semi")
    sizes = whole.groupBy(*partitions).agg(F.sum(F.when(gone, 0).otherwise(1)).alias("kept")).collect()  # a row a partition
    whole.where(~gone).write.parquet(scratch)
    rest = spark.read.schema(table.schema).parquet(scratch)
    if any(r.kept for r in sizes):
        rest.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    for r in sizes:
        if not r.kept:
            drop_partitions(spark, path, **{c: r[c] for c in partitions})


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).csv(path)


def write_entries(df: DataFrame, path: str) -> None:
    df.select(*[f.split()[0] for f in ENTRIES.split(", ")]).write.csv(path)


def read_rappor_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAPPOR_PARAMS).csv(path, header=True)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "candidate").where("candidate != ''")


def merge_registries(tables: list[DataFrame]) -> DataFrame:
    """Per-project registries one after another, in key order."""
    return reduce(DataFrame.unionByName, tables).orderBy("customer_id", "project_id", "id")


def load_registry(table: DataFrame) -> DataFrame:
    """The registry with a flag on rows whose key is repeated or 0, which callers treat as an error."""
    repeated = table.groupBy("customer_id", "project_id", "id").agg(F.count("*").alias("_n"))
    return table.join(repeated, ["customer_id", "project_id", "id"]).withColumn("bad_key", (F.col("_n") > 1) | (F.col("id") == 0)).drop("_n")


def report_bucket(report_id: str | Column) -> Column:
    return F.pmod(F.xxhash64(report_id), F.lit(REPORT_BUCKETS)).cast("int")


def store_report(rows: DataFrame, meta: DataFrame, path: str) -> DataFrame:
    """Rows of reports that are in progress and kept in store, written by buckets of reports; returns what was written.

    Folders don't grow with the reports: a report's rows lie next to each other in its bucket.
    A report with a row of another type than its own is refused whole, as is every raw dump.
    """
    allowed = meta.where(F.col("in_store") & (F.col("state") == "IN_PROGRESS") & F.col("report_type").isin(*ROW_TYPES)).select("report_id", "report_type")
    typed = rows.join(allowed, "report_id")
    refused = typed.where(~F.col("row_type").eqNullSafe(F.col("report_type"))).select("report_id").distinct()
    kept = typed.join(refused, "report_id", "left_anti").select(*rows.columns)
    dealt = kept.withColumn("bucket", report_bucket("report_id")).repartition("bucket").sortWithinPartitions("bucket", "report_id")
    dealt.write.mode("append").partitionBy("bucket").parquet(path)
    return kept


def stored_rows(spark: SparkSession, path: str, schema: str, report_id=None) -> DataFrame:
    """The stored rows, of one report or of all; one report is read from its bucket's folder alone."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if report_id is not None:
        key = F.lit(report_id).cast(rows.schema["report_id"].dataType)
        rows = rows.where((F.col("bucket") == report_bucket(key)) & (F.col("report_id") == key))
    return rows.drop("bucket")


def read_report(rows: DataFrame, meta: DataFrame, report_id, limit: int = REPORT_ROW_LIMIT) -> DataFrame:
    """Rows of one report with its metadata; a report of more rows than the limit fails when it is read."""
    of = rows.where(F.col("report_id") == report_id).limit(limit + 1)
    counted = of.withColumn("_n", F.count("*").over(W.partitionBy()))  # limit + 1 rows at most
    error = F.raise_error(F.format_string("report %s has more than %d rows", F.lit(str(report_id)), F.lit(limit))).cast("boolean")
    return counted.where(F.when(F.col("_n") <= limit, True).otherwise(error)).drop("_n").join(meta, "report_id", "left")


def query_reports(meta: DataFrame, config: int, since, until) -> DataFrame:
    return meta.where((F.col("config_id") == config) & (F.col("created") >= since) & (F.col("created") < until))


def export_lines(rows: DataFrame, header: str, line) -> DataFrame:
    """One string column: the header first, then the rows in their order column; nothing for an empty report."""
    body = rows.select(F.lit(1).alias("_part"), F.col("_order"), line.alias("value"))
    head = rows.limit(1).select(F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_order"), F.lit(header).alias("value"))
    return head.unionByName(body).orderBy("_part", "_order").select("value")


def export_csv(rows: DataFrame, header: str, line: Column, paths: list[str], parts: int | None = None) -> None:
    """Write a report as text for each path: header, body in numbered parts, and a manifest (part, file, n).

    Parts hold consecutive ranges of the order column, so the header and the parts in the order of their names are the
    report. parts: how many; None: as many as the rows ask for by Spark's settings. An empty report is not exported.
    """
    if rows.isEmpty():
        return
    spark = rows.sparkSession
    lines = rows.select("_order", line.alias("value"))
    body = (lines.repartitionByRange("_order") if parts is None else lines.repartitionByRange(parts, "_order")).sortWithinPartitions("_order").select("value")
    for path in paths:
        spark.createDataFrame([(header,)], "value string").write.text(f"{path}/header")
        body.write.text(f"{path}/body")
        sizes = spark.read.text(f"{path}/body").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("n"))
        sizes.withColumn("part", F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")).write.json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of an export and their places, the header's 0, by the manifest's counts of the parts before."""
    parts = spark.read.schema("file string, n long, part int").json(f"{path}/manifest")
    before = parts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("file", "before")  # a row a part
    lines = spark.read.text(f"{path}/body").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("at"))
    inside = F.row_number().over(W.partitionBy("file").orderBy("at"))
    body = lines.join(before, "file").select((F.col("before") + inside).alias("place"), "value")
    return spark.read.text(f"{path}/header").select(F.lit(0).cast("long").alias("place"), "value").unionByName(body)


def delete_where(df: DataFrame, **key) -> DataFrame:
    """Rows that remain after everything of one metric or report configuration has gone."""
    gone = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()])
    return df.where(~F.coalesce(gone, F.lit(False)))


def read_page(df: DataFrame, key: str, token, n: int) -> DataFrame:
    """n rows after the token in key order, with has_more on each; the last key is the next token."""
    rows = (df if token is None else df.where(F.col(key) > token)).orderBy(key).limit(n + 1)
    numbered = rows.select("*", F.expr(f"row_number() OVER (ORDER BY {key})").alias("_n"), F.expr("count(*) OVER ()").alias("_all"))
    return numbered.where(F.col("_n") <= n).withColumn("has_more", F.col("_all") > n).drop("_n", "_all")


def count_capped(df: DataFrame, most: int) -> DataFrame:
    return df.limit(most).agg(F.count("*").alias("n"))


def peek(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
