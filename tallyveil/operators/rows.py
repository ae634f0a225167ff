"""Filters, projections, lookups, set operations, sorts and samples on observation and report tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalars import keyed_uniform

PROFILE = ("os", "arch", "board_name", "product_name", "build_level")
KIND_RANK = ("string", "int", "index", "blob")
METRIC = ["customer_id", "project_id", "metric_id"]


def consistent_encoding(obs: DataFrame, encodings: DataFrame) -> DataFrame:
    """Rows whose encoding exists and has the kind of their payload."""
    joined = with_encoding(obs, encodings)
    return joined.where("payload_kind = encoding_kind")


def with_encoding(obs: DataFrame, encodings: DataFrame) -> DataFrame:
    of = encodings.select("customer_id", "project_id", F.col("id").alias("encoding_config_id"), F.col("kind").alias("encoding_kind"), *[c for c in encodings.columns if c not in ("customer_id", "project_id", "id", "kind")])
    return obs.join(of, ["customer_id", "project_id", "encoding_config_id"])


def without_encoding(obs: DataFrame, encodings: DataFrame) -> DataFrame:
    of = encodings.select("customer_id", "project_id", F.col("id").alias("encoding_config_id"))
    return obs.join(of, ["customer_id", "project_id", "encoding_config_id"], "left_anti")


def project_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: F.lit(None).cast(df.schema[f].dataType) for f in PROFILE if f in df.columns and f not in fields})


def merge_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Envelope fields (env_<f>) that are set win over the batch's; the env_ columns go."""
    return df.withColumns({f: F.coalesce(F.nullif(F.col(f"env_{f}"), F.lit("")), F.col(f)) for f in fields}).drop(*[f"env_{f}" for f in fields])


def day_range(df: DataFrame, first: int, last: int) -> DataFrame:
    if first > last:
        raise ValueError("first day after last day")
    return df.where(F.col("day_index").between(first, last))


def relative_day_range(df: DataFrame, today: int | None, first_offset: int, last_offset: int, zone: str = "UTC", all_days: bool = False) -> DataFrame:
    """Days by their distance from today; today None: the current day of the zone. all_days: no limit."""
    if all_days:
        return df
    now = F.lit(today) if today is not None else F.unix_date(F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone)))
    if first_offset > last_offset:
        raise ValueError("first day after last day")
    return df.where(F.col("day_index").between(now + first_offset, now + last_offset))


def raw_dump(tall: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per observation that has every part unencoded and of its declared type; other observations are left out."""
    good = None
    for part, kind in types.items():
        ok = (F.col("part_name") == part) & (F.col("kind") == kind) & (F.col("encoding") == "noop")
        good = ok if good is None else good | ok
    cells = [F.max(F.when(F.col("part_name") == part, F.col("value"))).alias(part) for part in types]
    rows = tall.where(good).groupBy("obs_id").agg(*cells, F.count_distinct("part_name").alias("_n"))
    return rows.where(F.col("_n") == len(types)).drop("_n")


def suppress_empty(rows: DataFrame) -> DataFrame:
    return rows.where("NOT (kind = 'index' AND label IS NULL AND abs(count_estimate) < 1e-4)")


def strip_identifiers(df: DataFrame, drop: list[str], normalise: list[str]) -> DataFrame:
    return df.drop(*drop).withColumns({c: F.lower(F.trim(c)) for c in normalise})


def drop_observations(df: DataFrame, p: float, salt: str, key: str = "obs_id") -> DataFrame:
    return df.where(keyed_uniform(salt, key) >= p)


def limit_observation_size(df: DataFrame, payload: str, fingerprint_bytes: int, most: int) -> DataFrame:
    return df.where(F.octet_length(payload) + fingerprint_bytes + 1 <= most)


def route_backend(df: DataFrame, known: list[str]) -> DataFrame:
    """Adds route: the backend, or 'unknown' for tags that are none of those known; one scan serves all routes."""
    return df.withColumn("route", F.when(F.col("backend").isin(known), F.col("backend")).otherwise("unknown"))


def write_routes(df: DataFrame, known: list[str], path: str) -> None:
    """Every backend's rows in a folder of its own, by one job."""
    route_backend(df, known).write.mode("append").partitionBy("route").parquet(path)


def drop_blank_reports(df: DataFrame, v1: str, v2: str, strict: bool = False) -> DataFrame:
    """Rows with both variables; strict: a row without one fails the query when it is read."""
    full = (F.coalesce(v1, F.lit("")) != "") & (F.coalesce(v2, F.lit("")) != "")
    return df.where(F.when(full, True).otherwise(F.raise_error(F.lit("a report has a blank variable")).cast("boolean") if strict else F.lit(False)))


def filter_build_level(obs: DataFrame, metrics: DataFrame) -> DataFrame:
    of = metrics.select("customer_id", "project_id", F.col("id").alias("metric_id"), "max_build_level")
    return obs.join(of, METRIC).where("build_level <= max_build_level").drop("max_build_level")


# lookups


def with_report(reports: DataFrame, metrics: DataFrame, variables: DataFrame) -> DataFrame:
    """Report -> metric -> part."""
    m = metrics.select("customer_id", "project_id", F.col("id").alias("metric_id"), F.col("name").alias("metric_name"))
    v = variables.select("report_id", "position", "part_name")
    return reports.withColumnRenamed("id", "report_id").join(m, ["customer_id", "project_id", "metric_id"]).join(v, "report_id")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "idx", "left")


def candidate_matrix(candidates: DataFrame, k: int, h: int, m: int) -> DataFrame:
    """(cohort, bit, row, candidate) of the set entries; row = cohort * k + (k - 1 - bit)."""
    from .encoding import bloom_bits

    grid = candidates.select("candidate", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("cohort"))
    bits = grid.select("candidate", "cohort", F.explode(bloom_bits("candidate", F.col("cohort"), k, h)).alias("bit"))
    return bits.distinct().withColumn("row", F.col("cohort") * k + (k - 1 - F.col("bit")))


def compare_with_actual(est: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Estimates beside exact counts (0 where missing) with a 1.96 sigma interval."""
    joined = est.join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("low", F.col("estimate") - 1.96 * F.col("std_error")).withColumn("high", F.col("estimate") + 1.96 * F.col("std_error"))


def categorical_map(df: DataFrame, k: int, m: int) -> DataFrame:
    """The identity map bit -> category, once a cohort, from a one-row DataFrame; the boolean map is k = 1."""
    rows = df.select(F.explode(F.sequence(F.lit(0), F.lit(k * m - 1))).alias("row"))
    return rows.select("row", F.floor(F.col("row") / k).cast("int").alias("cohort"), (F.col("row") % k).cast("int").alias("category"))


def associated_reports(meta: DataFrame) -> DataFrame:
    """Each joint report with its marginals of sequence 0 and 1."""
    joint = meta.where("report_type = 'JOINT'").select(F.col("report_id").alias("joint_id"), "request_id")
    parts = meta.where("report_type = 'HISTOGRAM' AND sequence IN (0, 1)").select("request_id", "sequence", F.col("report_id").alias("marginal_id"))
    return joint.join(parts, "request_id")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; an inner join keeps b's other columns."""
    names, on = {k: f"_b{i}" for i, k in enumerate(keys)}, F.lit(True)
    for k, other in names.items():
        on &= F.col(k).eqNullSafe(F.col(other))
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


# sets, order, samples


def merge_batches(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def diff_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def dedupe(df: DataFrame, key: list[str]) -> DataFrame:
    return df.dropDuplicates(key)


def sort_report(rows: DataFrame) -> DataFrame:
    """null < string < int < index < blob, by value inside a kind, then profile."""
    rank: Column = F.lit(0)
    for n, kind in enumerate(KIND_RANK, 1):
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    return rows.withColumn("kind_rank", rank).orderBy("kind_rank", "s", "i", "idx", *[c for c in ("os", "arch", "board_name") if c in rows.columns])


def top_k(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def order_for_display(df: DataFrame, count: str, item: str) -> DataFrame:
    return df.orderBy(F.desc(count), item)


def shuffle_rows(df: DataFrame, salt: str, key: str) -> DataFrame:
    """A permutation of the rows by keyed hash: range-partitioned, so no task gets them all."""
    return df.withColumn("shuffle_key", F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def cap_distinct(rows: DataFrame, value: str, cap: int) -> DataFrame:
    """The first cap values in order, and whether there were more."""
    first = rows.orderBy(value).limit(cap + 1)
    numbered = first.select("*", F.row_number().over(W.orderBy(value)).alias("_n"), F.count("*").over(W.partitionBy()).alias("_all"))
    return numbered.where(F.col("_n") <= cap).withColumn("truncated", F.col("_all") > cap).drop("_n", "_all")


def sample_reports(df: DataFrame, n: int, salt: str, key: str) -> DataFrame:
    return df.withColumn("_u", F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)).orderBy("_u", key).limit(n).drop("_u")


def chunk(df: DataFrame, keys: list[str], order: str, n: int, salt: str) -> DataFrame:
    """Numbers rows inside a metadata key in keyed-hash order and cuts chunks of at most n.

    Rows are numbered inside 256 ranges of the hash, to which the counts of the ranges before are added, so that a key
    with very many rows is no single task's.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(salt), F.col(order).cast("string")), 256)
    rows = df.withColumn("_h", digest).withColumn("_r", F.substring("_h", 1, 2))
    sizes = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_r")) - F.col("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_r2"), "_before")
    place = F.row_number().over(W.partitionBy(*keys, "_r").orderBy("_h", order)) - 1
    same = F.col("_r") == F.col("_r2")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_place", place).join(before, same).withColumn("chunk", F.floor((F.col("_place") + F.col("_before")) / n).cast("int")).select(*df.columns, "chunk")


def pack_batches(df: DataFrame, keys: list[str], order: str, size: Column, most: int, slice_envelopes: int = 10_000) -> DataFrame:
    """Adds bytes and envelope: rows of a key in order, each envelope as full as most bytes allow; larger rows go.

    A key with more than slice_envelopes envelopes' bytes is dealt by a hash of order into slices that are packed
    apart; envelope is slice * 2^32 + number.
    """
    rows = df.withColumn("bytes", size.cast("long")).where(F.col("bytes") <= most)
    sizes = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.sum("bytes") / (most * slice_envelopes)), F.lit(1)).alias("_slices"))
    dealt = null_safe_join(rows, sizes, keys).withColumn("_slice", F.pmod(F.xxhash64(order), F.col("_slices"))).drop("_slices")
    group = [*keys, "_slice"]

    def task(batches):
        last, used, number = None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(zip(*(b.column(k).to_pylist() for k in group)), b.column("bytes").to_pylist()):
                if g != last:
                    last, used, number = g, 0, 0
                if used + n > most:
                    used, number = 0, number + 1
                used += n
                out.append(g[-1] << 32 | number)
            yield b.append_column("envelope", pa.array(out, pa.int64()))

    packed = dealt.repartition(*group).sortWithinPartitions(*group, order)
    return packed.mapInArrow(task, StructType([*packed.schema.fields, StructField("envelope", LongType())])).drop("_slice")


def first_points(df: DataFrame, group: list[str], x: str, t: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(x))).where(F.col("_n") <= t).drop("_n")


def threshold_release(buffer: DataFrame, keys: list[str], threshold: int, disposal_days: int, today: int) -> DataFrame:
    """Adds action: release when a key holds at least threshold rows, else dispose of rows older than disposal_days, else hold.

    Counts come from an aggregate joined back, so that a key with very many rows is not gathered in one task.
    """
    sizes = buffer.groupBy(*keys).agg(F.count("*").alias("buffered"))
    action = F.when(F.col("buffered") >= threshold, "release").when(F.lit(today) - F.col("arrival_day") > disposal_days, "dispose").otherwise("hold")
    return null_safe_join(buffer, sizes, keys).withColumn("action", action)


def receive(envelopes: DataFrame, arrival_day: int) -> DataFrame:
    """envelopes(envelope_id, env_board, batches array of (board, metric_id, observations)) to rows; empty or metadata-less ones go."""
    batches = envelopes.select("envelope_id", "env_board", F.explode("batches").alias("b")).where("b.metric_id IS NOT NULL")
    rows = batches.select("envelope_id", "env_board", F.col("b.board").alias("board"), F.col("b.metric_id").alias("metric_id"), F.explode("b.observations").alias("obs_id"))
    return merge_profile(rows, ["board"]).withColumn("arrival_day", F.lit(arrival_day))
