"""Encoding of client values as the registry says: one plan in which every parameter is a column of the joined row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checks import ENCODABLE, METRIC
from .encoding import assign_cohort, bloom_bits, drawn_bits, let, point_y
from .rows import PROFILE

BACKENDS = ("LEGACY", "V1")
VALUES = ("s", "i", "idx", "d")
TAG = {"string": "s", "int": "i", "index": "x"}  # before the value in what a threshold encoding seals


def local_day(ts: str, policy: str, zone: str) -> Column:
    """Day index by a metric's policy: UTC, or the client's zone; null for another policy."""
    return F.when(F.col(policy) == "UTC", S.day_index(ts)).when(F.col(policy) == "LOCAL", F.date_diff(F.to_date(F.from_utc_timestamp(F.col(ts), F.col(zone))), F.lit("1970-01-01").cast("date")))


def _registered(values: DataFrame, metrics: DataFrame, parts: DataFrame, encodings: DataFrame) -> DataFrame:
    """values with the rows of their metric, part and encoding (null where there is none)."""
    of_metric = parts.groupBy(*METRIC).agg(F.count("*").alias("n_parts"), F.min("part_name").alias("only_part"))
    metric = metrics.select("customer_id", "project_id", F.col("id").alias("metric_id"), "time_zone_policy", "profile_fields", "backend", F.lit(True).alias("known")).join(of_metric, METRIC, "left")
    rows = values.join(metric, METRIC, "left")
    rows = rows.withColumn("part_name", F.when((F.col("part_name") == "") & (F.col("n_parts") == 1), F.col("only_part")).otherwise(F.col("part_name")))
    rows = rows.join(parts.select(*METRIC, "part_name", "data_type"), [*METRIC, "part_name"], "left")
    of = encodings.select("customer_id", "project_id", F.col("id").alias("encoding_config_id"), F.col("kind").alias("payload_kind"), "k", "h", "m", "p", "q", "threshold", "epoch_type", "categories", "first", "last", "num_categories")
    return rows.join(of, ["customer_id", "project_id", "encoding_config_id"], "left")


def n_categories() -> Column:
    """Bits of a basic RAPPOR encoding: its names, or its range of numbers, or its number of indices."""
    return F.coalesce(F.size("categories"), (F.col("last") - F.col("first") + 1).cast("int"), F.col("num_categories").cast("int"))


def category() -> Column:
    """The value's place among the categories of its encoding; null if it is none of them."""
    place = F.when(F.col("categories").isNotNull(), F.nullif(F.array_position("categories", F.col("s")), F.lit(0)) - 1).when(F.col("first").isNotNull(), F.col("i") - F.col("first")).otherwise(F.col("idx"))
    return F.when((place >= 0) & (place < n_categories()), place.cast("int"))


def _reason() -> Column:
    """What is wrong with a row by itself, in an observation of a known metric with all its parts."""
    encodable = F.lit(False)
    for encoding, kinds in ENCODABLE.items():
        encodable |= (F.col("payload_kind") == encoding) & F.col("kind").isin(*kinds)
    value = F.coalesce(*[F.when(F.col("kind") == k, F.col(c).isNotNull()) for k, c in zip(("string", "int", "index", "double"), VALUES)])
    return (
        F.when(F.col("day_index").isNull(), "no day by the time zone policy")
        .when(~F.coalesce(F.col("backend").isin(*BACKENDS), F.lit(False)), "unknown backend")
        .when(F.col("data_type").isNull(), "unknown part")
        .when(~F.coalesce(value, F.lit(False)), "unset value")
        .when(F.col("kind") != F.col("data_type"), "wrong type")
        .when(F.col("payload_kind").isNull(), "unknown encoding")
        .when(~encodable, "type not for this encoding")
        .when((F.col("payload_kind") == "basic_rappor") & F.col("category").isNull(), "no such category")
    )


def encode(values: DataFrame, metrics: DataFrame, parts: DataFrame, encodings: DataFrame, salt: str) -> DataFrame:
    """One row per value: what a client sends for it, or the reason why its whole observation is rejected.

    values(obs_id, client_id, customer_id, project_id, metric_id, part_name, encoding_config_id, ts, zone, profile
    fields, kind, s, i, idx, d). An observation is encoded whole or not at all; ``reason`` is then set on all its rows
    and the payload null. The only shuffle of values is that by observation.

    Payload by kind: noop (s, i, idx, d), basic_rappor (set_bits), rappor (cohort, set_bits), threshold (epoch,
    ciphertext, point_x, point_y).
    """
    rows = _registered(values, metrics, parts, encodings).withColumn("day_index", local_day("ts", "time_zone_policy", "zone")).withColumn("category", category())
    whole = W.partitionBy(*METRIC, "obs_id")
    rows = rows.withColumn("reason", _reason()).withColumns({"n_sent": F.count("*").over(whole), "reason": F.min("reason").over(whole)})
    complete = F.coalesce("n_sent", F.lit(0)) == F.coalesce("n_parts", F.lit(0))  # all rows of an observation have one n_parts
    rows = rows.withColumn("reason", F.when(F.col("known").isNull(), "unknown metric").when(~complete, "wrong number of parts").otherwise(F.col("reason")))
    good = F.col("reason").isNull()
    kind = F.when(good, F.col("payload_kind"))
    rows = rows.withColumns({f: F.when(F.array_contains("profile_fields", f), F.col(f)) for f in PROFILE if f in rows.columns})
    rows = rows.withColumn("random_id", F.when(good, F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.lit("id"), *METRIC, "obs_id"), 256), 1, 16)))
    key = F.concat_ws("|", F.col("obs_id").cast("string"), "part_name")
    # RAPPOR: the bits of the value, each drawn anew; both kinds share one draw of k bits
    cohort = F.when(kind == "rappor", assign_cohort("client_id", F.col("m"), salt))
    own = lambda c: F.when(kind == "basic_rappor", F.array("category")).when(kind == "rappor", bloom_bits("s", c, F.col("k"), F.col("h")))
    rows = rows.select("*", F.inline(F.array(let(cohort, lambda c: F.struct(c.alias("cohort"), own(c).alias("_own"))))))
    bits = F.when(kind == "basic_rappor", n_categories()).when(kind == "rappor", F.col("k").cast("int"))
    begin = F.when(kind.isin("basic_rappor", "rappor"), F.concat_ws("|", F.lit(salt), key))
    rows = rows.withColumn("set_bits", drawn_bits(begin, "_own", bits, F.col("p").cast("double"), F.col("q").cast("double")))
    # threshold: one secret a value and epoch, one point a client
    epoch = F.when(kind == "threshold", F.coalesce(*[F.when(F.col("epoch_type") == e, S.epoch_index("day_index", e)) for e in (S.DAY, S.WEEK, S.MONTH)]))
    plain = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(f"{TAG[k]}:"), F.col(c).cast("string"))) for k, c in zip(TAG, VALUES)])
    secret = F.when(epoch.isNotNull(), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *METRIC, "part_name", epoch.cast("string"), F.col("threshold").cast("string"), plain), 256), 1, 30))
    rows = rows.withColumn("epoch", epoch).withColumn("_plain", plain).withColumn("_secret", secret)
    rows = rows.withColumn("point_x", F.when(F.col("_secret").isNotNull(), F.substring(F.sha2(F.concat_ws("|", F.lit("client"), F.col("client_id").cast("string"), F.col("_secret")), 256), 1, 30)))
    sealed = F.expr("CASE WHEN _secret IS NOT NULL THEN hex(aes_encrypt(encode(_plain, 'UTF-8'), unhex(sha2(concat('key|', _secret), 256)), 'GCM', 'DEFAULT', unhex('000000000000000000000000'))) END")
    rows = rows.withColumn("ciphertext", sealed).withColumn("point_y", point_y("_secret", "point_x", "threshold"))
    rows = rows.withColumns({c: F.when(kind == "noop", F.col(c)) for c in VALUES})
    profile = [f for f in PROFILE if f in rows.columns]
    return rows.select("obs_id", "client_id", *METRIC, "part_name", "encoding_config_id", "random_id", "day_index", "backend", *profile, kind.alias("payload_kind"), "kind", *VALUES, "cohort", "set_bits", "epoch", "ciphertext", "point_x", "point_y", "reason")
