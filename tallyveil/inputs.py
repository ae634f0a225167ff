"""Working tables that the queries derive from the given ones, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "obs": """SELECT event_id AS obs_id, user_id AS client_id, CAST(1 AS BIGINT) AS customer_id, CAST(1 AS BIGINT) AS project_id,
        1 + user_id % 3 AS metric_id, DAYOF(ts) AS day_index, event_id AS random_id, STAMP(ts) AS ts, event_type AS s,
        CAST(floor(value) AS BIGINT) AS i, value AS d, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS idx,
        concat('board', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS VARCHAR(20))) AS board,
        CASE WHEN event_id % 3 = 0 THEN 'threshold' WHEN event_id % 3 = 1 THEN 'basic_rappor' ELSE 'noop' END AS payload_kind,
        event_id % 5 AS encoding_config_id, event_id % 4 AS build_level FROM {events}""",
    "tall": """SELECT obs_id, 'type' AS part_name, CASE WHEN obs_id % 11 = 0 THEN 'int' ELSE 'string' END AS kind, 'noop' AS encoding, s AS value FROM {obs}
        UNION ALL SELECT obs_id, 'amount', 'int', CASE WHEN obs_id % 13 = 0 THEN 'rappor' ELSE 'noop' END, CAST(i AS VARCHAR(20)) FROM {obs} WHERE obs_id % 7 <> 0""",
    "metrics": """SELECT CAST(n_regionkey + 1 AS BIGINT) AS customer_id, CAST(100 * (n_nationkey % 2) + 1 AS BIGINT) AS project_id, CAST(n_nationkey % 20 AS BIGINT) AS id,
        n_name AS name, CASE n_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN '2024/06/01' WHEN 2 THEN 'soon' WHEN 3 THEN '2024/02/15' WHEN 4 THEN '2029/01/01' ELSE '2023/12/31' END AS expires_after,
        n_nationkey % 4 AS max_build_level FROM {nation}""",
    "encodings": """SELECT CAST(1 AS BIGINT) AS customer_id, CAST(1 AS BIGINT) AS project_id, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'basic_rappor' ELSE 'noop' END AS kind,
        p_size * 8 AS k, p_size % 10 AS h, p_size * 40 AS m, (p_size % 12) / 10.0 AS p, (p_size % 7) / 6.0 AS q, CASE WHEN p_size % 9 = 0 THEN 0.5 ELSE 0.0 END AS f,
        (p_size - 3) * 50000 AS threshold, p_size - 10 AS first, p_size * 25 AS last, p_size * 30 AS num_categories,
        CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END AS value_kind, concat(p_brand, ',', p_type, ',', CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END) AS names FROM {part}""",
    "parts": """SELECT CAST(p_partkey % 20 AS BIGINT) AS metric_id, CASE WHEN p_size % 4 = 0 THEN concat('1', p_name) WHEN p_size % 4 = 1 THEN concat(p_name, '!') ELSE p_name END AS part_name,
        CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END AS data_type, p_partkey FROM {part}""",
    "reports": """SELECT s_suppkey AS id, CAST(s_nationkey % 5 + 1 AS BIGINT) AS customer_id, CAST(100 * (s_suppkey % 2) + 1 AS BIGINT) AS project_id, CAST(s_nationkey AS BIGINT) AS metric_id,
        CASE s_suppkey % 3 WHEN 0 THEN 'HISTOGRAM' WHEN 1 THEN 'JOINT' ELSE 'RAW_DUMP' END AS report_type, s_suppkey % 4 AS n_variables, s_suppkey % 30 AS finalization_days,
        s_suppkey % 2 = 0 AS has_export, s_suppkey % 3 = 0 AS has_serialization, s_suppkey % 5 <> 0 AS has_location FROM {supplier}""",
    "report_events": """SELECT o_custkey AS report_id, o_orderkey AS stamp, CASE o_orderstatus WHEN 'O' THEN 'IN_PROGRESS' WHEN 'F' THEN 'COMPLETED' ELSE 'TERMINATED' END AS state,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS message FROM {orders}""",
    "meta": """SELECT c_custkey AS report_id, CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS request_id, c_custkey % 3 AS position, CASE WHEN c_custkey % 3 = 2 THEN 'JOINT' ELSE 'HISTOGRAM' END AS report_type,
        c_nationkey AS config_id, c_acctbal AS created FROM {customer}""",
    "history": """SELECT o_custkey % 50 AS config_id, 19740 + o_orderkey % 60 AS day, CASE WHEN o_orderkey % 5 <> 0 THEN 'TERMINATED' WHEN o_orderstatus = 'O' THEN 'IN_PROGRESS' WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'TERMINATED' END AS state, o_orderkey % 7 = 0 AS one_off FROM {orders}""",
    "configs": "SELECT DISTINCT o_custkey % 50 AS config_id, o_custkey % 50 % 21 AS finalization_days FROM {orders}",
    # a registry of ten metrics with one to three parts and fifteen encodings of every kind, and values that mostly fit it
    "reg_metrics": """SELECT CAST(1 AS BIGINT) AS customer_id, CAST(1 AS BIGINT) AS project_id, CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
        CASE WHEN n_nationkey = 9 THEN 'NONE' WHEN n_nationkey % 2 = 0 THEN 'UTC' ELSE 'LOCAL' END AS time_zone_policy,
        split(CASE n_nationkey % 3 WHEN 0 THEN 'board_name' WHEN 1 THEN 'os,arch' ELSE 'none' END, ',') AS profile_fields,
        CASE WHEN n_nationkey = 10 THEN 'OTHER' WHEN n_nationkey % 2 = 0 THEN 'V1' ELSE 'LEGACY' END AS backend FROM {nation} WHERE n_nationkey BETWEEN 1 AND 10""",
    "reg_parts": """SELECT customer_id, project_id, id AS metric_id, 'type' AS part_name, 'string' AS data_type FROM {reg_metrics}
        UNION ALL SELECT customer_id, project_id, id, 'amount', 'int' FROM {reg_metrics} WHERE id % 2 = 0
        UNION ALL SELECT customer_id, project_id, id, 'slot', 'index' FROM {reg_metrics} WHERE id % 3 = 0""",
    "reg_encodings": """SELECT CAST(1 AS BIGINT) AS customer_id, CAST(1 AS BIGINT) AS project_id, CAST(n_nationkey AS BIGINT) AS id,
        CASE n_nationkey % 5 WHEN 1 THEN 'noop' WHEN 2 THEN 'basic_rappor' WHEN 3 THEN 'rappor' WHEN 4 THEN 'threshold' ELSE 'basic_rappor' END AS kind,
        CASE n_nationkey WHEN 3 THEN 512 WHEN 8 THEN 16 WHEN 13 THEN 24 END AS k, CASE WHEN n_nationkey % 5 = 3 THEN 2 END AS h, CASE n_nationkey WHEN 3 THEN 2 WHEN 8 THEN 11 WHEN 13 THEN 16 END AS m,
        CASE n_nationkey % 3 WHEN 0 THEN CAST(0.125 AS DOUBLE) WHEN 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p, CASE n_nationkey % 4 WHEN 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS q,
        CASE n_nationkey WHEN 4 THEN 3 WHEN 9 THEN 2 WHEN 14 THEN 4 END AS threshold, CASE n_nationkey % 3 WHEN 0 THEN 'DAY' WHEN 1 THEN 'WEEK' ELSE 'MONTH' END AS epoch_type,
        CASE WHEN n_nationkey % 5 = 2 THEN split('click,error,purchase,signup,view', ',') END AS categories,
        CASE n_nationkey WHEN 5 THEN CAST(0 AS BIGINT) WHEN 15 THEN CAST(2 AS BIGINT) END AS first, CASE n_nationkey WHEN 5 THEN CAST(11 AS BIGINT) WHEN 15 THEN CAST(10 AS BIGINT) END AS last,
        CASE WHEN n_nationkey = 10 THEN 10 END AS num_categories FROM {nation} WHERE n_nationkey BETWEEN 1 AND 15""",
    "reg_base": """SELECT obs_id, client_id, CAST(1 AS BIGINT) AS customer_id, CAST(1 AS BIGINT) AS project_id, CAST(1 + obs_id % 11 AS BIGINT) AS metric_id, ts,
        CASE WHEN client_id % 2 = 0 THEN '+05:00' ELSE '-08:00' END AS zone, concat('os', CAST(client_id % 2 AS VARCHAR(20))) AS os, 'x64' AS arch, board AS board_name, 'box' AS product_name, s, i, idx FROM {obs}""",
    "reg_values": """SELECT obs_id, client_id, customer_id, project_id, metric_id, ts, zone, os, arch, board_name, product_name, CASE WHEN metric_id % 6 = 1 THEN '' ELSE 'type' END AS part_name,
        CASE WHEN obs_id % 23 = 0 THEN CAST(99 AS BIGINT) WHEN metric_id = 8 AND obs_id % 2 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(1 + (metric_id - 1) % 4 + 5 * (metric_id % 3) AS BIGINT) END AS encoding_config_id,
        CASE WHEN obs_id % 29 = 0 THEN 'int' ELSE 'string' END AS kind, s, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS d FROM {reg_base}
        UNION ALL SELECT obs_id, client_id, customer_id, project_id, metric_id, ts, zone, os, arch, board_name, product_name, 'amount',
        CAST(CASE metric_id % 8 WHEN 0 THEN 5 WHEN 2 THEN 15 WHEN 4 THEN 1 ELSE 5 END AS BIGINT), 'int', CAST(NULL AS VARCHAR(20)), i % 12, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM {reg_base} WHERE metric_id % 2 = 0 AND obs_id % 17 <> 0
        UNION ALL SELECT obs_id, client_id, customer_id, project_id, metric_id, ts, zone, os, arch, board_name, product_name, 'slot',
        CAST(CASE WHEN metric_id % 2 = 1 THEN 10 ELSE 6 END AS BIGINT), 'index', CAST(NULL AS VARCHAR(20)), CAST(NULL AS BIGINT), CASE WHEN obs_id % 31 = 0 THEN CAST(NULL AS BIGINT) ELSE idx % 10 END, CAST(NULL AS DOUBLE) FROM {reg_base} WHERE metric_id % 3 = 0""",
    # a report of each part, on different days and by different fields; that of metric 8 mixes encodings, 71 has no candidates
    "reg_reports": """SELECT metric_id * 10 + CASE part_name WHEN 'type' THEN 1 WHEN 'amount' THEN 2 ELSE 3 END AS report_id, customer_id, project_id, metric_id, part_name, CAST(19720 + metric_id % 4 AS INT) AS first_day, CAST(19790 - metric_id AS INT) AS last_day,
        split(CASE metric_id % 4 WHEN 0 THEN 'os' WHEN 3 THEN 'board_name' ELSE 'none' END, ',') AS report_fields FROM {reg_parts}""",
    "reg_buckets": """SELECT *, CASE WHEN metric_id = 4 AND part_name = 'amount' THEN 'linear' END AS bucket_kind, CAST(1 AS BIGINT) AS floor, 4 AS n_buckets, 2 AS step, 0 AS multiplier FROM {reg_parts}""",
    "reg_labels": "SELECT report_id, CAST(n_nationkey AS BIGINT) AS idx, n_name AS label FROM {reg_reports} JOIN {nation} ON n_nationkey % 3 <> 0 WHERE part_name = 'slot'",
    "reg_candidates": "SELECT DISTINCT CAST(31 AS BIGINT) AS report_id, event_type AS candidate FROM {events}",
    "labels_dim": "SELECT CAST(n_nationkey * 5 AS BIGINT) AS idx, n_name AS label FROM {nation}",
}

_PLACE = re.compile(r"\{(\w+)\}")
_STAMP = re.compile(r"STAMP\((\w+)\)")
_DAY = re.compile(r"DAYOF\(([\w.]+)\)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a working table over given ones."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _DAY.sub(r"CAST(date_diff(CAST(\1 AS DATE), DATE'1970-01-01') AS BIGINT)", TABLES[name])
    text = _STAMP.sub(r"CAST(\1 AS TIMESTAMP)", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(_PLACE.findall(text))})


def duck(text: str) -> str:
    """DuckDB text with {name} places: working tables become subqueries."""
    while _PLACE.search(text):
        text = _PLACE.sub(lambda m: f"({TABLES[m[1]]})" if m[1] in TABLES else m[1], text)
    text = _STAMP.sub(r"\1", text)
    return _DAY.sub(r"date_diff('day', DATE '1970-01-01', CAST(\1 AS DATE))", text)
