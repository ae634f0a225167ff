"""Registered queries: one per operator of the blueprint, each over whole tables, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .inputs import duck, table
from .operators import checks, encoding, estimate, joint, registry, rows
from .plans import compiled, joint_report, reports
from .sources import tables
from .streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "r1_basic_rappor_report"
TODAY = 19750
KINDS = ["click", "error", "purchase", "signup", "view"]
KINDS_SQL = "['click','error','purchase','signup','view']"


def query(sql: str | None = None):
    """Registers f(t), where t(name) gives a table, under f's name."""

    def register(f: Callable):
        def run(spark, sf_dir):
            return f(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def joined(name: str, out: str | None = None):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(out or name)


def _uniform_sql(salt: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{salt}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


# sources


@query("SELECT obs_id, day_index, s, board FROM {obs} WHERE metric_id = 2 AND day_index BETWEEN 19725 AND 19740")
def s1_scan_observations(t):
    return tables.scan_observations(t("obs"), 1, 1, 2, 19725, 19740, ["obs_id", "day_index", "s", "board"])


@query("SELECT random_id, s, i FROM {obs} WHERE obs_id % 4 <> 0")
def s2_append_observations(t):
    cols = ["customer_id", "project_id", "metric_id", "day_index", "random_id", "s", "i"]
    obs = t("obs")
    stored = obs.where("obs_id % 4 = 0").select(*cols)
    return tables.append_observations(obs.select(*cols).unionByName(obs.where("obs_id % 3 = 0").select(*cols)), stored).select("random_id", "s", "i")


@query("SELECT client_id::INTEGER AS user_id, s AS name, board AS city, hour(ts)::INTEGER AS hour, (i % 11)::INTEGER AS rating, 'q, ' || s AS help_query, 'http://x/' || obs_id AS url FROM {obs}")
def s3_entries_round_trip(t):
    obs = t("obs")
    entries = obs.selectExpr("CAST(client_id AS INT) AS user_id", "s AS name", "board AS city", "hour(ts) AS hour", "CAST(i % 11 AS INT) AS rating", "concat('q, ', s) AS help_query", "concat('http://x/', obs_id) AS url")
    path = streams.shared_path(obs.sparkSession, "entries")
    tables.write_entries(entries, path)
    return tables.read_entries(obs.sparkSession, path)


@query("SELECT k, CAST(h AS INTEGER) AS h, m, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q, CAST(f AS DOUBLE) AS f FROM {encodings}")
def s4_rappor_params(t):
    rows_ = t("encodings").select("k", "h", "m", F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q"), F.col("f").cast("double").alias("f"))
    path = streams.shared_path(rows_.sparkSession, "params")
    rows_.write.csv(path, header=True)
    return tables.read_rappor_params(rows_.sparkSession, path)


@query("SELECT DISTINCT p_name AS candidate FROM part")
def s5_candidates(t):
    names = t("part").select("p_name").distinct()
    path = streams.shared_path(names.sparkSession, "candidates")
    names.write.text(path)
    return tables.read_candidates(names.sparkSession, path)


@query("""SELECT stamp, report_id FROM (SELECT *, bool_or(stamp % 97 = 0) OVER (PARTITION BY report_id) AS mixed FROM {report_events}) WHERE report_id % 2 = 0 AND report_id % 3 = 0 AND report_id % 5 <> 0 AND NOT mixed""")
def s8_store_report(t):
    """Reports in progress and in store; raw dumps and reports with a row of another type are refused."""
    events = t("report_events").selectExpr("report_id", "stamp", "CASE WHEN stamp % 97 = 0 THEN 'JOINT' ELSE 'HISTOGRAM' END AS row_type")
    kinds = "CASE WHEN report_id % 5 = 0 THEN 'RAW_DUMP' ELSE 'HISTOGRAM' END AS report_type"
    meta = events.select("report_id").distinct().selectExpr("report_id", "report_id % 2 = 0 AS in_store", "CASE WHEN report_id % 3 = 0 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS state", kinds)
    path = streams.shared_path(events.sparkSession, "reports")
    tables.store_report(events, meta, path)
    return tables.stored_rows(events.sparkSession, path, "stamp long, report_id long")


@query("SELECT *, count(*) OVER (PARTITION BY customer_id, project_id, id) > 1 OR id = 0 AS bad_key FROM {metrics}")
def s6_load_registry(t):
    return tables.load_registry(t("metrics"))


@query("SELECT customer_id, project_id, id, name FROM {metrics}")
def s7_merge_registries(t):
    m = t("metrics").select("customer_id", "project_id", "id", "name")
    return tables.merge_registries([m.where("project_id = 1"), m.where("project_id != 1")])


@query("SELECT report_id, stamp, state, config_id, created FROM {report_events} LEFT JOIN (SELECT report_id, config_id, created FROM {meta}) USING (report_id) WHERE report_id = 7")
def s9_read_report(t):
    return tables.read_report(t("report_events").select("report_id", "stamp", "state"), t("meta").select("report_id", "config_id", "created"), 7)


@query("SELECT report_id, config_id, created FROM {meta} WHERE config_id = 3 AND created >= 0 AND created < 5000")
def s10_query_reports(t):
    return tables.query_reports(t("meta"), 3, 0, 5000).select("report_id", "config_id", "created")


@query("""SELECT CASE WHEN n = 0 THEN 'type,count' ELSE '"' || s || '",' || c END AS value FROM (SELECT 0 AS n, NULL AS s, NULL AS c UNION ALL SELECT 1, s, CAST(count(*) AS VARCHAR) FROM {obs} GROUP BY s)""")
def s11_export_lines(t):
    rows_ = t("obs").groupBy("s").agg(F.count("*").alias("n")).withColumn("_order", F.xxhash64("s"))
    return tables.export_lines(rows_, "type,count", reports.csv_line([S.csv_string("s"), F.col("n").cast("string")]))


@query("""SELECT 0 AS place, 'type,day,count' AS value UNION ALL SELECT row_number() OVER (ORDER BY day_index, s), '"' || s || '",' || day_index || ',' || n FROM (SELECT s, day_index, count(*) AS n FROM {obs} GROUP BY ALL)""")
def s11_export_csv(t):
    """A report written in parts, and its lines in their order."""
    spark = t("region").sparkSession
    path = streams.shared_path(spark, "export")
    body = t("obs").groupBy("s", "day_index").agg(F.count("*").alias("n")).withColumn("_order", F.struct("day_index", "s"))
    tables.export_csv(body, "type,day,count", reports.csv_line([S.csv_string("s"), F.col("day_index").cast("string"), F.col("n").cast("string")]), [path])
    return tables.read_export(spark, path)


@query("SELECT metric_id, day_index, count(*) AS n, count(DISTINCT random_id) AS ids FROM {obs} WHERE metric_id <> 2 AND obs_id % 10 <> 3 GROUP BY ALL")
def s12_delete_observations(t):
    """Stored in two batches that overlap; then a metric's folders go, and some rows of other partitions."""
    spark = t("region").sparkSession
    path, obs = streams.shared_path(spark, "store"), t("obs").select(*tables.OBSERVATION_KEY, "s", "obs_id")
    tables.write_observations(obs.where("obs_id % 3 > 0"), path)
    tables.write_observations(obs.where("obs_id % 3 < 2"), path)
    tables.drop_partitions(spark, path, customer_id=1, project_id=1, metric_id=2)
    tables.delete_rows(spark, path, F.col("obs_id") % 10 == 3, tables.PARTITIONS, streams.shared_path(spark, "rest"))
    return spark.read.parquet(path).groupBy(F.col("metric_id").cast("long").alias("metric_id"), F.col("day_index").cast("long").alias("day_index")).agg(F.count("*").alias("n"), F.count_distinct("random_id").alias("ids"))


@query("SELECT obs_id, s, (SELECT count(*) FROM {obs} WHERE obs_id > 100) > 50 AS has_more FROM {obs} WHERE obs_id > 100 ORDER BY obs_id LIMIT 50")
def s13_read_page(t):
    return tables.read_page(t("obs").select("obs_id", "s"), "obs_id", 100, 50)


@query("SELECT least(count(*), 5000) AS n FROM {obs}")
def s14_count_capped(t):
    return tables.count_capped(t("obs"), 5000)


@query("SELECT obs_id, s FROM {obs} ORDER BY obs_id LIMIT 10")
def s14_peek(t):
    return tables.peek(t("obs").select("obs_id", "s"), "obs_id", 10)


# filters and checks

VALUES_SQL = """SELECT obs_id, CASE WHEN obs_id % 4 = 3 THEN 2 ELSE 1 END AS customer_id, CASE WHEN obs_id % 17 = 0 THEN 99 ELSE metric_id END AS metric_id, CASE WHEN obs_id % 5 = 0 THEN '' WHEN obs_id % 19 = 0 THEN 'other' ELSE 'type' END AS part_name,
 CASE WHEN obs_id % 7 = 0 THEN 'int' ELSE 'string' END AS kind, obs_id % 23 <> 0 AS is_set FROM {obs}"""
REASON_SQL = f"""SELECT obs_id, reason FROM (SELECT obs_id, CASE WHEN metric_id = 99 THEN 'unknown metric' WHEN metric_id = 3 AND customer_id = 1 THEN 'wrong number of parts'
 WHEN part_name NOT IN ('', 'type') THEN 'unknown part' WHEN NOT is_set THEN 'unset value' WHEN kind <> CASE customer_id WHEN 1 THEN 'string' ELSE 'int' END THEN 'wrong type' END AS reason FROM ({VALUES_SQL}))"""


def _judged(t):
    # customers 1 and 2 have metrics of the same ids with other parts
    values = t("obs").selectExpr("obs_id", "CAST(CASE WHEN obs_id % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) AS customer_id", "project_id", "CASE WHEN obs_id % 17 = 0 THEN 99 ELSE metric_id END AS metric_id", "CASE WHEN obs_id % 5 = 0 THEN '' WHEN obs_id % 19 = 0 THEN 'other' ELSE 'type' END AS part_name", "CASE WHEN obs_id % 7 = 0 THEN 'int' ELSE 'string' END AS kind", "obs_id % 23 != 0 AS is_set")
    registry = t("obs").select("customer_id", "project_id", "metric_id").distinct()
    key = ["customer_id", "project_id", "metric_id"]
    parts = registry.selectExpr(*key, "'type' AS part_name", "'string' AS data_type").unionByName(registry.where("metric_id = 3").selectExpr(*key, "'second' AS part_name", "'int' AS data_type"))
    parts = parts.unionByName(registry.selectExpr("customer_id + 1 AS customer_id", "project_id", "metric_id", "'type' AS part_name", "'int' AS data_type"))
    return checks.validate_values(values, parts)


@query(REASON_SQL)
def f1_validate_values(t):
    return _judged(t).select("obs_id", "reason")


@query("SELECT obs_id, i % 14 < 12 AS valid FROM {obs} WHERE i >= 0")
def f2_valid_distributions(t):
    dist = t("obs").where("i >= 0").withColumn("dist", F.create_map((F.col("i") % 14).cast("int"), F.lit(1), F.lit(-1), F.lit(0)))
    dist = dist.withColumn("dist", F.map_filter("dist", lambda k, v: v > 0))
    return checks.valid_distributions(dist, 10).select("obs_id", "valid")


@query("""SELECT obs_id, encoding, kind, (encoding = 'noop') OR (encoding = 'threshold' AND kind IN ('string', 'blob')) OR (encoding = 'rappor' AND kind = 'string') OR (encoding = 'basic_rappor' AND kind IN ('string', 'int', 'index')) AS valid
 FROM (SELECT obs_id, CASE obs_id % 4 WHEN 0 THEN 'noop' WHEN 1 THEN 'threshold' WHEN 2 THEN 'rappor' ELSE 'basic_rappor' END AS encoding, CASE idx % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'index' WHEN 3 THEN 'double' ELSE 'blob' END AS kind FROM {obs})""")
def f3_valid_encoding_types(t):
    df = t("obs").selectExpr("obs_id", "CASE obs_id % 4 WHEN 0 THEN 'noop' WHEN 1 THEN 'threshold' WHEN 2 THEN 'rappor' ELSE 'basic_rappor' END AS encoding", "CASE idx % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'index' WHEN 3 THEN 'double' ELSE 'blob' END AS kind")
    return checks.valid_encoding_types(df)


@query("SELECT o.obs_id, e.kind AS encoding_kind FROM {obs} o JOIN {encodings} e ON e.id = o.encoding_config_id WHERE e.kind = o.payload_kind")
def f4_consistent_encoding(t):
    return rows.consistent_encoding(t("obs"), t("encodings").select("customer_id", "project_id", "id", "kind")).select("obs_id", "encoding_kind")


@query("SELECT obs_id, NULL AS board_name, 'os' || CAST(obs_id % 2 AS VARCHAR) AS os FROM {obs}")
def f5_project_profile(t):
    df = t("obs").select("obs_id", F.col("board").alias("board_name"), F.concat(F.lit("os"), (F.col("obs_id") % 2).cast("string")).alias("os"))
    return rows.project_profile(df, ["os"])


@query("SELECT obs_id, CASE WHEN obs_id % 3 = 0 THEN 'env' ELSE board END AS board FROM {obs}")
def f6_merge_profile(t):
    df = t("obs").select("obs_id", "board", F.when(F.col("obs_id") % 3 == 0, "env").when(F.col("obs_id") % 3 == 1, "").alias("env_board"))
    return rows.merge_profile(df, ["board"])


@query("SELECT obs_id, day_index FROM {obs} WHERE day_index BETWEEN 19730 AND 19735")
def f7_day_range(t):
    return rows.day_range(t("obs"), 19730, 19735).select("obs_id", "day_index")


@query("SELECT day_index, count(*) AS n FROM {obs} WHERE day_index BETWEEN 19743 AND 19749 GROUP BY day_index")
def f8_relative_day_range(t):
    return rows.relative_day_range(t("obs"), TODAY, -7, -1).groupBy("day_index").agg(F.count("*").alias("n"))


@query("SELECT a.obs_id, a.value AS type, b.value AS amount FROM {tall} a JOIN {tall} b USING (obs_id) WHERE a.part_name = 'type' AND a.kind = 'string' AND b.part_name = 'amount' AND b.encoding = 'noop'")
def f9_raw_dump(t):
    return rows.raw_dump(t("tall"), {"type": "string", "amount": "int"})


@query("SELECT idx, label, n AS count_estimate FROM (SELECT idx, count(*) * (idx % 2) AS n FROM {obs} GROUP BY idx) LEFT JOIN {labels_dim} USING (idx) WHERE NOT (label IS NULL AND n < 1e-4)")
def f10_suppress_empty(t):
    df = t("obs").groupBy("idx").agg((F.count("*") * (F.col("idx") % 2)).alias("count_estimate")).withColumn("kind", F.lit("index"))
    return rows.suppress_empty(rows.with_labels(df, t("labels_dim"))).select("idx", "label", "count_estimate")


@query("SELECT obs_id, lower(trim(s)) AS s FROM {obs}")
def f11_strip_identifiers(t):
    return rows.strip_identifiers(t("obs").select("obs_id", "client_id", "s"), ["client_id"], ["s"])


@query(f"SELECT obs_id FROM {{obs}} WHERE {_uniform_sql('drop', 'obs_id')} >= 0.3")
def f12_drop_observations(t):
    return rows.drop_observations(t("obs"), 0.3, "drop").select("obs_id")


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 33 <= 1000")
def f13_limit_size(t):
    return rows.limit_observation_size(t("documents"), "text", 32, 1000).select("doc_id")


@query("SELECT CASE WHEN s IN ('click', 'view') THEN s ELSE 'unknown' END AS route, count(*) AS n FROM {obs} GROUP BY 1")
def f14_route_backend(t):
    return rows.route_backend(t("obs").withColumn("backend", F.col("s")), ["click", "view"]).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT obs_id FROM {obs} WHERE obs_id % 6 <> 0 AND obs_id % 5 <> 0")
def f15_drop_blank_reports(t):
    df = t("obs").select("obs_id", F.when(F.col("obs_id") % 6 != 0, F.col("s")).alias("v1"), F.when(F.col("obs_id") % 5 != 0, F.col("board")).otherwise("").alias("v2"))
    return rows.drop_blank_reports(df, "v1", "v2").select("obs_id")


@query("SELECT o.obs_id FROM {obs} o JOIN {metrics} m ON m.customer_id = 1 + obs_id % 5 AND m.project_id = 1 + 100 * (obs_id % 2) AND m.id = obs_id % 20 WHERE build_level <= max_build_level")
def f16_filter_build_level(t):
    obs = t("obs").selectExpr("obs_id", "build_level", "1 + obs_id % 5 AS customer_id", "1 + 100 * (obs_id % 2) AS project_id", "obs_id % 20 AS metric_id")
    return rows.filter_build_level(obs, t("metrics")).select("obs_id")


@query("SELECT customer_id, project_id, id, count(*) AS n FROM {metrics} GROUP BY ALL HAVING count(*) > 1 OR id = 0")
def v1_duplicate_ids(t):
    return checks.duplicate_ids(t("metrics"))


@query("SELECT id FROM {reports} r WHERE NOT EXISTS (FROM {metrics} m WHERE m.customer_id = r.customer_id AND m.project_id = r.project_id AND m.id = r.metric_id)")
def v2_dangling_reports(t):
    return checks.dangling_reports(t("reports"), t("metrics")).select("id")


@query("""SELECT v.id, CASE WHEN data_type IS NULL THEN 'no such part' WHEN has_labels AND data_type <> 'index' THEN 'labels on a part that is no index' WHEN has_candidates AND data_type <> 'string' THEN 'candidates on a part that is no string' END AS reason
 FROM (SELECT id, customer_id, project_id, metric_id % 20 AS metric_id, CASE WHEN id % 7 = 0 THEN 'other' ELSE 'part' END AS part_name, id % 2 = 0 AS has_labels, id % 3 = 0 AS has_candidates FROM {reports}) v
 LEFT JOIN (SELECT 1 + p_size % 5 AS customer_id, 1 + 100 * (p_size % 2) AS project_id, p_partkey % 20 AS metric_id, 'part' AS part_name, min(CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END) AS data_type FROM part GROUP BY ALL) p USING (customer_id, project_id, metric_id, part_name) WHERE reason IS NOT NULL""")
def v3_invalid_variables(t):
    variables = t("reports").selectExpr("id", "customer_id", "project_id", "metric_id % 20 AS metric_id", "CASE WHEN id % 7 = 0 THEN 'other' ELSE 'part' END AS part_name", "id % 2 = 0 AS has_labels", "id % 3 = 0 AS has_candidates")
    parts = t("part").selectExpr("1 + p_size % 5 AS customer_id", "1 + 100 * (p_size % 2) AS project_id", "p_partkey % 20 AS metric_id", "'part' AS part_name", "CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END AS data_type")
    parts = parts.groupBy("customer_id", "project_id", "metric_id", "part_name").agg(F.min("data_type").alias("data_type"))
    return checks.invalid_variables(variables, parts).select("id", "reason")


@query("SELECT r.id, 'arch' AS missing FROM {reports} r JOIN {metrics} m ON m.customer_id = r.customer_id AND m.project_id = r.project_id AND m.id = r.metric_id WHERE r.id % 2 = 0")
def v4_invalid_profile_fields(t):
    asked = t("reports").withColumn("profile_fields", F.when(F.col("id") % 2 == 0, F.array(F.lit("os"), F.lit("arch"))).otherwise(F.array(F.lit("os"))))
    supplied = t("metrics").withColumn("profile_fields", F.array(F.lit("os"), F.lit("board_name")))
    return checks.invalid_profile_fields(asked, supplied).select("id", F.array_join("missing", ",").alias("missing"))


@query("""SELECT name, CASE WHEN expires_after = '' THEN 'error: missing' WHEN e IS NULL THEN 'error: malformed' WHEN e > DATE '2025-01-10' THEN 'error: more than a year away' WHEN e <= DATE '2024-01-10' THEN 'warning: expired' WHEN e <= DATE '2024-04-10' THEN 'warning: expires soon' END AS problem
 FROM (SELECT *, TRY_CAST(replace(expires_after, '/', '-') AS DATE) AS e FROM {metrics}) WHERE project_id >= 100 AND problem IS NOT NULL""")
def v5_expired_metrics(t):
    return checks.expired_metrics(t("metrics"), "2024-01-10").select("name", "problem")


@query(r"SELECT p_partkey, part_name FROM {parts} WHERE NOT regexp_full_match(part_name, '[a-zA-Z][_a-zA-Z0-9\- ]+')")
def v6_invalid_part_names(t):
    return checks.invalid_part_names(t("parts")).select("p_partkey", "part_name")


@query("SELECT id FROM {encodings} WHERE p < 0 OR p > 1 OR q < 0 OR q > 1 OR p = q OR f <> 0 OR k <= 1 OR k > 1024 OR bit_count(k) <> 1 OR h < 1 OR h > 8 OR h >= k OR m < 1 OR m > 1024")
def v7_invalid_rappor(t):
    return checks.invalid_rappor(t("encodings")).select("id")


@query("""SELECT id FROM {encodings} WHERE (value_kind = 'string' AND len(list_distinct(string_split(names, ','))) < 3) OR (value_kind = 'int' AND (last <= first OR last - first + 1 >= 1024)) OR (value_kind = 'index' AND (num_categories < 1 OR num_categories > 1023))""")
def v8_invalid_basic_rappor(t):
    df = t("encodings").drop("kind").withColumnRenamed("value_kind", "kind").withColumn("categories", F.split("names", ","))
    return checks.invalid_basic_rappor(df).select("id")


@query("SELECT id, threshold FROM {encodings} WHERE threshold < 2 OR threshold >= 1000000")
def v9_invalid_threshold(t):
    return checks.invalid_threshold(t("encodings")).select("id", "threshold")


@query("""SELECT id, CASE WHEN n_variables < 1 THEN 'no variable' WHEN report_type = 'HISTOGRAM' AND n_variables <> 1 THEN 'a histogram has one variable' WHEN report_type = 'JOINT' AND n_variables <> 2 THEN 'a joint report has two variables'
 WHEN finalization_days > 20 THEN 'more than 20 finalization days' WHEN has_export AND NOT (has_serialization AND has_location) THEN 'incomplete export' END AS reason FROM {reports} WHERE reason IS NOT NULL""")
def v10_invalid_report_shape(t):
    return checks.invalid_report_shape(t("reports")).select("id", "reason")


# joins


@query("SELECT obs_id, e.id IS NOT NULL AS found FROM {obs} o LEFT JOIN (SELECT id FROM {encodings} WHERE id < 3) e ON e.id = o.encoding_config_id")
def j1_with_encoding(t):
    e = t("encodings").where("id < 3").select("customer_id", "project_id", "id", "kind")
    good = rows.with_encoding(t("obs"), e).select("obs_id", F.lit(True).alias("found"))
    return good.unionByName(rows.without_encoding(t("obs"), e).select("obs_id", F.lit(False).alias("found")))


@query("SELECT r.id AS report_id, m.name AS metric_name, CAST(r.id % 3 AS VARCHAR) AS part_name FROM {reports} r JOIN {metrics} m ON m.customer_id = r.customer_id AND m.project_id = r.project_id AND m.id = r.metric_id")
def j2_with_report(t):
    variables = t("reports").select(F.col("id").alias("report_id"), F.lit(0).alias("position"), (F.col("id") % 3).cast("string").alias("part_name"))
    return rows.with_report(t("reports"), t("metrics"), variables).select("report_id", "metric_name", "part_name")


@query("SELECT idx, label, count(*) AS n FROM {obs} LEFT JOIN {labels_dim} USING (idx) GROUP BY ALL")
def j3_with_labels(t):
    return rows.with_labels(t("obs").groupBy("idx").agg(F.count("*").alias("n")), t("labels_dim"))


def _bloom_sql(value: str, cohort: str, k: int, h: int) -> str:
    return "list_distinct([" + ", ".join(f"CAST('0x' || substr(sha256({value} || CAST({cohort} AS VARCHAR)), {4 * i + 1}, 4) AS BIGINT) % {k}" for i in range(h)) + "])"


@query(f"SELECT candidate, cohort, bit, cohort * 16 + 15 - bit AS row FROM (SELECT candidate, cohort, unnest({_bloom_sql('candidate', 'cohort', 16, 2)}) AS bit FROM (SELECT DISTINCT p_name AS candidate FROM part), (SELECT unnest(range(4)) AS cohort))")
def j4_candidate_matrix(t):
    return rows.candidate_matrix(t("part").select(F.col("p_name").alias("candidate")).distinct(), 16, 2, 4)


@query("""SELECT s, round(e - a, 6) AS off, round(e - 1.96 * 2, 6) AS low, round(e + 1.96 * 2, 6) AS high FROM (SELECT s, count(*) + 1.5 AS e FROM {obs} GROUP BY s) LEFT JOIN (SELECT s, count(*) AS c FROM {obs} WHERE s <> 'view' GROUP BY s) USING (s), LATERAL (SELECT coalesce(c, 0) AS a)""")
def j5_compare_with_actual(t):
    est = t("obs").groupBy("s").agg((F.count("*") + 1.5).alias("estimate")).withColumn("std_error", F.lit(2.0))
    actual = t("obs").where("s != 'view'").groupBy("s").agg(F.count("*").alias("actual"))
    out = rows.compare_with_actual(est, actual, "s").withColumn("off", F.col("estimate") - F.col("actual"))
    return out.select("s", *r6("off", "low", "high"))


DUE_SQL = f"""SELECT c.config_id, d AS day FROM {{configs}} c, LATERAL (SELECT unnest(range({TODAY} - greatest(30, finalization_days), {TODAY} + 1)) AS d)
 LEFT JOIN (SELECT config_id, day, bool_or(state = 'IN_PROGRESS') AS running, bool_or(state = 'COMPLETED') AS done FROM {{history}} WHERE NOT one_off GROUP BY ALL) h ON h.config_id = c.config_id AND h.day = d
 WHERE NOT coalesce(running, false) AND (d >= {TODAY} - finalization_days OR NOT coalesce(done, false))"""


@query(DUE_SQL)
def j6_due_reports(t):
    return reports.due_daily_reports(t("configs"), t("history"), TODAY)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q < 5 THEN 0 WHEN q >= 45 THEN 5 ELSE (q - 5) // 10 + 1 END AS bucket FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)")
def j7_bucketize(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", S.linear_bucket(F.col("l_quantity").cast("long"), 5, 4, 10).alias("bucket"))


@query("SELECT a.report_id AS joint_id, b.position AS sequence, b.report_id AS marginal_id FROM {meta} a JOIN {meta} b USING (request_id) WHERE a.report_type = 'JOINT' AND b.report_type = 'HISTOGRAM'")
def j8_associated_reports(t):
    return rows.associated_reports(t("meta").withColumnRenamed("position", "sequence")).select("joint_id", "sequence", "marginal_id")


@query("SELECT r AS row, r // 5 AS cohort, r % 5 AS category FROM (SELECT unnest(range(5 * (SELECT count(DISTINCT board) FROM {obs}))) AS r)")
def j9_categorical_map(t):
    m = t("obs").select("board").distinct().count()
    return rows.categorical_map(t("obs").groupBy().agg(F.count("*")), 5, m)


# encodings


@query("SELECT obs_id, s AS value FROM {obs}")
def e1_encode_noop(t):
    return encoding.encode_noop(t("obs"), "s").select("obs_id", "value")


def _draw_sql(salt: str) -> str:
    """Bit j's draw: a quarter of the digest of obs_id and j // 4."""
    return f"(CAST('0x' || substr(sha256('{salt}|' || CAST(obs_id AS VARCHAR) || '|' || CAST(j // 4 AS VARCHAR)), 13 * (j % 4) + 1, 13) AS BIGINT) / 4503599627370496.0)"


def _bits_sql(k: int, index: str, p: float, q: float, salt: str) -> str:
    return f"array_to_string(list_filter(range({k}), lambda j: {_draw_sql(salt)} < CASE WHEN {index} THEN {q} ELSE {p} END), ',')"


@query(f"SELECT obs_id, {_bits_sql(5, f'j = list_position({KINDS_SQL}, s) - 1', 0.2, 0.8, 'basic')} AS set_bits FROM {{obs}}")
def e2_basic_rappor(t):
    return encoding.encode_basic_rappor(t("obs"), "s", KINDS, 0.2, 0.8, "basic").select("obs_id", joined("set_bits"))


def _cohort_sql(m: int, span: int, salt: str) -> str:
    draw = f"CAST('0x' || substr(sha256('{salt}|' || CAST(client_id AS VARCHAR) || '|' || CAST(a AS VARCHAR)), 1, 13) AS BIGINT) % {span}"
    return f"list_filter(list_transform(range(64), lambda a: {draw}), lambda v: v < {m})[1]"


@query(f"SELECT DISTINCT client_id, {_cohort_sql(50, 64, 'cohort')} AS cohort FROM {{obs}}")
def e3_assign_cohort(t):
    return t("obs").select("client_id").distinct().withColumn("cohort", encoding.assign_cohort("client_id", 50, "cohort"))


@query(f"SELECT p_partkey, array_to_string(list_sort({_bloom_sql('p_name', '3', 32, 2)}), ',') AS bits FROM part")
def e4_bloom_bits(t):
    return t("part").select("p_partkey", encoding.bloom_bits("p_name", F.lit(3), 32, 2).alias("b")).select("p_partkey", F.sort_array("b").alias("b")).select("p_partkey", joined("b", "bits"))


@query(f"SELECT obs_id, cohort, {_bits_sql(16, 'list_contains(bloom, j)', 0.1, 0.9, 'rappor')} AS set_bits FROM (SELECT *, {_bloom_sql('s', 'cohort', 16, 2)} AS bloom FROM (SELECT *, {_cohort_sql(8, 8, 'rappor')} AS cohort FROM {{obs}}))")
def e5_encode_rappor(t):
    return encoding.encode_rappor(t("obs"), "s", "client_id", 16, 2, 8, 0.1, 0.9, "rappor").select("obs_id", "cohort", joined("set_bits"))


@query("SELECT metric_id, s, day_index AS epoch, count(*) AS n, count(DISTINCT client_id) AS points FROM {obs} GROUP BY ALL")
def e6_encode_threshold(t):
    coded = encoding.encode_threshold(t("obs"), "s", "client_id", 5, S.DAY, "master")
    # one ciphertext a value and epoch, one point a client
    return coded.groupBy("metric_id", "epoch", "ciphertext").agg(F.min("s").alias("s"), F.count("*").alias("n"), F.count_distinct("point_x", "point_y").alias("points")).select("metric_id", "s", F.col("epoch").cast("long").alias("epoch"), "n", "points")


@query(f"SELECT obs_id, client_id % 8 AS cohort, array_to_string(list_transform(range(15, -1, -1), lambda j: CASE WHEN list_contains({_bloom_sql('s', '(client_id % 8)', 16, 2)}, j) THEN '1' ELSE '0' END), '') AS bits1 FROM {{obs}}")
def e7_legacy_cohort(t):
    return encoding.encode_legacy_cohort(t("obs"), "client_id", 8, {"s": "bits1"}, 16, 2).select("obs_id", "cohort", "bits1")


@query(f"SELECT obs_id, 0 AS cohort, {_bits_sql(8, 'j = i', 0.25, 0.75, 'hot')} AS set_bits FROM {{obs}} WHERE i BETWEEN 0 AND 7")
def e8_one_hot(t):
    return encoding.encode_one_hot(t("obs"), "i", 8, 0.25, 0.75, "hot").select("obs_id", "cohort", joined("set_bits"))


def _hex_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), {{}}, {{}}) AS BIGINT)"


_KEY_SQL = "CAST(obs_id AS VARCHAR) || '|' || part_name"
_REG_DRAW = f"({_hex_sql("'reg'", _KEY_SQL, 'CAST(j // 4 AS VARCHAR)').format('13 * (j % 4) + 1', 13)} / 4503599627370496.0)"
_REG_BITS = f"list_filter(range(n), lambda j: {_REG_DRAW} < CASE WHEN CASE WHEN payload_kind = 'rappor' THEN list_contains(bloom, j) ELSE j = place END THEN q ELSE p END)"
_REG_COHORT = f"list_filter(list_transform(range(64), lambda a: {_hex_sql("'reg'", 'CAST(client_id AS VARCHAR)', 'CAST(a AS VARCHAR)').format(1, 13)} % CAST(pow(2, ceil(log2(m))) AS BIGINT)), lambda v: v < m)[1]"
REG_CTE = f"""WITH j AS (SELECT v.* EXCLUDE (part_name), mt.time_zone_policy, mt.profile_fields, mt.backend, mt.id IS NOT NULL AS known, mp.n_parts, CASE WHEN v.part_name = '' AND mp.n_parts = 1 THEN mp.only_part ELSE v.part_name END AS part_name,
 count(*) OVER (PARTITION BY v.obs_id) AS n_sent FROM {{reg_values}} v LEFT JOIN {{reg_metrics}} mt ON mt.id = v.metric_id
 LEFT JOIN (SELECT metric_id, count(*) AS n_parts, min(part_name) AS only_part FROM {{reg_parts}} GROUP BY metric_id) mp ON mp.metric_id = v.metric_id),
r AS (SELECT j.*, pt.data_type, en.kind AS payload_kind, en.k, en.h, en.m, en.p, en.q, en.threshold, en.epoch_type, en.categories,
 CASE time_zone_policy WHEN 'UTC' THEN CAST(ts AS DATE) WHEN 'LOCAL' THEN CAST(ts + CASE zone WHEN '+05:00' THEN INTERVAL 5 HOUR ELSE INTERVAL '-8' HOUR END AS DATE) END AS day,
 coalesce(len(en.categories), en.last - en.first + 1, en.num_categories) AS nc, CASE WHEN en.categories IS NOT NULL THEN list_position(en.categories, s) - 1 WHEN en.first IS NOT NULL THEN i - en.first ELSE idx END AS place
 FROM j LEFT JOIN {{reg_parts}} pt ON pt.metric_id = j.metric_id AND pt.part_name = j.part_name LEFT JOIN {{reg_encodings}} en ON en.id = j.encoding_config_id),
w AS (SELECT *, CASE WHEN NOT known THEN 'unknown metric' WHEN n_sent <> coalesce(n_parts, 0) THEN 'wrong number of parts' WHEN day IS NULL THEN 'no day by the time zone policy' WHEN backend NOT IN ('LEGACY', 'V1') THEN 'unknown backend'
 WHEN data_type IS NULL THEN 'unknown part' WHEN CASE kind WHEN 'string' THEN s IS NULL WHEN 'int' THEN i IS NULL ELSE idx IS NULL END THEN 'unset value' WHEN kind <> data_type THEN 'wrong type' WHEN payload_kind IS NULL THEN 'unknown encoding'
 WHEN payload_kind IN ('rappor', 'threshold') AND kind <> 'string' THEN 'type not for this encoding' WHEN payload_kind = 'basic_rappor' AND (place IS NULL OR place < 0 OR place >= nc) THEN 'no such category' END AS own FROM r),
g AS (SELECT *, min(own) OVER (PARTITION BY obs_id) AS reason, CASE WHEN payload_kind = 'rappor' THEN k ELSE nc END AS n, CASE WHEN payload_kind = 'rappor' THEN {_REG_COHORT} END AS cohort FROM w),
b AS (SELECT *, list_transform(range(2), lambda x: CAST('0x' || substr(sha256(s || cohort), CAST(4 * x + 1 AS INT), 4) AS BIGINT) % k) AS bloom,
 CASE epoch_type WHEN 'DAY' THEN date_diff('day', DATE '1970-01-01', day) WHEN 'WEEK' THEN (date_diff('day', DATE '1970-01-01', day) + 4) // 7 ELSE (year(day) - 1970) * 12 + month(day) - 1 END AS ep FROM g),
z AS (SELECT *, substr(sha256(concat_ws('|', 'reg', '1', '1', metric_id, part_name, ep, threshold, 's:' || s)), 1, 30) AS secret FROM b)"""
REG_SQL = REG_CTE + f"""
SELECT obs_id, part_name, encoding_config_id, date_diff('day', DATE '1970-01-01', day) AS day_index, CASE WHEN list_contains(profile_fields, 'os') THEN os END AS os, CASE WHEN list_contains(profile_fields, 'board_name') THEN board_name END AS board_name,
 CASE WHEN reason IS NULL THEN substr(sha256(concat_ws('|', 'reg', 'id', '1', '1', metric_id, obs_id)), 1, 16) END AS random_id, CASE WHEN reason IS NULL THEN payload_kind END AS payload_kind, reason,
 CASE WHEN reason IS NULL THEN CASE payload_kind WHEN 'noop' THEN coalesce(s, CAST(i AS VARCHAR), CAST(idx AS VARCHAR)) WHEN 'basic_rappor' THEN array_to_string({_REG_BITS}, ',') WHEN 'rappor' THEN cohort || ':' || array_to_string({_REG_BITS}, ',')
 ELSE ep || ':' || substr(sha256('client|' || client_id || '|' || secret), 1, 30) END END AS payload FROM z"""


def _coded(t, values=None):
    return registry.encode(t("reg_values") if values is None else values, t("reg_metrics"), t("reg_parts"), t("reg_encodings"), "reg")


@query(REG_SQL)
def e9_encode(t):
    payload = F.coalesce(F.when(F.col("payload_kind") == "noop", F.coalesce("s", F.col("i").cast("string"), F.col("idx").cast("string"))), F.concat_ws(":", "epoch", "point_x"))
    bits = F.concat_ws(":", "cohort", joined_column(F.col("set_bits")))
    return _coded(t).select("obs_id", "part_name", "encoding_config_id", "day_index", "os", "board_name", "random_id", "payload_kind", "reason", F.when(F.col("payload_kind").isin("basic_rappor", "rappor"), bits).when(F.col("reason").isNull(), payload).alias("payload"))


# estimators


@query("SELECT s, count(*) AS count_estimate, 0.0::DOUBLE AS std_error FROM {obs} GROUP BY s")
def a1_histogram(t):
    return estimate.histogram(t("obs"), "s")


@query("SELECT CASE WHEN q < 5 THEN 0 WHEN q >= 45 THEN 5 ELSE (q - 5) // 10 + 1 END AS bucket, count(*) AS n FROM (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1")
def a2_int_buckets(t):
    return estimate.histogram_int_buckets(t("lineitem"), S.linear_bucket(F.col("l_quantity").cast("long"), 5, 4, 10))


@query("SELECT i % 14 AS bucket, sum(1 + obs_id % 3) AS n FROM {obs} WHERE i % 14 < 12 GROUP BY 1")
def a3_merge_distributions(t):
    dist = t("obs").withColumn("dist", F.create_map((F.col("i") % 14).cast("int"), 1 + F.col("obs_id") % 3))
    return estimate.merge_distributions(dist, 10)


BITS_SQL = f"SELECT obs_id, metric_id, board, list_filter(range(5), lambda j: {_draw_sql('basic')} < CASE WHEN j = list_position({KINDS_SQL}, s) - 1 THEN 0.8 ELSE 0.2 END) AS b FROM {{obs}}"
COUNTS_SQL = f"SELECT bit, n, (SELECT count(*) FROM ({BITS_SQL}) WHERE list_contains(b, bit)) AS y FROM (SELECT count(*) AS n FROM {{obs}}), (SELECT unnest(range(5)) AS bit)"
EST_SQL = "(y - 0.2 * n) / (0.8 - 0.2) AS e, sqrt(y * (1 - 0.2 - 0.8) + n * (0.2 * 0.8)) / abs(0.8 - 0.2) AS se"


def _basic(t):
    return encoding.encode_basic_rappor(t("obs"), "s", KINDS, 0.2, 0.8, "basic")


@query(COUNTS_SQL)
def a4_bit_counts(t):
    return estimate.bit_counts(_basic(t), 5)


@query(f"SELECT bit, round(e, 6) AS count_estimate, round(se, 6) AS std_error FROM (SELECT bit, {EST_SQL} FROM ({COUNTS_SQL}))")
def a5_basic_rappor_estimate(t):
    return estimate.basic_rappor_estimate(estimate.bit_counts(_basic(t), 5), 0.2, 0.8).select("bit", *r6("count_estimate", "std_error"))


def _bloom(t):
    return encoding.encode_rappor(t("obs"), "s", "client_id", 16, 2, 8, 0.1, 0.9, "rappor")


CELLS_SQL = f"""SELECT cohort, bit, n, coalesce(y, 0) AS y FROM (SELECT cohort, count(*) AS n FROM (SELECT {_cohort_sql(8, 8, 'rappor')} AS cohort FROM {{obs}}) GROUP BY 1) CROSS JOIN (SELECT unnest(range(16)) AS bit)
 LEFT JOIN (SELECT cohort, bit, count(*) AS y FROM (SELECT cohort, unnest(list_filter(range(16), lambda j: {_draw_sql('rappor')} < CASE WHEN list_contains(bloom, j) THEN 0.9 ELSE 0.1 END)) AS bit
 FROM (SELECT *, {_bloom_sql('s', 'cohort', 16, 2)} AS bloom FROM (SELECT *, {_cohort_sql(8, 8, 'rappor')} AS cohort FROM {{obs}}))) GROUP BY ALL) USING (cohort, bit)"""


@query(CELLS_SQL)
def a6_cohort_bit_counts(t):
    return estimate.cohort_bit_counts(_bloom(t), 16, 8)


@query(f"SELECT cohort, bit, round((y - 0.1 * n) / (0.9 - 0.1), 6) AS count_estimate, round(sqrt(y * (1 - 0.1 - 0.9) + n * (0.1 * 0.9)) / abs(0.9 - 0.1), 6) AS std_error FROM ({CELLS_SQL})")
def a7_cohort_bit_estimates(t):
    return estimate.basic_rappor_estimate(estimate.cohort_bit_counts(_bloom(t), 16, 8), 0.1, 0.9).select("cohort", "bit", *r6("count_estimate", "std_error"))


@query(f"SELECT cohort * 16 + 15 - bit AS row, round((y - 0.1 * n) / (0.9 - 0.1) / n, 6) AS ratio FROM ({CELLS_SQL})")
def a8_bit_count_ratios(t):
    return estimate.bit_count_ratios(estimate.basic_rappor_estimate(estimate.cohort_bit_counts(_bloom(t), 16, 8), 0.1, 0.9), 16).select("row", *r6("ratio"))


@query()
def a9_rappor_estimate(t):
    candidates = t("obs").select(F.col("s").alias("candidate")).distinct()
    return estimate.rappor_estimate(_bloom(t), candidates, 16, 2, 8, 0.1, 0.9)


_FOUR = ["click", "error", "purchase", "signup"]  # under 80 bits and 4 cohorts no two of them share a bit, so the solution has a closed form


@query(f"""WITH b AS (SELECT board, cohort, list_filter(range(80), lambda j: {_draw_sql('nine')} < CASE WHEN list_contains(bloom, j) THEN 0.9 ELSE 0.1 END) AS bits FROM (SELECT *, {_bloom_sql('s', 'cohort', 80, 2)} AS bloom FROM (SELECT *, {_cohort_sql(4, 4, 'nine')} AS cohort FROM {{obs}}))),
 c AS (SELECT board, cohort, count(*) AS n, sum(count(*)) OVER (PARTITION BY board) AS n_all, 80 * count(*) OVER (PARTITION BY board) AS rws FROM b GROUP BY board, cohort),
 y AS (SELECT board, cohort, bit, count(*) AS y FROM (SELECT board, cohort, unnest(bits) AS bit FROM b) GROUP BY ALL),
 mat AS (SELECT DISTINCT candidate, cohort, CAST('0x' || substr(sha256(candidate || cohort), CAST(4 * x + 1 AS INT), 4) AS BIGINT) % 80 AS bit FROM (SELECT unnest({_FOUR!r}) AS candidate), (SELECT unnest(range(4)) AS cohort), (SELECT unnest(range(2)) AS x)),
 s AS (SELECT board, candidate, any_value(n_all) AS n_all, any_value(rws) AS rws, count(*) AS ones, sum((coalesce(y, 0) - 0.1 * n) / 0.8 / n) AS pull FROM c JOIN mat USING (cohort) LEFT JOIN y USING (board, cohort, bit) GROUP BY board, candidate)
SELECT board, candidate, round(sign(pull) * greatest(0, abs(pull) - rws * 0.5 / 320) / (ones + rws * 1e-3 / 320) * n_all + 0.0, 4) AS count_estimate, true AS converged FROM s""")
def a9_grouped_rappor_estimate(t):
    """String RAPPOR of each board, all in one plan."""
    coded = encoding.encode_rappor(t("obs"), "s", "client_id", 80, 2, 4, 0.1, 0.9, "nine")
    ratios = estimate.basic_rappor_estimate(estimate.bit_counts(coded, 80, ["board", "cohort"]), 0.1, 0.9)
    sizes = ratios.where("bit = 0").groupBy("board").agg(F.sum("n").alias("n_all"))
    ratios = ratios.join(sizes, "board").select("board", "cohort", "bit", F.lit(80).alias("k"), F.lit(4).alias("m"), (F.col("count_estimate") / F.col("n")).alias("ratio"), "n_all")
    names = sizes.select("board", F.explode(F.array(*map(F.lit, _FOUR))).alias("candidate"))
    bits = rows.candidate_matrix(names.select("candidate").distinct(), 80, 2, 4)
    found = estimate.grouped_rappor_estimate(ratios, names.join(bits, "candidate").select("board", "candidate", "cohort", "bit"), ["board"])
    return found.select("board", "candidate", F.round("count_estimate", 4).alias("count_estimate"), "converged")


THRESHOLD_SQL = "SELECT s AS plaintext, sum(n) AS total, count(*) AS epochs FROM (SELECT s, day_index, count(*) AS n FROM {obs} GROUP BY ALL HAVING count(DISTINCT client_id) >= 20) GROUP BY s"


@query(THRESHOLD_SQL)
def a10_threshold_decrypt(t):
    coded = encoding.encode_threshold(t("obs").withColumn("metric_id", F.lit(1)), "s", "client_id", 20, S.DAY, "master")
    return encoding.threshold_decrypt(coded, 20)


@query("SELECT epoch, s, count(*) AS conflicts FROM (SELECT day_index AS epoch, s, client_id FROM {obs} GROUP BY ALL HAVING count(DISTINCT obs_id % 7 = 0) > 1) GROUP BY ALL")
def a11_threshold_errors(t):
    coded = t("obs").select(F.col("day_index").alias("epoch"), F.col("s").alias("ciphertext"), F.col("client_id").alias("point_x"), (F.col("obs_id") % 7 == 0).cast("string").alias("point_y"))
    return encoding.threshold_errors(coded).select("epoch", F.col("ciphertext").alias("s"), "conflicts")


@query("SELECT board, s, count(*) AS count_estimate, 0.0::DOUBLE AS std_error FROM {obs} GROUP BY ALL")
def a12_histogram_by_profile(t):
    return estimate.histogram(t("obs"), "s", ["board"])


@query("SELECT board, min(e) AS lo, max(e) AS hi FROM (SELECT board, CASE WHEN board = 'board2' THEN encoding_config_id ELSE 1 END AS e FROM {obs}) GROUP BY board HAVING min(e) <> max(e)")
def a13_heterogeneous_groups(t):
    obs = t("obs").selectExpr("board", "CASE WHEN board = 'board2' THEN encoding_config_id ELSE 1 END AS encoding_config_id")
    return estimate.heterogeneous_groups(obs, ["board"])


@query(f"SELECT cohort, count(*) AS total, {', '.join(f'sum(CASE WHEN list_contains(b, {j}) THEN 1 ELSE 0 END) AS bit{j}' for j in range(4))} FROM (SELECT client_id % 8 AS cohort, {_bloom_sql('s', '(client_id % 8)', 4, 2)} AS b FROM {{obs}}) GROUP BY cohort")
def a14_sum_bits(t):
    coded = encoding.encode_legacy_cohort(t("obs"), "client_id", 8, {"s": "bits"}, 4, 2)
    return estimate.sum_bits(coded, 4)


@query("SELECT h AS hour, count(event_id) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
def a15_usage_by_hour(t):
    return estimate.usage_by_hour(t("events"), "ts")


@query("SELECT url, count(*) AS n FROM pages GROUP BY url")
def a15_usage_by_url(t):
    return estimate.usage_by(t("pages"), "url")


@query("SELECT board, count(*) AS n, round(avg(d), 6) AS mean FROM {obs} GROUP BY board")
def a16_usage_and_mean(t):
    return estimate.usage_and_mean(t("obs"), "board", "d").select("board", "n", *r6("mean"))


def _pair(t):
    """A string's kind in five categories, and an index in four: both as noisy bits."""
    obs = encoding.encode_basic_rappor(t("obs"), "s", KINDS, 0.2, 0.8, "v1").withColumnRenamed("set_bits", "bits1").drop("category")
    return obs.withColumn("b4", F.col("idx") % 4).withColumn("bits2", encoding.noisy_bits(F.col("b4"), 4, 0.2, 0.8, "v2", "obs_id"))


def _pair_table(t):
    return joint.report_likelihoods(joint.report_patterns(_pair(t), "bits1", "bits2"), joint.index_variable(KINDS, 0.2, 0.8), joint.index_variable(NAMES4, 0.2, 0.8))


_KNOWN = ["click", "error", "purchase"]  # candidates; signup and view are Other
_OTHER_SQL = f"""cells AS (SELECT cohort, bit, y, n FROM ({CELLS_SQL})), marg AS (SELECT * FROM (VALUES ('click', 0.25), ('error', 0.125), ('purchase', 0.2)) v(candidate, proportion)),
 kn AS (SELECT candidate, ceil(proportion * (SELECT sum(n) FROM cells WHERE bit = 0) / 8) AS known FROM marg),
 mat AS (SELECT DISTINCT candidate, cohort, CAST('0x' || substr(sha256(candidate || cohort), CAST(4 * x + 1 AS INT), 4) AS BIGINT) % 16 AS bit FROM marg, (SELECT unnest(range(8)) AS cohort), (SELECT unnest(range(2)) AS x)),
 own AS (SELECT cohort, bit, sum(known) AS own FROM mat JOIN kn USING (candidate) GROUP BY ALL),
 lft AS (SELECT cohort, bit, greatest(0, y - (((SELECT sum(known) FROM kn) - coalesce(own, 0)) * 0.1 + coalesce(own, 0) * 0.9)) AS ones, greatest(0, n - (SELECT sum(known) FROM kn)) AS rest FROM cells LEFT JOIN own USING (cohort, bit)),
 oth AS (SELECT cohort, bit, CASE WHEN rest > 0 THEN least(1.0, ones / rest) WHEN ones > 0 THEN 1.0 ELSE 0.0 END AS probability FROM lft)"""


def _other(t):
    spark = t("region").sparkSession
    marginal = spark.createDataFrame([("click", 0.25), ("error", 0.125), ("purchase", 0.2)], "candidate string, proportion double")
    return estimate.other_probabilities(estimate.cohort_bit_counts(_bloom(t), 16, 8), rows.candidate_matrix(marginal.select("candidate"), 16, 2, 8), marginal, 8, 0.1, 0.9)


_RAPPOR_PAIR_SQL = f"""SELECT cohort, list_filter(range(16), lambda j: {_draw_sql('rappor')} < CASE WHEN list_contains(bloom, j) THEN 0.9 ELSE 0.1 END) AS bits1, list_filter(range(4), lambda j: {_draw_sql('v2')} < CASE WHEN j = idx % 4 THEN 0.8 ELSE 0.2 END) AS bits2
 FROM (SELECT *, {_bloom_sql('s', 'cohort', 16, 2)} AS bloom FROM (SELECT *, {_cohort_sql(8, 8, 'rappor')} AS cohort FROM {{obs}}))"""


@query(f"""WITH {_OTHER_SQL}, rep AS (SELECT *, row_number() OVER () AS id FROM (SELECT cohort, bits1, bits2, count(*) AS weight FROM ({_RAPPOR_PAIR_SQL}) GROUP BY ALL)), mb AS (SELECT candidate, cohort, list(bit) AS own FROM mat GROUP BY ALL),
 one AS (SELECT id, sum(ln(CASE WHEN list_contains(bits1, j) = list_contains(own, j) THEN 0.9 ELSE 0.1 END)) AS lg FROM (SELECT *, unnest(range(16)) AS j FROM rep JOIN mb USING (cohort)) GROUP BY id, candidate
  UNION ALL SELECT id, sum(ln(CASE WHEN list_contains(bits1, bit) THEN greatest(1e-12, least(1 - 1e-12, probability)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, probability)) END)) FROM rep JOIN oth USING (cohort) GROUP BY id),
 two AS (SELECT id, sum(ln(CASE WHEN list_contains(bits2, j) = (j = c) THEN 0.8 ELSE 0.2 END)) AS lg FROM (SELECT *, unnest(range(4)) AS j FROM (SELECT *, unnest(range(4)) AS c FROM rep)) GROUP BY id, c)
 SELECT weight, round(log1, 6) AS log1, round(log2, 6) AS log2 FROM rep JOIN (SELECT id, ln(sum(exp(lg))) AS log1 FROM one GROUP BY id) USING (id) JOIN (SELECT id, ln(sum(exp(lg))) AS log2 FROM two GROUP BY id) USING (id)""")
def a17_report_likelihoods(t):
    """Likelihoods of three known strings and Other by cohort, and of an index."""
    spark = t("region").sparkSession
    import numpy as np

    other = np.zeros((8, 16))
    for r in _other(t).collect():
        other[r.cohort, r.bit] = r.probability
    strings = joint.string_variable(spark, _KNOWN, 16, 2, 8, 0.1, 0.9, other)
    pair = _bloom(t).withColumn("b4", F.col("idx") % 4).withColumn("bits2", encoding.noisy_bits(F.col("b4"), 4, 0.2, 0.8, "v2", "obs_id"))
    table_ = joint.report_likelihoods(joint.report_patterns(pair, "set_bits", "bits2", "cohort"), strings, joint.index_variable(NAMES4, 0.2, 0.8))
    return table_.select("weight", *[F.round(F.log(F.aggregate(f"c{n}", F.lit(0.0), lambda a, x: a + x)) + F.col(f"top{n}"), 6).alias(f"log{n}") for n in (1, 2)])


@query(f"WITH {_OTHER_SQL} SELECT cohort, bit, round(probability, 6) AS probability FROM oth")
def a18_other_probabilities(t):
    return _other(t).select("cohort", "bit", *r6("probability"))


NAMES4 = ["0", "1", "2", "3"]


@query()
def a19_joint_em(t):
    grid = joint.joint_em(_pair_table(t), 5, 4).grid
    return joint.as_rows(t("region").sparkSession, grid, KINDS, NAMES4)


@query()
def a20_joint_variance(t):
    table_ = _pair_table(t).cache()
    grid = joint.joint_em(table_, 5, 4).grid
    errors, _ = joint.joint_variance(table_, grid)
    table_.unpersist()
    return joint.as_rows(t("region").sparkSession, errors, KINDS, NAMES4).withColumnRenamed("proportion", "std_error")


@query()
def a21_independence_test(t):
    table_ = _pair_table(t).cache()
    grid = joint.joint_em(table_, 5, 4).grid
    statistic, p_value = joint.independence_test(grid, joint.joint_variance(table_, grid)[1])
    table_.unpersist()
    return t("region").sparkSession.createDataFrame([(statistic, p_value)], "statistic double, p_value double")


@query("SELECT s AS v1, round(sum(r * n) / sum(n), 6) AS mean FROM (SELECT s, idx % 4 AS r, count(*) AS n FROM {obs} GROUP BY ALL) WHERE s <> 'view' GROUP BY s")
def a22_mean_by_candidate(t):
    fit = t("obs").groupBy(F.when(F.col("s") == "view", "Other").otherwise(F.col("s")).alias("v1"), (F.col("idx") % 4).alias("v2")).agg(F.count("*").alias("proportion"))
    return estimate.mean_by_candidate(fit).select("v1", *r6("mean"))


@query("SELECT floor({u} * 0)::BIGINT AS zero, s, CAST(round(n - 2.0 * sign({u} - 0.5) * ln(greatest(1 - 2 * abs({u} - 0.5), 1e-15))) AS BIGINT) AS released FROM (SELECT s, count(*) AS n FROM {obs} GROUP BY s)".replace("{u}", _uniform_sql("laplace", "s")))
def a23_laplace_release(t):
    report = t("obs").groupBy("s").agg(F.count("*").alias("n"))
    return estimate.laplace_release(report, "n", 2.0, "laplace", "s").select(F.lit(0).cast("long").alias("zero"), "s", "released")


@query("""WITH c AS (SELECT DISTINCT 12 + day_index % 9 AS n, least(12 + day_index % 9, count(*) % 13) AS y FROM {obs} GROUP BY day_index),
 g AS (SELECT n, y, v, sum(exp(lgamma(v+1)-lgamma(j+1)-lgamma(v-j+1) + j*ln(0.75) + (v-j)*ln(0.25) + lgamma(n-v+1)-lgamma(y-j+1)-lgamma(n-v-y+j+1) + (y-j)*ln(0.25) + (n-v-y+j)*ln(0.75))) AS l
 FROM c, LATERAL (SELECT unnest(range(n + 1)) AS v), LATERAL (SELECT unnest(range(greatest(0, y - (n - v)), least(v, y) + 1)) AS j) GROUP BY ALL)
SELECT n, y, arg_max(v, l) AS estimate FROM g GROUP BY ALL""")
def a24_mle_counts(t):
    counts = t("obs").groupBy("day_index").agg(F.count("*").alias("c")).select((12 + F.col("day_index") % 9).alias("n"), F.least(12 + F.col("day_index") % 9, F.col("c") % 13).alias("y"))
    return estimate.mle_counts(counts, 0.25, 0.75, 40)


@query("SELECT metric_id, day_index, board, count(*) AS n FROM {obs} GROUP BY ALL")
def a25_batch_sizes(t):
    return estimate.batch_sizes(t("obs"), ["metric_id", "day_index", "board"])


@query(f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ({REASON_SQL}) GROUP BY 1")
def a26_quality_counters(t):
    return estimate.quality_counters(_judged(t))


@query("SELECT s, v2, count(*) AS proportion FROM (SELECT s, 'board' || (idx % 4) AS v2 FROM {obs}) GROUP BY ALL")
def a27_flatten_joint(t):
    wide = t("obs").groupBy("s").pivot("board", ["board0", "board1", "board2", "board3"]).count()
    return estimate.flatten_joint(wide, "s").where("proportion IS NOT NULL")


# epochs, chunks, order


@query("SELECT obs_id, day_index AS d, (day_index + 4) // 7 AS w, (year(ts) - 1970) * 12 + month(ts) - 1 AS m FROM {obs}")
def w1_epoch_index(t):
    return t("obs").select("obs_id", *[S.epoch_index("day_index", e).cast("long").alias(e[0].lower()) for e in (S.DAY, S.WEEK, S.MONTH)])


@query("SELECT obs_id, CAST(floor((row_number() OVER (PARTITION BY metric_id, day_index ORDER BY sha256('chunk|' || obs_id), obs_id) - 1) / 20) AS BIGINT) AS chunk FROM {obs}")
def w2_chunk(t):
    return rows.chunk(t("obs"), ["metric_id", "day_index"], "obs_id", 20, "chunk").select("obs_id", "chunk")


@query("""WITH RECURSIVE r AS (SELECT client_id, obs_id, length(s) + 10 AS b, row_number() OVER (PARTITION BY client_id ORDER BY obs_id) AS n FROM {obs}),
 g AS (SELECT client_id, obs_id, n, b AS used, 0 AS envelope FROM r WHERE n = 1
 UNION ALL SELECT r.client_id, r.obs_id, r.n, CASE WHEN used + b > 100 THEN b ELSE used + b END, envelope + CASE WHEN used + b > 100 THEN 1 ELSE 0 END FROM g JOIN r ON r.client_id = g.client_id AND r.n = g.n + 1)
SELECT obs_id, CAST(envelope AS BIGINT) AS envelope FROM g""")
def w3_pack_batches(t):
    return rows.pack_batches(t("obs"), ["client_id"], "obs_id", F.length("s") + 10, 100).select("obs_id", "envelope")


@query("SELECT k, count(*) AS n, sum(bytes) AS bytes, max(full_bytes) <= 400 AS within FROM (SELECT CASE WHEN obs_id % 3 = 0 THEN NULL ELSE board END AS k, length(s) + 10 AS bytes, 400 AS full_bytes FROM {obs}) GROUP BY k")
def w3_pack_batches_null_keys(t):
    """Rows without a key are packed as a key of their own, each envelope within its cap."""
    keyed = t("obs").withColumn("k", F.when(F.col("obs_id") % 3 != 0, F.col("board")))
    full = rows.pack_batches(keyed, ["k"], "obs_id", F.length("s") + 10, 400).groupBy("k", "envelope").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return full.groupBy("k").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), (F.max("bytes") <= 400).alias("within"))


@query("SELECT s, day_index, obs_id FROM {obs} QUALIFY row_number() OVER (PARTITION BY s, day_index ORDER BY obs_id) <= 3")
def w4_first_points(t):
    return rows.first_points(t("obs").select("s", "day_index", "obs_id"), ["s", "day_index"], "obs_id", 3)


@query("SELECT obs_id, s, i, kind, CASE kind WHEN 'string' THEN 1 WHEN 'int' THEN 2 ELSE 3 END AS kind_rank FROM (SELECT obs_id, CASE WHEN k = 'string' THEN s END AS s, CASE WHEN k = 'int' THEN i END AS i, k AS kind FROM (SELECT *, CASE obs_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END AS k FROM {obs}))")
def t1_sort_report(t):
    df = t("obs").withColumn("kind", F.expr("CASE obs_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'index' END"))
    df = df.withColumn("s", F.expr("CASE WHEN kind = 'string' THEN s END")).withColumn("i", F.expr("CASE WHEN kind = 'int' THEN i END"))
    return rows.sort_report(df).select("obs_id", "s", "i", "kind", "kind_rank")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 50")
def t2_top_k(t):
    return rows.top_k(t("part"), "p_name", 50)


@query("SELECT s, count(*) AS n FROM {obs} GROUP BY s")
def t3_order_for_display(t):
    return rows.order_for_display(estimate.usage_by(t("obs"), "s"), "n", "s")


@query("SELECT obs_id, sha256('perm|' || obs_id) AS shuffle_key FROM {obs}")
def t4_shuffle_rows(t):
    return rows.shuffle_rows(t("obs").select("obs_id"), "perm", "obs_id")


@query("SELECT i, n, (SELECT count(DISTINCT i) FROM {obs}) > 25 AS truncated FROM (SELECT i, count(*) AS n FROM {obs} GROUP BY i) ORDER BY i LIMIT 25")
def t5_cap_distinct(t):
    return rows.cap_distinct(estimate.usage_by(t("obs"), "i"), "i", 25)


@query("SELECT obs_id, s FROM {obs} ORDER BY sha256('sample|' || obs_id), obs_id LIMIT 500")
def t6_sample_reports(t):
    return rows.sample_reports(t("obs").select("obs_id", "s"), 500, "sample", "obs_id")


@query("SELECT s, count(*) AS n FROM (SELECT s FROM {obs} UNION ALL SELECT s FROM {obs} WHERE metric_id = 1) GROUP BY s")
def u1_merge_batches(t):
    obs = t("obs").select("s", "metric_id")
    return rows.merge_batches(obs, obs.where("metric_id = 1")).groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT s, n, 'left' AS side FROM (SELECT s, count(*) AS n FROM {obs} GROUP BY s) WHERE s IN ('view', 'click') UNION ALL SELECT s, n - 1, 'right' FROM (SELECT s, count(*) AS n FROM {obs} GROUP BY s) WHERE s = 'click'")
def u2_diff_results(t):
    a = estimate.usage_by(t("obs"), "s")
    b = a.where("s != 'view'").withColumn("n", F.when(F.col("s") == "click", F.col("n") - 1).otherwise(F.col("n")))
    return rows.diff_results(a, b)


@query("SELECT obs_id, s FROM {obs}")
def u3_dedupe(t):
    obs = t("obs").select("obs_id", "s")
    return rows.dedupe(obs.unionByName(obs.where("obs_id % 2 = 0")), ["obs_id"])


# scalars


@query("SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS utc, date_diff('day', DATE '1970-01-01', CAST(ts - INTERVAL 8 HOUR AS DATE)) AS pacific FROM events")
def c1_day_index(t):
    return t("events").select("event_id", S.day_index("ts").alias("utc"), S.day_index("ts", "-08:00").alias("pacific"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, DAYOF(o_orderdate) AS day FROM orders")
def c2_day_and_date(t):
    day = S.date_to_day(F.to_date("o_orderdate"))
    return t("orders").select("o_orderkey", S.day_to_date(day).cast("string").alias("date"), day.alias("day"))


@query("SELECT o_orderkey, w AS week, strftime(DATE '1970-01-01' + CAST(greatest(w * 7 - 4, 0) AS INTEGER), '%Y-%m-%d') AS begins FROM (SELECT o_orderkey, (DAYOF(o_orderdate) + 4) // 7 AS w FROM orders)")
def c3_week(t):
    week = S.week_index(S.date_to_day(F.to_date("o_orderdate")))
    return t("orders").select("o_orderkey", week.alias("week"), S.week_to_date(week).cast("string").alias("begins"))


@query("SELECT o_orderkey, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS begins FROM orders")
def c4_month(t):
    month = S.month_index(S.date_to_day(F.to_date("o_orderdate")))
    return t("orders").select("o_orderkey", month.alias("month"), S.month_to_date(month).cast("string").alias("begins"))


@query("SELECT obs_id, day_index * 86400 AS midnight FROM {obs}")
def c5_midnight_utc(t):
    return t("obs").select("obs_id", S.midnight_utc("day_index").alias("midnight"))


@query("SELECT obs_id, CASE WHEN i < 10 THEN 0 WHEN i >= 40 THEN 4 ELSE (i - 10) // 10 + 1 END AS bucket FROM {obs}")
def c6_linear_bucket(t):
    return t("obs").select("obs_id", S.linear_bucket("i", 10, 3, 10).alias("bucket"))


@query("SELECT obs_id, CASE WHEN i < 0 THEN 0 WHEN i < 2 THEN 1 WHEN i < 4 THEN 2 WHEN i < 8 THEN 3 WHEN i < 16 THEN 4 ELSE 5 END AS bucket FROM {obs}")
def c7_exponential_bucket(t):
    return t("obs").select("obs_id", S.exponential_bucket("i", 0, 4, 2, 2).alias("bucket"))


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(p_size))) AS BIGINT) END AS p2 FROM part")
def c8_next_pow2(t):
    return t("part").select("p_partkey", S.next_pow2("p_size").alias("p2"))


@query("SELECT p_partkey, array_to_string(list_filter(range(16), lambda j: (p_partkey >> j) & 1 = 1), ',') AS bits FROM part")
def c9_bits_of(t):
    data = t("part").select("p_partkey", F.unhex(F.lpad(F.hex("p_partkey"), 16, "0")).alias("data"))
    return data.select("p_partkey", joined_column(S.bits_of("data", 16)).alias("bits"))


def joined_column(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""SELECT doc_id, '"' || array_to_string(list_transform(range(least(256, octet_length(encode(text)))), lambda n: CASE WHEN substr(h, CAST(2 * n + 1 AS INT), 2) BETWEEN '20' AND '7E' AND substr(h, CAST(2 * n + 1 AS INT), 2) NOT IN ('22', '25')
 THEN chr(CAST('0x' || substr(h, CAST(2 * n + 1 AS INT), 2) AS INT)) ELSE '%' || substr(h, CAST(2 * n + 1 AS INT), 2) END), '') || '"' AS field FROM (SELECT *, hex(text) AS h FROM documents)""")
def c10_csv_string(t):
    return t("documents").select("doc_id", S.csv_string("text").alias("field"))


@query("SELECT url, regexp_replace(substr(url, 1, 128), '[^A-Za-z0-9]', '_', 'g') AS header FROM pages")
def c11_csv_header(t):
    return t("pages").select("url", S.csv_header("url").alias("header"))


@query("SELECT event_id, CASE WHEN x = '0.000' THEN '0' ELSE x END AS shown FROM (SELECT event_id, printf('%.3f', value) AS x FROM events)")
def c12_format_float(t):
    return t("events").select("event_id", S.format_float("value").alias("shown"))


@query("SELECT event_id, greatest(0.0, value - 20) AS clipped FROM events")
def c13_clip_count(t):
    return t("events").select("event_id", S.clip_count(F.col("value") - 20).alias("clipped"))


def _kinds(t):
    return t("obs").withColumn("kind", F.expr("CASE obs_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'index' ELSE 'blob' END")).withColumn("b", F.encode("s", "UTF-8"))


@query("""SELECT obs_id, CASE obs_id % 4 WHEN 0 THEN '"' || s || '"' WHEN 1 THEN CAST(i AS VARCHAR) WHEN 2 THEN coalesce('"' || label || '"', '"<index ' || idx || '>"') ELSE base64(unhex(sha256(s))) END AS value FROM {obs} LEFT JOIN {labels_dim} USING (idx)""")
def c14_value_to_string(t):
    return rows.with_labels(_kinds(t), t("labels_dim")).select("obs_id", S.value_to_string().alias("value"))


@query("""SELECT obs_id, CASE obs_id % 4 WHEN 0 THEN s WHEN 1 THEN CAST(i AS VARCHAR) WHEN 2 THEN coalesce(label, '<index ' || idx || '>') ELSE '[blob]' END AS value FROM {obs} LEFT JOIN {labels_dim} USING (idx)""")
def c15_display_value(t):
    return rows.with_labels(_kinds(t), t("labels_dim")).select("obs_id", S.display_value().alias("value"))


@query("SELECT obs_id, year(ts) || '-' || month(ts) || '-' || day(ts) AS date, strftime(ts, '%Y%m%d') AS suffix FROM {obs}")
def c16_date_strings(t):
    return t("obs").select("obs_id", S.date_string("day_index").alias("date"), S.date_suffix("day_index").alias("suffix"))


@query("""SELECT obs_id, '1_1_' || metric_id || '/' || name || '.csv' AS path FROM (SELECT *, 'report_1_1_' || metric_id || '_' || strftime(ts, '%Y%m%d') || CASE WHEN obs_id % 2 = 0 THEN '_' || strftime(ts + INTERVAL 6 DAY, '%Y%m%d') ELSE '' END AS name FROM {obs})""")
def c17_export_paths(t):
    last = F.when(F.col("obs_id") % 2 == 0, F.col("day_index") + 6).otherwise(F.col("day_index"))
    named = t("obs").withColumn("last", last).withColumn("name", S.export_name("customer_id", "project_id", "metric_id", "day_index", "last"))
    return named.select("obs_id", S.export_path("customer_id", "project_id", "metric_id", "name").alias("path"))


@query("SELECT obs_id, array_to_string(list_filter([CASE WHEN obs_id % 2 = 0 THEN 'board:' || board END, CASE WHEN obs_id % 3 = 0 THEN 's:' || s END], lambda x: x IS NOT NULL), ',') AS profile FROM {obs}")
def c18_profile_strings(t):
    df = t("obs").select("obs_id", F.when(F.col("obs_id") % 2 == 0, F.col("board")).alias("board"), F.when(F.col("obs_id") % 3 == 0, F.col("s")).otherwise("").alias("s"))
    return df.select("obs_id", F.array_join(S.profile_strings("board", "s"), ",").alias("profile"))


@query("SELECT event_id, round(greatest(0, value - 1.96 * 3), 6) AS low, round(greatest(0, value + 1.96 * 3), 6) AS high FROM events")
def c19_confidence_interval(t):
    low, high = S.confidence_interval("value", F.lit(3.0), clip=True)
    return t("events").select("event_id", low.alias("low"), high.alias("high")).select("event_id", *r6("low", "high"))


@query(f"SELECT event_id, {_uniform_sql('u', 'event_id', '7')} AS u FROM events")
def c20_keyed_uniform(t):
    return t("events").select("event_id", S.keyed_uniform("u", "event_id", F.lit(7)).alias("u"))


@query("SELECT obs_id, client_id % 8 AS cohort, array_to_string(string_split(reverse(right('0000000' || bin(idx), 7)), ''), ',') AS bits FROM {obs}")
def c21_fold_cohort(t):
    return t("obs").select("obs_id", S.fold_cohort("client_id", 8).alias("cohort"), joined_column(S.bit_array(F.lpad(F.bin("idx"), 7, "0"))).alias("bits"))


# reports


@query("SELECT s AS value, count(*) AS count_estimate, 0.0::DOUBLE AS std_error FROM {obs} WHERE day_index BETWEEN 19725 AND 19740 GROUP BY s")
def r1_noop_report(t):
    return reports.histogram_report(t("obs"), "noop", {"value": "s"}, 19725, 19740)


@query(f"SELECT {KINDS_SQL}[bit + 1] AS value, round(e, 6) AS count_estimate, round(se, 6) AS std_error FROM (SELECT bit, {EST_SQL} FROM ({COUNTS_SQL}))")
def r1_basic_rappor_report(t):
    """Day range, one-hot encoding with keyed noise, bit counts, estimates and standard errors."""
    cfg = {"categories": KINDS, "p": 0.2, "q": 0.8}
    return reports.histogram_report(_basic(t), "basic_rappor", cfg, 0, 1_000_000).select("value", *r6("count_estimate", "std_error"))


@query("SELECT plaintext AS value, total AS count_estimate, 0.0::DOUBLE AS std_error FROM (" + THRESHOLD_SQL + ")")
def r1_threshold_report(t):
    coded = encoding.encode_threshold(t("obs").withColumn("metric_id", F.lit(1)), "s", "client_id", 20, S.DAY, "master")
    return reports.histogram_report(coded, "threshold", {"threshold": 20}, 0, 1_000_000)


def _compiled_sql(which: str) -> str:
    """All reports but those of string RAPPOR with candidates that share bits: counts, buckets, bits, thresholds and statuses."""
    group = "report_id, os, board_name"
    estimate = "(y - p * n) / (q - p) AS e, sqrt(y * (1 - p - q) + n * (p * q)) / abs(q - p) AS se"
    return REG_CTE + f""", o AS (SELECT rp.report_id, CASE WHEN list_contains(report_fields, 'os') AND list_contains(profile_fields, 'os') THEN os END AS os, CASE WHEN list_contains(report_fields, 'board_name') AND list_contains(profile_fields, 'board_name') THEN board_name END AS board_name,
 z.* EXCLUDE (os, board_name), bk.bucket_kind FROM z JOIN {{reg_reports}} rp USING (metric_id, part_name) JOIN {{reg_buckets}} bk USING (metric_id, part_name) WHERE reason IS NULL AND date_diff('day', DATE '1970-01-01', day) BETWEEN first_day AND last_day AND ({which})),
mixed AS (SELECT report_id, min([lo, hi]) AS ids FROM (SELECT report_id, min(encoding_config_id) AS lo, max(encoding_config_id) AS hi FROM o GROUP BY {group}) WHERE lo <> hi GROUP BY report_id),
bits AS (SELECT *, {_REG_BITS} AS set_bits FROM o WHERE payload_kind IN ('basic_rappor', 'rappor')),
basic AS (SELECT g.*, en.categories, en.first, en.p, en.q, (SELECT count(*) FROM bits b WHERE b.report_id = g.report_id AND b.os IS NOT DISTINCT FROM g.os AND b.board_name IS NOT DISTINCT FROM g.board_name AND list_contains(b.set_bits, g.bit)) AS y
 FROM (SELECT *, unnest(range(nb)) AS bit FROM (SELECT {group}, encoding_config_id, count(*) AS n, any_value(nc) AS nb FROM bits WHERE payload_kind = 'basic_rappor' GROUP BY ALL)) g JOIN {{reg_encodings}} en ON en.id = g.encoding_config_id),
thr AS (SELECT {group}, s, count(*) AS n FROM (SELECT *, count(DISTINCT client_id) OVER (PARTITION BY {group}, ep, s) AS c FROM o WHERE payload_kind = 'threshold') WHERE c >= threshold GROUP BY ALL),
rap AS (SELECT {group}, candidate, greatest(0, abs(pull) - rws * 0.5 / (k * m)) * sign(pull) / (ones + rws * 1e-3 / (k * m)) * n_all + 0.0 AS e FROM (
 SELECT {group}, candidate, any_value(k) AS k, any_value(m) AS m, any_value(n_all) AS n_all, any_value(k * cohorts) AS rws, count(*) AS ones, sum((y - p * n) / (q - p) / n) AS pull FROM (
 SELECT c.*, ca.candidate, (SELECT count(*) FROM bits b WHERE b.report_id = c.report_id AND b.board_name IS NOT DISTINCT FROM c.board_name AND b.cohort = c.cohort AND list_contains(b.set_bits, ca.bit)) AS y FROM
 (SELECT {group}, cohort, count(*) AS n, any_value(k) AS k, any_value(m) AS m, any_value(p) AS p, any_value(q) AS q, sum(count(*)) OVER (PARTITION BY {group}) AS n_all, count(*) OVER (PARTITION BY {group}) AS cohorts FROM bits WHERE payload_kind = 'rappor' GROUP BY {group}, cohort) c
 JOIN (SELECT DISTINCT rc.report_id, candidate, cohort, CAST('0x' || substr(sha256(candidate || cohort), CAST(4 * x + 1 AS INT), 4) AS BIGINT) % 512 AS bit FROM {{reg_candidates}} rc, (SELECT unnest(range(2)) AS x), (SELECT unnest(range(2)) AS cohort)) ca ON ca.report_id = c.report_id AND ca.cohort = c.cohort) GROUP BY {group}, candidate)),
good AS (SELECT {group}, s, i, idx, count(*)::DOUBLE AS e, 0.0::DOUBLE AS se FROM o WHERE payload_kind = 'noop' AND bucket_kind IS NULL GROUP BY ALL
 UNION ALL SELECT {group}, NULL, NULL, CASE WHEN i < 1 THEN 0 WHEN i >= 9 THEN 5 ELSE (i - 1) // 2 + 1 END, count(*), 0 FROM o WHERE bucket_kind IS NOT NULL GROUP BY ALL
 UNION ALL SELECT {group}, categories[bit + 1], first + bit, CASE WHEN categories IS NULL AND first IS NULL THEN bit END, e, se FROM (SELECT *, {estimate} FROM basic)
 UNION ALL SELECT {group}, s, NULL, NULL, n, 0 FROM thr UNION ALL SELECT {group}, candidate, NULL, NULL, e, 0 FROM rap)
SELECT {group}, s, i, idx, label, round(e, 6) AS count_estimate, round(se, 6) AS std_error, 'OK' AS status, NULL::VARCHAR AS message FROM good LEFT JOIN {{reg_labels}} USING (report_id, idx) WHERE report_id NOT IN (SELECT report_id FROM mixed)
UNION ALL SELECT report_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'UNIMPLEMENTED', 'encodings ' || ids[1] || ' and ' || ids[2] || ' in one group' FROM mixed
UNION ALL SELECT DISTINCT report_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'INVALID_ARGUMENT', 'no candidates' FROM o WHERE payload_kind = 'rappor' AND report_id NOT IN (SELECT report_id FROM {{reg_candidates}})"""


def _compiled(t, which: str):
    """The observations of the reports' metrics are stored by kind of payload first, as clients' are; a report's estimators read their own."""
    spark = t("region").sparkSession
    stored = streams.shared_path(spark, "observations")
    asked = t("reg_reports").where(which)
    coded = _coded(t, t("reg_values").join(asked.select(*registry.METRIC).distinct(), registry.METRIC, "left_semi"))
    coded.where("reason IS NULL").write.partitionBy("payload_kind").parquet(stored)
    obs = spark.read.schema(coded.schema).parquet(stored)
    out = compiled.histogram_reports(obs, asked, t("reg_buckets"), t("reg_encodings"), t("reg_labels"), t("reg_candidates"))
    return out.select("report_id", "os", "board_name", "s", "i", "idx", "label", *r6("count_estimate", "std_error"), "status", "message")


REPORTS_OF = {"noop": "report_id IN (11, 51, 63)", "buckets": "report_id = 42", "basic_rappor": "report_id IN (21, 22, 33, 61, 62)", "threshold": "report_id = 41", "string_rappor": "report_id = 31", "mixed": "report_id > 0"}


def _compiled_query(kind: str):
    def run(t):
        return _compiled(t, REPORTS_OF[kind])

    run.__name__ = f"r1_compiled_{kind}"
    query(_compiled_sql(REPORTS_OF[kind].replace("report_id", "rp.report_id")))(run)


for _kind in REPORTS_OF:
    _compiled_query(_kind)


@query("SELECT s AS v1, board AS v2, count(*) AS n FROM {obs} GROUP BY ALL")
def r2_joint_counts(t):
    return reports.joint_counts(t("obs").select(F.col("s").alias("v1"), F.col("board").alias("v2")), "v1", "v2")


@query()
def r2_joint_report(t):
    """A string under cohorts, of which three values are known, with an index."""
    pair = _bloom(t).withColumn("b4", F.col("idx") % 4).withColumn("bits2", encoding.noisy_bits(F.col("b4"), 4, 0.2, 0.8, "v2", "obs_id"))
    string = joint_report.Part("string", bits="set_bits", cohort="cohort", names=tuple(_KNOWN), k=16, h=2, m=8, p=0.1, q=0.9)
    return joint_report.joint_report(pair, string, joint_report.Part("index", bits="bits2", names=tuple(NAMES4), p=0.2, q=0.8), 200, 1e-5)


@query("SELECT s AS v1, board AS v2, count(*)::DOUBLE AS count_estimate, 0.0::DOUBLE AS std_error, round(count(*) / (SELECT count(*) FROM {obs}), 9) AS proportion FROM {obs} GROUP BY ALL")
def r2_joint_report_unencoded(t):
    found = joint_report.joint_report(t("obs"), joint_report.Part("noop", value="s"), joint_report.Part("noop", value="board"))
    return found.select("v1", "v2", "count_estimate", "std_error", F.round("proportion", 9).alias("proportion"))


@query("SELECT a.obs_id, a.value AS type, b.value AS amount, o.board FROM {tall} a JOIN {tall} b USING (obs_id) JOIN {obs} o USING (obs_id) WHERE a.part_name = 'type' AND a.kind = 'string' AND b.part_name = 'amount' AND b.encoding = 'noop'")
def r3_raw_dump_report(t):
    return rows.raw_dump(t("tall"), {"type": "string", "amount": "int"}).join(t("obs").select("obs_id", "board"), "obs_id")


@query("SELECT 0 AS variable, s AS value, count(*) AS n FROM {obs} GROUP BY s UNION ALL SELECT 1, board, count(*) FROM {obs} GROUP BY board")
def r4_marginal_reports(t):
    return reports.marginal_reports(reports.joint_counts(t("obs").select(F.col("s").alias("v1"), F.col("board").alias("v2")), "v1", "v2"))


@query("""SELECT year(d) || '-' || month(d) || '-' || day(d) AS date, coalesce('"' || label || '"', '"<index ' || idx || '>"') AS value, CASE WHEN n <= 0 THEN '0' ELSE printf('%.3f', n) END AS count, '1.500' AS err
 FROM (SELECT CAST(ts AS DATE) AS d, idx, count(*) - 5.0::DOUBLE AS n FROM {obs} GROUP BY ALL) LEFT JOIN {labels_dim} USING (idx) WHERE NOT (label IS NULL AND abs(n) < 1e-4)""")
def r5_finished_report(t):
    report = t("obs").groupBy("day_index", "idx").agg((F.count("*") - 5.0).alias("count_estimate"))
    report = report.withColumns({"kind": F.lit("index"), "std_error": F.lit(1.5), "s": F.lit(None).cast("string"), "i": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "b": F.lit(None).cast("binary")})
    return reports.finished_report(report, t("labels_dim"))


@query("""SELECT year(f) || '-' || month(f) || '-' || day(f) AS start_date, year(l) || '-' || month(l) || '-' || day(l) AS end_date, '"' || s || '"' AS value, '"' || coalesce(os, '') || '"' AS os, '"' || board || '"' AS board_name, printf('%.3f', n) AS count, '0' AS err
 FROM (SELECT s, CASE WHEN client_id % 3 > 0 THEN 'os' || client_id % 2 END AS os, board, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l, count(*)::DOUBLE AS n FROM {obs} GROUP BY ALL)""")
def r5_finished_report_by_profile(t):
    """Start and end dates, and profile columns of which some are unset."""
    os = F.when(F.col("client_id") % 3 > 0, F.concat(F.lit("os"), (F.col("client_id") % 2).cast("string")))
    report = t("obs").groupBy("s", os.alias("os"), F.col("board").alias("board_name")).agg(F.min("day_index").alias("first"), F.max("day_index").alias("last"), F.count("*").cast("double").alias("count_estimate"))
    report = report.withColumns({"kind": F.lit("string"), "std_error": F.lit(0.0), "idx": F.lit(None).cast("long"), "i": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "b": F.lit(None).cast("binary"), "label": F.lit(None).cast("string")})
    return reports.finished_report(report, None, ("os", "board_name"), "first", "last")


@query(DUE_SQL)
def r6_due_daily_reports(t):
    return reports.due_daily_reports(t("configs"), t("history"), TODAY)


@query(f"""SELECT config_id, e AS epoch FROM {{configs}}, (SELECT unnest(range(({TODAY} + 4) // 7 - 8, ({TODAY} + 4) // 7)) AS e)
 WHERE (config_id, e) NOT IN (SELECT (config_id, (day + 4) // 7) FROM {{history}} WHERE NOT one_off AND state IN ('COMPLETED', 'IN_PROGRESS'))""")
def r7_due_weekly_reports(t):
    return reports.due_epoch_reports(t("configs"), t("history"), TODAY, S.WEEK, 8)


_MONTH = "((year({0}) - 1970) * 12 + month({0}) - 1)"
_TODAY_SQL = f"(DATE '1970-01-01' + INTERVAL {TODAY} DAY)"


@query(f"""SELECT config_id, e AS epoch FROM {{configs}}, (SELECT unnest(range({_MONTH.format(_TODAY_SQL)} - 3, {_MONTH.format(_TODAY_SQL)})) AS e)
 WHERE (config_id, e) NOT IN (SELECT (config_id, {_MONTH.format("(DATE '1970-01-01' + INTERVAL (day) DAY)")}) FROM {{history}} WHERE NOT one_off AND state IN ('COMPLETED', 'IN_PROGRESS'))""")
def r7_due_monthly_reports(t):
    return reports.due_epoch_reports(t("configs"), t("history"), TODAY, S.MONTH, 3)


@query("""SELECT obs_id, year(ts) || '-' || month(ts) || '-' || day(ts) || ',"' || s || '",' || i || ',' || coalesce('"' || label || '"', '"<index ' || idx || '>"') || ',' || CASE WHEN printf('%.3f', d) IN ('0.000', '-0.000') THEN '0' ELSE printf('%.3f', d) END || ',"' || board || '","' || CASE WHEN obs_id % 2 = 0 THEN 'x64' ELSE '' END || '"' AS line
 FROM {obs} LEFT JOIN {labels_dim} USING (idx) WHERE obs_id % 9 <> 0""")
def r8_raw_dump_rendered(t):
    """Dates, labels and profile of observations that have all parts."""
    obs = t("obs")
    part = lambda name, kind, value: obs.select("obs_id", F.lit(name).alias("part_name"), F.lit(kind).alias("kind"), F.lit("noop").alias("encoding"), F.col(value).cast("string").alias("value"))
    parts = {"type": "string", "amount": "int", "slot": "index", "share": "double"}
    tall = part("type", "string", "s").unionByName(part("amount", "int", "i").where("obs_id % 9 <> 0")).unionByName(part("slot", "index", "idx")).unionByName(part("share", "double", "d"))
    dump = rows.raw_dump(tall, parts).join(obs.select("obs_id", "day_index", F.col("board").alias("board_name"), F.when(F.col("obs_id") % 2 == 0, "x64").alias("arch")), "obs_id")
    return reports.dump_lines(dump, parts, {"slot": t("labels_dim")}, ("board_name", "arch")).select("obs_id", "line")


@query("SELECT report_id, min(stamp) AS created, arg_max(state, stamp) AS state, max(stamp) AS updated FROM {report_events} GROUP BY report_id")
def r9_report_metadata(t):
    return reports.report_metadata(t("report_events"))


@query("SELECT report_id, count(*) AS n_messages, arg_max(message, stamp) AS last_message FROM {report_events} WHERE message IS NOT NULL GROUP BY report_id")
def r9_report_errors(t):
    return reports.report_errors(t("report_events"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 5")
def r10_popular_values(t):
    return reports.popular_values(t("part"), "p_name", 5)


# streams


@query("SELECT random_id, s FROM {obs}")
def st1_stream_dedupe(t):
    obs = t("obs").select("random_id", "ts", "s")
    twice = obs.unionByName(obs.where("random_id % 3 = 0"))
    return streams.drain(streams.stream_dedupe(streams.as_stream(twice, "st1"))).select("random_id", "s")


RELEASE_SQL = f"""SELECT obs_id, CASE WHEN count(*) OVER (PARTITION BY metric_id, k, day_index) >= 30 THEN 'release' WHEN {TODAY} - day_index > 15 THEN 'dispose' ELSE 'hold' END AS action
 FROM (SELECT *, CASE WHEN client_id % 5 <> 0 THEN board END AS k FROM {{obs}})"""


@query(RELEASE_SQL)
def st2_threshold_release(t):
    """Some rows have no board: null is a key like any other."""
    buffer = t("obs").withColumn("arrival_day", F.col("day_index")).withColumn("k", F.when(F.col("client_id") % 5 != 0, F.col("board")))
    return rows.threshold_release(buffer, ["metric_id", "k", "day_index"], 30, 15, TODAY).select("obs_id", "action")


RELEASE_DAYS = (19732, 19745)  # the last days of the first and second batch
_LEAST = "(SELECT greatest(3, count(*) // 400) FROM b)"


def _batch_sql(n: int) -> str:
    """Batch n: what is left of the batches before, by their latest arrival less five days, and the new rows that are not too late."""
    if n == 1:
        return "buf1 AS (SELECT k, obs_id, ts FROM b WHERE n = 1)"
    mark = f"(SELECT max(ts) - INTERVAL 5 DAY FROM b WHERE n < {n})"
    held = f"SELECT k, obs_id, ts FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM buf{n - 1}) WHERE c < {_LEAST} AND CAST(ts AS DATE) >= CAST({mark} AS DATE)"
    return f"buf{n} AS ({held} UNION ALL SELECT k, obs_id, ts FROM b WHERE n = {n} AND ts >= {mark})"


RELEASE_STREAM_SQL = f"""WITH b AS (SELECT CASE WHEN client_id % 37 <> 0 THEN board || client_id % 37 END AS k, obs_id, ts, CASE WHEN day_index <= {RELEASE_DAYS[0]} THEN 1 WHEN day_index <= {RELEASE_DAYS[1]} THEN 2 ELSE 3 END AS n FROM {{obs}}),
 {', '.join(map(_batch_sql, (1, 2, 3)))}
SELECT k, obs_id FROM ({' UNION ALL '.join(f'SELECT *, {n} AS n, count(*) OVER (PARTITION BY k) AS c FROM buf{n}' for n in (1, 2, 3))}) WHERE c >= {_LEAST}"""


@query(RELEASE_STREAM_SQL)
def st2_threshold_release_stream(t):
    """Three batches; rows older than five days before the latest arrival go, also those of keys that get nothing new."""
    k = F.when(F.col("client_id") % 37 != 0, F.concat("board", (F.col("client_id") % 37).cast("string")))
    obs = t("obs").select(k.alias("k"), "obs_id", "ts", "day_index")
    first, second = RELEASE_DAYS
    days = [F.col("day_index") <= first, F.col("day_index").between(first + 1, second), F.col("day_index") > second]
    stream = streams.as_batches([obs.where(d).drop("day_index") for d in days], "st2")
    return streams.drain(streams.threshold_release_stream(stream, "k", "obs_id", "ts", max(3, obs.count() // 400), 5))


@query("SELECT obs_id, s FROM {obs}")
def st3_dispatch_trigger(t):
    """Dispatched at an interval of a second until all is out."""
    return streams.drain(streams.as_stream(t("obs").select("obs_id", "s").repartition(4), "st3", 2), hours=1 / 3600)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS period, s, count(*) AS n FROM {obs} GROUP BY ALL")
def st4_counter_stream(t):
    return streams.drain(streams.counter_stream(streams.as_stream(t("obs").select("ts", "s"), "st4"), "1 hour", "s", late="60 days"), "update", ["period", "s"])


@query("SELECT metric_id, obs_id FROM {obs} QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY " + _uniform_sql("res", "obs_id") + ", obs_id) <= 20")
def st5_reservoir_sample(t):
    return streams.reservoir(t("obs"), 20, ["metric_id"], "obs_id", "res").select("metric_id", "obs_id")


PERIODS = "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')"
_DRAW_PERIOD = f"row_number() OVER (PARTITION BY metric_id, period ORDER BY {_uniform_sql('res', 'obs_id')}, obs_id) <= 20"


def _week_batches(t):
    """Three batches by day, and a last row that ends all periods."""
    obs = t("obs").select("metric_id", "obs_id", "ts", "s", "d", "day_index")
    parts = [obs.where(F.pmod(F.col("obs_id"), F.lit(3)) == n).drop("day_index") for n in range(3)]
    end = t("region").limit(1).select(F.lit(-1).cast("long").alias("metric_id"), F.lit(-1).cast("long").alias("obs_id"), F.expr("timestamp'2030-01-01 00:00:00'").alias("ts"), F.lit("end").alias("s"), F.lit(0.0).alias("d"))
    return streams.as_batches([*parts, end.select(*parts[0].columns)], "weeks")


@query(f"SELECT metric_id, period, obs_id FROM (SELECT *, {PERIODS} AS period FROM {{obs}}) QUALIFY {_DRAW_PERIOD}")
def st5_reservoir_stream(t):
    return streams.drain(streams.reservoir_stream(_week_batches(t), 20, "metric_id", "7 days", "obs_id", "res", late="60 days")).select("metric_id", "period", "obs_id")


LOG_SQL = f"""SELECT metric_id, period, (SELECT string_agg(s || '=' || c, ',' ORDER BY s) FROM (SELECT s, count(*) AS c FROM {{obs}} x WHERE x.metric_id = w.metric_id AND time_bucket(INTERVAL 7 DAY, x.ts, TIMESTAMP '1970-01-01') = w.period GROUP BY s)) AS statuses,
 count(*) AS n, round(sum(d), 4) AS total, round(avg(d) FILTER (WHERE drawn), 6) AS mean FROM (SELECT *, {_DRAW_PERIOD} AS drawn FROM (SELECT *, {PERIODS} AS period FROM {{obs}})) w GROUP BY ALL"""


def _log_rows(df):
    statuses = F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select("metric_id", "period", statuses.alias("statuses"), "n", F.round("total", 4).alias("total"), *r6("mean"))


@query(LOG_SQL)
def st6_event_log(t):
    """Statuses, total and the mean of a sample, by week."""
    return _log_rows(streams.event_log(t("obs"), 20, "metric_id", "7 days", "s", "d", "obs_id", "res"))


@query(LOG_SQL)
def st6_event_log_stream(t):
    return _log_rows(streams.drain(streams.event_log_stream(_week_batches(t), 20, "metric_id", "7 days", "s", "d", "obs_id", "res", late="60 days")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, s, count(*) AS n FROM {obs} GROUP BY ALL")
def st7_finalization_window(t):
    return streams.drain(streams.finalization_window(streams.as_stream(t("obs").select("ts", "s"), "st7"), 60, "s"), "update", ["day", "s"])


@query("SELECT client_id AS envelope_id, CASE WHEN client_id % 4 = 0 THEN 'env' ELSE board END AS board, metric_id, obs_id, 19750 AS arrival_day FROM {obs}")
def st8_receive(t):
    # an envelope holds at most 100 observations: those of a client with ids in one run of 100
    batches = t("obs").groupBy("client_id", F.floor(F.col("obs_id") / 100).alias("run"), "board", "metric_id").agg(F.collect_list("obs_id").alias("observations"))
    envelopes = batches.groupBy(F.col("client_id").alias("envelope_id"), "run").agg(F.collect_list(F.struct("board", "metric_id", "observations")).alias("batches"))
    envelopes = envelopes.withColumn("env_board", F.when(F.col("envelope_id") % 4 == 0, "env").otherwise(""))
    return rows.receive(envelopes, TODAY)
