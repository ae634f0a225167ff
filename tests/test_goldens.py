"""Closed-form expectations of single operators."""

import hashlib
from math import isclose, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil import catalog
from tallyveil.functions import scalars as S
from tallyveil.operators import checks, encoding, estimate, field, joint, rows
from tallyveil.plans import compiled, joint_report, reports
from tallyveil.sources import tables
from tallyveil.streaming import streams


@pytest.mark.parametrize(("n", "p", "q", "y"), [(100, 0.2, 0.8, 40), (1000, 0.15, 0.85, 300), (5000, 0.5, 0.9, 2600), (100, 0.0, 1.0, 17)])
def test_basic_rappor_estimate(spark, n, p, q, y):
    r = estimate.basic_rappor_estimate(spark.createDataFrame([(y, n)], "y long, n long"), p, q).first()
    assert isclose(r.count_estimate, (y - p * n) / (q - p), rel_tol=1e-9)
    assert isclose(r.std_error, sqrt(y * (1 - p - q) + n * p * q) / abs(q - p), abs_tol=1e-9)


def test_linear_buckets(spark):
    values = [(9, 0), (10, 1), (11, 1), (12, 2), (14, 3), (15, 3), (16, 4), (20, 4), (-100, 0)]
    got = spark.createDataFrame(values, "v long, want int").select(S.linear_bucket("v", 10, 3, 2).alias("b"), "want").collect()
    assert all(r.b == r.want for r in got)


def test_calendar(spark):
    r = spark.range(1).select(S.date_to_day(F.lit("1970-02-01").cast("date")).alias("a"), S.date_to_day(F.lit("2016-10-18").cast("date")).alias("b"), S.week_index(F.lit(17137)).alias("w"), S.date_string(F.lit(17137)).alias("d")).first()
    assert (r.a, r.b, r.w, r.d) == (31, 17092, 2448, "2016-12-2")


def test_report_floats_and_strings(spark):
    r = spark.range(1).select(*[S.format_float(F.lit(x)).alias(f"f{i}") for i, x in enumerate((456.7, 8.0, 1e-6, 0.02))], S.csv_string(F.lit('a"\n\t%é')).alias("s")).first()
    assert list(r)[:4] == ["456.700", "8.000", "0", "0.020"]
    assert r.s == '"a%22%0A%09%25%C3%A9"'


def test_threshold_decryption(spark):
    clients = {"AAAA": (18, 1), "BBBB": (19, 1), "CCCC": (20, 1), "DDDD": (21, 1), "EEEE": (22, 2), "FFFF": (23, 3)}
    data = [(v, c, 5, 1) for v, (n, times) in clients.items() for c in range(n) for _ in range(times)]
    obs = spark.createDataFrame(data, "v string, client long, day_index int, metric_id int")
    got = encoding.threshold_decrypt(encoding.encode_threshold(obs, "v", "client", 20, S.DAY, "k"), 20).collect()
    assert {r.plaintext: r.total for r in got} == {"CCCC": 20, "DDDD": 21, "EEEE": 44, "FFFF": 69}


def test_threshold_epochs(spark):
    obs = spark.createDataFrame([("x", c, d, 1) for d in (0, 1) for c in range(10 * d, 10 * d + 10)], "v string, client long, day_index int, metric_id int")
    for epoch, found in ((S.DAY, 0), (S.WEEK, 1)):
        assert encoding.threshold_decrypt(encoding.encode_threshold(obs, "v", "client", 20, epoch, "k"), 20).count() == found


@pytest.mark.parametrize("threshold", [1, 10, 20, 40, 80, 100])
def test_release_needs_the_threshold(spark, threshold):
    buffer = spark.range(40).select("id", F.lit(1).alias("metric_id"), F.lit(10).alias("arrival_day"))
    got = rows.threshold_release(buffer, ["metric_id"], threshold, 4, 10).where("action = 'release'").count()
    assert got == (40 if 40 >= threshold else 0)


def test_joint_em_recovers_independence(spark):
    patterns = spark.createDataFrame([(0, [0], 0, [0], 360), (0, [0], 0, [1], 240), (0, [1], 0, [0], 240), (0, [1], 0, [1], 160)], "cohort1 int, bits1 array<int>, cohort2 int, bits2 array<int>, weight long")
    v = joint.index_variable(["a", "b"], 0.1, 0.9)
    table = joint.report_likelihoods(patterns, v, v)
    fit = joint.joint_em(table, 2, 2, 60, 1e-5)
    _, info = joint.joint_variance(table, fit.grid)
    statistic, p = joint.independence_test(fit.grid, info)
    assert abs(fit.grid.sum() - 1) < 1e-9 and statistic < 0.5 and p > 0.4 and fit.converged


def test_likelihoods_equal_products_over_all_bits(spark):
    """Cohorts with bits of their own, Other by cohort, and a boolean."""
    other = np.random.default_rng(1).random((3, 12))
    v = joint.string_variable(spark, ["x", "y", "zz"], 12, 2, 3, 0.2, 0.7, other)
    reports = [(c, sorted({(7 * c + i) % 12, (5 * i) % 12, 3}), 0, [0] if i % 2 else []) for c in range(3) for i in range(9)]
    reports = [r for n, r in enumerate(reports) if r not in reports[:n]]
    df = spark.createDataFrame(reports + reports[:4], "c1 int, set_bits array<int>, c2 int, flag array<int>")
    table = joint.report_likelihoods(joint.report_patterns(df, "set_bits", "flag", "c1"), v, joint.boolean_variable(0.2, 0.7)).collect()
    got = sorted((int(r.weight), *(round(float(np.exp(r.top1) * x), 12) for x in r.c1), *(round(float(np.exp(r.top2) * x), 12) for x in r.c2)) for r in table)
    want = []
    for n, (c, bits, _, flag) in enumerate(reports):
        own = [set(v.places[c, j][v.places[c, j] < 12]) for j in range(3)]
        chance = [np.prod([(0.7 if b in o else 0.2) if b in bits else (0.3 if b in o else 0.8) for b in range(12)]) for o in own]
        chance.append(np.prod([other[c, b] if b in bits else 1 - other[c, b] for b in range(12)]))
        want.append((2 if n < 4 else 1, *(round(float(x), 12) for x in chance), *((0.7, 0.2) if flag else (0.3, 0.8))))
    assert got == [tuple(x) for x in sorted(want)] or np.allclose(got, sorted(want))


def test_sums_over_many_tasks(spark):
    """More tasks than are merged at once, and an information matrix of several blocks."""
    patterns = spark.createDataFrame([(0, [i % 3], 0, [(i // 3) % 2], 1 + i % 5) for i in range(400)], "cohort1 int, bits1 array<int>, cohort2 int, bits2 array<int>, weight long")
    table = joint.report_likelihoods(patterns.repartition(70), joint.index_variable(list("abc"), 0.2, 0.8), joint.index_variable(list("de"), 0.2, 0.8)).cache()
    one = table.coalesce(1).cache()
    grid = joint.joint_em(one, 3, 2, 5).grid
    assert np.allclose(joint.joint_em(table, 3, 2, 5).grid, grid)
    rows = one.collect()
    c = np.array([np.outer(r.c1, r.c2).ravel() for r in rows])
    v = c / (c @ grid.ravel())[:, None]
    dense = (v * np.array([r.weight for r in rows])[:, None]).T @ v
    assert np.allclose(joint.joint_variance(table, grid)[1], dense)


def test_planted_joint_of_strings_and_indices(spark):
    """Strings follow the index; one string is no candidate."""
    values = F.array(*map(F.lit, ["apple", "banana", "cherry", "unlisted"]))
    obs = spark.range(12_000).select(F.col("id").alias("obs_id"), F.col("id").alias("client"), (F.col("id") % 3).cast("int").alias("i"))
    obs = obs.withColumn("v", F.get(values, F.when(F.col("obs_id") % 10 < 7, F.col("i")).when(F.col("obs_id") % 10 == 7, 3).otherwise((F.col("i") + 1) % 3)))
    coded = encoding.encode_rappor(obs, "v", "client", 32, 2, 4, 0.1, 0.9, "t").withColumn("bits2", encoding.noisy_bits(F.col("i"), 3, 0.1, 0.9, "u", "obs_id"))
    string = joint_report.Part("string", bits="set_bits", cohort="cohort", names=("apple", "banana", "cherry", "durian"), k=32, h=2, m=4, p=0.1, q=0.9)
    got = {(r.v1, r.v2): r for r in joint_report.joint_report(coded, string, joint_report.Part("index", bits="bits2", names=("0", "1", "2"), p=0.1, q=0.9)).collect()}
    assert len(got) == 15 and all(r.converged for r in got.values())
    actual = {(r.v, str(r.i)): r.n for r in obs.groupBy("v", "i").agg(F.count("*").alias("n")).collect()}
    for name in ("apple", "banana", "cherry"):
        for i in "012":
            assert abs(got[name, i].count_estimate - actual.get((name, i), 0)) < 450
    assert abs(sum(got["Other", i].count_estimate for i in "012") - 1200) < 1000  # the penalty takes from known strings


def test_elastic_net_finds_the_frequent_candidate(spark):
    obs = spark.range(3000).select(F.col("id").alias("obs_id"), F.col("id").alias("client"), F.when(F.col("id") % 10 < 8, "aa").otherwise("bb").alias("v"))
    coded = encoding.encode_rappor(obs, "v", "client", 16, 2, 4, 0.05, 0.95, "t")
    got = {r.candidate: r.count_estimate for r in estimate.rappor_estimate(coded, spark.createDataFrame([("aa",), ("bb",), ("cc",)], "candidate string"), 16, 2, 4, 0.05, 0.95).collect()}
    assert got["aa"] > got["bb"] > got["cc"] - 1e-9 and abs(got["aa"] - 2400) < 600


def test_envelopes_keep_their_cap(spark):
    sizes = [60, 60, 30, 10, 101, 100, 1]
    df = spark.createDataFrame([(k, i, n) for k in ("a", "b") for i, n in enumerate(sizes)], "k string, i long, n long")
    got = {(r.k, r.i): r.envelope for r in rows.pack_batches(df, ["k"], "i", F.col("n"), 100).collect()}
    assert [got.get(("a", i)) for i in range(7)] == [0, 1, 1, 1, None, 2, 3] and len(got) == 12
    hot = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") % 40 + 1).alias("n"))
    full = rows.pack_batches(hot, ["k"], "i", F.col("n"), 100, slice_envelopes=10).groupBy("envelope").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r.c for r in full) == 1000 and max(r.n for r in full) <= 100
    assert len({r.envelope >> 32 for r in full}) > 1


def test_metrics_are_found_by_customer_and_project(spark):
    metrics = spark.createDataFrame([(1, 1, 7, 0), (2, 1, 7, 3)], "customer_id long, project_id long, id long, max_build_level int")
    obs = spark.createDataFrame([(1, 1, 1, 7, 2), (2, 2, 1, 7, 2)], "obs_id long, customer_id long, project_id long, metric_id long, build_level int")
    assert [r.obs_id for r in rows.filter_build_level(obs, metrics).collect()] == [2]
    parts = spark.createDataFrame([(1, 1, 7, "p", "string"), (2, 1, 7, "p", "int"), (2, 1, 7, "q", "int")], "customer_id long, project_id long, metric_id long, part_name string, data_type string")
    values = obs.selectExpr("obs_id", "customer_id", "project_id", "metric_id", "'p' AS part_name", "'string' AS kind", "true AS is_set")
    assert {r.obs_id: r.reason for r in checks.validate_values(values, parts).collect()} == {1: None, 2: "wrong number of parts"}
    variables = obs.selectExpr("obs_id", "customer_id", "project_id", "metric_id", "'q' AS part_name", "false AS has_labels", "true AS has_candidates")
    assert {r.obs_id: r.reason for r in checks.invalid_variables(variables, parts).collect()} == {1: "no such part", 2: "candidates on a part that is no string"}


def _arrivals(spark, batches, columns="k string, v long, day int"):
    return streams.as_batches([spark.createDataFrame(b, columns).withColumn("at", F.timestamp_seconds(F.col("day").cast("long") * 86_400 + 60)) for b in batches], "t")


def test_release_over_three_batches(spark):
    """Null keys are kept, thresholds are met over batches, what is too old goes, and an idle key's state ends."""
    batches = [
        [("a", 1, 10), ("a", 2, 10), (None, 3, 10), ("idle", 4, 10), ("old", 5, 10), ("b", 6, 10)],
        [("a", 11, 12), (None, 12, 12), (None, 13, 12), ("b", 14, 20)],
        [("old", 21, 20), ("old", 22, 20), ("b", 23, 20), ("b", 24, 21), ("b", 25, 21), ("b", 26, 21)],
    ]
    for hours in (None, 1 / 3600):
        progress = []
        stream = streams.threshold_release_stream(_arrivals(spark, batches), "k", "v", "at", 3, 4)
        got = streams.drain(stream, progress=progress, hours=hours).collect()
        # "old" has two rows left of three, since the first went with the watermark of day 16; "b" loses its first too
        assert sorted((r.k or "", r.v) for r in got) == [("", 3), ("", 12), ("", 13), ("a", 1), ("a", 2), ("a", 11), ("b", 14), ("b", 23), ("b", 24), ("b", 25), ("b", 26)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) > states[-1]


def test_release_sends_large_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", 7)
    batches = [[("k", i, 10) for i in range(90)], [("k", i, 11) for i in range(90, 130)]]
    got = streams.drain(streams.threshold_release_stream(_arrivals(spark, batches), "k", "v", "at", 100, 4)).collect()
    assert sorted(r.v for r in got) == list(range(130))


def test_periods_end_with_their_state(spark):
    """Three periods: stream equals batch, and only the last row's period is left in the state."""
    events = spark.range(600).select(F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("string")).alias("g"), F.col("id").alias("e"), F.timestamp_seconds(F.col("id") * 500 + 1).alias("ts"), F.when(F.col("id") % 3 > 0, "ok").otherwise("bad").alias("s"), (F.col("id") % 17).cast("double").alias("d"))
    end = spark.createDataFrame([("end", -1, 10**9, "ok", 0.0)], "g string, e long, t long, s string, d double").select("g", "e", F.timestamp_seconds("t").alias("ts"), "s", "d")
    parts = [events.where(F.col("e") % 3 == n) for n in range(3)] + [end]
    progress = []
    sample = streams.drain(streams.reservoir_stream(streams.as_batches(parts, "t"), 5, "g", "100000 seconds", "e", "salt", late="10 days"), progress=progress).collect()
    want = streams.reservoir(events.withColumn("period", F.window("ts", "100000 seconds")["start"]), 5, ["g", "period"], "e", "salt").collect()
    assert sorted((r.g or "", r.period, r.e) for r in sample) == sorted((r.g or "", r.period, r.e) for r in want) and len({r.period for r in want}) == 3 and len(want) == 45
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert states[-1] < 10 and max(states) < 9 * (5 + 12)
    log = streams.drain(streams.event_log_stream(streams.as_batches(parts, "t"), 5, "g", "100000 seconds", "s", "d", "e", "salt", late="10 days")).collect()
    batch = streams.event_log(events, 5, "g", "100000 seconds", "s", "d", "e", "salt").collect()
    key = lambda r: (r.g or "", r.period, sorted(r.statuses.items()), r.n, round(r.total, 6), round(r.mean, 6))
    assert sorted(map(key, log)) == sorted(map(key, batch)) and len(log) == 9


def test_bad_rows_are_errors(spark):
    bits = spark.createDataFrame([(0, [1]), (0, [9]), (5, [1]), (None, None)], "cohort int, set_bits array<int>")
    assert tuple(estimate.bit_errors(bits, 4, 2).first()) == (4, 3) and tuple(estimate.bit_errors(bits, 4).first()) == (4, 2)
    assert {r.n for r in estimate.bit_counts(bits, 4).collect()} == {2}
    with pytest.raises(Exception, match="n is above 10"):
        estimate.mle_counts(spark.createDataFrame([(11, 3)], "n long, y long"), 0.25, 0.75, 10).collect()
    pairs = spark.createDataFrame([("a", "b"), ("", "b")], "v1 string, v2 string")
    assert rows.drop_blank_reports(pairs, "v1", "v2").count() == 1
    with pytest.raises(Exception, match="blank"):
        rows.drop_blank_reports(pairs, "v1", "v2", strict=True).collect()


def test_chunks_of_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 > 0, "hot").alias("k"), F.col("id").alias("i"))
    sizes = [tuple(r) for r in rows.chunk(df, ["k"], "i", 100, "s").groupBy("k", "chunk").count().collect()]
    assert len(sizes) == 20 and all(n == 100 for *_, n in sizes)


def test_grouped_elastic_net_equals_the_general_solver(spark):
    """Two groups in one plan; on each, the weights of a regression with the same penalties."""
    obs = spark.range(4000).select(F.col("id").alias("obs_id"), F.col("id").alias("client"), (F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 < 6, "aa").when(F.col("id") % 10 < 8, "bb").otherwise("dd").alias("v"))
    coded = encoding.encode_rappor(obs, "v", "client", 16, 2, 4, 0.05, 0.95, "t")
    names = spark.createDataFrame([("aa",), ("bb",), ("cc",), ("dd",)], "candidate string")
    counts = estimate.bit_counts(coded, 16, ["g", "cohort"])
    ratios = estimate.basic_rappor_estimate(counts, 0.05, 0.95).select("g", "cohort", "bit", F.lit(16).alias("k"), F.lit(4).alias("m"), (F.col("count_estimate") / F.col("n")).alias("ratio"), F.lit(2000).alias("n_all"))
    matrix = rows.candidate_matrix(names, 16, 2, 4).select(F.explode(F.expr("array(0L, 1L)")).alias("g"), "candidate", "cohort", "bit")
    got = {(r.g, r.candidate): r for r in estimate.grouped_rappor_estimate(ratios, matrix, ["g"]).collect()}
    assert len(got) == 8 and all(r.converged and r.epochs < 1000 for r in got.values())
    for g in (0, 1):
        want = estimate.rappor_estimate(coded.where(F.col("g") == g), names, 16, 2, 4, 0.05, 0.95).collect()
        assert all(abs(got[g, r.candidate].count_estimate - r.count_estimate) < 1 for r in want)
    short = estimate.grouped_rappor_estimate(ratios, matrix, ["g"], epochs=1).collect()
    assert not any(r.converged for r in short)


def test_candidates_apart_are_exact(spark):
    """No noise, no shared bits: each estimate is its count, less what the penalty takes; unlisted strings get nothing."""
    data = [("a" * n, c) for n, times in ((1, 50), (2, 30), (3, 20)) for c in range(1000 * n, 1000 * n + times)]
    obs = spark.createDataFrame(data, "v string, client long").withColumn("obs_id", F.col("client"))
    coded = encoding.encode_rappor(obs, "v", "client", 512, 2, 2, 0.0, 1.0, "t")
    names = spark.createDataFrame([("a",), ("aa",), ("zz",)], "candidate string")
    got = {r.candidate: r.count_estimate for r in estimate.rappor_estimate(coded, names, 512, 2, 2, 0.0, 1.0).collect()}
    assert abs(got["a"] - 50) < 16 and abs(got["aa"] - 30) < 16 and abs(got["zz"]) < 1e-6


def test_forged_ciphertexts_count_as_failures(spark):
    obs = spark.createDataFrame([(v, c, 5, 1) for v in ("good", "forged", "few") for c in range(3 if v == "few" else 6)], "v string, client long, day_index int, metric_id int")
    coded = encoding.encode_threshold(obs, "v", "client", 5, S.DAY, "k")
    forged = coded.withColumn("ciphertext", F.when(F.col("v") == "forged", F.expr("concat(left(ciphertext, length(ciphertext) - 2), CASE WHEN right(ciphertext, 2) = '00' THEN '11' ELSE '00' END)")).otherwise(F.col("ciphertext")))
    clash = coded.where("v = 'few'").limit(1).withColumn("point_y", F.lit("00"))
    got = {(r.outcome, r.plaintext) for r in encoding.threshold_outcomes(forged.unionByName(clash), 5).collect()}
    assert got == {("ok", "good"), ("unauthentic", None), ("conflict", None)}
    per_row = encoding.threshold_outcomes(coded.withColumn("t", F.when(F.col("v") == "few", 3).otherwise(7)).withColumn("g", F.lit(None).cast("string")), "t", ("g", "t")).collect()
    assert sorted(r.outcome for r in per_row) == ["below", "below", "unauthentic"]  # three points of a polynomial of degree four


def test_exponential_buckets_by_columns(spark):
    df = spark.createDataFrame([(v, "exponential", 10, 3, 2, 3) for v in (9, 10, 11, 12, 15, 16, 27, 28, 99)], "i long, bucket_kind string, floor long, n_buckets int, step int, multiplier int")
    got = [r.b for r in df.select(compiled.bucket_of("i").alias("b")).collect()]
    want = [r.b for r in df.select(S.exponential_bucket("i", 10, 3, 2, 3).alias("b")).collect()]
    assert got == want and min(got) == 0 and max(got) == 4


def _store(spark, n=60):
    rows_ = [(1, 1, i % 3, 100 + i % 5, i, f"v{i}") for i in range(n)]
    return spark.createDataFrame(rows_, "customer_id long, project_id long, metric_id long, day_index int, random_id long, s string")


def test_append_reads_touched_partitions_only(spark, tmp_path):
    """A file of another partition may even be broken: it is neither read nor changed."""
    obs, path = _store(spark), str(tmp_path / "store")
    tables.write_observations(obs, path)
    broken = next((tmp_path / "store" / "customer_id=1" / "project_id=1" / "metric_id=2" / "day_index=104").glob("part-*.parquet"))
    broken.write_bytes(b"no parquet")
    spark.catalog.clearCache()
    again = obs.where("metric_id = 0").unionByName(spark.createDataFrame([(1, 1, 0, 101, 999, "new"), (1, 1, 7, 100, 1, "new")], obs.schema))
    tables.write_observations(again, path)
    tables.write_observations(again, path)
    assert broken.read_bytes() == b"no parquet"
    read = spark.read.parquet(path)
    assert read.where("metric_id = 0").count() == 21 and read.where("metric_id = 7").count() == 1 and read.where("metric_id = 1").count() == 20
    plan = read.where(tables.touched(again))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_deletion_leaves_other_partitions(spark, tmp_path):
    obs, path = _store(spark), str(tmp_path / "store")
    tables.write_observations(obs, path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*.parquet")}
    before = files()
    assert tables.drop_partitions(spark, path, customer_id=1, project_id=1, metric_id=2)
    tables.delete_rows(spark, path, (F.col("s") == "v0") | ((F.col("metric_id") == 1) & (F.col("day_index") == 101)), tables.PARTITIONS, str(tmp_path / "rest"))
    left = {r.s for r in spark.read.parquet(path).collect()}
    assert left == {f"v{i}" for i in range(60) if i % 3 != 2 and i and not (i % 3 == 1 and i % 5 == 1)}
    after = files()
    kept = [p for p in before if "metric_id=2" not in str(p) and "metric_id=0/day_index=100" not in str(p) and "metric_id=1/day_index=101" not in str(p)]
    assert len(kept) >= 8 and all(after.get(p) == before[p] for p in kept)
    assert not any("metric_id=1/day_index=101" in str(p) for p in after)


def test_export_in_parts_keeps_the_order(spark, tmp_path):
    rows_ = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("_order"), F.col("id").cast("string").alias("v")).repartition(7)
    tables.export_csv(rows_, "v", F.col("v"), [str(tmp_path / "a"), str(tmp_path / "b")], parts=6)
    parts = sorted((tmp_path / "a" / "body").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert lines == [str(i) for i in range(4999, -1, -1)] and len(parts) > 1
    got = [(r.place, r.value) for r in tables.read_export(spark, str(tmp_path / "b")).orderBy("place").collect()]
    assert got == list(enumerate(["v", *lines]))
    tables.export_csv(rows_.where("false"), "v", F.col("v"), [str(tmp_path / "c")])
    assert not (tmp_path / "c").exists()


def test_long_reports_are_errors(spark):
    meta = spark.createDataFrame([(1, "m"), (2, "n")], "report_id long, name string")
    rows_ = spark.range(15).select(F.when(F.col("id") < 5, 1).otherwise(2).cast("long").alias("report_id"), "id")
    assert {r.name for r in tables.read_report(rows_, meta, 1, 5).collect()} == {"m"} and tables.read_report(rows_, meta, 3).count() == 0
    with pytest.raises(Exception, match="more than 9 rows"):
        tables.read_report(rows_, meta, 2, 9).collect()


def test_header_rows():
    assert reports.report_header(["New York", "x"], ("os", "board_name")) == "date,New_York,x,OS,Board_Name,count,err"
    assert reports.report_header(["v"], days=3, counts=False) == "start_date,end_date,v"


def test_field_arithmetic_equals_whole_numbers():
    rng = np.random.default_rng(5)
    edge = [0, 1, 2, field.PRIME - 1, field.PRIME - 2, 2**126, 2**104 - 1, 2**26, 2**64]
    a = [int.from_bytes(rng.bytes(16), "big") % field.PRIME for _ in range(200)] + edge
    b = edge + [int.from_bytes(rng.bytes(16), "big") % field.PRIME for _ in range(200)]
    x, y = (field.pack([f"{v:x}" for v in side]) for side in (a, b))
    whole = lambda z: [int(h, 16) for h in field.unpack(z)]
    assert whole(x) == a and whole(field.add(x, y)) == [(i + j) % field.PRIME for i, j in zip(a, b)]
    assert whole(field.sub(x, y)) == [(i - j) % field.PRIME for i, j in zip(a, b)] and whole(field.mul(x, y)) == [i * j % field.PRIME for i, j in zip(a, b)]
    assert whole(field.inverse(x)) == [pow(i, field.PRIME - 2, field.PRIME) for i in a]


def test_interpolation_gives_the_secret():
    for t in (1, 2, 20, 150):
        secrets = [f"{(7919 * i + t) ** 7 % 2**120:030x}" for i in range(5)]
        xs = [[f"{(31 * j + 17 * i + 1) ** 5 % 2**120:x}" for j in range(t)] for i in range(5)]
        ys = [field.evaluate([s] * t, x, t) for s, x in zip(secrets, xs)]
        of = [int(c, 16) for c in field.unpack(field.coefficients(secrets[0], t))]
        assert int(ys[0][0], 16) == sum(c * pow(int(xs[0][0], 16), n, field.PRIME) for n, c in enumerate(of)) % field.PRIME
        assert field.at_zero(xs, ys) == secrets
    assert field.at_zero(xs[:1] + [xs[1][:2]], ys[:1] + [ys[1][:2]])[0] == secrets[0] and field.at_zero([], []) == []


def test_order_of_reports(spark):
    """Null, string, int, index, blob; values in order inside a kind; profiles last. Displays: counts down, then names."""
    data = [("blob", None, None, None, "a"), ("index", None, None, 2, "a"), ("int", None, 5, None, "b"), ("int", None, -1, None, "a"), ("string", "b", None, None, "a"), ("string", "a", None, None, "b"), ("string", "a", None, None, "a"), (None, None, None, None, "a"), ("index", None, None, 1, "a")]
    df = spark.createDataFrame(data, "kind string, s string, i long, idx long, os string").repartition(4)
    got = [(r.kind, r.s, r.i, r.idx, r.os) for r in rows.sort_report(df).collect()]
    assert got == [data[7], data[6], data[5], data[4], data[3], data[2], data[8], data[1], data[0]]
    shown = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 0)], "item string, n long").repartition(3)
    assert [r.item for r in rows.order_for_display(shown, "n", "item").collect()] == ["c", "a", "b", "d"]


def test_compiled_reports_take_further_estimators(spark):
    """Reports by profile and day, a kind of encoding of one's own, inconsistent payloads, and more values than are kept."""
    columns = "customer_id long, project_id long, metric_id long, part_name string, day_index int, encoding_config_id long, payload_kind string, kind string, s string, i long, idx long, d double, cohort int, set_bits array<int>, epoch int, ciphertext string, point_x string, point_y string, os string"
    row = lambda metric, day, enc, kind, s, os="a": (1, 1, metric, "p", day, enc, kind, "string", s, None, None, None, None, None, None, None, None, None, os)
    obs = [row(1, 10, 1, "noop", "x"), row(1, 10, 1, "noop", "x", "b"), row(1, 11, 1, "noop", "y"), row(1, 99, 1, "noop", "late"), row(1, 10, 1, "rappor", "wrong"), row(1, 10, 7, "noop", "unknown"), row(2, 10, 2, "length", "four"), row(2, 10, 2, "length", "sixsix")]
    obs += [row(3, 10, 1, "noop", f"v{n:05d}") for n in range(30)]
    reports_ = spark.createDataFrame([(n, 1, 1, n, "p", 10, 20, ["os"] if n == 1 else []) for n in (1, 2, 3)], "report_id long, customer_id long, project_id long, metric_id long, part_name string, first_day int, last_day int, report_fields array<string>")
    parts = spark.createDataFrame([(1, 1, n, "p") for n in (1, 2, 3)], "customer_id long, project_id long, metric_id long, part_name string").selectExpr("*", "CAST(NULL AS STRING) AS bucket_kind", "0L AS floor", "1 AS n_buckets", "1 AS step", "1 AS multiplier")
    encodings = spark.createDataFrame([(1, 1, 1, "noop"), (1, 1, 2, "length")], "customer_id long, project_id long, id long, kind string").selectExpr("*", "1 AS k", "1 AS h", "1 AS m", "0D AS p", "1D AS q", "1 AS threshold", "'DAY' AS epoch_type", "CAST(NULL AS ARRAY<STRING>) AS categories", "CAST(NULL AS BIGINT) AS first", "CAST(NULL AS BIGINT) AS last", "CAST(NULL AS INT) AS num_categories")
    none = spark.createDataFrame([], "report_id long, idx long, label string"), spark.createDataFrame([], "report_id long, candidate string")

    def lengths(of):
        counts = of.of("length").groupBy(*of.group, F.length("s").cast("long").alias("i")).agg(F.count("*").cast("double").alias("count_estimate"))
        return counts.select(*of.group, F.lit("int").alias("kind"), *compiled._null("kind", "i"), "i", "count_estimate", F.lit(0.0).alias("std_error"))

    got = compiled.histogram_reports(spark.createDataFrame(obs, columns), reports_, parts, encodings, *none, compiled.ESTIMATORS | {"length": lengths}).collect()
    assert sorted((r.os, r.s, r.count_estimate) for r in got if r.report_id == 1) == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]
    assert sorted((r.i, r.count_estimate) for r in got if r.report_id == 2) == [(4, 1), (6, 1)]
    assert len([r for r in got if r.report_id == 3]) == 30 and {r.status for r in got} == {"OK"}


def test_compiled_reports_open_large_thresholds(spark):
    """Thresholds above 2000 take all the points that they ask for."""
    obs = spark.range(2003 + 2002).selectExpr("CASE WHEN id < 2003 THEN 's:enough' ELSE 's:few' END AS v", "id AS client", "10 AS day_index", "1L AS metric_id")
    coded = encoding.encode_threshold(obs, "v", "client", 2003, S.DAY, "k").selectExpr("1L AS customer_id", "1L AS project_id", "metric_id", "'p' AS part_name", "day_index", "1L AS encoding_config_id", "'threshold' AS payload_kind", "epoch", "ciphertext", "point_x", "point_y")
    rest = {"kind": "string", "s": "string", "i": "long", "idx": "long", "d": "double", "cohort": "int", "set_bits": "array<int>"}
    coded = coded.withColumns({c: F.lit(None).cast(t) for c, t in rest.items()})
    reports_ = spark.sql("SELECT 1L AS report_id, 1L AS customer_id, 1L AS project_id, 1L AS metric_id, 'p' AS part_name, 10 AS first_day, 20 AS last_day, CAST(array() AS ARRAY<STRING>) AS report_fields")
    parts = spark.sql("SELECT 1L AS customer_id, 1L AS project_id, 1L AS metric_id, 'p' AS part_name, CAST(NULL AS STRING) AS bucket_kind, 0L AS floor, 1 AS n_buckets, 1 AS step, 1 AS multiplier")
    encodings = spark.sql("SELECT 1L AS customer_id, 1L AS project_id, 1L AS id, 'threshold' AS kind, 1 AS k, 1 AS h, 1 AS m, 0D AS p, 1D AS q, 2003 AS threshold, 'DAY' AS epoch_type, CAST(NULL AS ARRAY<STRING>) AS categories, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS last, CAST(NULL AS INT) AS num_categories")
    none = spark.createDataFrame([], "report_id long, idx long, label string"), spark.createDataFrame([], "report_id long, candidate string")
    got = compiled.histogram_reports(coded, reports_, parts, encodings, *none).collect()
    assert [(r.kind, r.s, r.count_estimate, r.status) for r in got] == [("string", "enough", 2003, "OK")]
    assert [r.total for r in encoding.threshold_decrypt(coded, 2003).collect()] == [2003]


def test_bits_of_keys_beyond_two_bytes(spark, tmp_path):
    keys = [0, 1, 65535, 65536, 65537, 1_200_000, 2**40 + 5, -2]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.bits for r in catalog.QUERIES["c9_bits_of"](spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(str(j) for j in range(16) if k >> j & 1) for k in keys}
    short = spark.createDataFrame([(bytearray(b"\x81"),), (bytearray(b"\x01\x02\x03"),)], "data binary")
    assert [r.b for r in short.select(S.bits_of("data", 12).alias("b")).collect()] == [[0, 7], [0, 1, 9]]


def test_report_store_has_few_folders(spark, tmp_path):
    rows_ = spark.range(3000).selectExpr("id DIV 3 AS report_id", "id AS stamp", "'HISTOGRAM' AS row_type")
    meta = spark.range(1000).selectExpr("id AS report_id", "true AS in_store", "'IN_PROGRESS' AS state", "'HISTOGRAM' AS report_type")
    tables.store_report(rows_, meta, f"{tmp_path}/reports")
    assert len([f for f in (tmp_path / "reports").iterdir() if f.is_dir()]) <= 64
    got = lambda *report: sorted(r.stamp for r in tables.stored_rows(spark, f"{tmp_path}/reports", "stamp long, report_id long", *report).collect())
    assert got() == list(range(3000)) and got(7) == [21, 22, 23] and got(5000) == []


def test_drawn_bits_follow_their_digests(spark):
    data = [(f"s|{i}", sorted({i % k, (i * 7) % k}), k, p, q) for i, (k, p, q) in enumerate([(5, 0.25, 0.75), (512, 0.125, 1.0), (1, 0.0, 0.5), (24, 0.0, 1.0), (11, 1.0, 0.0)] * 40)] + [(None, None, None, None, None)]
    def bits(begin, own, k, p, q):
        draw = lambda j: int(hashlib.sha256(f"{begin}|{j // 4}".encode()).hexdigest()[13 * (j % 4) :][:13], 16)
        return [j for j in range(k) if draw(j) < (q if j in own else p) * 2**52]
    got = spark.createDataFrame(data, "begin string, own array<int>, k int, p double, q double").repartition(1).select("begin", encoding.drawn_bits("begin", "own", "k", "p", "q").alias("b")).collect()
    assert {r.begin: r.b for r in got} == {d[0]: d[0] and bits(*d) for d in data}
