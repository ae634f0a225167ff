"""Histograms, bit counters and their estimators."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import laplace
from .rows import candidate_matrix


def histogram(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact counts with standard error 0."""
    return df.groupBy(*(by or []), value).agg(F.count("*").alias("count_estimate")).withColumn("std_error", F.lit(0.0))


def histogram_int_buckets(df: DataFrame, bucket) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_distributions(dists: DataFrame, n_buckets: int) -> DataFrame:
    """Sums bucket counts of rows(dist MAP<INT,BIGINT>); a row with an index outside 0..n+1 goes whole."""
    good = dists.where(F.forall(F.map_keys("dist"), lambda k: (k >= 0) & (k < n_buckets + 2)))
    return good.select(F.explode("dist").alias("bucket", "c")).groupBy("bucket").agg(F.sum("c").alias("n"))


def bit_counts(df: DataFrame, k: int | str, by: list[str] | None = None) -> DataFrame:
    """(group, bit, y, n) for all k bits: how many observations have the bit, of how many. k may name a column of by.

    Only set bits are exploded, with a mark -1 for each observation, so that one partial aggregate gives y and n. Rows
    with a bit outside 0..k-1, or without bits at all (null), are left out; `bit_errors` counts them.
    """
    by, top = by or [], F.col(k) if isinstance(k, str) else F.lit(k)
    df = df.where(F.forall("set_bits", lambda b: (b >= 0) & (b < top)))
    marked = df.select(*by, F.explode(F.concat(F.array(F.lit(-1)), "set_bits")).alias("bit"))
    tally = marked.groupBy(*by, "bit").agg(F.count("*").alias("c"))
    counts = tally.groupBy(*by).agg(F.max(F.when(F.col("bit") == -1, F.col("c"))).alias("n"), F.map_from_entries(F.collect_list(F.struct("bit", "c"))).alias("of"))
    rows = counts.select(*by, "n", "of", F.explode(F.sequence(F.lit(0), (top - 1).cast("int"))).alias("bit"))
    return rows.select(*by, "bit", F.coalesce(F.try_element_at("of", "bit"), F.lit(0)).alias("y"), "n")


def basic_rappor_estimate(counts: DataFrame, p: float | Column, q: float | Column) -> DataFrame:
    p, q = (x if isinstance(x, Column) else F.lit(x) for x in (p, q))
    est = (F.col("y") - p * F.col("n")) / (q - p)
    err = F.sqrt(F.col("y") * (1 - p - q) + F.col("n") * (p * q)) / F.abs(q - p)
    return counts.withColumn("count_estimate", est).withColumn("std_error", err)


def _good_cohort(k: int, m: int):
    return F.coalesce(F.col("cohort").between(0, m - 1) & F.forall("set_bits", lambda b: (b >= 0) & (b < k)), F.lit(False))


def cohort_bit_counts(df: DataFrame, k: int, m: int) -> DataFrame:
    """(cohort, bit, y, n); rows of a cohort outside 0..m-1 or of a bit outside 0..k-1 are left out as errors."""
    return bit_counts(df.where(_good_cohort(k, m)), k, ["cohort"])


def bit_errors(df: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """One row (n, errors): observations, and those that bit counting leaves out (bit or, with m, cohort out of range)."""
    good = _good_cohort(k, m) if m is not None else F.coalesce(F.forall("set_bits", lambda b: (b >= 0) & (b < k)), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.sum(F.when(good, 0).otherwise(1)).alias("errors"))


def bit_count_ratios(estimates: DataFrame, k: int) -> DataFrame:
    """(row, ratio): estimate over the cohort's size, bits numbered from the left; empty cohorts have no rows."""
    return estimates.where("n > 0").select((F.col("cohort") * k + (k - 1 - F.col("bit"))).alias("row"), (F.col("count_estimate") / F.col("n")).alias("ratio"))


def rappor_estimate(obs: DataFrame, candidates: DataFrame, k: int, h: int, m: int, p: float, q: float, max_iterations: int = 10_000) -> DataFrame:
    """(candidate, count_estimate): elastic net of bit ratios on the candidates' bits, times the number of observations.

    The candidates are a report's configured list, which the driver holds as the model's vocabulary. A fit that has not
    converged after max_iterations is an error.
    """
    ratios = bit_count_ratios(basic_rappor_estimate(cohort_bit_counts(obs, k, m), p, q), k)
    matrix = candidate_matrix(candidates, k, h, m).groupBy("row").agg(F.collect_set("candidate").alias("names"))
    vocabulary = sorted(r.candidate for r in candidates.select("candidate").distinct().collect())
    system = ratios.join(matrix, "row", "left").select(F.col("ratio").alias("label"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="names", outputCol="features").setBinary(True).transform(system)
    l1, l2 = 0.5 / (k * m), 1e-3 / (k * m)
    fit = LinearRegression(fitIntercept=False, standardization=False, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), maxIter=max_iterations, tol=1e-6, solver="l-bfgs").fit(vectors.select("features", "label"))
    if fit.summary.totalIterations >= max_iterations:
        raise ArithmeticError(f"no convergence after {max_iterations} iterations")
    n = obs.count()
    rows = [(c, float(w) * n) for c, w in zip(vocabulary, fit.coefficients)]
    return obs.sparkSession.createDataFrame(rows, "candidate string, count_estimate double")


def coordinate_descent(target: np.ndarray, columns: list[np.ndarray], l1: float, l2: float, epochs: int = 10_000, tolerance: float = 1e-6) -> tuple[np.ndarray, int, bool]:
    """Weights w of least |Aw - target|^2 / 2R + l1 |w| + l2 |w|^2 / 2, the epochs taken, and whether w has settled.

    A has R rows, and ones in the rows that columns lists for each weight: an epoch costs as much as A has ones.
    """
    w, rest, n = np.zeros(len(columns)), target.astype(float), len(target)
    for epoch in range(1, epochs + 1):
        most = 0.0
        for j, of in enumerate(columns):
            if len(of):
                pull = rest[of].sum() + len(of) * w[j]
                step = np.sign(pull) * max(abs(pull) - n * l1, 0.0) / (len(of) + n * l2) - w[j]
                if step:
                    rest[of] -= step
                    w[j] += step
                    most = max(most, abs(step))
        if most < tolerance:
            return w, epoch, True
    return w, epochs, False


def grouped_rappor_estimate(ratios: DataFrame, matrix: DataFrame, by: list[str], epochs: int = 10_000) -> DataFrame:
    """(by, candidate, count_estimate, epochs, converged): an elastic net for each group, all groups in one plan.

    ratios(by, cohort, bit, k, m, ratio, n_all): bit ratios of the cohorts that have observations, and the group's
    number of observations; matrix(by, candidate, cohort, bit): the candidates' bits. A group holds k m ratios and h m
    bits a candidate. Groups without candidates have no rows.
    """

    def solve(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = sorted(set(right["candidate"].to_pylist()))
        weights, taken, settled = np.zeros(len(names)), 0, True
        if left.num_rows and names:
            k, m, n = (left[c][0].as_py() for c in ("k", "m", "n_all"))
            place = lambda t: t["cohort"].to_numpy().astype(np.int64) * k + t["bit"].to_numpy()
            rows, bits = place(left), place(right)
            order = np.argsort(rows)
            rows, target = rows[order], left["ratio"].to_numpy()[order]
            at = np.minimum(np.searchsorted(rows, bits), len(rows) - 1)
            there = rows[at] == bits
            of = np.searchsorted(names, right["candidate"].to_pylist())
            columns = [np.unique(at[there & (of == j)]) for j in range(len(names))]
            weights, taken, settled = coordinate_descent(target, columns, 0.5 / (k * m), 1e-3 / (k * m), epochs)
            weights = weights * n
        out = {c: pa.array([v.as_py()] * len(names), kinds[c]) for c, v in zip(by, key)}
        return pa.table(out | {"candidate": pa.array(names, pa.string()), "count_estimate": pa.array(weights, pa.float64()), "epochs": pa.array([taken] * len(names), pa.int32()), "converged": pa.array([settled] * len(names), pa.bool_())})

    kinds = {f.name: to_arrow_type(f.dataType) for f in ratios.schema if f.name in by}
    schema = ", ".join(f"{c} {t}" for c, t in ratios.dtypes if c in by)
    matrix = matrix.select(*[F.col(c).alias(c) for c in matrix.columns])  # both may come from the same table
    return ratios.groupBy(*by).cogroup(matrix.groupBy(*by)).applyInArrow(solve, f"{schema}, candidate string, count_estimate double, epochs int, converged boolean")


def heterogeneous_groups(obs: DataFrame, by: list[str]) -> DataFrame:
    """Groups with more than one encoding, which abort a report."""
    return obs.groupBy(*by).agg(F.min("encoding_config_id").alias("lo"), F.max("encoding_config_id").alias("hi")).where("lo != hi")


def sum_bits(reports: DataFrame, k: int) -> DataFrame:
    """Wide counts from '0'/'1' strings, highest bit first: one row a cohort, total, then bit0..bit<k-1>."""
    ones = [F.sum(F.substring("bits", k - j, 1).cast("int")).alias(f"bit{j}") for j in range(k)]
    return reports.groupBy("cohort").agg(F.count("*").alias("total"), *ones)


def usage_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def usage_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """All 24 hours, with 0 where nothing happened."""
    counts = df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return grid.join(counts, "hour", "left").fillna(0, ["n"])


def usage_and_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mean_by_candidate(fit: DataFrame) -> DataFrame:
    """Expected ordinal per candidate from (v1, v2, proportion); the category Other goes."""
    return fit.where("v1 != 'Other'").groupBy("v1").agg((F.sum(F.col("v2") * F.col("proportion")) / F.sum("proportion")).alias("mean"))


def flatten_joint(wide: DataFrame, key: str) -> DataFrame:
    return wide.unpivot(key, [c for c in wide.columns if c != key], "v2", "proportion")


def laplace_release(report: DataFrame, count: str, scale: float, salt: str, key: str) -> DataFrame:
    return report.withColumn("released", F.round(F.col(count) + laplace(scale, salt, key)).cast("long"))


def mle_counts(counts: DataFrame, p: float, q: float, most: int = 1000) -> DataFrame:
    """For each (n, y), the integer in 0..n under which y ones are likeliest: Binom(v, q) + Binom(n - v, p) = y.

    `most` is the size of the table of log factorials; a larger n is an error.
    """
    n = F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"n is above {most}")).cast("long"))
    logs = F.array(*[F.lit(lgamma(i + 1)) for i in range(most + 1)])
    choose = lambda a, b: F.get(logs, a) - F.get(logs, b) - F.get(logs, a - b)
    logp = lambda a, b, r: choose(a, b) + b * F.log(F.lit(r)) + (a - b) * F.log(F.lit(1 - r))
    rows = counts.select(n.alias("n"), "y").distinct().select("n", "y", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("v"))
    low, high = F.greatest(F.lit(0), F.col("y") - (F.col("n") - F.col("v"))).cast("int"), F.least("v", "y").cast("int")
    terms = rows.where(low <= high).select("n", "y", "v", F.explode(F.sequence(low, high)).alias("j"))
    likelihood = terms.groupBy("n", "y", "v").agg(F.sum(F.exp(logp(F.col("v").cast("int"), F.col("j"), q) + logp((F.col("n") - F.col("v")).cast("int"), (F.col("y") - F.col("j")).cast("int"), p))).alias("l"))
    return likelihood.groupBy("n", "y").agg(F.max_by("v", F.struct("l", -F.col("v"))).alias("estimate"))


def batch_sizes(buffer: DataFrame, keys: list[str]) -> DataFrame:
    return buffer.groupBy(*keys).agg(F.count("*").alias("n"))


def quality_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def other_probabilities(counts: DataFrame, matrix: DataFrame, marginal: DataFrame, m: int, p: float, q: float) -> DataFrame:
    """(cohort, bit, probability): the chance of a bit in reports of no known candidate, clipped to [0, 1].

    counts(cohort, bit, y, n); matrix(candidate, cohort, bit); marginal(candidate, proportion). Every cohort is taken to
    hold each known candidate ceil(proportion N / m) times; of those, q set each of their own bits and p any other.
    These are taken off the counts. A cohort that known candidates fill has chance 0, or 1 for bits set all the same.
    """
    everyone = counts.where("bit = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("everyone"))
    known = marginal.join(F.broadcast(everyone)).select("candidate", F.ceil(F.col("proportion") * F.col("everyone") / m).alias("known"))
    in_bit = matrix.select("candidate", "cohort", "bit").distinct().join(known, "candidate").groupBy("cohort", "bit").agg(F.sum("known").alias("own"))
    total = known.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("all_known"))
    rows = counts.join(in_bit, ["cohort", "bit"], "left").fillna(0, ["own"]).join(F.broadcast(total))
    ones = F.greatest(F.lit(0.0), F.col("y") - ((F.col("all_known") - F.col("own")) * p + F.col("own") * q))
    rest = F.greatest(F.lit(0), F.col("n") - F.col("all_known"))
    chance = F.when(rest > 0, F.least(F.lit(1.0), ones / rest)).when(ones > 0, 1.0).otherwise(0.0)
    return rows.select("cohort", "bit", chance.alias("probability"))
