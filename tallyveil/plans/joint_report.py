"""Joint reports of two variables of one metric, each unencoded, of indices, or of strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimate, joint
from ..operators.rows import candidate_matrix


@dataclass(frozen=True)
class Part:
    """A variable's columns and encoding. kind: noop (value), index (bits) or string (cohort and bits)."""

    kind: str
    value: str | None = None
    bits: str | None = None
    cohort: str | None = None
    names: tuple[str, ...] = ()
    k: int = 0
    h: int = 0
    m: int = 1
    p: float = 0.0
    q: float = 1.0


def string_marginal(obs: DataFrame, part: Part) -> tuple[DataFrame, DataFrame]:
    """(cohort, bit, y, n) and (candidate, proportion, converged) of a string variable."""
    spark = obs.sparkSession
    rows = obs.select(F.col(part.cohort).alias("cohort"), F.col(part.bits).alias("set_bits"))
    counts = estimate.cohort_bit_counts(rows, part.k, part.m)
    ratios = estimate.basic_rappor_estimate(counts, part.p, part.q).select(F.lit(0).alias("g"), "cohort", "bit", F.lit(part.k).alias("k"), F.lit(part.m).alias("m"), (F.col("count_estimate") / F.col("n")).alias("ratio"), F.lit(1.0).alias("n_all"))
    matrix = candidate_matrix(spark.createDataFrame([(n,) for n in part.names], "candidate string"), part.k, part.h, part.m)
    solved = estimate.grouped_rappor_estimate(ratios, matrix.select(F.lit(0).alias("g"), "candidate", "cohort", "bit"), ["g"])
    return counts, solved.select("candidate", F.greatest("count_estimate", F.lit(0.0)).alias("proportion"), "converged")


def variable(obs: DataFrame, part: Part) -> joint.Variable:
    """The likelihood model of a part; that of strings has Other, whose bits are what the known candidates leave."""
    if part.kind == "index":
        return joint.index_variable(list(part.names), part.p, part.q)
    spark = obs.sparkSession
    counts, marginal = string_marginal(obs, part)
    known = spark.createDataFrame(marginal.collect(), marginal.schema)  # a row a configured candidate
    if known.where("NOT converged").count():
        raise ArithmeticError("no convergence of the marginal")
    matrix = candidate_matrix(known.select("candidate"), part.k, part.h, part.m)
    other = np.zeros((part.m, part.k))
    for r in estimate.other_probabilities(counts, matrix, known, part.m, part.p, part.q).collect():  # a number a cohort and bit
        other[r.cohort, r.bit] = r.probability
    return joint.string_variable(spark, list(part.names), part.k, part.h, part.m, part.p, part.q, other)


def joint_report(obs: DataFrame, first: Part, second: Part, iterations: int = 1000, epsilon: float = 1e-6) -> DataFrame:
    """(v1, v2, count_estimate, std_error, proportion, steps, converged) of two parts of the same observations.

    Two unencoded parts are counted. Otherwise both must be encoded: marginals and Other for strings, likelihoods by
    report, expectation-maximisation, standard errors from the information matrix.
    """
    if first.kind == second.kind == "noop":
        n = F.sum("count_estimate").over(_everything())
        rows = obs.groupBy(F.col(first.value).cast("string").alias("v1"), F.col(second.value).cast("string").alias("v2")).agg(F.count("*").cast("double").alias("count_estimate"))
        return rows.select("v1", "v2", "count_estimate", F.lit(0.0).alias("std_error"), (F.col("count_estimate") / n).alias("proportion"), F.lit(0).alias("steps"), F.lit(True).alias("converged"))
    if "noop" in (first.kind, second.kind):
        raise ValueError("an unencoded and an encoded part have no joint report")
    spark = obs.sparkSession
    fits = lambda part: F.coalesce(F.forall(part.bits, lambda b: (b >= 0) & (b < _bits(part))), F.lit(False)) & (F.lit(True) if part.cohort is None else F.coalesce(F.col(part.cohort).between(0, part.m - 1), F.lit(False)))
    good = obs.where(fits(first) & fits(second))
    v1, v2 = variable(good, first), variable(good, second)
    table = joint.report_likelihoods(joint.report_patterns(good, first.bits, second.bits, first.cohort, second.cohort), v1, v2).cache()
    try:
        fit = joint.joint_em(table, len(v1.states), len(v2.states), iterations, epsilon)
        errors, _ = joint.joint_variance(table, fit.grid)
        n = table.agg(F.sum("weight")).first()[0] or 0.0
    finally:
        table.unpersist()
    rows = [(a, b, float(fit.grid[i, j] * n), float(errors[i, j] * n), float(fit.grid[i, j]), fit.steps, fit.converged) for i, a in enumerate(v1.states) for j, b in enumerate(v2.states)]
    return spark.createDataFrame(rows, "v1 string, v2 string, count_estimate double, std_error double, proportion double, steps int, converged boolean")


def _bits(part: Part) -> int:
    return part.k if part.kind == "string" else len(part.names)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()
