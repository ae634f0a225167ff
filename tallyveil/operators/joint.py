"""Joint distribution of two randomised variables by expectation-maximisation over Spark jobs.

Reports that are alike are one row with a weight. A row holds each variable's likelihoods apart (n1 + n2 numbers, not
n1 n2), and every sum over rows leaves a task as one row of partial sums, which are merged as a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import candidate_matrix

OTHER = "Other"
FAN = 32
BLOCK_CELLS = 1 << 20
MOST_STATES = 4096  # the information matrix of so many is inverted on the driver
TINY = 1e-12


@dataclass(frozen=True)
class Variable:
    """Categories of a variable, the bits of each in each cohort, and the randomisation.

    places[cohort, category] lists the category's bits, filled up with k. other: in a cohort and bit, the chance that a
    report of no known category has the bit; then Other is one category more.
    """

    names: tuple[str, ...]
    places: np.ndarray
    k: int
    p: float
    q: float
    other: np.ndarray | None = None

    @property
    def states(self) -> tuple[str, ...]:
        return self.names if self.other is None else (*self.names, OTHER)


def index_variable(names: list[str], p: float, q: float) -> Variable:
    """Category j is bit j."""
    return Variable(tuple(names), np.arange(len(names)).reshape(1, -1, 1), len(names), p, q)


def boolean_variable(p: float, q: float) -> Variable:
    """One bit: true has it, false has none."""
    return Variable(("true", "false"), np.array([[[0], [1]]]), 1, p, q)


def string_variable(spark: SparkSession, candidates: list[str], k: int, h: int, m: int, p: float, q: float, other: np.ndarray | None = None) -> Variable:
    """Candidates' bits by hash; their list is a report's configuration."""
    names = tuple(sorted(set(candidates)))
    places = np.full((m, len(names), h), k)
    found = candidate_matrix(spark.createDataFrame([(n,) for n in names], "candidate string"), k, h, m).groupBy("cohort", "candidate").agg(F.collect_set("bit").alias("bits"))
    for r in found.collect():
        places[r.cohort, names.index(r.candidate), : len(r.bits)] = r.bits
    return Variable(names, places, k, p, q, other)


def report_patterns(df: DataFrame, bits1: str, bits2: str, cohort1: str | None = None, cohort2: str | None = None) -> DataFrame:
    """Identical reports together: (cohort1, bits1, cohort2, bits2, weight), bits ascending."""
    cohort = lambda c: F.lit(0) if c is None else F.col(c).cast("int")
    rows = df.select(cohort(cohort1).alias("cohort1"), F.sort_array(bits1).alias("bits1"), cohort(cohort2).alias("cohort2"), F.sort_array(bits2).alias("bits2"))
    return rows.groupBy("cohort1", "bits1", "cohort2", "bits2").agg(F.count("*").alias("weight"))


def log_likelihoods(cohorts: np.ndarray, sizes: np.ndarray, bits: np.ndarray, v: Variable) -> np.ndarray:
    """ln P(report | category) of each report and category.

    A sum over all bits as if none were set by the value, then a correction at each category's own bits.
    """
    n, p, q = len(sizes), *np.clip([v.p, v.q], TINY, 1 - TINY)
    has = np.zeros((n, v.k + 1), bool)  # the last column stands for no bit
    has[np.repeat(np.arange(n), sizes), bits] = True
    ones = has[:, : v.k].sum(1)
    base = ones * np.log(p) + (v.k - ones) * np.log1p(-p)
    out = np.empty((n, len(v.states)))
    for c in np.unique(cohorts).tolist():
        mine, places = np.flatnonzero(cohorts == c), v.places[c]
        real = places < v.k
        step = max(1, BLOCK_CELLS // max(1, places.size))
        for i in range(0, len(mine), step):
            rows = mine[i : i + step]
            own = np.where(has[rows][:, places], np.log(q / p), np.log((1 - q) / (1 - p)))
            out[rows, : len(v.names)] = base[rows, None] + (own * real).sum(2)
        if v.other is not None:
            chance = np.clip(v.other[c], TINY, 1 - TINY)
            out[mine, -1] = has[mine, : v.k] @ np.log(chance / (1 - chance)) + np.log1p(-chance).sum()
    return out


def report_likelihoods(patterns: DataFrame, v1: Variable, v2: Variable) -> DataFrame:
    """(weight, top1, c1, top2, c2): each variable's likelihoods, as shares of the largest, whose logarithm is top."""
    shared = patterns.sparkSession.sparkContext.broadcast((v1, v2))  # configured lists and cohorts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"weight": b.column("weight").cast(pa.float64())}
            for n, v in zip((1, 2), shared.value):
                bits = b.column(f"bits{n}")
                logs = log_likelihoods(b.column(f"cohort{n}").to_numpy(), pa.compute.list_value_length(bits).to_numpy(), bits.flatten().to_numpy(), v)
                top = logs.max(1)
                out |= {f"top{n}": pa.array(top), f"c{n}": pa.FixedSizeListArray.from_arrays(pa.array(np.exp(logs - top[:, None]).ravel()), logs.shape[1]).cast(pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(out)

    return patterns.mapInArrow(task, "weight double, top1 double, c1 array<double>, top2 double, c2 array<double>")


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = batch.column("weight").to_numpy()
    c1, c2 = (batch.column(c).flatten().to_numpy().reshape(len(w), -1) if len(w) else np.zeros((0, 0)) for c in ("c1", "c2"))
    return w, c1, c2


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("s").to_pylist():
            total = np.frombuffer(raw).copy() if total is None else total + np.frombuffer(raw)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "s": pa.array([total.tobytes()], pa.binary())})


def summed(table: DataFrame, blocks: int, of_batch: Callable[[pa.RecordBatch, int], np.ndarray]) -> list[np.ndarray]:
    """The sum over all rows of each block of of_batch(batch, block): one row of partial sums a task and block, FAN merged at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list = [None] * blocks
        for b in batches:
            if b.num_rows:
                for i in range(blocks):
                    x = of_batch(b, i)
                    totals[i] = x if totals[i] is None else totals[i] + x
        part = TaskContext.get().partitionId()
        for i, x in enumerate(totals):
            if x is not None:
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "s": pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())})

    rows, parts = table.mapInArrow(task, "block int, part int, s binary"), table.rdd.getNumPartitions()
    while parts > FAN:
        rows = rows.withColumn("part", F.expr(f"part DIV {FAN}").cast("int")).groupBy("block", "part").applyInArrow(_added, "block int, part int, s binary")
        parts = -(-parts // FAN)
    out: list = [0.0] * blocks
    for r in rows.toLocalIterator():
        out[r.block] = out[r.block] + np.frombuffer(bytes(r.s))
    return out


class Fit(NamedTuple):
    """n1 x n2 proportions, the steps taken, and whether the last one changed them by less than epsilon."""

    grid: np.ndarray
    steps: int
    converged: bool


def joint_em(table: DataFrame, n1: int, n2: int, iterations: int = 1000, epsilon: float = 1e-6) -> Fit:
    """Each step needs one pass over the cached likelihoods; only grids reach the driver."""
    current, steps, settled = np.full((n1, n2), 1 / (n1 * n2)), 0, False
    own = not table.is_cached
    table = table.cache()
    try:
        while steps < iterations and not settled:
            shared = table.sparkSession.sparkContext.broadcast(current)

            def step(batch: pa.RecordBatch, _block: int, shared=shared) -> np.ndarray:
                w, c1, c2 = _matrices(batch)
                chance = ((c1 @ shared.value) * c2).sum(1)
                share = np.divide(w, chance, out=np.zeros_like(w), where=chance > 0)
                return (c1.T @ (c2 * share[:, None])).ravel()

            new = current * np.reshape(summed(table, 1, step)[0] + np.zeros(n1 * n2), (n1, n2))
            shared.unpersist()
            new /= max(new.sum(), 1e-300)
            settled, current, steps = bool(np.abs(new - current).max() < epsilon), new, steps + 1
    finally:
        if own:
            table.unpersist()
    return Fit(current, steps, settled)


def joint_variance(table: DataFrame, estimate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard errors and the information matrix, summed in blocks of rows of at most BLOCK_CELLS cells."""
    states = estimate.size
    if states > MOST_STATES:
        raise ValueError(f"the information matrix of over {MOST_STATES} states is not inverted")
    step = max(1, BLOCK_CELLS // states)

    def block(batch: pa.RecordBatch, i: int) -> np.ndarray:
        w, c1, c2 = _matrices(batch)
        total, some = 0.0, max(1, BLOCK_CELLS // states)
        for at in range(0, len(w), some):
            c = np.einsum("ri,rj->rij", c1[at : at + some], c2[at : at + some]).reshape(-1, states)
            v = c / np.maximum(c @ estimate.ravel(), 1e-300)[:, None]
            total = total + (v[:, i * step : (i + 1) * step] * w[at : at + some, None]).T @ v
        return np.ravel(total)

    info = np.concatenate([np.reshape(x + np.zeros(1), (-1, states)) if np.ndim(x) else np.zeros((min(step, states - i * step), states)) for i, x in enumerate(summed(table, -(-states // step), block))])
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0)).reshape(estimate.shape)
    return errors, info


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees > x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = dof / 2, x / 2
    term = total = 1 / a
    for n in range(1, 10_000):
        term *= h / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * exp(-h + a * log(h) - lgamma(a)))


def independence_test(estimate: np.ndarray, info: np.ndarray) -> tuple[float, float]:
    """Chi-square statistic and p-value of independence of the two variables."""
    d = (estimate - np.outer(estimate.sum(1), estimate.sum(0))).reshape(-1)
    statistic = float(d @ info @ d)
    return statistic, chi_square_tail(statistic, (estimate.shape[0] - 1) * (estimate.shape[1] - 1))


def as_rows(spark: SparkSession, grid: np.ndarray, names1: list[str], names2: list[str]) -> DataFrame:
    rows = [(a, b, float(grid[i, j])) for i, a in enumerate(names1) for j, b in enumerate(names2)]
    return spark.createDataFrame(rows, "v1 string, v2 string, proportion double")
