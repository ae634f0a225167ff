"""Client values to private observations, as column transforms. All noise is keyed, so a retried task repeats it."""

from __future__ import annotations

from hashlib import sha256
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.scalars import epoch_index, next_pow2
from . import field
from .rows import null_safe_join


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inlined into a lambda would be computed at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever filters and projections later use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def encode_noop(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("value", F.col(value)).withColumn("payload_kind", F.lit("noop"))


def noisy_bits(index: Column, k: int, p: float, q: float, salt: str, key: str) -> Column:
    """Places of set bits: the index's bit stays set with probability q, any other becomes set with probability p."""
    return _drawn(k, lambda j: j == index, p, q, salt, key)


def _below(share: float) -> str:
    """Hex digits h such that 13 random ones are less with probability share."""
    n = ceil(share * 2**52)
    return "" if n <= 0 else "g" if n >= 2**52 else f"{n:013x}"


def _drawn(k: int, is_set, p: float, q: float, salt: str, key: str) -> Column:
    """Places j in 0..k-1 whose draw is below q where is_set(j), else below p. Each digest gives four draws."""
    begin = F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))
    digests = let(begin, lambda x: F.transform(F.sequence(F.lit(0), F.lit((k - 1) // 4)), lambda d: F.sha2(F.concat_ws("|", x, d.cast("string")), 256)))
    quarter = lambda of, j: F.substring(F.get(of, F.shiftright(j, 2)), 13 * j.bitwiseAND(3) + 1, F.lit(13))
    return let(digests, lambda of: F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: quarter(of, j) < F.when(is_set(j), _below(q)).otherwise(_below(p))))


DIGESTS = 1 << 16  # taken at a time
_ENDS = [b"|%d" % d for d in range(4096)]


def _draws(begin: list[bytes], digests: list[int]) -> np.ndarray:
    """Four draws of 52 bits from each digest of begin|0, begin|1, ...: the numbers of 13 hexadecimal digits each."""
    raw = b"".join([sha256(b + e).digest() for b, n in zip(begin, digests) for e in _ENDS[:n]])
    data, mask = np.frombuffer(raw, np.uint8).reshape(-1, 32), np.uint64((1 << 52) - 1)
    at = lambda i, shift: np.ascontiguousarray(data[:, i : i + 8]).view(">u8")[:, 0].astype(np.uint64) >> np.uint64(shift) & mask
    return np.stack([at(0, 12), at(6, 8), at(13, 12), at(19, 8)], 1).reshape(-1)


@F.arrow_udf(ArrayType(IntegerType()))
def drawn_bits(begin: pa.Array, own: pa.Array, k: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
    """As `_drawn`, with the row's own bits, number of bits and probabilities as columns; null where begin is null.

    begin is the salt and the row's key, joined by |.
    """
    here = np.flatnonzero(np.asarray(begin.is_valid()))
    begins, own = [x.encode() for x in begin.take(here).to_pylist()], own.take(here)
    bits = k.take(here).to_numpy(zero_copy_only=False).astype(np.int64)
    top = lambda share: np.clip(np.ceil(share.take(here).to_numpy(zero_copy_only=False) * 2.0**52), 0, 2.0**52).astype(np.uint64)
    low, high, digests = top(p), top(q), (bits + 3) // 4
    owned, values = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
    sizes, found = np.zeros(len(begin), np.int64), []
    slices = np.searchsorted(np.cumsum(digests), np.arange(0, digests.sum() + DIGESTS, DIGESTS), "left")
    for a, b in zip(slices, slices[1:]):
        if a < b:
            base = np.cumsum(digests[a:b]) * 4 - digests[a:b] * 4
            row = np.repeat(np.arange(a, b), 4 * digests[a:b])
            place = np.arange(len(row)) - base[row - a]
            bound = low[row]
            mine = base[np.repeat(np.arange(b - a), np.diff(owned[a : b + 1]))] + values[owned[a] : owned[b]]
            bound[mine] = high[row[mine]]
            hit = np.flatnonzero((_draws(begins[a:b], digests[a:b].tolist()) < bound) & (place < bits[row]))
            sizes[here[a:b]] = np.bincount(row[hit] - a, minlength=b - a)
            found.append(place[hit].astype(np.int32))
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else [], pa.int32()), mask=begin.is_null())


def encode_basic_rappor(df: DataFrame, value: str, categories: list[str], p: float, q: float, salt: str, key: str = "obs_id") -> DataFrame:
    """set_bits of each row; values that are no category are left out."""
    index = F.array_position(F.array(*map(F.lit, categories)), F.col(value).cast("string")).cast("int") - 1
    rows = df.withColumn("category", index).where("category >= 0")
    return once(rows, "set_bits", noisy_bits(F.col("category"), len(categories), p, q, salt, key))


def encode_one_hot(df: DataFrame, value: str, n: int, p: float, q: float, salt: str, key: str = "obs_id") -> DataFrame:
    """Value j is bit j; cohort 0."""
    rows = df.where(F.col(value).between(0, n - 1)).withColumn("cohort", F.lit(0))
    return once(rows, "set_bits", noisy_bits(F.col(value), n, p, q, salt, key))


def assign_cohort(client: str, m: int | Column, salt: str) -> Column:
    """Uniform in [0, m): draws from the next power of two until one is below m."""
    span = next_pow2(m) if isinstance(m, Column) else 1 << max(m - 1, 0).bit_length()

    def draw(found: Column, attempt: Column) -> Column:
        text = F.concat_ws("|", F.lit(salt), F.col(client).cast("string"), attempt.cast("string"))
        v = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") % span
        return F.coalesce(found, let(v, lambda x: F.when(x < m, x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(None).cast("long"), draw).cast("int")


def bloom_bits(value: str, cohort: Column, k: int | Column, h: int | Column) -> Column:
    """Different bit places of a value in a cohort: two digest bytes a hash, modulo k."""
    digest = F.sha2(F.concat(F.col(value), cohort.cast("string")), 256)
    if isinstance(h, Column):
        place = lambda of: F.transform(F.sequence(F.lit(0), h - 1), lambda i: (F.conv(F.substring(of, 4 * i + 1, F.lit(4)), 16, 10).cast("long") % k).cast("int"))
        return F.array_distinct(let(digest, place))
    return F.array_distinct(F.array(*[(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long") % k).cast("int") for i in range(h)]))


def encode_rappor(df: DataFrame, value: str, client: str, k: int, h: int, m: int, p: float, q: float, salt: str, key: str = "obs_id") -> DataFrame:
    def noisy(bloom: Column) -> Column:
        return _drawn(k, lambda j: F.array_contains(bloom, j), p, q, salt, key)

    coded = let(assign_cohort(client, m, salt), lambda c: F.struct(c.alias("cohort"), let(bloom_bits(value, c, k, h), noisy).alias("set_bits")))
    return df.select("*", F.inline(F.array(coded)))


def encode_legacy_cohort(df: DataFrame, client: str, m: int, values: dict[str, str], k: int, h: int) -> DataFrame:
    """cohort = client mod m, and one bit string a value, highest bit first; the values share the cohort."""
    rows = df.withColumn("cohort", (F.col(client) % m).cast("int"))
    for value, out in values.items():
        bits = bloom_bits(value, F.col("cohort"), k, h)
        rows = rows.withColumn(out, F.array_join(F.transform(F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)), _digit(bits)), ""))
    return rows


def _digit(bits: Column):
    return lambda j: F.when(F.array_contains(bits, j), "1").otherwise("0")


# threshold encryption


@F.arrow_udf(StringType())
def point_y(secret: pa.Array, x: pa.Array, threshold: pa.Array) -> pa.Array:
    """The y of each client's point; null where there is no secret. Rows of one threshold are computed together."""
    here = np.flatnonzero(np.asarray(secret.is_valid()))
    of, out = threshold.take(here).to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(secret), None, object)
    for t in np.unique(of).tolist():
        rows = here[of == t]
        out[rows] = field.evaluate(secret.take(rows).to_pylist(), x.take(rows).to_pylist(), t)
    return pa.array(out, pa.string())


@F.pandas_udf(StringType())
def _secret(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series(field.at_zero([list(x) for x in xs], [list(y) for y in ys]), dtype=object)


def cipher_key(secret: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit("key|"), secret), 256))


def encode_threshold(df: DataFrame, value: str, client: str, threshold: int, epoch: str, master_salt: str) -> DataFrame:
    """Adds epoch, ciphertext, point_x and point_y.

    Equal values of an epoch have equal ciphertexts; a client has the same point for a value and epoch each time; any
    `threshold` different points give the key.
    """

    rows = df.withColumn("epoch", epoch_index("day_index", epoch))
    secret = F.substring(F.sha2(F.concat_ws("|", F.lit(master_salt), F.col("metric_id").cast("string"), F.col("epoch").cast("string"), F.lit(str(threshold)), F.col(value)), 256), 1, 30)
    rows = rows.withColumn("_secret", secret).withColumn("point_x", F.substring(F.sha2(F.concat_ws("|", F.lit("client"), F.col(client).cast("string"), F.col("_secret")), 256), 1, 30))
    sealed = F.expr(f"aes_encrypt(encode({value}, 'UTF-8'), unhex(sha2(concat('key|', _secret), 256)), 'GCM', 'DEFAULT', unhex('000000000000000000000000'))")
    return rows.withColumn("ciphertext", F.hex(sealed)).withColumn("point_y", point_y("_secret", "point_x", F.lit(threshold))).drop("_secret")


def _points(obs: DataFrame, group: list[str]) -> DataFrame:
    """Different points of each group: their rows, and the least and largest y."""
    return obs.groupBy(*group, "point_x").agg(F.count("*").alias("n"), F.min("point_y").alias("point_y"), F.max("point_y").alias("_y"))


def _groups(points: DataFrame, group: list[str]) -> DataFrame:
    return points.groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("points"), F.sum(F.when(F.col("point_y") != F.col("_y"), 1).otherwise(0)).alias("conflicts"))


def threshold_groups(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, epoch, ciphertext): rows, different points, and conflicting points (one x with several y)."""
    group = [*by, "epoch", "ciphertext"]
    return _groups(_points(obs, group), group)


def _judged(obs: DataFrame, threshold: int | str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Groups (by, epoch, ciphertext, n, points, outcome, plaintext): those whose points were interpolated, and the others."""
    least = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    group = [*by, "epoch", "ciphertext"]
    points = _points(obs, group)  # used twice with all its columns, so that Spark shuffles it (and encodes observations) once
    groups = _groups(points, group).withColumn("outcome", F.when(F.col("conflicts") > 0, "conflict").when(F.col("points") < least, "below"))
    ready = groups.where("outcome IS NULL").select(*group, F.col("n").alias("n_all"), "points")
    few = null_safe_join(points, ready, group).where("n > 0 AND point_y = _y")
    few = few.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("point_x"))).where(F.col("_n") <= least)
    gathered = few.groupBy(*group, "n_all", "points").agg(F.sort_array(F.collect_list(F.struct("point_x", "point_y"))).alias("p"))
    opened = gathered.withColumn("_secret", _secret("p.point_x", "p.point_y"))
    opened = opened.withColumn("plaintext", F.expr("decode(try_aes_decrypt(unhex(ciphertext), unhex(sha2(concat('key|', _secret), 256)), 'GCM', 'DEFAULT'), 'UTF-8')"))
    tried = opened.select(*group, F.col("n_all").alias("n"), "points", F.when(F.col("plaintext").isNotNull(), "ok").otherwise("unauthentic").alias("outcome"), "plaintext")
    return tried, groups.where("outcome IS NOT NULL").select(*group, "n", "points", "outcome", F.lit(None).cast("string").alias("plaintext"))


def threshold_outcomes(obs: DataFrame, threshold: int | str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, epoch, ciphertext, n, points, outcome, plaintext) of every group of equal ciphertexts.

    outcome: below (fewer than `threshold` points), conflict (one x with several y), unauthentic (the key that the
    points give doesn't open the ciphertext), ok. threshold may name a column of by. Groups are counted first; then at
    most `threshold` points of each group that qualifies are interpolated, in time quadratic in the threshold.
    """
    tried, others = _judged(obs, threshold, by)
    return tried.unionByName(others)


def threshold_errors(obs: DataFrame) -> DataFrame:
    """Groups with conflicting points, without any decryption; `threshold_outcomes` also tells failed authentications."""
    return threshold_groups(obs).where("conflicts > 0").select("epoch", "ciphertext", "conflicts")


def threshold_decrypt(obs: DataFrame, threshold: int | str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, plaintext, total, epochs) of values that at least `threshold` clients sent in an epoch."""
    plain = _judged(obs, threshold, by)[0].where("outcome = 'ok'")
    return plain.groupBy(*by, "plaintext").agg(F.sum("n").alias("total"), F.count("*").alias("epochs"))
