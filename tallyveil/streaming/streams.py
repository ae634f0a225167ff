"""The long-running stages as Structured Streaming transformations, and a runner that drains what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalars import keyed_uniform


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local-mode session without it uses a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def as_stream(table: DataFrame, name: str, files_a_batch: int | None = None) -> DataFrame:
    """A file stream over a table, which is written to a shared folder first."""
    path = shared_path(table.sparkSession, name)
    table.write.parquet(path)
    options = {} if files_a_batch is None else {"maxFilesPerTrigger": files_a_batch}
    return table.sparkSession.readStream.schema(table.schema).options(**options).parquet(path)


def as_batches(tables: list[DataFrame], name: str) -> DataFrame:
    """A file stream that brings each table as a batch of its own, in order."""
    spark = tables[0].sparkSession
    path = shared_path(spark, name)
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def dispatch_trigger(hours: float | None) -> dict:
    """Writer options: a fixed dispatch interval, or all that is there and stop."""
    return {"availableNow": True} if hours is None else {"processingTime": f"{int(hours * 3600)} seconds"}


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", key: list[str] | None = None, progress: list | None = None, hours: float | None = None) -> DataFrame:
    """Run the stream over all that is there; the sink as a table.

    In update mode the last row of each key counts. progress gets what Spark reports of each batch. hours: dispatch at
    that interval, until nothing is left to do; else all at once. State is kept by RocksDB, which list and map state need.
    """
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n:09d}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**dispatch_trigger(hours)).foreachBatch(write).start()
        if hours is not None:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    if progress is not None:
        progress += query.recentProgress
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).parquet(f"{out}/batch=*")
    if mode == "update" and key:
        rest = [c for c in stream.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*key, "_r.*")
        return rows.select(*stream.columns)
    return rows.drop("_batch")


def stream_dedupe(obs: DataFrame, key: str = "random_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    return obs.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counter_stream(events: DataFrame, period: str, by: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counter value per collection period; the checkpoint makes a failed send count once."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, period).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), by, "n")


def finalization_window(obs: DataFrame, days: int, by: str, ts: str = "ts") -> DataFrame:
    """A day's histogram, updated by late observations until `days` have passed."""
    return obs.withWatermark(ts, f"{days} days").groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


DAY_MS = 86_400_000
CHUNK = 10_000  # rows of one frame that leaves a processor


class _Release(StatefulProcessor):
    """Buffers (value, day) of a key in list state; a key's rows go out together, or one by one as they grow old."""

    def __init__(self, key: str, value: str, kind: str, threshold: int):
        self.key, self.value, self.kind, self.threshold = key, value, kind, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", f"v {self.kind}, day int")
        self.count = handle.getValueState("count", "n bigint")

    def _kept(self, timer_values) -> int:
        """Drop what is too old by the watermark, which trails the latest arrival by the days of disposal."""
        if not self.count.exists():
            return 0
        today = timer_values.getCurrentWatermarkInMs() // DAY_MS
        n = self.count.get()[0]
        kept = [(v, d) for v, d in self.buffer.get() if d >= today] if today > 0 else None
        if kept is None or len(kept) == n:
            return n
        if kept:
            self.buffer.put(kept)
            self.count.update((len(kept),))
        else:
            self.buffer.clear()
            self.count.clear()
        return len(kept)

    def _frame(self, key: tuple, values: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(values), dtype=object), self.value: values})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, released = self._kept(timerValues), False
        for pdf in rows:
            values, days = pdf[self.value].tolist(), pdf["x_day"].tolist()
            n += len(values)
            if n < self.threshold and not released:
                self.buffer.appendList(list(zip(values, days)))
                for day in set(days):
                    self.handle.registerTimer((day + 1) * DAY_MS)
                continue
            if not released:
                released, part = True, []
                for v, _ in self.buffer.get():
                    part.append(v)
                    if len(part) == CHUNK:
                        yield self._frame(key, part)
                        part = []
                yield self._frame(key, part)
                self.buffer.clear()
            yield self._frame(key, values)
        if released or not n:
            self.count.clear()
        else:
            self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._kept(timerValues)
        yield self._frame(key, [])

    def close(self) -> None:
        pass


def threshold_release_stream(obs: DataFrame, key: str, value: str, arrival: str, threshold: int, disposal_days: int) -> DataFrame:
    """Buffers values per key until there are `threshold`; then releases all (key, value). Null is a key like any other.

    Rows that arrived more than disposal_days before the latest arrival go: event-time timers end the buffer of a key
    that gets nothing new, under every trigger. A buffer holds fewer than `threshold` rows between batches; what is
    released goes out in frames of bounded size.
    """
    kinds = dict(obs.dtypes)
    rows = obs.select(key, value, arrival).withColumn("x_day", F.unix_date(F.to_date(arrival))).withWatermark(arrival, f"{disposal_days} days")
    return rows.groupBy(key).transformWithStateInPandas(_Release(key, value, kinds[value], threshold), f"{key} {kinds[key]}, {value} {kinds[value]}", "append", "eventTime")


def reservoir(events: DataFrame, n: int, by: list[str], key: str, salt: str) -> DataFrame:
    """Batch form: the n rows of least keyed hash in each group are a uniform sample."""
    top = F.row_number().over(W.partitionBy(*by).orderBy("_u", key))
    return events.withColumn("_u", keyed_uniform(salt, key)).withColumn("_n", top).where(F.col("_n") <= n).drop("_u", "_n")


def event_log(events: DataFrame, n: int, by: str, period: str, status: str, value: str, key: str, salt: str, ts: str = "ts") -> DataFrame:
    """Batch form: (by, period, statuses, n, total, mean) with the counts of each status, and the mean of a sample of n values."""
    rows = events.withColumn("period", F.window(ts, period)["start"])
    counts = rows.groupBy(by, "period", status).agg(F.count("*").alias("c"), F.sum(value).alias("t"))
    whole = counts.groupBy(by, "period").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "c")))).alias("statuses"), F.sum("c").alias("n"), F.sum("t").alias("total"))
    means = reservoir(rows, n, [by, "period"], key, salt).groupBy(F.col(by).alias("_by"), F.col("period").alias("_period")).agg(F.avg(value).alias("mean"))
    return whole.join(means, F.col(by).eqNullSafe(F.col("_by")) & (F.col("period") == F.col("_period"))).drop("_by", "_period")


class _Period(StatefulProcessor):
    """The n least hashes of a period, and its counts by status; a timer at the period's end sends them and ends the state."""

    def __init__(self, by: str, key: str, kind: str, n: int, summary: bool):
        self.by, self.key, self.kind, self.n, self.summary = by, key, kind, n, summary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sample = handle.getListState("sample", f"u double, id {self.kind}, v double")
        self.statuses = handle.getMapState("statuses", "status string", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, end = list(self.sample.get()), None
        for pdf in rows:
            best = sorted([*best, *zip(pdf["x_draw"].tolist(), pdf[self.key].tolist(), pdf["x_value"].tolist())])[: self.n]
            end = int(pdf["x_end"].iloc[0])
            if self.summary:
                for status, part in pdf.groupby("x_status")["x_value"]:
                    n, total = self.statuses.getValue((status,)) if self.statuses.containsKey((status,)) else (0, 0.0)
                    self.statuses.updateValue((status,), (n + len(part), total + float(part.sum())))
        self.sample.put(best)
        self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = list(self.sample.get())
        if self.summary:
            counts = {k[0]: v for k, v in self.statuses.iterator()}
            mean = sum(v for *_, v in best) / max(1, len(best))
            yield pd.DataFrame({self.by: pd.Series([key[0]], dtype=object), "period": [key[1]], "statuses": [{k: n for k, (n, _) in sorted(counts.items())}], "n": [sum(n for n, _ in counts.values())], "total": [sum(t for _, t in counts.values())], "mean": [mean]})
            self.statuses.clear()
        else:
            yield pd.DataFrame({self.by: pd.Series([key[0]] * len(best), dtype=object), "period": [key[1]] * len(best), self.key: [i for _, i, _ in best]})
        self.sample.clear()

    def close(self) -> None:
        pass


def _periods(events: DataFrame, n: int, by: str, period: str, status: str | None, value: str | None, key: str, salt: str, ts: str, late: str) -> DataFrame:
    kinds = dict(events.dtypes)
    window = F.window(ts, period)
    rows = events.withWatermark(ts, late).select(by, key, ts, window["start"].alias("period"), F.unix_millis(window["end"]).alias("x_end"), keyed_uniform(salt, key).alias("x_draw"), F.lit(0.0).alias("x_value") if value is None else F.col(value).cast("double").alias("x_value"), F.lit("").alias("x_status") if status is None else F.coalesce(status, F.lit("")).alias("x_status"))
    out = f"{by} {kinds[by]}, period timestamp, " + (f"{key} {kinds[key]}" if status is None else "statuses map<string,bigint>, n bigint, total double, mean double")
    return rows.groupBy(by, "period").transformWithStateInPandas(_Period(by, key, kinds[key], n, status is not None), out, "append", "eventTime")


def reservoir_stream(events: DataFrame, n: int, by: str, period: str, key: str, salt: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Stream form: (by, period, key) of each period's sample, sent when the watermark passes the period's end."""
    return _periods(events, n, by, period, None, None, key, salt, ts, late)


def event_log_stream(events: DataFrame, n: int, by: str, period: str, status: str, value: str, key: str, salt: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Stream form of `event_log`, sent when the watermark passes the period's end. A null status counts as ''."""
    return _periods(events, n, by, period, status, value, key, salt, ts, late)
