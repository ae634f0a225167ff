"""Exact deduplication with keyed streaming state, in DataFrame operations only.

Every row is digested (SHA-256 of the text without ASCII white space) and written to an inbox together with a stable
identifier and a content locator (file and row in it). A stream over the inbox keeps, for each digest and without
expiry, the number of rows and the best row seen, in RocksDB state on the executors' disks, checkpointed to the shared
folder. After the stream the state is read back as a table. Hits - rows whose digest has more than one row - are then
compared byte for byte with the row that stays; texts that only share a digest are regrouped by their bytes.

Order of preference: most code points in the original text, then smallest doc_id (null last), then locator, so that
exactly one of several equal rows stays. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _conf, fresh_path, settle, unused, write_once

WHITE = " \t\n\x0b\f\r"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# many small stores: no preallocated log files
FALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOCATOR = ["_file", "_row"]


def located(docs: DataFrame, names: list[str] = LOCATOR) -> DataFrame:
    """docs with the file and row (in columns of these names) of each of its rows; what isn't read from files is written to files first."""
    where = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return settle(docs, "located").select("*", *where)


def _digested(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.length(text).alias("points"), F.translate(text, WHITE, "").alias("norm"), *LOCATOR).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _best() -> Column:
    return F.max(F.struct("points", F.expr("~doc_id").alias("order_id"), *LOCATOR, "doc_id")).alias("best")


def keyed_state(inbox: DataFrame, path: str) -> DataFrame:
    """(digest, n, best) after a stream over the inbox's files has ended."""
    spark = inbox.sparkSession
    checkpoint = fresh_path(spark, "exact-state")
    stream = spark.readStream.schema(inbox.schema).parquet(path)
    grouped = stream.groupBy("digest").agg(F.count("*").alias("n"), _best())
    with _conf(spark, PROVIDER, ROCKSDB), _conf(spark, FALLOCATE, "false"):
        query = grouped.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        value = [f"value.`{c}`" for c in state.select("value.*").columns]
        return settle(state.selectExpr("key.digest AS digest", f"{value[0]} AS n", f"{value[1]} AS best"), "exact-groups")


def group_equal(rows: DataFrame) -> DataFrame:
    """One row per located row: doc_id, keep_id, group_size, kept, digest, and the row's locator."""
    spark = rows.sparkSession
    path = fresh_path(spark, "exact-inbox")
    plain = _digested(rows).drop("norm")
    write_once(plain, path, compression="zstd")
    inbox = spark.read.schema(plain.schema).parquet(path)
    groups = keyed_state(inbox, path)

    several = groups.where("n > 1").select("digest", "best")
    hits = _digested(rows).join(several, "digest").withColumn("keeper", F.expr("_file = best._file AND _row = best._row"))
    hits = settle(hits.drop("best"), "exact-hits")
    keepers = settle(hits.where("keeper").select("digest", F.col("norm").alias("keeper_norm")), "exact-keepers")
    clashing = settle(hits.join(keepers, "digest").where("norm != keeper_norm").select("digest"), "exact-clashes").distinct()
    alone = inbox.join(groups, "digest")
    if clashing.isEmpty():
        found = alone
    else:
        apart = hits.join(clashing, "digest", "left_semi")
        by_bytes = apart.groupBy("digest", "norm").agg(F.count("*").alias("n"), _best())
        again = apart.join(by_bytes, ["digest", "norm"]).select(*alone.columns)
        found = alone.join(clashing, "digest", "left_anti").unionByName(again)
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.expr("_file = best._file AND _row = best._row").alias("kept"), "digest", *LOCATOR)


def report(docs: DataFrame) -> DataFrame:
    return group_equal(located(docs.select("doc_id", "text"))).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called."""
    names = unused(docs, *LOCATOR)
    rows = located(docs, names)
    plain = rows.select("doc_id", "text", *[F.col(n).alias(c) for n, c in zip(names, LOCATOR)])
    gone = group_equal(plain).where("NOT kept").select(*[F.col(c).alias(n) for n, c in zip(names, LOCATOR)])
    return rows.join(gone, names, "left_anti").select(*docs.columns)
