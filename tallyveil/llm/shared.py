"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"  # rows hold whole texts, so Python's batches are cut by bytes
BATCH_BYTES = 4 << 20
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (as in tests) gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _local.setdefault(app, tempfile.mkdtemp(prefix="spark-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write df and let its shuffle files go as soon as the write has ended."""
    with _conf(df.sparkSession, CLEANUP, "true"), _conf(df.sparkSession, BATCH, str(BATCH_BYTES)):
        df.write.format(fmt).options(**options).save(path)


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write_once(df, path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fetched(df: DataFrame) -> pa.Table:
    """The rows of a bounded result; Python's batches below it are cut by bytes."""
    with _conf(df.sparkSession, BATCH, str(BATCH_BYTES)):
        return df.toArrow()


def discard(*tables: DataFrame) -> None:
    """Delete the folders of settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
