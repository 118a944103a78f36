"""Shared-storage tables that cut lineage, and small helpers for sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20
ROWS_A_FILE = 50_000
# Hadoop starts a chmod process for every local file and folder it makes; without checksum files these are fewer.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand texts to Python workers a few megabytes at a time; the session's setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see: ``spark.checkpoint.dir``.

    Only a local session (tests) may name none: it gets a folder of this machine,
    set for the session's context as well.  Elsewhere that is an error, as other
    machines could not see the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


class Scratch:
    """A folder of Parquet tables under the shared folder, one per operator call.

    A table written here survives the loss of any executor and starts a new
    lineage, which is what a checkpoint is for; Parquet keeps it small.  Each file
    costs its executor two processes or more on a local file system, and memory
    that is read while a JVM starts one counts twice.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        usual = spark._jsc.hadoopConfiguration().get("fs.file.impl") in (None, "org.apache.hadoop.fs.LocalFileSystem")
        self._options = _RAW if usual else {}

    def few(self, df: DataFrame, rows: int) -> DataFrame:
        """``df``, known to have at most about ``rows`` rows, in no more partitions than these are worth."""
        return df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))

    def table(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """``df`` stored; ``rows`` is a bound of its rows where one is known, and makes for fewer files."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        if rows is not None:
            df = self.few(df, rows)
        with small_batches(self.spark):
            df.write.options(**self._options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this folder that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
