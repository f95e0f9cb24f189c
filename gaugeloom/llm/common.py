"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is used, in local mode only.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gaugeloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialises a table in the shared folder and drops its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 8 MB at most, unless the session says otherwise.

    A task holds several copies of a batch; Spark's default is 64 MB.
    """
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, "8m")


def remainder(id_col: Column, m: int) -> Column:
    """crc32 of the id as text modulo ``m``; null for a null id."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % m


class Scratch:
    """Intermediate tables in the shared folder that go once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.held = spark, name, []

    def store(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{self.name}-{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((back, path))
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables that were read back as ``frames``."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame, path in [x for x in self.held if any(x[0] is f for f in frames)]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.held = [x for x in self.held if not any(x[0] is f for f in frames)]

    def drop_others(self, *kept: DataFrame) -> None:
        self.drop(*[f for f, _ in self.held if not any(f is k for k in kept)])


def bounded(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows; for tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
