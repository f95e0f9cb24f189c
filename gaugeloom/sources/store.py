"""Small versioned tables for registries and triggers.

A version counts once its number is logged, so a writer that dies leaves the
last one in force, and readers never see a table that is being replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version, 0 if there is none."""
    try:
        log = spark.read.schema("version long, updated_at timestamp").parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as last saved; empty before."""
    n = latest(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{n}") if n else spark.createDataFrame([], schema)


def save(df: DataFrame, path: str) -> int:
    """Writes the next version and logs it with the time; its number."""
    spark = df.sparkSession
    n = latest(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{n}")
    spark.range(1).select(F.lit(n).cast("long").alias("version"), F.current_timestamp().alias("updated_at")).write.mode("append").parquet(f"{path}/log")
    return n


def add_trigger(triggers: DataFrame, new: DataFrame) -> DataFrame:
    """Triggers with one more row, whose id follows the largest."""
    top = triggers.agg(F.coalesce(F.max("trigger_id"), F.lit(0)) + 1).scalar()
    return triggers.unionByName(new.withColumn("trigger_id", top.cast(triggers.schema["trigger_id"].dataType)))


def remove(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of other keys; null keys stay."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))
