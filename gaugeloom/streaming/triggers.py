"""Trigger evaluation over a stream of observations, with sticky firing times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.query import evaluate_triggers


def watch(observations: DataFrame, triggers: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's trigger results as Parquet."""

    def batch(df: DataFrame, epoch: int) -> None:
        evaluate_triggers(triggers, df).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_summary(observations: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Tumbling-window statistics by field; rows later than ``late`` are dropped by the watermark."""
    return (
        observations.withWatermark(at, late)
        .groupBy(F.window(at, width), "field")
        .agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    )
