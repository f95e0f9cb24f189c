"""Ranked survivorship: explicit orders instead of 'first wins'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def with_ties(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """All rows that tie for the first place."""
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(order))).where("__rank = 1").drop("__rank")


def unambiguous(scores: DataFrame, by: list[str], score: str, name: str, least: float, margin: float) -> DataFrame:
    """The best name a key has, NO_MATCH under ``least``, AMBIGUOUS within ``margin``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    top = scores.withColumn("__next", F.lead(score).over(w)).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    status = (
        F.when(F.col(score) < least, "NO_MATCH").when(F.col(score) - F.col("__next") <= margin, "AMBIGUOUS").otherwise("MATCHED")
    )
    return top.withColumn("status", status).select(*by, F.when(status == "MATCHED", F.col(name)).alias(name), score, "status")
