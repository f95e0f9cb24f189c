"""One-dimensional clustering of positioned rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, by: list[str], at: str, order: list[str], gap: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a run ends where ``gap`` (of __d) holds."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    df = df.withColumn("__d", F.col(at) - F.lag(at).over(w))
    df = df.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("long"))
    return df.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d", "__new")


def anchor_rows(df: DataFrame, by: list[str], at: str, order: str, tolerance: float) -> DataFrame:
    """Rows in order join a row while within ``tolerance`` of its first position.

    The anchor never moves, so this is a fold over the sorted positions of a key.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(order).alias("o"))))
    start = F.expr("named_struct('a', cast(null as double), 'n', -1, 'out', cast(array() as array<int>))")

    def step(acc: Column, x: Column) -> Column:
        new = acc["a"].isNull() | (F.abs(x["at"] - acc["a"]) > tolerance)
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, x["at"]).otherwise(acc["a"]).alias("a"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    g = df.groupBy(*by).agg(items.alias("items"))
    g = g.withColumn("rows", F.aggregate("items", start, step, lambda acc: acc["out"]))
    return g.select(*by, F.explode(F.arrays_zip("items", "rows")).alias("z")).select(*by, F.col("z.items.o").alias(order), F.col("z.items.at").alias(at), F.col("z.rows").alias("row_id"))


def centroid_rows(df: DataFrame, by: list[str], at: str, order: str, tolerance: float) -> DataFrame:
    """Each item joins the nearest row whose running mean is within ``tolerance``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order], kind="stable")
        means, counts, out = [], [], []
        for y in pdf[at].to_numpy(float):
            near = min(range(len(means)), key=lambda i: (abs(means[i] - y), i), default=None)
            if near is None or abs(means[near] - y) > tolerance:
                means.append(y)
                counts.append(1)
                near = len(means) - 1
            else:
                counts[near] += 1
                means[near] += (y - means[near]) / counts[near]
            out.append(near)
        return pdf.assign(row_id=out)[[*by, order, at, "row_id"]]

    part = df.select(*by, order, F.col(at).cast("double").alias(at))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema) + ", row_id long"
    return part.groupBy(*by).applyInPandas(fold, schema)


def upper_median(c: str) -> Column:
    """The element n // 2 of the sorted values, not an interpolated median."""
    s = F.array_sort(F.collect_list(c))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
