"""Tokens (page, left, top, text, conf) to grid cells with blanks kept."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_number


def value_columns(headers: DataFrame, edge: float = 200.0) -> DataFrame:
    """Header centres (page, label, x) -> intervals [lo, hi) at the midpoints."""
    w = Window.partitionBy("page").orderBy("x", "label")
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    return headers.select(
        "page",
        F.col("label").alias("column"),
        F.coalesce((before + F.col("x")) / 2, F.col("x") - edge).alias("lo"),
        F.coalesce((after + F.col("x")) / 2, F.col("x") + edge).alias("hi"),
        F.row_number().over(w).alias("col_no"),
    )


def grid_cells(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """Every (row, column) of a page; a cell without tokens is blank, not gone."""
    rows = tokens.select("page", "top").distinct()
    grid = rows.join(columns, "page")
    hit = tokens.join(columns, "page").where("left >= lo AND left < hi")
    cells = hit.groupBy("page", "top", "column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda t: t["text"]), " ").alias("raw_text"),
        F.avg("conf").alias("confidence"),
    )
    out = grid.join(cells, ["page", "top", "column"], "left")
    status = F.when(F.col("raw_text").isNull(), "SOURCE_BLANK").when(safe_number(F.col("raw_text")).isNull(), "EXTRACTION_FAILED").otherwise("PRESENT")
    return out.select("page", "top", "col_no", "column", "raw_text", safe_number(F.col("raw_text")).alias("value"), F.round("confidence", 4).alias("confidence"), status.alias("source_status"))


def recover_unique(cells: DataFrame, strays: DataFrame) -> DataFrame:
    """Fills a blank cell iff exactly one stray value lies in its column and row."""
    one = strays.groupBy("page", "top", "column").agg(F.count("*").alias("n"), F.max("value").alias("found")).where("n = 1")
    j = cells.join(one, ["page", "top", "column"], "left")
    take = (F.col("source_status") == "SOURCE_BLANK") & F.col("found").isNotNull()
    return j.withColumn("value", F.when(take, F.col("found")).otherwise(F.col("value"))).withColumn("recovered", take).drop("n", "found")


def match_ratio(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """Adds the Ratcliff-Obershelp ratio of two texts (Arrow batches)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [round(SequenceMatcher(None, x or "", y or "").ratio(), 6) for x, y in zip(pdf[a], pdf[b], strict=True)]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", `{name}` double"
    return pairs.mapInPandas(run, schema)
