"""Whole groups of sorted rows in Arrow batches, for folds over many small groups.

A Python call for each group costs more than a small group's work, so a task gets
batches that hold many groups; a group that does not end in a batch waits for its rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_groups(df: DataFrame, by: list[str], order: list[Column], fold: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """``fold`` of tables of whole groups (sorted by ``order``) and the bounds of their groups."""
    marked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    def close(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        bounds = np.flatnonzero(t.column("__n").to_numpy() == 1).tolist()
        return fold(t, [*bounds, t.num_rows]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b.column(b.schema.get_field_index("__n")).to_numpy() == 1)
            if len(begins):
                last = int(begins[-1])
                held.append(b.slice(0, last))
                if sum(h.num_rows for h in held):
                    yield from close(held)
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield from close(held)

    return marked.mapInArrow(run, schema)


def columns(df: DataFrame, names: list[str]) -> str:
    """The DDL of some columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def number(c: str) -> Column:
    """As double; NaN is null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)
