"""Positioned tokens to zones, headers, segments and schema columns.

All windows are within a page (or a row of one), so their size is that of a
page, not of the corpus.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER
from .batches import columns, fold_groups, number

DATE = r"^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$"
TIME = r"^[0-9]{1,2}:[0-9]{2}$"


def token_class(c: Column, units: list[str]) -> Column:
    """number, date, time, unit, artifact (no letter or digit), alpha or other; null stays null."""
    t = F.lower(F.trim(c))
    return (
        F.when(c.isNull(), None)
        .when(t.rlike(NUMBER), "number")
        .when(t.rlike(DATE), "date")
        .when(t.rlike(TIME), "time")
        .when(t.isin([u.lower() for u in units]), "unit")
        .when(~t.rlike("[a-z0-9]"), "artifact")
        .when(t.rlike("^[a-z]+$"), "alpha")
        .otherwise("other")
    )


def zones(bands: DataFrame, by: list[str], tolerance: float, narrower: float = 0.6) -> DataFrame:
    """Bands (top, bottom, extent) numbered by zone, and by row across the zones.

    A zone begins after a gap of 3.9 tolerances, or of 1.95 where the band is
    narrower than ``narrower`` of the one above.
    """
    w = Window.partitionBy(*by).orderBy("top")
    gap = F.col("top") - F.lag("bottom").over(w)
    new = (gap >= 3.9 * tolerance) | ((gap >= 1.95 * tolerance) & (F.col("extent") < narrower * F.lag("extent").over(w)))
    out = bands.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    out = out.withColumn("zone", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("row_no", F.row_number().over(w)).drop("__new")


def compound(tokens: DataFrame, by: list[str], max_gap: float) -> DataFrame:
    """Neighbouring tokens (left, width, text) of a row joined while the gap is small."""
    w = Window.partitionBy(*by).orderBy("left", "text")
    far = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w) > max_gap
    runs = tokens.withColumn("__new", F.coalesce(far, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("label"),
        F.min("left").alias("x_min"),
        F.max(F.col("left") + F.col("width")).alias("x_max"),
    )


def parent_by_overlap(leaves: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """Each leaf (x_min, x_max) with the parent interval it overlaps most; ties go left."""
    p = parents.select(*by, F.col("label").alias("parent"), F.col("x_min").alias("__lo"), F.col("x_max").alias("__hi"))
    j = leaves.join(p, by).withColumn("overlap", F.least("x_max", "__hi") - F.greatest("x_min", "__lo")).where("overlap > 0")
    best = j.groupBy(*by, "x_min", "x_max").agg(F.max(F.struct("overlap", (-F.col("__lo")).alias("l"), "parent")).alias("m"))
    return best.select(*by, "x_min", "x_max", F.col("m.parent").alias("parent"), F.col("m.overlap").alias("overlap"))


def segments(tokens: DataFrame, row: list[str], is_label: Column) -> DataFrame:
    """Value tokens with the last label on their left and where the next one begins."""
    w = Window.partitionBy(*row).orderBy("left")
    label = F.when(is_label, F.col("text"))
    at = F.when(is_label, F.col("left"))
    out = tokens.withColumn("label", F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("next_left", F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return out.where(~is_label)


def collisions(cells: DataFrame, row: list[str]) -> DataFrame:
    """Rows in which two values fell into one column."""
    return cells.groupBy(*row).agg(F.count("*").alias("n"), F.countDistinct("column").alias("columns")).withColumn("collision", F.col("n") > F.col("columns"))


def schema_map(leaves: DataFrame, by: list[str], schema: list[str]) -> DataFrame:
    """Leaf columns (label, x) placed on a schema: (by, column, label, x).

    A leaf with a schema label anchors it.  A schema column between two anchors
    takes the nearest free leaf to its interpolated place, from left to right.
    Columns outside the anchors stay unplaced: order alone is no evidence.  A
    leaf without x can only be an anchor, and nothing is placed beside it.
    """

    def place(table: pa.Table, bounds: list[int]) -> pa.Table:
        labels, xs = table.column("label").to_pylist(), table.column("x").to_pylist()
        leaf: list[int] = []
        column: list[int] = []
        for lo, end in zip(bounds, bounds[1:], strict=False):
            owner: dict[int, int] = {}
            for i in range(lo, end):
                if labels[i] in known and known[labels[i]] not in owner:
                    owner[known[labels[i]]] = i
            if not owner:
                continue
            free = [i for i in range(lo, end) if xs[i] is not None and i not in owner.values()]
            left = min(owner)
            for j in range(left, max(owner) + 1):
                if j in owner:
                    left = j
                    continue
                right = min(k for k in owner if k > j)
                if not free or xs[owner[left]] is None or xs[owner[right]] is None:
                    continue
                a, z = xs[owner[left]], xs[owner[right]]
                target = (z - a) / (right - left) * (j - left) + a
                owner[j] = min(free, key=lambda i: abs(xs[i] - target))
                free.remove(owner[j])
                left = j
            for j in sorted(owner):
                leaf.append(owner[j])
                column.append(j)
        out = table.select([*by, "label", "x"]).take(pa.array(leaf, pa.int64()))
        return out.add_column(len(by), "column", pa.array(schema, pa.string()).take(pa.array(column, pa.int64())))

    known = {name: j for j, name in reversed(list(enumerate(schema)))}
    part = leaves.select(*by, F.col("label").cast("string").alias("label"), number("x").alias("x"))
    order = [F.col(c).asc_nulls_last() for c in ("x", "label")]
    return fold_groups(part, by, order, place, f"{columns(part, by)}, `column` string, label string, x double")
