"""Joins that Spark has no operator for: nearest, as-of, range, fill.

As-of and nearest joins sort the union of both sides once by key and position
and carry the last (next) right row along, so no pair is generated.  A key's
rows are cut into ranges of its positions by approximate quantiles, each range
is a task's work, and the last right row of a range is carried over to the next
ones, so a key that holds most rows is not one task's.  The range join goes by
equi-joined bins.

Null keys are a key like others, rows with a null position match nothing, and
empty sides give unmatched or no rows.  Columns of the left side that begin with
two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the rows of a key are cut.
RANGES = 32


def _ranged(both: DataFrame, by: list[str], at: str) -> DataFrame:
    """Adds __range: the number of the key's quantiles below the position; equal positions stay together."""
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = both.groupBy(*by).agg(F.percentile_approx(at, steps, 1000).alias("__cuts"))
    cuts = cuts.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__cuts")
    on = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    below = F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["__cuts"].dataType)), lambda q: q < F.col(at)))
    return both.join(cuts, on).withColumn("__range", below).drop("__cuts", *[f"__by_{c}" for c in by])


def _carry(both: DataFrame, by: list[str], at: str, side: Column, name: str, upward: bool = True) -> DataFrame:
    """Adds the last non-null __r up to each row (or the first from it on, downward)."""
    here = F.col(at) if upward else F.col(at).desc()
    step = F.col("__range") if upward else F.col("__range").desc()
    within = Window.partitionBy(*by, "__range").orderBy(here, side).rowsBetween(Window.unboundedPreceding, 0)
    end = F.max_by("__r", at) if upward else F.min_by("__r", at)
    ends = both.where("__r IS NOT NULL").groupBy(*by, "__range").agg(end.alias("__end"))
    marks = both.select(*by, "__range").distinct().select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__to"))
    ends = ends.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__to"), "__end")
    keys = [*[f"__by_{c}" for c in by], "__to"]
    all_ranges = marks.withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)).unionByName(ends).groupBy(*keys).agg(F.max("__end").alias("__end"))
    before = Window.partitionBy(*[f"__by_{c}" for c in by]).orderBy(F.col("__to") if upward else F.col("__to").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = all_ranges.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    on = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] + [F.col("__range") == F.col("__to")]
    local = both.withColumn("__local", F.last("__r", ignorenulls=True).over(within))
    return local.join(carried, on).withColumn(name, F.coalesce("__local", "__carried")).drop("__local", "__carried", *keys)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, payload: list[str], strict: bool = False, tolerance: float | None = None) -> DataFrame:
    """Each left row with the latest right row at or (``strict``) before it.

    Ties on the right go to the largest payload.  Beyond ``tolerance`` the
    payload is null, as it is without any match.
    """
    names = left.columns
    packed = F.struct(F.col(at).alias("__at"), *payload)
    one = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*payload)).alias("__p")).select(*by, at, *[F.col(f"__p.{c}").alias(c) for c in payload])
    r = one.select(*by, at, packed.alias("__r"), F.lit(1 if strict else 0).alias("__side"))
    l = left.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).withColumn("__side", F.lit(0 if strict else 1))
    both = _ranged(l.unionByName(r, allowMissingColumns=True), by, at)
    both = _carry(both, by, at, F.col("__side"), "__m").where(F.col("__side") == (0 if strict else 1))
    ok = F.col(at).isNotNull() if tolerance is None else F.col(at) - F.col("__m.__at") <= tolerance
    return both.select(*names, *[F.when(ok, F.col(f"__m.{c}")).alias(c) for c in payload], F.when(ok, F.col("__m.__at")).alias(f"{at}_right"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, payload: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the right row nearest in ``at``; ties to the lower one, of equal positions to the smallest payload."""
    names = left.columns
    one = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.min(payload).alias(payload))
    r = one.select(*by, at, F.struct(F.col(at).alias("x"), F.col(payload).alias("p")).alias("__r"), F.lit(0).alias("__side"))
    l = left.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).withColumn("__side", F.lit(1))
    both = _ranged(l.unionByName(r, allowMissingColumns=True), by, at)
    both = _carry(both, by, at, F.col("__side"), "__lo")
    both = _carry(both, by, at, F.col("__side"), "__hi", upward=False).where("__side = 1")
    lo, hi = F.col(at) - F.col("__lo.x"), F.col("__hi.x") - F.col(at)
    pick = F.when(F.col("__hi").isNull() | (lo <= hi), F.struct(F.col("__lo.p").alias("p"), lo.alias("d"))).otherwise(F.struct(F.col("__hi.p").alias("p"), hi.alias("d")))
    out = both.withColumn("__m", pick)
    ok = F.col(at).isNotNull() if tolerance is None else F.col("__m.d") <= tolerance
    return out.select(*names, F.when(ok, F.col("__m.p")).alias(payload), F.when(ok, F.col("__m.d")).alias("distance"))


def range_assign(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, bin_width: float) -> DataFrame:
    """Points joined with the half-open ranges [lo, hi) that hold them, by bins."""
    p = points.withColumn("__bin", F.floor(F.col(at) / bin_width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width))))
    return p.join(r, "__bin").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bin")


def fill_absent(grid: DataFrame, cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every grid row, with its cell or marked absent; blank differs from absent."""
    c = cells.select(*keys, F.col(value), F.lit(True).alias("__has"))
    status = F.when(F.col("__has").isNull(), "SOURCE_ABSENT").when(F.col(value).isNull(), "SOURCE_BLANK").otherwise("PRESENT")
    return grid.join(c, keys, "left").withColumn("source_status", status).drop("__has")
