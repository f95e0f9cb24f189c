"""Analytical questions over observations (report, field, value, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import best, with_ties


def aggregate_field(obs: DataFrame, operations: list[str]) -> DataFrame:
    """(field, operation, result): mean, average, max, min, sum; others mean."""
    known = {"max": F.max, "min": F.min, "sum": F.sum}
    one = obs.groupBy("field").agg(*[known.get(o, F.avg)("value").alias(o) for o in operations])
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("operation"), F.col(o).alias("result")) for o in operations]))
    return one.select("field", pairs.alias("x")).select("field", "x.operation", F.round("x.result", 4).alias("result")).where("result IS NOT NULL")


def extreme_sources(obs: DataFrame, largest: bool) -> DataFrame:
    rows = obs.where("value IS NOT NULL")
    return with_ties(rows, ["field"], F.col("value").desc() if largest else F.col("value").asc())


def first_sources(obs: DataFrame, n: int = 5) -> DataFrame:
    return best(obs, ["field"], [F.col("ordinal")], n)


def compare_reports(obs: DataFrame, a: str, b: str) -> DataFrame:
    """Per field: counts, maxima and a label; absence in a is told first."""
    in_a, in_b = F.col("report") == a, F.col("report") == b
    g = obs.groupBy("field").agg(
        F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.max(F.when(in_a, F.col("value"))).alias("max_a"), F.max(F.when(in_b, F.col("value"))).alias("max_b")
    )
    label = F.when(F.col("n_a") == 0, "absent in a").when(F.col("n_b") == 0, "absent in b").otherwise("present in both")
    return g.withColumn("label", label)


def absent(reports: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return reports.join(present, key, "left_anti")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query in any column, case folded; an empty query finds all."""
    hit = F.lit(query == "")
    for c in columns:
        hit = hit | F.lower(c).contains(query.lower())
    return df.where(hit)


def compare(op: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(op == "<", value < threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "==", value == threshold)
        .otherwise(value > threshold)
    )


def evaluate_triggers(triggers: DataFrame, obs: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per active trigger; a field without observations does not fire.

    Equal values of a field are pre-aggregated and meet the triggers in an inner
    join, whose smaller side Spark may broadcast by its size.  With ``now`` the
    rows also carry last_fired: now where it fires, else as it was (sticky).
    """
    t = triggers.where("active")
    values = obs.groupBy("field", "value").agg(F.count("*").alias("n"))
    j = values.join(t.select("trigger_id", "field", "operator", "threshold"), "field")
    fired = F.coalesce(F.bool_or(compare(F.col("operator"), F.col("value"), F.col("threshold"))), F.lit(False))
    seen = j.groupBy("trigger_id").agg(fired.alias("fired"), F.max("value").alias("max_value"), F.sum("n").alias("n"))
    out = t.join(seen, "trigger_id", "left").withColumns({"fired": F.coalesce("fired", F.lit(False)), "n": F.coalesce("n", F.lit(0))})
    if now is None:
        return out.select("trigger_id", "fired", "max_value", "n")
    return out.select("trigger_id", "fired", "max_value", "n", F.when(F.col("fired"), now).otherwise(F.col("last_fired")).alias("last_fired"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_if_blank: list[str], overwrite: list[str], unite: list[str]) -> DataFrame:
    """Full outer merge by key: overwrite, keep where the new is blank, or unite sets."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    blank = lambda c: F.when(F.col(f"n.{c}") != "", F.col(f"n.{c}"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return j.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *[F.coalesce(blank(c), F.col(f"o.{c}")).alias(c) for c in keep_old_if_blank],
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in overwrite],
        *[F.array_sort(F.array_union(none(F.col(f"o.{c}")), none(F.col(f"n.{c}")))).alias(c) for c in unite],
    )
