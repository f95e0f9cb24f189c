"""Reports as a whole: templates, dates, definitions, rollups and indexes.

Empty tables give empty results; where nothing is said of nulls they are a value
like others in keys and are passed over by aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import first_number, safe_number

#: What the top of a fuel page says.
FUEL_MARKERS = ["fuel oil", "absolute consumption", "specific foc", "viscosit", "density", "lcv", "price", "sulfur", "lubricat", "water cont"]
#: Statuses of an audited field that are not adverse.
HARMLESS = ["OK", "SOURCE_BLANK", "TEXT_VALUE"]


def route_templates(pages: DataFrame, markers: list[str] = FUEL_MARKERS, report: str = "report") -> DataFrame:
    """Pages (report, page, reading, top_text) -> (report, template, pages).

    A: exactly two reading pages of which the second's top names a fuel marker;
    else B.  ``pages`` are the reading pages in order; pages of the same number
    and report count once.
    """
    fuel = F.coalesce(F.lower("top_text").rlike("|".join(markers)), F.lit(False))
    one = pages.groupBy(report, "page").agg(F.bool_or(F.coalesce("reading", F.lit(False))).alias("reading"), F.bool_or(fuel).alias("fuel"))
    g = one.groupBy(report).agg(F.sort_array(F.collect_list(F.when(F.col("reading"), F.struct("page", "fuel")))).alias("r"))
    is_a = (F.size("r") == 2) & F.coalesce(F.get("r", F.lit(1))["fuel"], F.lit(False))
    return g.select(report, F.when(is_a, "A").otherwise("B").alias("template"), F.transform("r", lambda x: x["page"]).alias("pages"))


def by_priority(cells: DataFrame, by: list[str], columns: list[str], value: str = "value") -> DataFrame:
    """The value of the first of ``columns`` that a key has one in; keys without one are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return cells.where((place > 0) & F.col(value).isNotNull()).groupBy(*by).agg(F.min(F.struct(place.alias("p"), value)).alias("m")).select(*by, F.col("m.p").cast("int").alias("place"), F.col(f"m.{value}").alias(value))


def field_definitions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each field."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def field_columns(cells: DataFrame, key: str) -> DataFrame:
    """(key, columns, chosen): a field's columns without VALUE (VALUE if it has no other); AVG is chosen, else the first."""
    g = cells.groupBy(key).agg(F.array_sort(F.collect_set("column")).alias("c"))
    other = F.filter("c", lambda x: x != "VALUE")
    columns = F.when(F.size(other) > 0, other).otherwise(F.array(F.lit("VALUE")))
    chosen = F.when(F.array_contains(columns, "AVG"), "AVG").otherwise(F.get(columns, F.lit(0)))
    return g.select(key, F.array_join(columns, ";").alias("columns"), chosen.alias("chosen"))


def latest(index: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that is first by ``order``: the index after its upserts."""
    return index.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def find_field(registry: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Names asked (name) -> the first field (by key) that has exactly this name or alias; null without."""
    names = registry.select(key, F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    first = names.groupBy("name").agg(F.min(key).alias(key))
    return asked.join(first, "name", "left")


def audit_rollup(fields: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Fields (by, statuses) -> counts by key: fields, ok, missing, shifted, text, adverse; and whether all are there."""
    has = lambda s: F.count_if(F.array_contains("statuses", s))
    adverse = F.size(F.array_except("statuses", F.array(*[F.lit(x) for x in HARMLESS]))) > 0
    return fields.groupBy(*by).agg(
        F.count("*").alias("fields"), has("OK").alias("ok"), has("MISSING_VALUE").alias("missing"), has("POSSIBLE_POSITIONAL_SHIFT").alias("shifted"),
        has("TEXT_VALUE").alias("text"), F.count_if(adverse).alias("adverse"), (F.count("*") == expected).alias("complete"),
    )


def field_statuses(cells: DataFrame, by: list[str], schema_size: int) -> DataFrame:
    """Cells (by, column, value, raw_text, confidence) -> the sorted statuses of a field.

    Wrong numbers of columns, repeated and unresolved columns, texts in place of
    numbers and numbers that could not be read; OK without any of them.
    """
    c, raw = F.col("column"), F.coalesce(F.trim("raw_text"), F.lit(""))
    g = cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("column").alias("k"),
        F.bool_or(c.rlike("^(X_|VAL[0-9])")).alias("unresolved"),
        F.bool_or((raw != "") & ~raw.rlike("[0-9]")).alias("text"),
        F.bool_or(raw.rlike("[0-9]") & F.col("value").isNull() | (F.col("confidence") < 0.15)).alias("malformed"),
        F.bool_and(raw == "").alias("blank"),
    )
    rules = {
        "COLUMN_UNRESOLVED": F.col("unresolved"), "DUPLICATE_COLUMN": F.col("n") > F.col("k"), "MALFORMED_NUMBER": F.col("malformed"),
        "POSSIBLE_POSITIONAL_SHIFT": F.col("k") < schema_size, "SCHEMA_MISMATCH": F.col("k") > schema_size, "SOURCE_BLANK": F.col("blank"), "TEXT_VALUE": F.col("text"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return g.select(*by, F.when(F.size(found) == 0, F.array(F.lit("OK"))).otherwise(found).alias("statuses"))


def across_pages(records: DataFrame, registry: DataFrame, report: str, field: str, order: list[Column]) -> DataFrame:
    """One record for each report and field: the best by ``order``, else absent on page 0."""
    best = records.withColumn("__n", F.row_number().over(Window.partitionBy(report, field).orderBy(*order))).where("__n = 1").drop("__n")
    grid = records.select(report).distinct().join(registry.agg(F.collect_set(field).alias("__f"))).select(report, F.explode("__f").alias(field))
    out = grid.join(best, [report, field], "left")
    return out.withColumn("source_status", F.when(F.col("page").isNull(), "SOURCE_ABSENT").otherwise("PRESENT")).withColumn("page", F.coalesce("page", F.lit(0)))


def columns_from_gaps(tokens: DataFrame, page: list[str], ratio: float, least: float) -> DataFrame:
    """Tokens (left, right, text) of a page -> its columns (column, lo, hi, label).

    A column ends where the gap to the next token exceeds ``ratio`` medians of
    the page's positive gaps, and ``least``; its label is its commonest text,
    the first in order of those that tie.
    """
    w = Window.partitionBy(*page).orderBy("left", "right", "text")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = tokens.withColumn("__gap", F.col("left") - reach)
    middle = t.where("__gap > 0").groupBy(*page).agg(F.median("__gap").alias("__mid"))
    t = t.join(middle, page, "left").withColumn("__new", F.coalesce(F.col("__gap") > F.greatest(ratio * F.col("__mid"), F.lit(least)), F.lit(False)).cast("int"))
    t = t.withColumn("column", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = t.groupBy(*page, "column", "text").agg(F.count("*").alias("n"), F.min("left").alias("lo"), F.max("right").alias("hi"))
    return said.groupBy(*page, "column").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct(-F.col("n"), "text"))["text"].alias("label"))


def drop_debris(tokens: DataFrame, by: list[str], at: str, near: float) -> DataFrame:
    """Tokens without the debris that has a clean token of its key nearer than ``near``.

    The last clean token before and the first after settle it, by windows.
    """
    w = Window.partitionBy(*by).orderBy(at)
    clean = F.when(~F.col("debris"), F.col(at))
    before = F.max(clean).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(clean).over(Window.partitionBy(*by).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, 0))
    t = tokens.withColumns({"__lo": F.col(at) - before, "__hi": after - F.col(at)})
    gone = F.col("debris") & (F.coalesce(F.col("__lo") < near, F.lit(False)) | F.coalesce(F.col("__hi") < near, F.lit(False)))
    return t.where(~gone).drop("__lo", "__hi")


def grid_left(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Where a page's numbers begin: the smallest centre of a numeric token."""
    return tokens.where(safe_number(F.col("text")).isNotNull()).groupBy(*by).agg(F.min("cx").alias("grid_left"))


def numeric_cell(value: Column, raw: Column) -> Column:
    """A cell's number: its value, else its text as a number, else the first number of the text; finite only."""
    text = F.replace(raw, F.lit(","), F.lit("."))
    v = F.coalesce(value, safe_number(text), first_number(raw))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def numbered_labels(cells: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Cells with the label of their column: the second of a column is 'column 2', and so on."""
    n = F.row_number().over(Window.partitionBy(*by, "column").orderBy(*order))
    return cells.withColumn("__n", n).withColumn("shown", F.when(F.col("__n") == 1, F.col("column")).otherwise(F.concat_ws(" ", "column", "__n"))).drop("__n")


def metadata(records: DataFrame, report: str, field: str) -> DataFrame:
    """(report, detected, populated, populated_fields): fields found, those with a value, and their names in order."""
    return records.groupBy(report).agg(
        F.countDistinct(field).alias("detected"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col(field))).alias("populated"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.col(field)))), ";").alias("populated_fields"),
    )


def markdown(counts: DataFrame, title: str) -> str:
    """A bounded table of counts as Markdown, rows in order; meant for rollups of some thousand rows at most."""
    head = f"# {title}\n\n| {' | '.join(counts.columns)} |\n|{'---|' * len(counts.columns)}\n"
    rows = counts.orderBy(*counts.columns).limit(10_000).collect()
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
