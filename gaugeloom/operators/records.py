"""Cells to records: schema fills, packed cells, survivorship and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which columns are shown.
COLUMN_ORDER = ["VALUE", "REF", "CALC", "AVG", "MEAS", "SUM"]
FAMILY_ORDER = ["CYL", "TC", "BRG"]


def fill_schema(values: DataFrame, by: list[str], order: list[str], schema: list[str]) -> DataFrame:
    """The i-th value of a key under the i-th schema column; the rest is absent.

    Values beyond the schema are cut off by it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = values.withColumn("__n", (F.row_number().over(w) - 1).cast("int")).where(F.col("__n") < len(schema))
    cells = numbered.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__n", "value"))).alias("m"))
    out = cells.select(*by, "m", F.posexplode(F.array(*[F.lit(c) for c in schema])).alias("__n", "column"))
    status = F.when(F.map_contains_key("m", F.col("__n")), "PRESENT").otherwise("SOURCE_ABSENT")
    return out.select(*by, "column", F.try_element_at("m", F.col("__n")).alias("value"), status.alias("source_status"))


def packed(tokens: DataFrame, cell: list[str], order: list[str], least_conf: float = 60.0) -> DataFrame:
    """Further confident numbers of a cell that differ from its first: secondary values."""
    first = F.first("value").over(Window.partitionBy(*cell).orderBy(*order))
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    t = tokens.where("value IS NOT NULL").withColumn("first", first).withColumn("__n", n)
    return t.where((F.col("__n") > 1) & (F.col("conf") >= least_conf) & (F.col("value") != F.col("first"))).drop("__n").withColumn("flag", F.lit("SECONDARY_VALUE"))


def quality(found: Column, cells: Column, confident: Column) -> Column:
    """Score of a reading: found, up to 12 cells, confident cells; nothing found or empty costs."""
    return F.when(found, 10).otherwise(-10) + 2 * F.least(cells, F.lit(12)) + confident - F.when(cells == 0, 4).otherwise(0)


def primary_value(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first VALUE cell, else the only other cell, else null."""
    own = F.col("column") == "VALUE"
    g = cells.groupBy(*by).agg(
        F.min_by("value", F.when(own, F.col(order))).alias("v"), F.count_if(own).alias("n"), F.count_if(~own).alias("others"), F.min(F.when(~own, F.col("value"))).alias("o")
    )
    return g.select(*by, F.when(F.col("n") > 0, F.col("v")).when(F.col("others") == 1, F.col("o")).alias("value"))


def column_key(c: Column) -> Column:
    """struct(group, number, name): the display order of a column."""
    plain = F.array_position(F.array(*[F.lit(x) for x in COLUMN_ORDER]), c)
    family = F.regexp_extract(c, f"^({'|'.join(FAMILY_ORDER)})([0-9]+)$", 1)
    number = F.regexp_extract(c, f"^({'|'.join(FAMILY_ORDER)})([0-9]+)$", 2).try_cast("int")
    place = F.array_position(F.array(*[F.lit(x) for x in FAMILY_ORDER]), family)
    group = F.when(plain > 0, plain).when(place > 0, place + len(COLUMN_ORDER)).otherwise(len(COLUMN_ORDER) + len(FAMILY_ORDER) + 1)
    return F.struct(group.alias("group"), F.coalesce(number, F.lit(0)).alias("number"), c.alias("name"))


def discover(registry: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Merge of catalogue findings: new keys are DISCOVERED, MANUAL ones stay, others unite aliases."""
    j = registry.alias("r").join(found.alias("f"), F.col(f"r.{key}") == F.col(f"f.{key}"), "full")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("r.aliases", none), F.coalesce("f.aliases", none)
    return j.select(
        F.coalesce(f"r.{key}", f"f.{key}").alias(key),
        F.coalesce("r.status", F.lit("DISCOVERED")).alias("status"),
        F.array_sort(F.when(F.col("r.status") == "MANUAL", old).otherwise(F.array_union(old, new))).alias("aliases"),
    )


def reading_pages(pages: DataFrame, report: str = "report") -> DataFrame:
    """Pages (report, page, text) -> the pair to read: two hits, a hit and the next page, or the last two.

    The first page is a cover and never a hit.
    """
    hit = (F.col("page") != 1) & F.coalesce(F.lower("text").rlike(r"\b(reading|recording)\b"), F.lit(False))
    g = pages.groupBy(report).agg(F.array_sort(F.collect_set(F.when(hit, F.col("page")))).alias("hits"), F.max("page").alias("n"))
    h, n = F.col("hits"), F.col("n")
    pair = F.when(F.size(h) >= 2, F.slice(h, 1, 2)).when((F.size(h) == 1) & (F.get(h, F.lit(0)) < n), F.array(F.get(h, F.lit(0)), F.get(h, F.lit(0)) + 1)).when(n >= 2, F.array(n - 1, n))
    return g.select(report, F.size(h).alias("n_hits"), F.get(pair, F.lit(0)).alias("first_page"), F.get(pair, F.lit(1)).alias("second_page"))
