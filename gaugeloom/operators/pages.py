"""Bands, recording times and header anchors of pages of positioned tokens.

Windows are within a row, a band or the headers of a page.  Empty tables give
empty results; tokens with a null text have no class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_edges

# fixed values
HEADER_COVERAGE, HEADER_LABELS, VALUE_ZONE = 0.30, 0.80, 0.30
GAP_OF_WIDTH, LEAST_GAP, DEFAULT_GAP = 0.6, 6.0, 12.0
BASELINE_OF_HEIGHT, LEAST_BASELINE, DEFAULT_HEIGHT = 0.35, 2.0, 16.0
ANCHOR_TOLERANCE = 12.0

VALUE = r"^[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)[CFKcfk]?$"
PURE = r"^[0-9]+([.][0-9]+)?$"
WORD = r"^[A-Za-z._%°]+$"


def band_classes(tokens: DataFrame, by: list[str], band: str = "band") -> DataFrame:
    """Bands of tokens (left, width, top, height, text) as data, header, title or separator.

    A lone token is data if it is a number or has a word of three characters.
    A band is data if a number stands right of the first 30 % of the page's width,
    unless it continues a word (CYL 4), or if less than 80 % of its groups are
    labels.  Of the others, those over 30 % of the width are headers.  Words in
    front of a token are looked for on the token before it.
    Returns by, band, n_tokens, row_type.
    """
    row = Window.partitionBy(*by, band)
    w = row.orderBy("left", "text")
    text = F.coalesce(strip_edges(F.col("text")), F.lit(""))
    t = tokens.repartition(*by).select(
        *by,
        band,
        "left",
        "top",
        (F.col("left") + F.col("width")).alias("right"),
        F.col("text"),
        text.rlike(VALUE).alias("num"),
        text.rlike(PURE).alias("pure"),
        F.coalesce(F.trim("text").rlike(WORD), F.lit(False)).alias("word"),
        (text.rlike("[A-Za-z]") & ~text.rlike(PURE)).alias("mergeable"),
        F.exists(F.split(text, r"\s+"), lambda x: x.rlike("[A-Za-z]") & (F.length(F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")) >= 3)).alias("genuine"),
        "height",
        F.median(F.when(F.col("width") > 0, F.col("width"))).over(row).alias("mw"),
        F.median(F.when(F.col("height") > 0, F.col("height"))).over(row).alias("mh"),
    )
    near = F.coalesce(F.greatest(F.col("mw") * GAP_OF_WIDTH, F.lit(LEAST_GAP)), F.lit(DEFAULT_GAP))
    close = F.col("left") - F.lag("right").over(w) <= near
    drop = F.abs(F.col("top") - F.lag("top").over(w))

    def level(height: Column) -> Column:
        return drop <= F.greatest(F.lit(LEAST_BASELINE), height * BASELINE_OF_HEIGHT)

    continues = F.col("num") & close & level(F.col("height")) & F.lag("word").over(w)
    merged = close & level(F.coalesce(F.col("mh"), F.lit(DEFAULT_HEIGHT))) & F.lag("mergeable").over(w) & (F.col("pure") | F.col("mergeable"))
    t = t.select("*", F.coalesce(continues, F.lit(False)).alias("continues"), F.coalesce(~merged, F.lit(True)).alias("first"))
    alone = F.col("first") & F.coalesce(F.lead("first").over(w), F.lit(True))
    t = t.withColumn("isolated", alone & F.col("num"))
    b = t.groupBy(*by, band).agg(
        F.count("*").alias("n_tokens"),
        F.min("left").alias("lo"),
        F.max("right").alias("hi"),
        F.max(F.when(F.col("num") & ~F.col("continues"), (F.col("left") + F.col("right")) / 2)).alias("value_x"),
        (1 - F.sum(F.col("isolated").cast("int")) / F.sum(F.col("first").cast("int"))).alias("labels"),
        F.bool_or(F.col("num") | F.col("genuine")).alias("real"),
    )
    page = Window.partitionBy(*by)
    left, width = F.min("lo").over(page), F.max("hi").over(page) - F.min("lo").over(page)
    kind = (
        F.when(F.col("n_tokens") < 2, F.when(F.col("real"), "data").otherwise("separator"))
        .when(F.col("value_x") >= left + width * VALUE_ZONE, "data")
        .when(F.col("labels") < HEADER_LABELS, "data")
        .when((F.col("hi") - F.col("lo")) / F.nullif(width, F.lit(0)) >= HEADER_COVERAGE, "header")
        .otherwise("title")
    )
    return b.select(*by, band, "n_tokens", kind.alias("row_type"))


def recording_time(tokens: DataFrame, row: list[str]) -> DataFrame:
    """Date and time of each row of tokens (left, text): row, recorded.

    The last month/day/year of the row, and the last hour:minute, else the first
    lone colon between one or two digits and two; there an hour of 0 is no time.
    Null without a date: numbers with a point are never times.  Ties go by text.
    """
    w = Window.partitionBy(*row).orderBy("left", "text")
    date, time = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})", r"([0-9]{1,2}):([0-9]{2})"
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    lone = (F.col("text") == ":") & before.rlike("^[0-9]{1,2}$") & after.rlike("^[0-9]{2}$")

    def parts(c: str, pattern: str, n: int) -> list[Column]:
        return [F.regexp_extract(c, pattern, i + 1).cast("int") for i in range(n)]

    t = tokens.select(*row, F.struct("left", "text").alias("at"), "text", F.when(lone, F.concat(before, F.lit(":"), after)).alias("split"))
    g = t.groupBy(*row).agg(
        F.max(F.when(F.col("text").rlike(date), F.col("at")))["text"].alias("d"),
        F.max(F.when(F.col("text").rlike(time), F.col("at")))["text"].alias("t"),
        F.min(F.when(F.col("split").isNotNull(), F.struct("at", "split")))["split"].alias("s"),
    )
    m, d, y = parts("d", date, 3)
    day = F.format_string("%04d-%02d-%02d", F.when(y < 100, y + 2000).otherwise(y), m, d)
    clock = F.format_string(" %02d:%02d", *parts("t", time, 2))
    split = F.format_string(" %02d:%02d", *parts("s", time, 2))
    shown = F.when(F.col("t").isNotNull(), clock).when(F.col("s").isNotNull() & (parts("s", time, 2)[0] != 0), split).otherwise("")
    return g.select(*row, F.when(F.col("d").isNotNull(), F.concat(day, shown)).alias("recorded"))


def sibling_anchors(columns: DataFrame, by: list[str], schema: list[str], meta: list[str], chosen: Column, tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """Places of the chosen header's columns, with missing ones taken from its siblings.

    ``columns`` has the columns (header, column, x) of each header of a page.  A
    sibling shares meta columns with the chosen header, all of them within the
    tolerance.  A schema column that the chosen header lacks takes the x of the
    value column of the same ordinal in the first sibling that has one; without
    one it stays away.  Of a repeated column of a header the largest x counts.
    Returns by, column, x, filled.
    """
    heads = columns.groupBy(*by, "header", "column", chosen.alias("chosen")).agg(F.max("x").alias("x"))
    own = heads.where("chosen").select(*by, "column", "x")
    metas = own.where(F.col("column").isin(meta)).withColumnRenamed("x", "own_x")
    siblings = heads.where("NOT chosen").join(metas, [*by, "column"], "left")
    w = Window.partitionBy(*by, "header")
    # the distance is null for columns that are no common meta columns
    siblings = siblings.withColumn("off", F.max(F.abs(F.col("x") - F.col("own_x"))).over(w)).where(F.col("off") < tolerance)
    value = siblings.where(~F.col("column").isin(meta))
    value = value.withColumn("i", F.row_number().over(w.orderBy("x", "column")))
    offered = value.groupBy(*by, "i").agg(F.min_by("x", "header").alias("x"))
    named = [F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("column")) for i, c in enumerate(c for c in schema if c not in meta)]
    wanted = own.select(*by).distinct().select(*by, F.explode(F.array(*named)).alias("s")).select(*by, "s.i", "s.column")
    filled = wanted.join(own, [*by, "column"], "left_anti").join(offered, [*by, "i"])
    return own.withColumn("filled", F.lit(False)).unionByName(filled.select(*by, "column", "x", F.lit(True).alias("filled")))
