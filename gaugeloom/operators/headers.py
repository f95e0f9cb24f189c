"""Header rows of positioned words, and the parts of a row's label zone.

Folds are over the words of one row, so their size is that of a row.  Words with
a null text count as empty; ties of the left edge go by text; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

# fixed values: families of numbered columns, misread names, names of columns
FAMILIES = ["CYL", "TC", "BRG", "PUMP"]
MISREAD = {"CCYL1": "CYL1", "CCYL": "CYL", "T1": "TC1", "BRGS": "BRG5", "BRGY": "BRG9"}
NAMES = {
    "REF": "REF", "CALC": "CALC", "AVG": "AVG", "AVG/ENG": "AVG/ENG", "MEAS": "MEAS", "MOP": "MOP", "ALL": "ALL", "EXPECT": "EXPECT",
    "ENGINE": "ENGINE", "MCR": "MCR", "VALUE": "VALUE", "SOG": "SOG", "STW": "STW", "FWD": "FWD", "AFT": "AFT", "MID": "MID", "TRIM": "TRIM",
    "TEMP": "VALUE", "DEG": "VALUE", "CEL": "VALUE", "RPM": "rpm", "KNOT": "kn", "METRE": "m", "BAR": "bar", "BARG": "barG", "BARA": "barA",
}
# fixed values: names that OCR reads as one to three words, without spaces and marks
PHRASES = {
    "XPERT": "XPERT", "TORSIOM": "TORSIOM.", "MOP": "MOP", "BYFIRPM": "by FI*rpm", "BYFLRPM": "by FI*rpm", "BYPSCAV": "by pscav",
    "BYTCRPM": "by TC rpm", "BYMEP": "by MEP", "BYRPM": "by rpm", "SEAWATERTEMP": "VALUE", "AMBIENTAIRTEMP": "VALUE", "SHO": "SOG",
    "STW": "STW", "FWD": "FWD", "AFT": "AFT", "MID": "MID", "TRIM": "TRIM",
}
#: Fixed value: words of a label zone that name a set.
SETS = ["ALL", "SUM"]


def _looked_up(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), key)


def _number(c: Column) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def header_name(c: Column) -> Column:
    """The column that a single word names; null if none."""
    compact = F.rtrim(F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9/.]", ""), F.lit("."))
    compact = F.coalesce(_looked_up(MISREAD, compact), compact)
    numbered = f"^({'|'.join(FAMILIES)})([0-9]+)$"
    family = F.regexp_extract(compact, numbered, 1)
    return F.when(family != "", F.concat(family, _number(F.regexp_extract(compact, numbered, 2)))).otherwise(_looked_up(NAMES, compact))


def header_rows(tokens: DataFrame, row: list[str], phrases: dict[str, str] = PHRASES, least: int = 2) -> DataFrame:
    """Words (left, width, text) -> the columns of rows that name at least ``least``: row, ordinal, column, x.

    A row is read from the left; words that make a column are used up.  A family
    and the number after it are one column, and so are MCR and %.  Else a word is
    a name of its own, or begins a phrase of up to three words, the longest first.
    Words without letters and digits, empty ones too, may stand in a phrase.
    x is the mean of the words' centres; ordinals from 1 go by x.
    """
    text = F.coalesce("text", F.lit(""))
    raw = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    bare = F.trim(text)
    word = F.struct(
        "left",
        text.alias("text"),
        (F.col("left") + F.col("width") / 2).alias("cx"),
        raw.alias("raw"),
        header_name(text).alias("name"),
        F.when(bare.rlike("^[0-9]+$"), _number(bare)).alias("number"),
        (F.regexp_replace(F.upper(text), "[^A-Z0-9%]", "") == "%").alias("percent"),
    )
    words = tokens.groupBy(*row).agg(F.sort_array(F.collect_list(word)).alias("w"))

    def begins(a: Column, i: Column) -> Column:
        b, c = F.get("w", i + 1), F.get("w", i + 2)

        def found(column: Column, *parts: Column) -> Column:
            x = sum((p["cx"] for p in parts[1:]), parts[0]["cx"]) / len(parts)
            s = F.struct(i.alias("i"), F.lit(len(parts)).alias("n"), column.alias("column"), x.alias("x"))
            return F.when(column.isNotNull(), s)

        return F.coalesce(
            found(F.when(a["raw"].isin(FAMILIES), F.concat(a["raw"], b["number"])), a, b),
            found(F.when((a["raw"] == "MCR") & b["percent"], F.lit("MCR_%")), a, b),
            found(a["name"], a),
            found(_looked_up(phrases, F.concat(a["raw"], b["raw"], c["raw"])), a, b, c),
            found(_looked_up(phrases, F.concat(a["raw"], b["raw"])), a, b),
            found(_looked_up(phrases, a["raw"]), a),
        )

    named = words.select(*row, F.filter(F.transform("w", begins), lambda m: m.isNotNull()).alias("m"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<x:double,i:int,column:string>>").alias("used"))

    def take(acc: Column, m: Column) -> Column:
        one = F.struct(m["x"].alias("x"), m["i"].alias("i"), m["column"].alias("column"))
        fits = m["i"] >= acc["free"]
        return F.struct(
            F.when(fits, m["i"] + m["n"]).otherwise(acc["free"]).alias("free"),
            F.when(fits, F.concat(acc["used"], F.array(one))).otherwise(acc["used"]).alias("used"),
        )

    used = named.select(*row, F.sort_array(F.aggregate("m", start, take, lambda acc: acc["used"])).alias("u")).where(F.size("u") >= least)
    return used.select(*row, F.posexplode("u").alias("ordinal", "c")).select(*row, (F.col("ordinal") + 1).alias("ordinal"), "c.column", "c.x")


def label_zones(tokens: DataFrame, row: list[str], aligned: Column, unit_shape: Column) -> DataFrame:
    """Words (left, text) left of a row's values -> row, label, unit, qualifiers (texts in order).

    Words in brackets, before a colon or naming a set are qualifiers.  A word is
    a unit if it is ``aligned`` with a column of units, or if it has a unit's shape
    and is the last of several words; all others are the label.  Blank words
    belong to nothing.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    apart = text.startswith("(") | text.endswith(")") | text.endswith(":") | text.isin(SETS)
    flags = [F.coalesce(c, F.lit(False)).alias(n) for n, c in (("apart", apart), ("aligned", aligned), ("shape", unit_shape))]
    words = tokens.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("left", text.alias("text"), *flags))).alias("w"))

    def part(x: Column, i: Column) -> Column:
        trailing = x["shape"] & (i > 0) & (i == F.size("w") - 1)
        return F.struct(x["text"].alias("text"), F.when(x["apart"], "qualifiers").when(x["aligned"] | trailing, "unit").otherwise("label").alias("part"))

    parts = words.select(*row, F.filter(F.transform("w", part), lambda x: x["text"] != "").alias("p"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.filter("p", lambda x: x["part"] == name), lambda x: x["text"]), " ").alias(name)

    return parts.select(*row, joined("label"), joined("unit"), joined("qualifiers"))
