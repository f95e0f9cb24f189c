"""Text normalisation: Column -> Column, evaluated in the JVM.  Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs that an OCR engine leaves at the edges of a word.
TRAILING = r"[;,|)\]}@®~^\-=><`]+$"
LEADING = r"^[~^=><`]+"
ARTIFACTS = "|®©@\\{}[]`"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def clean(c: Column) -> Column:
    """Bars become spaces, white space collapses (compatibility forms: ``nfkc``)."""
    return collapse(F.replace(c, F.lit("|"), F.lit(" ")))


def norm_for_match(c: Column) -> Column:
    c = F.translate(F.lower(clean(c)), "°*", "")
    return collapse(F.regexp_replace(c, r"[^a-z0-9%./@ \-]", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def field_key(c: Column) -> Column:
    """Lower case without degree marks, punctuation and numbers that stand alone."""
    c = F.regexp_replace(F.lower(c), r"[.:,]", " ")
    c = F.regexp_replace(c, r"(^| )[0-9]+(?= |$)", "$1")
    return collapse(F.regexp_replace(c, r"[^a-z0-9@\- ]", " "))


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), TRAILING, ""), LEADING, "")


def drop_artifacts(c: Column) -> Column:
    return F.regexp_replace(collapse(F.translate(c, ARTIFACTS, "")), r" +([,.:;])", "$1")


def label_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[.\-_/ ]+", " "), " "), lambda x: x != "")


def canonical_column(c: Column) -> Column:
    """VALUE for nothing; families CYL, TC, BRG and PUMP get plain integers."""
    up = F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9/.]", ""), r"\.+$", "")
    number = F.regexp_extract(up, r"^(CYL|TC|BRG|PUMP)0*([0-9]+)$", 2)
    family = F.regexp_extract(up, r"^(CYL|TC|BRG|PUMP)0*([0-9]+)$", 1)
    return F.when(up.isNull() | (up == ""), "VALUE").when(up == "/ENG", "ENGINE").when(number != "", F.concat(family, number)).otherwise(up)


def numeric_qualifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def excess_tokens(alias: Column, label: Column) -> Column:
    """Label tokens that an ordered reading of the alias' tokens does not use."""
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("rest"))
    words = label_tokens(alias)

    def step(acc: Column, tok: Column) -> Column:
        used = (acc["i"] < F.size(words)) & (F.get(words, acc["i"]) == tok)
        return F.struct(
            F.when(used, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
            F.when(used, acc["rest"]).otherwise(F.concat(acc["rest"], F.array(tok))).alias("rest"),
        )

    return F.array_join(F.aggregate(label_tokens(label), start, step, lambda acc: acc["rest"]), " ")


def ordered_recall(alias: Column, label: Column) -> Column:
    """0..1: .75 coverage of the alias + .25 purity of the label; 1 if equal."""
    words, got = label_tokens(alias), label_tokens(label)

    def step(acc: Column, tok: Column) -> Column:
        return F.when((acc < F.size(words)) & (F.get(words, acc) == tok), acc + 1).otherwise(acc)

    hits = F.aggregate(got, F.lit(0), step)
    score = 0.75 * hits / F.greatest(F.size(words), F.lit(1)) + 0.25 * hits / F.greatest(F.size(got), F.lit(1))
    return F.when(words == got, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
