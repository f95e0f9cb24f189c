"""Labels of rows matched with the names and aliases of a field registry.

Rows and aliases meet in an equi-join on the words they share, never in a cross
join: a score above nothing needs at least one common (or compound) word.  Null
and empty labels match nothing; ties are settled as each function says.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that tell two otherwise equal labels apart.
DISTINGUISHING = ["aft", "exh", "fp", "fwd"]
#: Fixed values of the scores: coverage and purity, the cost of a short label, a unit that agrees, the least score, a tie.
COVERAGE, PURITY, SHORT, UNIT, LEAST, TIE = 0.75, 0.25, 0.2, 0.01, 0.5, 0.001
#: Aliases that ``match_text`` sends to the tasks, at most.
MOST_ALIASES = 20_000


def alias_index(fields: DataFrame, key: str, names: Column) -> DataFrame:
    """(key, alias): the normalised, non-empty names of each field; repeated names count once."""
    alias = F.explode(F.array_distinct(F.transform(names, lambda x: T.norm_for_match(x)))).alias("alias")
    return fields.select(key, alias).where("alias <> ''")


def label_score(label: Column, alias: Column) -> Column:
    """0..1: how far the alias' words are found in order in the label.

    A word of the label may be several words of the alias run together.  Equal
    labels score 1; an alias longer than the label costs.
    """
    got, words = T.label_tokens(label), T.label_tokens(alias)

    def step(acc: Column, tok: Column) -> Column:
        ends = F.when(acc < F.size(words), F.sequence(acc + 1, F.size(words))).otherwise(F.array().cast("array<int>"))
        fit = F.filter(ends, lambda j: F.array_join(F.slice(words, acc + 1, j - acc), "") == tok)
        return F.coalesce(F.get(fit, F.lit(0)), acc)

    hits = F.aggregate(got, F.lit(0), step)
    n_got, n_words = F.size(got), F.size(words)
    short = F.when(n_words > n_got, SHORT * (n_words - n_got) / n_words).otherwise(0.0)
    score = COVERAGE * hits / n_words + PURITY * hits / n_got - short
    return F.when(T.collapse(F.lower(label)) == T.collapse(F.lower(alias)), 1.0).when((n_got == 0) | (n_words == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def match_fields(rows: DataFrame, row: str, index: DataFrame, field: str) -> DataFrame:
    """Rows (row, label, unit) and an index (field, alias, unit) -> (row, field, score, status).

    The best alias decides; a unit that agrees adds a little.  Under LEAST there
    is no match, and a second field within TIE makes it ambiguous; both have no
    field.  Several rows of one key are recompositions of one label.
    """
    words = F.array_distinct(T.label_tokens(F.col("label")))
    heard = rows.select(row, "label", F.col("unit").alias("__unit"), F.explode(words).alias("__word"))
    own = T.label_tokens(F.col("alias"))
    n = F.size(own)
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(own, i, j - i + 1), "")))
    )
    said = index.where(n > 0).select(field, "alias", F.col("unit").alias("__of"), F.explode(F.array_distinct(runs)).alias("__word"))
    pairs = heard.join(said, "__word").select(row, field, "label", "alias", "__unit", "__of").distinct()
    agrees = F.when((F.coalesce("__of", F.lit("")) != "") & (F.lower(F.trim("__of")) == F.lower(F.trim("__unit"))), UNIT).otherwise(0.0)
    scores = pairs.groupBy(row, field).agg(F.max(label_score(F.col("label"), F.col("alias"))).alias("s"), F.max(agrees).alias("u"))
    scores = scores.select(row, field, (F.col("s") + F.col("u")).alias("score"))
    w = Window.partitionBy(row).orderBy(F.col("score").desc(), field)
    top = scores.withColumn("__next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    status = F.when(F.col("score") < LEAST, "NO_MATCH").when(F.col("__next") >= F.col("score") - TIE, "OCR_AMBIGUOUS").otherwise("MATCHED")
    found = rows.select(row).distinct().join(top.withColumn("status", status), row, "left")
    return found.select(
        row, F.when(F.col("status") == "MATCHED", F.col(field)).alias(field), F.when(F.col("score") >= LEAST, F.round("score", 6)).alias("score"), F.coalesce("status", F.lit("NO_MATCH")).alias("status")
    )


def find_rows(fields: DataFrame, field: str, rows: DataFrame, by: list[str], order: str, qualified: bool = False) -> DataFrame:
    """Fields (field, name) and rows (by, order, text) -> the first best row of each field: (by, field, order, score).

    All words of the name stand in the row in order.  Distinguishing words must
    be in both, or not next to the name's words; gaps and further words cost,
    a contiguous name scores 1.  With ``qualified`` the numbers of a name must
    stand in the row, and a name without numbers is no row's that goes on with one.
    """
    name, said = T.label_tokens(F.col("name")), T.label_tokens(F.col("text"))
    special = F.array(*[F.lit(x) for x in DISTINGUISHING])
    f = fields.select(field, name.alias("__t")).where(F.size("__t") > 0).withColumn("__word", F.get("__t", F.lit(0)))
    r = rows.select(*by, order, said.alias("__c")).select(*by, order, "__c", F.explode(F.array_distinct("__c")).alias("__word"))
    j = f.join(r, "__word").drop("__word")
    start = F.struct(F.lit(0).alias("next"), F.lit(-1).alias("first"), F.lit(True).alias("ok"))

    def step(acc: Column, tok: Column) -> Column:
        place = F.array_position(F.slice(F.col("__c"), acc["next"] + 1, F.size("__c")), tok).cast("int")
        at = acc["next"] + place - 1
        return F.struct(
            F.when(place > 0, at + 1).otherwise(acc["next"]).alias("next"),
            F.when((acc["first"] < 0) & (place > 0), at).otherwise(acc["first"]).alias("first"),
            (acc["ok"] & (place > 0)).alias("ok"),
        )

    j = j.withColumn("__m", F.aggregate("__t", start, step)).where("__m.ok")
    first, last = F.col("__m.first"), F.col("__m.next") - 1
    own, there = F.array_intersect("__t", special), F.array_intersect("__c", special)
    near = F.exists(
        F.sequence(F.lit(0), F.size("__c") - 1),
        lambda i: F.array_contains(special, F.get("__c", i)) & ((F.abs(i - last) <= 1) | (F.abs(i - first) <= 1)),
    )
    ok = F.when(F.size(own) > 0, F.size(F.array_except(own, there)) == 0).otherwise(~near)
    if qualified:
        number = lambda x: x.rlike("^[0-9]+$")
        numbers = F.filter("__t", number)
        goes_on = F.coalesce(F.get("__c", last + 1).rlike("^[0-9]{1,4}$"), F.lit(False))
        ok = ok & F.when(F.size(numbers) > 0, F.size(F.array_except(numbers, F.filter("__c", number))) == 0).otherwise(~goes_on)
    span, n = last - first + 1, F.size("__t")
    cost = F.least(F.lit(0.2), (span - n) * 0.03) + F.least(F.lit(0.15), F.greatest(F.lit(0), F.size("__c") - n) * 0.02)
    j = j.where(ok).withColumn("score", F.round(F.when(span == n, 1.0).otherwise(1 - cost), 6)).where("score >= 0.6")
    w = Window.partitionBy(*by, field).orderBy(F.col("score").desc(), order)
    return j.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*by, field, order, "score")


def match_text(rows: DataFrame, text: str, index: DataFrame, field: str, least: float = 0.88) -> DataFrame:
    """Adds the field and score (0 without) whose alias the text equals, holds or resembles.

    The index must have at most MOST_ALIASES rows, as it goes to every task.  An
    alias inside the text scores by its share of the length, others by their
    Ratcliff-Obershelp ratio from ``least`` on; the first best in order of field
    and alias wins.
    """
    known = index.select(field, "alias").orderBy(field, "alias").limit(MOST_ALIASES + 1).collect()
    if len(known) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    known = [(r[0], r[1]) for r in known]

    def score(r: str, alias: str) -> float:
        if r == alias:
            return 1.0
        if alias in r:
            return min(0.995, 0.80 + 0.19 * len(alias) / max(1, len(r)))
        m = SequenceMatcher(None, r, alias)
        ratio = m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0
        return ratio if ratio >= least else 0.0

    def best(r: str) -> tuple[object, float]:
        found, top = None, 0.0
        for name, alias in known:
            s = score(r, alias)
            if s > top:
                found, top = name, s
        return found, round(top, 6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = {t: best(t) for t in pdf["__norm"].fillna("").unique()}
            got = [seen[t or ""] for t in pdf["__norm"].fillna("")]
            yield pdf.drop(columns="__norm").assign(**{field: pd.Series([g[0] for g in got], dtype=object), "score": [g[1] for g in got]})

    normal = rows.withColumn("__norm", T.norm_for_match(F.col(text)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return normal.mapInPandas(run, f"{schema}, `{field}` {index.schema[field].dataType.simpleString()}, score double")
