"""Mixing sources to target weights by iterative proportional fitting.

Token totals by (source, language, topic) are raked until they meet the target
share of every source, language and topic; a document's probability is its
cell's calibrated weight over its tokens, times a factor by which the expected
sampled tokens meet a budget, and 1 at most.  DataFrame functions only.  The raked table has a row for each cell, not for each
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: A share is its tokens to this power, normalised: 1 keeps it, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Rounds at most, and the relative miss of a margin that ends them.
ROUNDS, TOLERANCE = 200, 1e-6
#: Share of all tokens that the sample is expected to hold.
BUDGET = 2 / 3
#: Cells up to this number are broadcast (some 100 bytes each); more are joined.
BROADCAST_CELLS = 20_000


def n_tokens(text: Column) -> Column:
    """Words separated by white space; 0 for null."""
    words = F.trim(F.regexp_replace(text, "[\\x09-\\x0D\\x20]+", " "))
    return F.when(F.coalesce(words, F.lit("")) == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of text: table, data, or prose by length."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike("[0-9]{3}"), "data")
        .when(F.length(text) < 600, "short prose")
        .when(F.length(text) < 3000, "prose")
        .otherwise("long prose")
    )


def _residual(cells: DataFrame, dims: dict[str, float]) -> float:
    """The largest relative miss of a margin's target."""
    worst = 0.0
    for d in dims:
        margin = cells.groupBy(d).agg(F.sum("weight").alias("w"), (F.first(f"__t_{d}") * F.first("__grand")).alias("aim")).where("aim > 0")
        worst = max(worst, margin.agg(F.max(F.abs(F.col("w") / F.col("aim") - 1))).first()[0] or 0.0)
    return worst


def rake(
    cells: DataFrame, dims: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, at_once: int = BROADCAST_CELLS
) -> tuple[DataFrame, float]:
    """(dims..., tokens) -> with weight, raked to the target shares of each dim; and the residual.

    The total weight is the total of tokens.  A margin without tokens stays 0.
    Null is a value like others.  Rounds go on until every margin is met within
    ``tolerance`` of its target, at most ``rounds`` of them: where the margins
    cannot all be met (structural zeros), the weights after the last round stand,
    the last dim met exactly, and the residual says how far the others miss.  Up
    to ``at_once`` cells are raked in one partition without any shuffle, more by
    aggregates that are joined back.
    """
    base = cells = cut(cells)  # else the texts are read again for every margin
    few = base.limit(at_once + 1).count() <= at_once
    for d, power in dims.items():
        margin = base.groupBy(F.col(d).alias("__d")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("__r"))
        total = margin.agg(F.sum("__r")).scalar()
        cells = (
            cells.join(margin, F.col(d).eqNullSafe(F.col("__d"))).withColumn(f"__t_{d}", F.col("__r") / total).drop("__d", "__r")
        )
    grand = base.agg(F.sum("tokens").cast("double"))
    cells = cells.withColumns({"__grand": grand.scalar(), "weight": F.col("tokens").cast("double")})
    cells = cut(cells.coalesce(1) if few else cells)
    residual = float("inf")
    for i in range(rounds):
        for d in dims:
            if few:
                cells = cells.withColumn("__now", F.sum("weight").over(Window.partitionBy(d)))
            else:
                margin = cells.groupBy(F.col(d).alias("__d")).agg(F.sum("weight").alias("__now"))
                cells = cells.join(margin, F.col(d).eqNullSafe(F.col("__d"))).drop("__d")
            met = F.col("weight") * F.col(f"__t_{d}") * F.col("__grand") / F.col("__now")
            cells = cells.withColumn("weight", F.when(F.col("__now") > 0, met).otherwise(F.lit(0.0))).drop("__now")
            if not few:
                cells = stored(cells, "raked")
        if i % 4 == 3 or i == rounds - 1:
            cells = cut(cells).coalesce(1) if few else cells
            residual = _residual(cells, dims)
            if residual <= tolerance:
                break
    return cells.drop("__grand", *[f"__t_{d}" for d in dims]), residual


def scale(raked: DataFrame, budget: float) -> float:
    """The factor f with sum(tokens * min(1, f * ratio)) = ``budget`` * sum(tokens); infinite if all must stay.

    Cells that reach 1 leave their share of the budget to the others, until no
    more cells reach it; each round is one row.
    """
    held = raked.where("ratio > 0")
    wanted = budget * (held.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
    factor, full = 0.0, -1
    while True:
        whole = F.col("ratio") * factor >= 1
        n, tokens, rest = held.agg(
            F.count_if(whole), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == full:
            return factor
        if not rest:
            return float("inf")
        factor, full = max(factor, (wanted - tokens) / rest), n


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: dict[str, tuple[Column, float]] | None = None,
    seed: int = 8,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    carry_text: bool = True,
) -> DataFrame:
    """All rows and columns, with n_tokens, weight, probability and sampled.

    Without ``carry_text`` the text is left out, and read only once.

    ``dims`` maps a name to (column, power); by default source, lang and topic.
    ``weight`` is the calibrated number of tokens that the document stands for.
    Sampled documents are expected to hold the share ``budget`` of all tokens,
    however small the rarest cell is.  A document is sampled if a hash of its id falls under its probability, so
    rows that repeat an id share their fate.  Null sources, languages and topics
    are values of their own.  Documents without tokens have weight 0 and the
    probability of their cell (1 if the whole cell has no tokens).  Columns of
    the added names are replaced; an empty table stays empty.
    """
    text = F.col(text_col).cast("string")
    if dims is None:
        dims = {"source": (F.col("source"), POWERS["source"]), "lang": (F.col("lang"), POWERS["lang"]), "topic": (topic(text), POWERS["topic"])}
    added = ("n_tokens", "weight", "probability", "sampled")
    names = [c for c in docs.columns if c not in added]
    keys = {d: f"__{d}" for d in dims}
    d = docs.select(
        *[F.col(f"`{c}`") for c in names], n_tokens(text).alias("n_tokens"), *[c.cast("string").alias(keys[k]) for k, (c, _) in dims.items()]
    )
    if not carry_text:
        names = [c for c in names if c != text_col]
        d = stored(d.drop(text_col), "mixing-measured")
    cells = d.groupBy(*keys.values()).agg(F.sum("n_tokens").alias("tokens"))
    raked, _ = rake(cells, {keys[k]: p for k, (_, p) in dims.items()}, rounds)
    raked = cut(raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))))
    factor = scale(raked, budget)
    rates = cut(
        raked.select(
            *[F.col(k).alias(f"{k}_c") for k in keys.values()],
            F.coalesce("ratio", F.lit(0.0)).alias("__ratio"),
            F.coalesce(F.least(F.lit(1.0), F.col("ratio") * factor), F.lit(1.0)).alias("probability"),
        )
    )
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    on = None
    for k in keys.values():
        same = F.col(k).eqNullSafe(F.col(f"{k}_c"))
        on = same if on is None else on & same
    share = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return d.join(rates, on, "left").select(
        *[F.col(f"`{c}`") for c in names],
        "n_tokens",
        (F.col("n_tokens") * F.col("__ratio")).alias("weight"),
        "probability",
        (share < F.col("probability")).alias("sampled"),
    )
