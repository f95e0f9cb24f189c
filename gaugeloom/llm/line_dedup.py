"""Cross-site boilerplate lines by distinct-site spread.

A HyperLogLog sketch of sites per line merges by aggregation; lines whose
estimate lies near the threshold get exact distinct counts.  A line is
boilerplate if it stands on at least ``min_sites`` sites.  Exact copies of a whole
text count as one document on one site, the first in order, so that copies of a
document do not make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, stored

MIN_SITES, MARGIN = 5, 0.2
#: Unicode's space separators (Zs), as the SQL's trim takes them.
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (xxhash64 of the trimmed line) of the lines to remove: (line).

    A null site is a site of its own.  Empty lines are never boilerplate.
    """
    text = F.col(text_col).cast("string")
    d = docs.where(text.isNotNull()).select(
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.array_distinct(F.transform(F.filter(F.transform(_lines(text), lambda x: _trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("lines"),
    )
    folded = stored(d.groupBy("t1", "t2").agg(F.min("site").alias("site"), F.first("lines").alias("lines")).select("site", "lines"), "line-sites")
    held = folded.select("site", F.explode("lines").alias("line"))
    spread = cut(
        held.groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("about"), F.count("*").alias("n"))
        .where((F.col("about") >= min_sites * (1 - MARGIN)) & (F.col("n") >= min_sites))
        .select("line", (F.col("about") <= min_sites * (1 + MARGIN)).alias("close"))
    )
    near = bounded(spread.where("close").select("line"))
    exact = held.join(near, "line").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where("NOT close").select("line").unionByName(exact.select("line"))


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """All rows and columns, the text without its boilerplate lines.

    Adds n_lines and n_removed (long; columns of these names are replaced).  A
    null text stays null with 0 lines; the empty text has one empty line.  The
    other lines keep their order and repetitions.  Rows that repeat an id, or
    have none, are each treated as a document.
    """
    lines = boilerplate(docs, text_col, site_col, min_sites)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    keyed = base.select(
        F.col(id_col).alias("__id"),
        F.explode(F.array_distinct(F.transform(_lines(F.col(text_col).cast("string")), lambda x: F.xxhash64(_trim(x))))).alias("line"),
    )
    hit = keyed.join(bounded(cut(lines)), "line").groupBy("__id").agg(F.collect_set("line").alias("__removed"))
    joined = base.join(hit, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    cleaned = F.filter(
        _lines(F.col(text_col).cast("string")), lambda x: ~F.array_contains(F.col("__removed"), F.xxhash64(_trim(x)))
    )
    out = joined.withColumn("__kept", F.when(F.col("__removed").isNull(), _lines(F.col(text_col).cast("string"))).otherwise(cleaned))
    return out.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size(_lines(F.col(text_col).cast("string"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(_lines(F.col(text_col).cast("string"))) - F.size("__kept"), F.lit(0)).cast("long").alias("n_removed"),
    ).withColumns({c: F.greatest(F.col(c), F.lit(0).cast("long")) for c in ("n_lines", "n_removed")})


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS parts FROM documents),
f AS (SELECT min(site) AS site, parts FROM d WHERE text IS NOT NULL GROUP BY text, parts),
h AS (SELECT site, unnest(list_distinct([trim(x) for x in parts if trim(x) <> ''])) AS line FROM f),
b AS (SELECT line FROM h GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
a AS (SELECT coalesce(list(line), []) AS gone FROM b),
k AS (SELECT doc_id, text, parts, [x for x in parts if NOT list_contains(gone, trim(x))] AS kept FROM d, a)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(kept), 0)::BIGINT AS n_removed FROM k
"""
