"""Queries over header rows and label zones of positioned words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers
from .catalogue import read, register

_WORDS = ["Ref.", "CYL", "4", "MCR", "%", "by", "TC", "rpm", "03", "mep", "TORSIOM.", "BRGS", "cyl 07", "noise", "|", "Sea", "water", "temp.", "AVG./"]


def _listed(texts, index):
    return F.get(F.array(*[F.lit(x) for x in texts]), index.cast("int"))


@register(
    "header_rows",
    f"""WITH RECURSIVE w AS (SELECT event_id // 8 AS row_id, event_id % 8 AS p, event_id % 8 * 60 + (20 + event_id % 3 * 10) / 2 AS cx,
  [{', '.join(f"'{x}'" for x in _WORDS)}][(event_id % 8 * (1 + event_id // 8 % 3) + event_id // 8 * 7) % 19 + 1] AS text FROM events),
g AS (SELECT *, coalesce(lead(text) OVER o, '') AS b, coalesce(lead(text, 2) OVER o, '') AS c, lead(cx) OVER o AS bx, lead(cx, 2) OVER o AS dx FROM w WINDOW o AS (PARTITION BY row_id ORDER BY p)),
k AS (SELECT *, CASE WHEN text IN ('CYL', 'TC') AND b IN ('4', '03') THEN text || b::INT WHEN text = 'MCR' AND b = '%' THEN 'MCR_%' END AS pair,
  CASE text WHEN 'Ref.' THEN 'REF' WHEN 'MCR' THEN 'MCR' WHEN 'rpm' THEN 'rpm' WHEN 'BRGS' THEN 'BRG5' WHEN 'cyl 07' THEN 'CYL7' WHEN 'temp.' THEN 'VALUE' WHEN 'TORSIOM.' THEN 'TORSIOM.' END AS one,
  CASE WHEN text = 'by' AND b = 'TC' AND c = 'rpm' THEN 'by TC rpm' WHEN text = 'Sea' AND b = 'water' AND c = 'temp.' THEN 'VALUE'
    WHEN text = 'by' AND b IN ('%', '|') AND c = 'mep' THEN 'by MEP' END AS three,
  CASE WHEN text = 'by' AND b = 'rpm' THEN 'by rpm' WHEN text = 'by' AND b = 'mep' THEN 'by MEP' END AS two FROM g),
m AS (SELECT row_id, p, coalesce(pair, one, three, two) AS col, CASE WHEN pair IS NOT NULL THEN 2 WHEN one IS NOT NULL THEN 1 WHEN three IS NOT NULL THEN 3 WHEN two IS NOT NULL THEN 2 ELSE 1 END AS n, cx, bx, dx FROM k),
walk(row_id, p) AS (SELECT DISTINCT row_id, min(p) OVER (PARTITION BY row_id) FROM w UNION ALL SELECT row_id, p + n FROM walk JOIN m USING (row_id, p)),
f AS (SELECT row_id, col, CASE n WHEN 1 THEN cx WHEN 2 THEN (cx + bx) / 2 ELSE (cx + bx + dx) / 3 END AS x, p FROM walk JOIN m USING (row_id, p) WHERE col IS NOT NULL)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY x, p)::INT AS ordinal, col AS "column", round(x, 6) AS x FROM f QUALIFY count(*) OVER (PARTITION BY row_id) >= 2""",
)
def header_rows(spark, d):
    e = F.col("event_id")
    row = F.expr("event_id div 8")
    t = read(spark, d, "events").select(
        row.alias("row_id"),
        (e % 8 * 60).alias("left"),
        (20 + e % 3 * 10).alias("width"),
        _listed(_WORDS, (e % 8 * (1 + row % 3) + row * 7) % 19).alias("text"),
    )
    return headers.header_rows(t, ["row_id"]).withColumn("x", F.round("x", 6))


_LABELS = ["Firing", "pressure", "(mean)", "bar", "ALL", "kW", "max:", "%", " ", "pmax", "set)"]


@register(
    "label_zones",
    f"""WITH t AS (SELECT event_id // 6 AS row_id, event_id % 6 * 50 + event_id * 11 % 17 AS "left", [{', '.join(f"'{x}'" for x in _LABELS)}][(event_id * 3 + event_id // 6) % 11 + 1] AS text FROM events WHERE event_id % 6 < 1 + event_id // 6 % 6),
p AS (SELECT row_id, "left", trim(text) AS text, CASE WHEN text IN ('(mean)', 'ALL', 'max:', 'set)') THEN 'q' WHEN "left" BETWEEN 150 AND 158 THEN 'u'
  WHEN text IN ('bar', 'kW', '%') AND "left" = max("left") OVER (PARTITION BY row_id) AND count(*) OVER (PARTITION BY row_id) > 1 THEN 'u' ELSE 'l' END AS part FROM t)
SELECT row_id, coalesce(string_agg(text, ' ' ORDER BY "left") FILTER (part = 'l' AND text <> ''), '') AS label, coalesce(string_agg(text, ' ' ORDER BY "left") FILTER (part = 'u' AND text <> ''), '') AS unit,
coalesce(string_agg(text, ' ' ORDER BY "left") FILTER (part = 'q'), '') AS qualifiers FROM p GROUP BY 1""",
)
def label_zones(spark, d):
    e = F.col("event_id")
    row = F.expr("event_id div 6")
    t = read(spark, d, "events").where(e % 6 < 1 + row % 6)
    t = t.select(row.alias("row_id"), (e % 6 * 50 + e * 11 % 17).alias("left"), _listed(_LABELS, (e * 3 + row) % 11).alias("text"))
    return headers.label_zones(t, ["row_id"], F.col("left").between(150, 158), F.col("text").isin("bar", "kW", "%"))


QUERIES_HERE = ["header_rows", "label_zones"]
