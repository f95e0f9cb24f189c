"""Queries over bands, recording times and header anchors of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from .catalogue import read, register

_BAND_TOKENS = """SELECT event_id // 40 AS page, event_id % 40 // 5 AS band, CASE WHEN event_id % 40 // 5 % 4 = 1 THEN event_id % 5 * 20 + 10 ELSE event_id % 5 * 100 + event_id * 3 % 11 END AS "left",
CASE WHEN event_id % 40 // 5 % 4 = 1 THEN 15 WHEN event_id % 3 = 0 THEN 95 ELSE 40 END AS width, event_id % 40 // 5 * 20 + event_id % 4 * 3 AS top, 16 AS height,
['12.5', 'CYL', '4', 'Engine power', '|~', '85C', 'TC', 'x', 'REF', 'CALC', 'MEAN', 'AVG', 'SER'][CASE WHEN event_id % 40 // 5 % 3 = 0 AND event_id * 7 % 13 IN (0, 2, 5) THEN 2 ELSE event_id * 7 % 13 + 1 END] AS text
FROM events WHERE event_id % 40 // 5 < 7 OR event_id % 5 = 0"""
_BAND_TEXTS = ["12.5", "CYL", "4", "Engine power", "|~", "85C", "TC", "x", "REF", "CALC", "MEAN", "AVG", "SER"]


@register(
    "band_classes",
    f"""WITH t AS ({_BAND_TOKENS}),
c AS (SELECT *, "left" + width AS "right", text IN ('12.5', '4', '85C') AS num, text IN ('12.5', '4') AS pure, text NOT IN ('12.5', '4', '|~') AS letters, text IN ('CYL', 'TC', 'x', 'REF', 'CALC', 'MEAN', 'AVG', 'SER') AS word,
  greatest(median(width) OVER (PARTITION BY page, band) * 0.6, 6) AS near FROM t),
l AS (SELECT *, coalesce("left" - lag("right") OVER w <= near AND abs(top - lag(top) OVER w) <= 5.6, false) AS touching, lag(word) OVER w AS after_word, lag(letters) OVER w AS after_letters FROM c WINDOW w AS (PARTITION BY page, band ORDER BY "left", text)),
f AS (SELECT *, NOT (touching AND after_letters AND (pure OR letters)) AS first, num AND NOT (touching AND after_word) AS value FROM l),
r AS (SELECT *, first AND coalesce(lead(first) OVER (PARTITION BY page, band ORDER BY "left", text), true) AND num AS isolated FROM f),
b AS (SELECT page, band, count(*) AS n_tokens, min("left") AS lo, max("right") AS hi, max(CASE WHEN value THEN ("left" + "right") / 2 END) AS x, 1 - count(*) FILTER (isolated) / count(*) FILTER (first) AS labels,
  bool_or(num OR text IN ('CYL', 'Engine power', 'REF', 'CALC', 'MEAN', 'AVG', 'SER')) AS real FROM r GROUP BY 1, 2),
p AS (SELECT *, min(lo) OVER (PARTITION BY page) AS p_lo, max(hi) OVER (PARTITION BY page) - min(lo) OVER (PARTITION BY page) AS wide FROM b)
SELECT page, band, n_tokens, CASE WHEN n_tokens < 2 THEN CASE WHEN real THEN 'data' ELSE 'separator' END WHEN x >= p_lo + wide * 0.3 THEN 'data' WHEN labels < 0.8 THEN 'data' WHEN (hi - lo) / wide >= 0.3 THEN 'header' ELSE 'title' END AS row_type FROM p""",
)
def band_classes(spark, d):
    e = F.col("event_id")
    k, at = e * 7 % 13, F.expr("event_id % 40 div 5")
    narrow = at % 4 == 1
    named = F.when((at % 3 == 0) & k.isin(0, 2, 5), "CYL")
    for i, x in enumerate(_BAND_TEXTS):
        named = named.when(k == i, x)
    t = read(spark, d, "events").where((at < 7) | (e % 5 == 0))
    t = t.select(
        F.expr("event_id div 40").alias("page"),
        at.alias("band"),
        F.when(narrow, e % 5 * 20 + 10).otherwise(e % 5 * 100 + e * 3 % 11).alias("left"),
        F.when(narrow, 15).when(e % 3 == 0, 95).otherwise(40).alias("width"),
        (at * 20 + e % 4 * 3).alias("top"),
        F.lit(16).alias("height"),
        named.alias("text"),
    )
    return pages.band_classes(t, ["page"])


_TIMES = ["4/15/2025", "at 7:05x", "0", ":", "12-3-24", "20", "19.00", "09", None, ":", "34"]


@register(
    "recording_time",
    f"""WITH t AS (SELECT event_id // 5 AS row_id, event_id % 5 AS "left", [{', '.join('event_type' if x is None else f"'{x}'" for x in _TIMES)}][event_id * 7 % 11 + 1] AS text FROM events),
n AS (SELECT *, lag(text) OVER w AS a, lead(text) OVER w AS b FROM t WINDOW w AS (PARTITION BY row_id ORDER BY "left", text)),
g AS (SELECT row_id, max(CASE text WHEN '4/15/2025' THEN "left" || '2025-04-15' WHEN '12-3-24' THEN "left" || '2024-12-03' END) AS d, bool_or(text = 'at 7:05x') AS early,
min(CASE WHEN text = ':' AND regexp_full_match(a, '[0-9]{{1,2}}') AND regexp_full_match(b, '[0-9]{{2}}') THEN "left" || lpad(a, 2, '0') || ':' || b END) AS s FROM n GROUP BY 1)
SELECT row_id, substr(d, 2) || CASE WHEN early THEN ' 07:05' WHEN s IS NOT NULL AND substr(s, 2, 2) <> '00' THEN ' ' || substr(s, 2) ELSE '' END AS recorded FROM g""",
)
def recording_time(spark, d):
    k, text = F.col("event_id") * 7 % 11, F.when(F.lit(False), "")
    for i, x in enumerate(_TIMES):
        text = text.when(k == i, F.col("event_type") if x is None else F.lit(x))
    t = read(spark, d, "events").select(F.expr("event_id div 5").alias("row_id"), (F.col("event_id") % 5).alias("left"), text.alias("text"))
    return pages.recording_time(t, ["row_id"])


_META = ["REF", "CALC"]
_SLOTS = [f"TC{i}" for i in range(1, 7)]


@register(
    "sibling_anchors",
    """WITH h AS (SELECT event_id // 24 AS page, event_id % 24 // 8 AS header, event_id % 8 AS slot, event_id % 8 * 50 + event_id * 7 % 15 AS x,
  CASE event_id % 8 WHEN 0 THEN 'REF' WHEN 1 THEN 'CALC' ELSE ['TC', 'CYL', 'BRG'][event_id % 24 // 8 + 1] || (event_id % 8 - 1) END AS "column" FROM events WHERE event_id * 5 % 7 <> 0),
o AS (SELECT * FROM h WHERE header = 0),
m AS (SELECT h.page, h.header FROM h JOIN o USING (page, "column") WHERE h.header > 0 AND h.slot < 2 GROUP BY 1, 2 HAVING max(abs(h.x - o.x)) < 12),
v AS (SELECT page, header, x, row_number() OVER (PARTITION BY page, header ORDER BY x) AS i FROM h SEMI JOIN m USING (page, header) WHERE slot > 1),
a AS (SELECT page, i, x FROM v QUALIFY row_number() OVER (PARTITION BY page, i ORDER BY header) = 1)
SELECT page, "column", x, false AS filled FROM o UNION ALL
SELECT p.page, 'TC' || i, a.x, true FROM (SELECT DISTINCT page FROM o) p JOIN a USING (page) WHERE i <= 6 AND NOT EXISTS (FROM o WHERE o.page = p.page AND o.slot = i + 1)""",
)
def sibling_anchors(spark, d):
    e = F.col("event_id")
    slot, header = e % 8, F.expr("event_id % 24 div 8")
    family = F.when(header == 0, "TC").when(header == 1, "CYL").otherwise("BRG")
    column = F.when(slot == 0, "REF").when(slot == 1, "CALC").otherwise(F.concat(family, (slot - 1).cast("string")))
    h = read(spark, d, "events").where(e * 5 % 7 != 0)
    h = h.select(F.expr("event_id div 24").alias("page"), header.alias("header"), column.alias("column"), (slot * 50 + e * 7 % 15).alias("x"))
    return pages.sibling_anchors(h, ["page"], [*_META, *_SLOTS], _META, F.col("header") == 0)


QUERIES_HERE = ["band_classes", "recording_time", "sibling_anchors"]
