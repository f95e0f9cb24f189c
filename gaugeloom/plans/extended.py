"""Queries of the matching and report operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, query, reports
from .catalogue import _TRIGGERS, observations, read, register


@register(
    "alias_index_names",
    """SELECT DISTINCT p_partkey, alias FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(unnest([p_name, p_brand, p_type])), '[^a-z0-9%./@ -]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS alias FROM part)
WHERE alias <> ''""",
)
def alias_index_names(spark, d):
    return matching.alias_index(read(spark, d, "part"), "p_partkey", F.array("p_name", "p_brand", "p_type"))


@register(
    "label_field_match",
    """WITH RECURSIVE r AS (SELECT p_partkey, (CASE WHEN p_size % 5 = 0 THEN replace(p_name, ' ', '') ELSE p_name END) || ' ' || lower(p_type) AS label, CASE WHEN p_size % 2 = 0 THEN 'bar' ELSE 'kW' END AS unit FROM part),
f AS (SELECT DISTINCT p_name AS field, CASE WHEN length(p_name) % 2 = 0 THEN 'bar' ELSE 'kW' END AS unit FROM part),
l AS (SELECT DISTINCT label, field, string_split(label, ' ') AS rt, string_split(field, ' ') AS a FROM r, f),
s AS (SELECT label, field, rt, a, 0 AS k, 0::BIGINT AS i FROM l
  UNION ALL SELECT label, field, rt, a, k + 1, coalesce([j for j in range(i + 1, len(a) + 1) if array_to_string(a[i + 1:j], '') = rt[k + 1]][1], i) FROM s WHERE k < len(rt)),
z AS (SELECT label, field, CASE WHEN label = field THEN 1e0 ELSE greatest(0e0, least(1e0, 75e-2 * i / len(a) + 25e-2 * i / len(rt) - CASE WHEN len(a) > len(rt) THEN 2e-1 * (len(a) - len(rt)) / len(a) ELSE 0e0 END)) END AS s FROM s WHERE k = len(rt)),
q AS (SELECT p_partkey, z.field, z.s + CASE WHEN r.unit = f.unit THEN 1e-2 ELSE 0e0 END AS score FROM r JOIN z USING (label) JOIN f USING (field) WHERE z.s > 0),
t AS (SELECT p_partkey, field, score, coalesce(lead(score) OVER w, 0) AS nxt, row_number() OVER w AS n FROM q WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, field))
SELECT r.p_partkey, CASE WHEN score >= 5e-1 AND nxt < score - 1e-3 THEN field END AS field, CASE WHEN score >= 5e-1 THEN round(score, 6) END AS score,
CASE WHEN coalesce(score, 0) < 5e-1 THEN 'NO_MATCH' WHEN nxt >= score - 1e-3 THEN 'OCR_AMBIGUOUS' ELSE 'MATCHED' END AS status FROM r LEFT JOIN t ON t.p_partkey = r.p_partkey AND n = 1""",
)
def label_field_match(spark, d):
    p = read(spark, d, "part")
    label = F.concat_ws(" ", F.when(F.col("p_size") % 5 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name")), F.lower("p_type"))
    rows = p.select("p_partkey", label.alias("label"), F.when(F.col("p_size") % 2 == 0, "bar").otherwise("kW").alias("unit"))
    index = p.select(F.col("p_name").alias("field"), F.col("p_name").alias("alias"), F.when(F.length("p_name") % 2 == 0, "bar").otherwise("kW").alias("unit")).distinct()
    return matching.match_fields(rows, "p_partkey", index, "field")


def _row_texts(spark, d):
    p = read(spark, d, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    text = (
        F.when(kind == 0, F.concat_ws(" ", "p_name", F.lit("fwd"))).when(kind == 1, F.concat_ws(" ", word(1), F.lit("x"), word(2), size))
        .when(kind == 2, F.concat_ws(" ", F.lit("old"), "p_name", size)).otherwise(F.concat_ws(" ", "p_name", F.lit("z")))
    )
    return p.select(F.col("p_name").alias("field"), F.col("p_name").alias("name")).distinct(), p.select("p_type", "p_partkey", text.alias("text"))


_ROWS = """WITH r AS (SELECT p_type, p_partkey, string_split(CASE p_size % 4 WHEN 0 THEN p_name || ' fwd' WHEN 1 THEN split_part(p_name, ' ', 1) || ' x ' || split_part(p_name, ' ', 2) || ' ' || p_size
  WHEN 2 THEN 'old ' || p_name || ' ' || p_size ELSE p_name || ' z' END, ' ') AS c FROM part),
f AS (SELECT DISTINCT p_name AS field, string_split(p_name, ' ') AS t FROM part),
j AS (SELECT *, list_position(c, t[1]) AS a FROM r JOIN f ON list_contains(c, t[1])),
k AS (SELECT *, a + list_position(c[a + 1:], t[2]) AS b FROM j WHERE list_contains(c[a + 1:], t[2])),
m AS (SELECT p_type, field, p_partkey, CASE WHEN b - a = 1 THEN 1e0 ELSE 1 - least(2e-1, 3e-2 * (b - a - 1)) - least(15e-2, 2e-2 * greatest(0, len(c) - 2)) END AS score FROM k
  WHERE len([i for i in range(1, len(c) + 1) if list_contains(['aft', 'exh', 'fp', 'fwd'], c[i]) AND (abs(i - a) <= 1 OR abs(i - b) <= 1)]) = 0{more})
SELECT p_type, field, p_partkey, round(score, 6) AS score FROM m WHERE score >= 6e-1 QUALIFY row_number() OVER (PARTITION BY p_type, field ORDER BY score DESC, p_partkey) = 1"""


@register("field_row_match", _ROWS.replace("{more}", ""))
def field_row_match(spark, d):
    fields, rows = _row_texts(spark, d)
    return matching.find_rows(fields, "field", rows, ["p_type"], "p_partkey")


@register("qualified_row_match", _ROWS.replace("{more}", " AND NOT coalesce(regexp_matches(c[b + 1], '^[0-9]{1,4}$'), false)"))
def qualified_row_match(spark, d):
    fields, rows = _row_texts(spark, d)
    return matching.find_rows(fields, "field", rows, ["p_type"], "p_partkey", qualified=True)


@register("text_alias_match")
def text_alias_match(spark, d):
    p = read(spark, d, "part")
    index = p.select(F.col("p_name").alias("field"), F.col("p_name").alias("alias")).distinct()
    return matching.match_text(p.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("text")), "text", index, "field")


@register(
    "template_route",
    """WITH o AS (SELECT l_orderkey AS report, l_linenumber AS page, bool_or(l_returnflag = 'R') AS reading, bool_or(l_linestatus = 'F') AS fuel FROM lineitem GROUP BY 1, 2),
g AS (SELECT report, list({'page': page, 'fuel': fuel} ORDER BY page) FILTER (reading) AS r FROM o GROUP BY 1)
SELECT report, CASE WHEN len(r) = 2 AND r[2].fuel THEN 'A' ELSE 'B' END AS template, coalesce(array_to_string([x.page for x in r], ';'), '') AS pages FROM g""",
)
def template_route(spark, d):
    l = read(spark, d, "lineitem")
    pages = l.select(
        F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("page"), (F.col("l_returnflag") == "R").alias("reading"),
        F.when(F.col("l_linestatus") == "F", "Fuel Oil data").otherwise("none").alias("top_text"),
    )
    return reports.route_templates(pages).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ";"))


@register(
    "recording_date",
    """SELECT l_orderkey, place, value FROM (SELECT l_orderkey, 4 - l_linenumber AS place, strftime(l_shipdate, '%Y-%m-%d') AS value FROM lineitem WHERE l_linenumber <= 3 AND l_tax > 0.02)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY place, value) = 1""",
)
def recording_date(spark, d):
    l = read(spark, d, "lineitem")
    column = F.when(F.col("l_linenumber") == 1, "VALUE").when(F.col("l_linenumber") == 2, "VAL1").when(F.col("l_linenumber") == 3, "DATETIME").otherwise("X")
    cells = l.select("l_orderkey", column.alias("column"), F.when(F.col("l_tax") > 0.02, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("value"))
    return reports.by_priority(cells, ["l_orderkey"], ["DATETIME", "VAL1", "VALUE"])


@register("field_definitions", "SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def field_definitions(spark, d):
    return reports.field_definitions(read(spark, d, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", ["p_partkey"])


@register(
    "field_columns",
    """WITH c AS (SELECT DISTINCT l_partkey, CASE l_returnflag WHEN 'A' THEN 'AVG' WHEN 'N' THEN 'VALUE' ELSE 'REF' END AS col FROM lineitem),
g AS (SELECT l_partkey, list(col ORDER BY col) FILTER (col <> 'VALUE') AS o FROM c GROUP BY 1)
SELECT l_partkey, coalesce(array_to_string(o, ';'), 'VALUE') AS columns, CASE WHEN list_contains(o, 'AVG') THEN 'AVG' ELSE coalesce(o[1], 'VALUE') END AS chosen FROM g""",
)
def field_columns(spark, d):
    column = F.when(F.col("l_returnflag") == "A", "AVG").when(F.col("l_returnflag") == "N", "VALUE").otherwise("REF")
    return reports.field_columns(read(spark, d, "lineitem").select("l_partkey", column.alias("column")), "l_partkey")


@register("latest_reports", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def latest_reports(spark, d):
    o = read(spark, d, "orders")
    return reports.latest(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@register(
    "field_lookup",
    """WITH n AS (SELECT p_partkey, unnest([p_name, p_brand]) AS name FROM part), f AS (SELECT name, min(p_partkey) AS p_partkey FROM n GROUP BY 1)
SELECT a.name, f.p_partkey FROM (SELECT DISTINCT unnest([p_brand, p_type, upper(p_name)]) AS name FROM part) a LEFT JOIN f ON f.name = a.name""",
)
def field_lookup(spark, d):
    p = read(spark, d, "part")
    asked = p.select(F.explode(F.array("p_brand", "p_type", F.upper("p_name"))).alias("name")).distinct()
    return reports.find_field(p.select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand").alias("aliases")), asked, "p_partkey")


_FIELDS = """WITH c AS (SELECT l_orderkey % 100 AS report, l_orderkey, CASE WHEN l_linenumber = 7 THEN 'X_700' ELSE 'C' || l_linenumber END AS col,
  CASE WHEN l_discount < 0.01 THEN '' WHEN l_discount < 0.02 THEN 'open' ELSE l_quantity::INT::VARCHAR END AS raw, CASE WHEN l_tax > 0.07 OR l_discount < 0.02 THEN NULL ELSE l_quantity END AS v, l_suppkey % 101 / 100 AS conf FROM lineitem),
g AS (SELECT report, l_orderkey, count(*) AS n, count(DISTINCT col) AS k, bool_or(col = 'X_700') AS unresolved, bool_or(raw = 'open') AS txt, bool_or(regexp_matches(raw, '[0-9]') AND v IS NULL OR conf < 0.15) AS malformed, bool_and(raw = '') AS blank FROM c GROUP BY 1, 2),
s AS (SELECT report, l_orderkey, [x for x in [CASE WHEN unresolved THEN 'COLUMN_UNRESOLVED' END, CASE WHEN n > k THEN 'DUPLICATE_COLUMN' END, CASE WHEN malformed THEN 'MALFORMED_NUMBER' END, CASE WHEN k < 4 THEN 'POSSIBLE_POSITIONAL_SHIFT' END,
  CASE WHEN k > 4 THEN 'SCHEMA_MISMATCH' END, CASE WHEN blank THEN 'SOURCE_BLANK' END, CASE WHEN txt THEN 'TEXT_VALUE' END] if x IS NOT NULL] AS f FROM g),
t AS (SELECT report, l_orderkey, CASE WHEN len(f) = 0 THEN ['OK'] ELSE f END AS statuses FROM s) """


def _statuses(spark, d):
    l = read(spark, d, "lineitem")
    raw = F.when(F.col("l_discount") < 0.01, "").when(F.col("l_discount") < 0.02, "open").otherwise(F.col("l_quantity").cast("int").cast("string"))
    cells = l.select(
        (F.col("l_orderkey") % 100).alias("report"), "l_orderkey", F.when(F.col("l_linenumber") == 7, "X_700").otherwise(F.concat(F.lit("C"), F.col("l_linenumber").cast("string"))).alias("column"),
        raw.alias("raw_text"), F.when((F.col("l_tax") > 0.07) | (F.col("l_discount") < 0.02), F.lit(None)).otherwise(F.col("l_quantity")).alias("value"), (F.col("l_suppkey") % 101 / 100).alias("confidence"),
    )
    return reports.field_statuses(cells, ["report", "l_orderkey"], 4)


@register("audit_field_statuses", _FIELDS + "SELECT l_orderkey, array_to_string(statuses, ';') AS statuses FROM t")
def audit_field_statuses(spark, d):
    return _statuses(spark, d).select("l_orderkey", F.array_join("statuses", ";").alias("statuses"))


@register(
    "audit_report_rollup",
    _FIELDS + """SELECT report, count(*) AS fields, count(*) FILTER (list_contains(statuses, 'OK')) AS ok, count(*) FILTER (list_contains(statuses, 'MISSING_VALUE')) AS missing,
count(*) FILTER (list_contains(statuses, 'POSSIBLE_POSITIONAL_SHIFT')) AS shifted, count(*) FILTER (list_contains(statuses, 'TEXT_VALUE')) AS "text",
count(*) FILTER (len([x for x in statuses if x NOT IN ('OK', 'SOURCE_BLANK', 'TEXT_VALUE')]) > 0) AS adverse, count(*) = 150 AS complete FROM t GROUP BY 1""",
)
def audit_report_rollup(spark, d):
    return reports.audit_rollup(_statuses(spark, d), ["report"], 150)


@register(
    "canonical_across_pages",
    """WITH b AS (SELECT l_suppkey AS report, l_returnflag || l_linestatus AS field, l_linenumber AS page, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag || l_linestatus ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) = 1),
f AS (SELECT DISTINCT l_returnflag || l_linestatus AS field FROM lineitem UNION ALL SELECT 'ZZ')
SELECT r.report, f.field, coalesce(b.page, 0) AS page, b.l_quantity AS value, CASE WHEN b.page IS NULL THEN 'SOURCE_ABSENT' ELSE 'PRESENT' END AS source_status
FROM (SELECT DISTINCT l_suppkey AS report FROM lineitem) r CROSS JOIN f LEFT JOIN b ON b.report = r.report AND b.field = f.field""",
)
def canonical_across_pages(spark, d):
    l = read(spark, d, "lineitem")
    records = l.select(F.col("l_suppkey").alias("report"), F.concat("l_returnflag", "l_linestatus").alias("field"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("value"), "l_orderkey", "l_partkey")
    registry = records.select("field").distinct().unionByName(spark.range(1).select(F.lit("ZZ").alias("field")))
    out = reports.across_pages(records, registry, "report", "field", [F.col("value").desc(), F.col("l_orderkey"), F.col("page"), F.col("l_partkey")])
    return out.select("report", "field", "page", "value", "source_status")


@register(
    "columns_from_gaps",
    """WITH t AS (SELECT l_orderkey AS page, l_linenumber * 100 + l_partkey % 40 AS lo, l_linenumber * 100 + l_partkey % 40 + 30 + l_suppkey % 50 AS hi, l_returnflag AS txt FROM lineitem),
g AS (SELECT *, lo - max(hi) OVER (PARTITION BY page ORDER BY lo, hi, txt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM t),
m AS (SELECT page, median(gap) AS mid FROM g WHERE gap > 0 GROUP BY 1),
n AS (SELECT g.*, coalesce(gap > greatest(2 * mid, 20), false)::INT AS brk FROM g LEFT JOIN m USING (page)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY page ORDER BY lo, hi, txt ROWS UNBOUNDED PRECEDING)::BIGINT AS col FROM n),
s AS (SELECT page, col, txt, count(*) AS k, min(lo) AS lo, max(hi) AS hi FROM c GROUP BY 1, 2, 3)
SELECT page, col AS "column", min(lo) AS lo, max(hi) AS hi, min({'k': -k, 'txt': txt}).txt AS label FROM s GROUP BY 1, 2""",
)
def columns_from_gaps(spark, d):
    left = F.col("l_linenumber") * 100 + F.col("l_partkey") % 40
    tokens = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), left.alias("left"), (left + 30 + F.col("l_suppkey") % 50).alias("right"), F.col("l_returnflag").alias("text"))
    return reports.columns_from_gaps(tokens, ["page"], 2.0, 20.0)


@register(
    "debris_near_clean",
    """WITH e AS (SELECT event_id, user_id, value, event_id % 3 = 0 AS debris FROM events)
SELECT event_id, user_id, value FROM e WHERE NOT (debris AND EXISTS (SELECT 1 FROM e c WHERE c.user_id = e.user_id AND NOT c.debris AND abs(c.value - e.value) < 0.5))""",
)
def debris_near_clean(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_id") % 3 == 0).alias("debris"))
    return reports.drop_debris(e, ["user_id"], "value", 0.5).drop("debris")


@register("grid_left_edge", "SELECT l_orderkey, min(l_linenumber * 100) AS grid_left FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def grid_left_edge(spark, d):
    text = F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int").cast("string")).otherwise("x")
    return reports.grid_left(read(spark, d, "lineitem").select("l_orderkey", text.alias("text"), (F.col("l_linenumber") * 100).alias("cx")), ["l_orderkey"])


@register(
    "numeric_cells",
    "SELECT event_id, coalesce(CASE WHEN event_id % 8 = 0 THEN value END, CASE event_id % 4 WHEN 1 THEN user_id + 5e-1 WHEN 2 THEN user_id::DOUBLE END) AS number FROM events",
)
def numeric_cells(spark, d):
    e, user = read(spark, d, "events"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, "abc").when(kind == 1, F.concat(user, F.lit(",5"))).when(kind == 2, F.concat(F.lit("n "), user, F.lit(" x"))).otherwise("21:40")
    return e.select("event_id", reports.numeric_cell(F.when(F.col("event_id") % 8 == 0, F.col("value")), raw).alias("number"))


@register(
    "numbered_labels",
    """SELECT l_orderkey, l_partkey, CASE WHEN n = 1 THEN col ELSE col || ' ' || n END AS shown FROM
(SELECT l_orderkey, l_partkey, l_returnflag AS col, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)""",
)
def numbered_labels(spark, d):
    l = read(spark, d, "lineitem").withColumn("column", F.col("l_returnflag"))
    return reports.numbered_labels(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_partkey", "shown")


@register(
    "template_metadata",
    """SELECT l_suppkey, count(DISTINCT l_linenumber) AS detected, count(DISTINCT l_linenumber) FILTER (l_tax > 0.07) AS populated,
coalesce(array_to_string(list_sort(list(DISTINCT 'f' || l_linenumber) FILTER (l_tax > 0.07)), ';'), '') AS populated_fields FROM lineitem GROUP BY 1""",
)
def template_metadata(spark, d):
    l = read(spark, d, "lineitem")
    records = l.select("l_suppkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.when(F.col("l_tax") > 0.07, F.col("l_quantity")).alias("value"))
    return reports.metadata(records, "l_suppkey", "field")


@register(
    "trigger_sticky",
    f"""WITH t(trigger_id, field, operator, threshold, active) AS (VALUES {', '.join(f"({a}, '{b}', '{c}', {x}, {y})" for a, b, c, x, y in _TRIGGERS)}),
r AS (SELECT trigger_id, coalesce(bool_or(CASE operator WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold ELSE value > threshold END), false) AS fired
FROM t LEFT JOIN events ON event_type = field WHERE active GROUP BY trigger_id)
SELECT trigger_id::INT AS trigger_id, fired, CASE WHEN fired THEN '2025-01-01' ELSE '2024-06-30' END AS last_fired FROM r""",
)
def trigger_sticky(spark, d):
    t = spark.createDataFrame(_TRIGGERS, "trigger_id int, field string, operator string, threshold double, active boolean").withColumn("last_fired", F.lit("2024-06-30"))
    return query.evaluate_triggers(t, observations(spark, d), F.lit("2025-01-01")).select("trigger_id", "fired", "last_fired")
