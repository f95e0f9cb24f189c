"""Queries over positioned tokens and records, registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grid, layout, rank, records
from .catalogue import _CELLS, _GRID, _grid, read, register

_UNITS = ["bar", "kW", "rpm", "mm", "%"]


@register(
    "token_classes",
    f"""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '12.50' WHEN 1 THEN '4/15/2025' WHEN 2 THEN '21:40' WHEN 3 THEN ' BAR' WHEN 4 THEN '|~' WHEN 5 THEN event_type WHEN 6 THEN 'CYL' || event_id END AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN NULL WHEN s = '12.50' THEN 'number' WHEN s = '4/15/2025' THEN 'date' WHEN s = '21:40' THEN 'time' WHEN lower(trim(s)) IN ({', '.join(f"'{u.lower()}'" for u in _UNITS)}) THEN 'unit'
WHEN NOT regexp_matches(lower(s), '[a-z0-9]') THEN 'artifact' WHEN regexp_matches(lower(trim(s)), '^[a-z]+$') THEN 'alpha' ELSE 'other' END AS class FROM t""",
)
def token_classes(spark, d):
    k, s = F.col("event_id") % 8, None
    fixed = ["12.50", "4/15/2025", "21:40", " BAR", "|~"]
    s = F.when(k == 5, F.col("event_type")).when(k == 6, F.concat(F.lit("CYL"), F.col("event_id").cast("string")))
    for i, x in enumerate(fixed):
        s = s.when(k == i, x)
    return read(spark, d, "events").select("event_id", layout.token_class(s, _UNITS).alias("class"))


_BANDS = 'SELECT page, top, top + 16 AS bottom, max("left") - min("left") AS extent FROM t GROUP BY 1, 2'


def _bands(spark, d):
    t, _ = _grid(spark, d)
    return t.groupBy("page", "top").agg((F.max("left") - F.min("left")).alias("extent")).withColumn("bottom", F.col("top") + 16)


@register(
    "zones",
    f"""WITH {_GRID}, b AS ({_BANDS}), l AS (SELECT *, lag(bottom) OVER w AS pb, lag(extent) OVER w AS pe, row_number() OVER w AS row_no FROM b WINDOW w AS (PARTITION BY page ORDER BY top))
SELECT page, top, extent, row_no::INT AS row_no, sum(CASE WHEN top - pb >= 39 OR (top - pb >= 19.5 AND extent < 0.6 * pe) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top)::BIGINT AS zone FROM l""",
)
def zones(spark, d):
    return layout.zones(_bands(spark, d), ["page"], 10.0).drop("bottom")


_RUNS = f"""{_GRID}, v AS (SELECT DISTINCT page, top, "left", text, 60 + ("left" * 7) % 50 AS width FROM t),
f AS (SELECT *, CASE WHEN "left" - lag("left" + width) OVER w > 12 THEN 1 ELSE 0 END AS far FROM v WINDOW w AS (PARTITION BY page, top ORDER BY "left", text)),
r AS (SELECT *, sum(far) OVER (PARTITION BY page, top ORDER BY "left", text ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f),
c2 AS (SELECT page, top, run, array_to_string(list(text ORDER BY "left", text), ' ') AS label, min("left") AS x_min, max("left" + width) AS x_max FROM r GROUP BY 1, 2, 3)"""


def _runs(spark, d):
    t, _ = _grid(spark, d)
    t = t.select("page", "top", "left", "text").distinct().withColumn("width", 60 + (F.col("left") * 7) % 50)
    return layout.compound(t, ["page", "top"], 12.0)


@register("compound_headers", f"WITH {_RUNS} SELECT page, top, run, label, x_min, x_max FROM c2")
def compound_headers(spark, d):
    return _runs(spark, d)


@register(
    "interval_overlap",
    f"""WITH {_RUNS}, p(parent, lo, hi) AS (VALUES ('LEFT', 90, 260), ('RIGHT', 240, 480)),
o AS (SELECT DISTINCT page, x_min, x_max, parent, lo, least(x_max, hi) - greatest(x_min, lo) AS overlap FROM c2, p WHERE least(x_max, hi) > greatest(x_min, lo))
SELECT page, x_min, x_max, parent, overlap FROM o QUALIFY row_number() OVER (PARTITION BY page, x_min, x_max ORDER BY overlap DESC, lo) = 1""",
)
def interval_overlap(spark, d):
    leaves = _runs(spark, d).select("page", "x_min", "x_max").distinct()
    heads = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("x_min"), F.lit(b).alias("x_max")) for n, a, b in (("LEFT", 90, 260), ("RIGHT", 240, 480))]))
    parents = leaves.select("page").distinct().select("page", heads.alias("h")).select("page", "h.*")
    return layout.parent_by_overlap(leaves, parents, ["page"])


@register(
    "segment_numeric",
    """WITH t AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS "left", CASE WHEN l_linenumber % 2 = 1 THEN 'L' || min(l_suppkey) ELSE '7' END AS text FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
s AS (SELECT *, text LIKE 'L%' AS is_label FROM t)
SELECT page, "left", text, last_value(CASE WHEN is_label THEN text END IGNORE NULLS) OVER (PARTITION BY page ORDER BY "left" ROWS UNBOUNDED PRECEDING) AS label,
first_value(CASE WHEN is_label THEN "left" END IGNORE NULLS) OVER (PARTITION BY page ORDER BY "left" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_left FROM s QUALIFY NOT is_label""",
)
def segment_numeric(spark, d):
    l = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    text = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("L"), F.col("s").cast("string"))).otherwise("7")
    t = l.select("page", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("left"), text.alias("text"))
    return layout.segments(t, ["page"], F.col("text").startswith("L"))


@register("geometry_collision", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS columns, count(*) > count(DISTINCT l_returnflag) AS collision FROM lineitem GROUP BY 1")
def geometry_collision(spark, d):
    return layout.collisions(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "column"), ["l_orderkey"])


@register("greedy_column_map")
def greedy_column_map(spark, d):
    l = read(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") == 1, "REF").when(F.col("l_linenumber") == 4, "AVG").otherwise(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")))
    return layout.schema_map(l.select("l_orderkey", label.alias("label"), (F.col("l_linenumber") * 100 + F.col("l_partkey") % 30).alias("x")), ["l_orderkey"], ["REF", "CALC", "MEAS", "AVG"])


@register(
    "unique_candidate_recovery",
    f"""WITH cells AS ({_CELLS}), s AS (SELECT l_orderkey AS page, 20 * l_linenumber AS top, max(l_tax) AS found, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT c.page, c.top, c."column", coalesce(CASE WHEN c."column" = 'REF' AND c.source_status = 'SOURCE_BLANK' AND n = 1 THEN found END, c.value) AS value,
c."column" = 'REF' AND c.source_status = 'SOURCE_BLANK' AND coalesce(n, 0) = 1 AS recovered FROM cells c LEFT JOIN s ON s.page = c.page AND s.top = c.top""",
)
def unique_candidate_recovery(spark, d):
    strays = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 20).alias("top"), F.lit("REF").alias("column"), F.col("l_tax").alias("value"))
    return grid.recover_unique(grid.grid_cells(*_grid(spark, d)), strays).select("page", "top", "column", "value", "recovered")


@register(
    "positional_fill",
    """WITH v AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem WHERE l_discount > 0.04),
s(i, col) AS (VALUES (1, 'REF'), (2, 'CALC'), (3, 'AVG'))
SELECT k.l_orderkey, s.col AS "column", v.l_quantity AS value, CASE WHEN v.n IS NULL THEN 'SOURCE_ABSENT' ELSE 'PRESENT' END AS source_status
FROM (SELECT DISTINCT l_orderkey FROM v) k CROSS JOIN s LEFT JOIN v ON v.l_orderkey = k.l_orderkey AND v.n = s.i""",
)
def positional_fill(spark, d):
    l = read(spark, d, "lineitem").where("l_discount > 0.04").withColumn("value", F.col("l_quantity"))
    return records.fill_schema(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["REF", "CALC", "AVG"])


@register(
    "packed_cells",
    """WITH v AS (SELECT l_orderkey, l_returnflag, l_quantity AS value, l_suppkey % 101 AS conf, first_value(l_quantity) OVER w AS first, row_number() OVER w AS n FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
SELECT l_orderkey, l_returnflag, value, conf, first, 'SECONDARY_VALUE' AS flag FROM v WHERE n > 1 AND conf >= 60 AND value <> first""",
)
def packed_cells(spark, d):
    t = read(spark, d, "lineitem").withColumn("value", F.col("l_quantity")).withColumn("conf", F.col("l_suppkey") % 101)
    return records.packed(t, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_returnflag", "value", "conf", "first", "flag")


@register(
    "best_of_modes",
    """WITH m AS (SELECT l_orderkey, l_linestatus AS mode, count(*) AS cells, count(*) FILTER (l_suppkey % 101 >= 60) AS sure, bool_or(l_quantity > 25) AS found FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, mode, (CASE WHEN found THEN 10 ELSE -10 END + 2 * least(cells, 12) + sure)::BIGINT AS score FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN found THEN 10 ELSE -10 END + 2 * least(cells, 12) + sure DESC, mode) = 1""",
)
def best_of_modes(spark, d):
    m = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("mode")).agg(
        F.count("*").alias("cells"), F.count_if(F.col("l_suppkey") % 101 >= 60).alias("sure"), F.bool_or(F.col("l_quantity") > 25).alias("found")
    )
    m = m.withColumn("score", records.quality(F.col("found"), F.col("cells"), F.col("sure")).cast("long"))
    return rank.best(m, ["l_orderkey"], [F.col("score").desc(), F.col("mode")]).select("l_orderkey", "mode", "score")


@register(
    "primary_value",
    """WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 'VALUE' ELSE l_returnflag END AS col, l_quantity AS v, (l_linenumber * 10000000 + l_partkey) * 100 + l_quantity::BIGINT AS o FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) FILTER (col = 'VALUE') > 0 THEN min_by(v, o) FILTER (col = 'VALUE') WHEN count(*) FILTER (col <> 'VALUE') = 1 THEN min(v) FILTER (col <> 'VALUE') END AS value FROM c GROUP BY 1""",
)
def primary_value(spark, d):
    column = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), "VALUE").otherwise(F.col("l_returnflag"))
    order = (F.col("l_linenumber") * 10000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")
    return records.primary_value(read(spark, d, "lineitem").select("l_orderkey", column.alias("column"), F.col("l_quantity").alias("value"), order.alias("o")), ["l_orderkey"], "o")


@register(
    "web_rows_column_order",
    """WITH c AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'CYL' || l_linenumber WHEN 1 THEN 'AVG' WHEN 2 THEN 'TC' || l_linenumber ELSE l_returnflag END AS col FROM lineitem)
SELECT col AS "column", row_number() OVER (ORDER BY CASE WHEN col = 'AVG' THEN 4 WHEN col LIKE 'CYL%' THEN 7 WHEN col LIKE 'TC%' THEN 8 ELSE 10 END, coalesce(try_cast(regexp_extract(col, '([0-9]+)$', 1) AS INT), 0), col)::INT AS place FROM c""",
)
def web_rows_column_order(spark, d):
    n, text = F.col("l_linenumber") % 4, F.col("l_linenumber").cast("string")
    column = F.when(n == 0, F.concat(F.lit("CYL"), text)).when(n == 1, "AVG").when(n == 2, F.concat(F.lit("TC"), text)).otherwise(F.col("l_returnflag"))
    # the universe of columns is a fixed vocabulary; one array holds it
    c = read(spark, d, "lineitem").select(column.alias("c")).distinct().agg(F.sort_array(F.collect_list(records.column_key(F.col("c")))).alias("all"))
    return c.select(F.posexplode("all").alias("p", "k")).select(F.col("k.name").alias("column"), (F.col("p") + 1).alias("place"))


@register(
    "discovery_merge",
    """WITH r AS (SELECT n_name AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'MANUAL' ELSE 'DISCOVERED' END AS status, ['old'] AS a FROM nation WHERE n_nationkey < 15), f AS (SELECT n_name AS k, ['R' || n_regionkey] AS a FROM nation WHERE n_nationkey > 5)
SELECT coalesce(r.k, f.k) AS n_name, coalesce(status, 'DISCOVERED') AS status, array_to_string(list_sort(CASE WHEN status = 'MANUAL' THEN r.a ELSE list_distinct(list_concat(coalesce(r.a, []), coalesce(f.a, []))) END), ';') AS aliases FROM r FULL JOIN f ON r.k = f.k""",
)
def discovery_merge(spark, d):
    n = read(spark, d, "nation")
    r = n.where("n_nationkey < 15").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, "MANUAL").otherwise("DISCOVERED").alias("status"), F.array(F.lit("old")).alias("aliases"))
    f = n.where("n_nationkey > 5").select("n_name", F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("aliases"))
    return records.discover(r, f, "n_name").withColumn("aliases", F.array_join("aliases", ";"))


@register(
    "reading_pair_fallback",
    r"""WITH p AS (SELECT doc_id // 10 AS report, doc_id % 10 + 1 AS page, page <> 1 AND regexp_matches(lower(coalesce(text, '')), '\b(and|der)\b') AS hit FROM documents),
g AS (SELECT report, list_sort(list(DISTINCT page) FILTER (hit)) AS h, max(page) AS n FROM p GROUP BY 1), z AS (SELECT report, coalesce(h, []) AS h, n FROM g),
q AS (SELECT report, len(h) AS n_hits, CASE WHEN len(h) >= 2 THEN h[1:2] WHEN len(h) = 1 AND h[1] < n THEN [h[1], h[1] + 1] WHEN n >= 2 THEN [n - 1, n] END AS pair FROM z)
SELECT report, n_hits::INT AS n_hits, pair[1] AS first_page, pair[2] AS second_page FROM q""",
)
def reading_pair_fallback(spark, d):
    text = F.when(F.lower("text").rlike(r"\b(and|der)\b"), "reading").otherwise("")
    pages = read(spark, d, "documents").select(F.expr("doc_id div 10").alias("report"), (F.col("doc_id") % 10 + 1).alias("page"), text.alias("text"))
    return records.reading_pages(pages)


@register("excess_tokens", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w, i: i > 1 AND w <> ''), ' ') AS rest FROM part")
def excess_tokens(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", T.excess_tokens(F.substring_index("p_name", " ", 1), F.col("p_name")).alias("rest"))


QUERIES_HERE = [
    "token_classes", "zones", "compound_headers", "interval_overlap", "segment_numeric", "geometry_collision", "greedy_column_map", "unique_candidate_recovery", "positional_fill",
    "packed_cells", "best_of_modes", "primary_value", "web_rows_column_order", "discovery_merge", "reading_pair_fallback", "excess_tokens",
]
