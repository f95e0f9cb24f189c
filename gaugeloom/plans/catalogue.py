"""Queries over the driver's tables, each with SQL that gives the same rows.

The tables stand for measurement reports: a day, customer or order is a report,
an event type or flag is a field, a numeric column holds the cell values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import audit, cluster, grid, joins, query, rank
from ..sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """events as (report: day, field: type, value, ordinal)."""
    e = read(spark, d, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("report"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("ordinal"))


OBS = "(SELECT strftime(ts, '%Y-%m-%d') AS report, event_type AS field, value, event_id AS ordinal FROM events)"
OPS = ["mean", "average", "max", "min", "sum", "median?"]


@register(
    "field_aggregate",
    f"""SELECT field, operation, round(CASE operation WHEN 'max' THEN mx WHEN 'min' THEN mn WHEN 'sum' THEN sm ELSE av END, 4) AS result
FROM (SELECT field, max(value) mx, min(value) mn, sum(value) sm, avg(value) av FROM {OBS} GROUP BY field),
(SELECT unnest(['mean','average','max','min','sum','median?']) AS operation)""",
)
def field_aggregate(spark, d):
    return query.aggregate_field(observations(spark, d), OPS)


for _name, _big in (("field_max_sources", True), ("field_min_sources", False)):

    @register(
        _name,
        f"SELECT report, field, value, ordinal FROM {OBS} QUALIFY rank() OVER (PARTITION BY field ORDER BY value {'DESC' if _big else 'ASC'}) = 1",
    )
    def _extreme(spark, d, _big=_big):
        return query.extreme_sources(observations(spark, d), _big)


@register("field_first_n_sources", f"SELECT report, field, value, ordinal FROM {OBS} QUALIFY row_number() OVER (PARTITION BY field ORDER BY ordinal) <= 5")
def field_first_n_sources(spark, d):
    return query.first_sources(observations(spark, d))


@register(
    "compare_groups",
    """SELECT n_name AS field, count(*) FILTER (c_mktsegment='BUILDING') AS n_a, count(*) FILTER (c_mktsegment='MACHINERY') AS n_b,
max(c_acctbal) FILTER (c_mktsegment='BUILDING') AS max_a, max(c_acctbal) FILTER (c_mktsegment='MACHINERY') AS max_b,
CASE WHEN count(*) FILTER (c_mktsegment='BUILDING') = 0 THEN 'absent in a' WHEN count(*) FILTER (c_mktsegment='MACHINERY') = 0 THEN 'absent in b' ELSE 'present in both' END AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def compare_groups(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    obs = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("report"), F.col("n_name").alias("field"), F.col("c_acctbal").alias("value"))
    return query.compare_reports(obs, "BUILDING", "MACHINERY")


@register("present_reports", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def present_reports(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@register("absent_reports", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def absent_reports(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return query.absent(read(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@register("search_fields", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def search_fields(spark, d):
    return query.search(read(spark, d, "part"), "AN", ["p_name", "p_type"]).select("p_partkey", "p_name")


@register(
    "observations_enriched",
    """SELECT l_orderkey, p_brand, l_partkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber, l_partkey) = 1""",
)
def observations_enriched(spark, d):
    l, p = read(spark, d, "lineitem"), read(spark, d, "part")
    j = l.join(p, l.l_partkey == p.p_partkey).select("l_orderkey", "p_brand", "l_partkey", "l_linenumber", "p_type")
    return rank.best(j, ["l_orderkey", "p_brand"], [F.col("l_linenumber"), F.col("l_partkey")])


@register(
    "registry_view_alias_tags",
    """SELECT w AS alias, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS canonicals, count(*) AS n
FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY w""",
)
def registry_view_alias_tags(spark, d):
    words = read(spark, d, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("alias")).where("alias <> ''")
    return words.groupBy("alias").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("canonicals"), F.count("*").alias("n"))


@register(
    "registry_upsert",
    """WITH o AS (SELECT lower(trim(n_name)) AS key, 'F' || n_nationkey AS field_id, 'old' AS unit, [n_name] AS aliases FROM nation WHERE n_nationkey < 20),
n AS (SELECT lower(trim(n_name)) AS key, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'G' || n_nationkey END AS field_id, 'new' AS unit, ['N' || n_regionkey] AS aliases FROM nation WHERE n_nationkey > 10)
SELECT coalesce(n.key, o.key) AS key, coalesce(nullif(n.field_id, ''), o.field_id) AS field_id, coalesce(n.unit, o.unit) AS unit,
array_to_string(list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])))), ';') AS aliases FROM o FULL JOIN n ON o.key = n.key""",
)
def registry_upsert(spark, d):
    n = read(spark, d, "nation")
    key = F.lower(F.trim("n_name")).alias("key")
    old = n.where("n_nationkey < 20").select(key, F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("field_id"), F.lit("old").alias("unit"), F.array("n_name").alias("aliases"))
    fid = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("G"), F.col("n_nationkey").cast("string")))
    new = n.where("n_nationkey > 10").select(key, fid.alias("field_id"), F.lit("new").alias("unit"), F.array(F.concat(F.lit("N"), F.col("n_regionkey").cast("string"))).alias("aliases"))
    return query.upsert(old, new, "key", ["field_id"], ["unit"], ["aliases"]).withColumn("aliases", F.array_join("aliases", ";"))


@register("registry_delete", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def registry_delete(spark, d):
    gone = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return read(spark, d, "nation").select("n_nationkey", "n_name").join(gone, "n_nationkey", "left_anti")


_TRIGGERS = [(1, "view", ">", 489.0, True), (2, "click", "<", 0.5, True), (3, "purchase", ">=", 480.0, True), (4, "error", "<=", 0.02, True),
             (5, "signup", "==", 100.0, True), (6, "view", "~", 1000.0, True), (7, "nothing", ">", 0.0, True), (8, "view", ">", 0.0, False)]


@register(
    "trigger_eval",
    f"""WITH t(trigger_id, field, operator, threshold, active) AS (VALUES {', '.join(f"({a}, '{b}', '{c}', {x}, {y})" for a, b, c, x, y in _TRIGGERS)})
SELECT trigger_id::INT AS trigger_id, coalesce(bool_or(CASE operator WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold
WHEN '==' THEN value = threshold ELSE value > threshold END), false) AS fired, max(value) AS max_value, count(value) AS n
FROM t LEFT JOIN events ON event_type = field WHERE active GROUP BY trigger_id""",
)
def trigger_eval(spark, d):
    t = spark.createDataFrame(_TRIGGERS, "trigger_id int, field string, operator string, threshold double, active boolean")
    return query.evaluate_triggers(t, observations(spark, d))


@register(
    "trend_series",
    """WITH r AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS report FROM events), s AS (SELECT DISTINCT event_type AS field FROM events)
SELECT r.report, s.field, round(min_by(e.value, e.event_id), 4) AS value FROM r CROSS JOIN s
LEFT JOIN events e ON strftime(e.ts, '%Y-%m-%d') = r.report AND e.event_type = s.field GROUP BY r.report, s.field""",
)
def trend_series(spark, d):
    obs = observations(spark, d)
    fields = obs.select("field").distinct()
    reports = obs.select("report").distinct()
    cells = obs.groupBy("report", "field").agg(F.min_by("value", "ordinal").alias("value"))
    # the series matrix: reports by fields, both as long as the charts' axes
    return reports.join(F.broadcast(fields.agg(F.collect_set("field").alias("fs")))).select("report", F.explode("fs").alias("field")).join(cells, ["report", "field"], "left").withColumn("value", F.round("value", 4))


@register("trend_month_bounds", "SELECT o_orderstatus AS field, min(year(o_orderdate)*100+month(o_orderdate)) AS first_month, max(year(o_orderdate)*100+month(o_orderdate)) AS last_month FROM orders GROUP BY 1")
def trend_month_bounds(spark, d):
    k = N.month_key(F.col("o_orderdate"))
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("field")).agg(F.min(k).cast("long").alias("first_month"), F.max(k).cast("long").alias("last_month"))


@register("trend_range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IS NULL OR year(o_orderdate)*100+month(o_orderdate) BETWEEN 199503 AND 199602")
def trend_range_filter(spark, d):
    k = N.month_key(F.col("o_orderdate"))
    return read(spark, d, "orders").where(k.isNull() | k.between(199503, 199602)).select("o_orderkey", "o_totalprice")


@register(
    "wide_pivot_first",
    """SELECT l_orderkey, min_by(l_quantity, (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT) FILTER (l_returnflag='A') AS "A",
min_by(l_quantity, (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT) FILTER (l_returnflag='N') AS "N", min_by(l_quantity, (l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey) * 100 + l_quantity::BIGINT) FILTER (l_returnflag='R') AS "R"
FROM lineitem GROUP BY l_orderkey""",
)
def wide_pivot_first(spark, d):
    l = read(spark, d, "lineitem").withColumn("ordinal", (F.col("l_linenumber") * 10000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long"))
    return io.wide(l, ["l_orderkey"], "l_returnflag", "l_quantity", "ordinal", ["A", "N", "R"])


@register("export_summary_counters", "SELECT count(*) AS n, count(*) FILTER (quality=1) AS good, count(*) FILTER (toxic=1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def export_summary_counters(spark, d):
    j = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@register(
    "briefing_stats",
    """SELECT c_mktsegment AS report, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS found, round(avg(c_acctbal), 2) AS average,
array_to_string(list_slice(list_sort(list(c_name) FILTER (c_acctbal <= 0)), 1, 5), ', ') AS missing FROM customer GROUP BY 1""",
)
def briefing_stats(spark, d):
    c = read(spark, d, "customer")
    low = rank.best(c.where("c_acctbal <= 0"), ["c_mktsegment"], [F.col("c_name")], 5)
    names = low.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("missing"))
    stats = c.groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("found"), F.round(F.avg("c_acctbal"), 2).alias("average"))
    return stats.join(names, "c_mktsegment", "left").withColumnRenamed("c_mktsegment", "report")


@register(
    "canonical_best",
    """SELECT o_custkey AS field_id, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'P') DESC, o_totalprice DESC, o_orderkey) = 1""",
)
def canonical_best(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "field_id")
    return rank.best(o, ["field_id"], [(F.col("o_orderstatus") != "P").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("field_id", "o_orderkey", "o_totalprice")


@register(
    "canonical_fill_absent",
    """SELECT c_custkey AS field_id, max(o_totalprice) AS value, CASE WHEN count(o_orderkey) = 0 THEN 'SOURCE_ABSENT' WHEN max(o_totalprice) IS NULL THEN 'SOURCE_BLANK' ELSE 'PRESENT' END AS source_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def canonical_fill_absent(spark, d):
    cells = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("field_id")).agg(F.max("o_totalprice").alias("value"))
    return joins.fill_absent(read(spark, d, "customer").select(F.col("c_custkey").alias("field_id")), cells, ["field_id"], "value")


@register("schema_cap", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 3")
def schema_cap(spark, d):
    return rank.best(read(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@register(
    "ordinal_assign",
    """SELECT l_orderkey, l_partkey, coalesce(list_extract(['REF','CALC','AVG'], row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT),
'column_unresolved') AS "column" FROM lineitem WHERE l_discount > 0.02""",
)
def ordinal_assign(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    schema = F.array(*[F.lit(x) for x in ("REF", "CALC", "AVG")])
    l = read(spark, d, "lineitem").where("l_discount > 0.02").withColumn("n", F.row_number().over(w))
    return l.select("l_orderkey", "l_partkey", F.coalesce(F.get(schema, F.col("n") - 1), F.lit("column_unresolved")).alias("column"))


@register("dup_column_flag", "SELECT l_orderkey, l_returnflag, count(*) AS n, 'duplicate_column_assignment' AS flag FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_column_flag(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1").withColumn("flag", F.lit("duplicate_column_assignment"))


@register(
    "clean_beats_debris",
    """SELECT event_id, event_type, value FROM (SELECT *, event_id % 3 = 0 AS debris, round(value, 0) AS v FROM events)
QUALIFY NOT (debris AND bool_or(NOT debris) OVER (PARTITION BY event_type, v))""",
)
def clean_beats_debris(spark, d):
    e = read(spark, d, "events").withColumn("debris", F.col("event_id") % 3 == 0)
    clean = F.bool_or(~F.col("debris")).over(Window.partitionBy("event_type", F.round("value", 0)))
    return e.withColumn("clean", clean).where("NOT (debris AND clean)").select("event_id", "event_type", "value")


_MARKS = "(SELECT event_type, value AS x, min(event_id) AS mark FROM events WHERE event_id % 50 = 0 GROUP BY 1, 2)"


def _marks(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", "event_type", F.col("value").alias("x")), e.where("event_id % 50 = 0").select("event_type", F.col("value").alias("x"), F.col("event_id").alias("mark"))


@register(
    "nearest_anchor",
    f"""SELECT e.event_id, e.event_type, e.value AS x, m.mark, round(abs(e.value - m.x), 6) AS distance FROM events e LEFT JOIN {_MARKS} m USING (event_type)
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.value - m.x), m.x) = 1""",
)
def nearest_anchor(spark, d):
    return joins.nearest(*_marks(spark, d), ["event_type"], "x", "mark").withColumn("distance", F.round("distance", 6))


for _name, _strict, _tol in (("asof_inclusive", False, None), ("strict_backward_asof", True, None), ("asof_tolerance", False, 2.0)):

    @register(
        _name,
        f"""SELECT e.event_id, e.event_type, e.value AS x, {'m.mark, m.x AS x_right' if _tol is None else f'CASE WHEN e.value - m.x <= {_tol} THEN m.mark END AS mark, CASE WHEN e.value - m.x <= {_tol} THEN m.x END AS x_right'}
FROM events e ASOF LEFT JOIN {_MARKS.replace('min(event_id)', 'max(event_id)')} m ON e.event_type = m.event_type AND e.value {'>' if _strict else '>='} m.x""",
    )
    def _asof(spark, d, _strict=_strict, _tol=_tol):
        return joins.asof_backward(*_marks(spark, d), ["event_type"], "x", ["mark"], _strict, _tol)


_REGIONS = [("low", 0, 10), ("mid", 10, 30), ("all", 0, 51), ("high", 40, 51)]


@register("range_region_assign", f"SELECT p_partkey, p_size, region FROM part JOIN (VALUES {', '.join(f'{r}' for r in _REGIONS)}) r(region, lo, hi) ON p_size >= lo AND p_size < hi")
def range_region_assign(spark, d):
    r = spark.createDataFrame(_REGIONS, "region string, lo int, hi int")
    return joins.range_assign(read(spark, d, "part").select("p_partkey", "p_size"), r, "p_size", "lo", "hi", 10.0).drop("lo", "hi")


@register(
    "gap_islands",
    """SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM
(SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 7200 THEN 1 ELSE 0 END AS flag FROM events)) GROUP BY 1, 2""",
)
def gap_islands(spark, d):
    e = read(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    i = cluster.gap_islands(e, ["user_id"], "s", ["event_id"], F.col("__d") > 7200)
    return i.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("anchor_rows_fold")
def anchor_rows_fold(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.col("value").alias("y"))
    return cluster.anchor_rows(e, ["user_id"], "y", "event_id", 15.0)


@register("running_centroid_rows")
def running_centroid_rows(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.col("value").alias("y"))
    return cluster.centroid_rows(e, ["user_id"], "y", "event_id", 5.0)


@register("upper_median", "SELECT p_brand, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS upper_median FROM part GROUP BY 1")
def upper_median(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(cluster.upper_median("p_retailprice").alias("upper_median"))


@register("unit_columns_repeat", "SELECT round(l_quantity) AS cx, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= greatest(2, 0.02 * (SELECT count(DISTINCT l_orderkey) FROM lineitem))")
def unit_columns_repeat(spark, d):
    l = read(spark, d, "lineitem")
    total = l.agg(F.countDistinct("l_orderkey").alias("total"))
    g = l.groupBy(F.round("l_quantity").alias("cx")).agg(F.countDistinct("l_orderkey").alias("n"))
    return g.join(F.broadcast(total)).where("n >= greatest(2, 0.02 * total)").drop("total")


@register(
    "grid_pitch_test",
    "SELECT p_brand, max(g) / min(g) AS ratio, max(g) / min(g) <= 2.5 AS is_grid FROM (SELECT p_brand, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) - p_size AS g FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE g > 0 GROUP BY 1",
)
def grid_pitch_test(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    g = read(spark, d, "part").select("p_brand", "p_size").distinct().withColumn("g", F.lead("p_size").over(w) - F.col("p_size")).where("g > 0")
    ratio = F.max("g") / F.min("g")
    return g.groupBy("p_brand").agg(ratio.alias("ratio"), (ratio <= 2.5).alias("is_grid"))


@register("row_offset_lookup", "SELECT conv_id, turn, lag(role) OVER w AS above, lead(role) OVER w AS below FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def row_offset_lookup(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("above"), F.lead("role").over(w).alias("below"))


@register(
    "text_norms",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(translate(lower(trim(regexp_replace(replace(url, '|', ' '), '[ \t\r\n]+', ' ', 'g'))), '°*', ''), '[^a-z0-9%./@ \-]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS matched,
regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM pages""",
)
def text_norms(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", T.norm_for_match(u).alias("matched"), T.slug(u).alias("slug"), T.escape_html(u).alias("html"))


@register(
    "header_canonical",
    r"""SELECT p_partkey, CASE WHEN u = '' THEN 'VALUE' WHEN u = '/ENG' THEN 'ENGINE' ELSE u END AS "column" FROM (SELECT p_partkey,
regexp_replace(regexp_replace(regexp_replace(upper(p_type || '.' || ' cyl0' || p_size), '[^A-Z0-9/.]', '', 'g'), '\.+$', ''), '^(CYL|TC|BRG|PUMP)0*([0-9]+)$', '\1\2') AS u FROM part)""",
)
def header_canonical(spark, d):
    label = F.concat(F.col("p_type"), F.lit(". cyl0"), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", T.canonical_column(label).alias("column"))


@register(
    "parse_num_debris",
    r"""WITH x AS (SELECT event_id, round(value * 100)::BIGINT AS c, event_id % 4 AS k FROM events),
t AS (SELECT event_id, k, (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS s FROM x)
SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE s::DOUBLE END AS value, k = 2 AS debris FROM t""",
)
def parse_num_debris(spark, d):
    c = F.round(F.col("value") * 100).cast("long")
    s = F.concat(F.expr("cast(cast(round(value * 100) as bigint) div 100 as string)"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, s).when(k == 1, F.concat(F.lit("("), s, F.lit(")|"))).when(k == 2, F.concat(s, F.lit("/$#"))).otherwise(F.concat(F.lit("CYL"), s))
    return read(spark, d, "events").select("event_id", N.parse_debris(raw).alias("p")).select("event_id", "p.value", "p.debris")


@register("datetime_parse", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) * 100 + month(o_orderdate) AS month_key FROM orders")
def datetime_parse(spark, d):
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "'on' yyyy-MM-dd"))
    day = N.report_date(text)
    return o.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), N.month_key(day).cast("long").alias("month_key"))


@register(
    "token_recall_match",
    """WITH a AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS alias FROM part),
s AS (SELECT p_partkey, alias, CASE WHEN lower(p_name) = alias THEN 1.0 ELSE 0.75 + 0.25 / len(list_filter(string_split(lower(p_name), ' '), lambda w: w <> '')) END AS score
FROM part JOIN a ON list_contains(string_split(lower(p_name), ' '), alias)),
r AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, alias))
SELECT p_partkey, CASE WHEN nxt IS NOT NULL AND score - nxt <= 0.001 THEN NULL ELSE alias END AS alias, round(score, 6) AS score,
CASE WHEN nxt IS NOT NULL AND score - nxt <= 0.001 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM r WHERE n = 1""",
)
def token_recall_match(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    aliases = p.select(F.substring_index(F.lower("p_name"), " ", 1).alias("alias")).distinct()
    tokens = p.select("p_partkey", "p_name", F.explode(F.array_distinct(T.label_tokens(F.col("p_name")))).alias("alias"))
    scored = tokens.join(aliases, "alias").withColumn("score", T.ordered_recall(F.col("alias"), F.col("p_name")))
    return rank.unambiguous(scored, ["p_partkey"], "score", "alias", 0.5, 0.001).withColumn("score", F.round("score", 6))


@register("ratio_match")
def ratio_match(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return grid.match_ratio(p, "p_name", "p_type")


@register(
    "audit_classify",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f = '' THEN 'OK' ELSE f END AS flags FROM (SELECT *, array_to_string(list_sort(list_filter([
CASE WHEN trim(raw) = '' THEN 'SOURCE_BLANK' END, CASE WHEN trim(raw) <> '' AND v IS NULL THEN 'EXTRACTION_FAILED' END, CASE WHEN conf < 0.6 THEN 'low_ocr_confidence' END], lambda z: z IS NOT NULL)), ';') AS f
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN ' ' WHEN l_partkey % 7 = 1 THEN 'x' ELSE '1' END AS raw,
CASE WHEN l_partkey % 7 > 1 THEN l_quantity END AS v, (l_suppkey % 101) / 100.0 AS conf FROM lineitem))""",
)
def audit_classify(spark, d):
    return audit.classify_cells(_audit_cells(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "flags")


def _audit_cells(spark, d):
    k = F.col("l_partkey") % 7
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(k == 0, " ").when(k == 1, "x").otherwise("1").alias("raw_text"),
        F.when(k > 1, F.col("l_quantity")).alias("value"), ((F.col("l_suppkey") % 101) / 100.0).alias("confidence"),
    )


@register("audit_rollup", f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM ({ORACLE['audit_classify']})) GROUP BY 1")
def audit_rollup(spark, d):
    return audit.rollup(audit.classify_cells(_audit_cells(spark, d)))


_DIFF = """SELECT s.o_orderkey, s.o_orderpriority, CASE WHEN e.k IS NULL THEN 'MISSING_VALUE' WHEN s.raw <> '' AND e.other <> '' AND s.raw <> e.other THEN 'WRONG_VALUE' ELSE 'MATCHED' END AS category
FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus AS raw FROM orders WHERE o_orderkey % 11 <> 0) s
LEFT JOIN (SELECT l_orderkey AS k, max_by(l_linestatus, l_linenumber * 10000000 + l_partkey) AS other FROM lineitem WHERE l_quantity > 20 GROUP BY 1) e ON e.k = s.o_orderkey"""


def _discrepancies(spark, d):
    status = F.when(F.col("o_orderkey") % 11 != 0, "PRESENT").otherwise("SOURCE_ABSENT")
    s = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("raw_text"), status.alias("source_status"))
    ordinal = (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ordinal")
    e = read(spark, d, "lineitem").where("l_quantity > 20").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("raw_text"), ordinal, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    # equal ordinals: the first row of the table, as the SQL has it on one thread
    return audit.diff(s, e, ["o_orderkey"], ["file", "row"])


@register("fidelity_strict", _DIFF)
def fidelity_strict(spark, d):
    return _discrepancies(spark, d).select("o_orderkey", "o_orderpriority", "category")


@register(
    "fidelity_summary_grouping_sets",
    f"SELECT category, o_orderpriority, count(*) AS n, grouping_id(category, o_orderpriority)::BIGINT AS level FROM ({_DIFF}) GROUP BY GROUPING SETS ((category), (category, o_orderpriority), ())",
)
def fidelity_summary(spark, d):
    return audit.summary(_discrepancies(spark, d), "category", "o_orderpriority")


@register(
    "union_catalog",
    """SELECT p_type, count(*) AS observations, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS p_brand, array_to_string(list_sort(list(DISTINCT p_size::VARCHAR)), ';') AS p_size
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def union_catalog(spark, d):
    l, p = read(spark, d, "lineitem").select("l_partkey"), read(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return audit.union_catalog(l.join(p, F.col("l_partkey") == F.col("p_partkey")), "p_type", ["p_brand", "p_size"])


@register("explode_json_props", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def explode_json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("page_range_expand", "SELECT page_id, unnest(list_sort(list_distinct(list_concat([page_id % 5 + 1], generate_series(page_id % 5 + 2, page_id % 5 + 4), [3])))) ::INT AS page FROM pages")
def page_range_expand(spark, d):
    a = F.col("page_id") % 5
    spec = F.concat((a + 1).cast("string"), F.lit(", "), (a + 2).cast("string"), F.lit("-"), (a + 4).cast("string"), F.lit(",3,auto"))
    return read(spark, d, "pages").select("page_id", F.explode(io.page_range(spec)).alias("page"))


@register("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return read(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


_GRID = """h(label, x) AS (VALUES ('REF', 103.0), ('CALC', 203.0), ('AVG', 303.0), ('TC1', 403.0)),
c AS (SELECT label, coalesce((lag(x) OVER w + x) / 2, x - 200) AS lo, coalesce((lead(x) OVER w + x) / 2, x + 200) AS hi, row_number() OVER w AS col_no FROM h WINDOW w AS (ORDER BY x, label)),
t AS (SELECT l_orderkey AS page, 20 * l_linenumber AS top, 100 * k + l_partkey % 7 AS "left", (CASE k WHEN 1 THEN l_quantity::INT ELSE k * 7 END)::VARCHAR AS text, l_suppkey % 101 AS conf
FROM lineitem, (VALUES (1), (2), (3), (4)) k(k) WHERE (l_partkey + k) % 5 <> 0)"""
_CELLS = f"""WITH {_GRID}, r AS (SELECT DISTINCT page, top FROM t),
x AS (SELECT page, top, label, array_to_string(list(text ORDER BY "left", text), ' ') AS raw_text, avg(conf) AS confidence FROM t JOIN c ON "left" >= lo AND "left" < hi GROUP BY 1, 2, 3)
SELECT r.page, r.top, c.col_no::INT AS col_no, c.label AS "column", raw_text, CASE WHEN regexp_matches(raw_text, '^[0-9]+$') THEN raw_text::DOUBLE END AS value, round(confidence, 4) AS confidence,
CASE WHEN raw_text IS NULL THEN 'SOURCE_BLANK' WHEN NOT regexp_matches(raw_text, '^[0-9]+$') THEN 'EXTRACTION_FAILED' ELSE 'PRESENT' END AS source_status
FROM r CROSS JOIN c LEFT JOIN x ON x.page = r.page AND x.top = r.top AND x.label = c.label"""


def _grid(spark, d):
    l = read(spark, d, "lineitem").withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    tokens = l.where("(l_partkey + k) % 5 <> 0").select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 20).alias("top"), (F.col("k") * 100 + F.col("l_partkey") % 7).alias("left"),
        F.when(F.col("k") == 1, F.col("l_quantity").cast("int")).otherwise(F.col("k") * 7).cast("string").alias("text"), (F.col("l_suppkey") % 101).alias("conf"),
    )
    heads = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(x).alias("x")) for n, x in (("REF", 103.0), ("CALC", 203.0), ("AVG", 303.0), ("TC1", 403.0))]))
    headers = tokens.select("page").distinct().select("page", heads.alias("h")).select("page", "h.label", "h.x")
    return tokens, grid.value_columns(headers)


@register("grid_cells_blank_preserved", _CELLS)
def grid_cells_blank_preserved(spark, d):
    return grid.grid_cells(*_grid(spark, d))


@register("reconstruct_diagnostics", f"""SELECT page, count(*) AS cells, round(count(*) FILTER (source_status = 'SOURCE_BLANK') / count(*), 4) AS blank_rate FROM ({_CELLS}) GROUP BY 1""")
def reconstruct_diagnostics(spark, d):
    c = grid.grid_cells(*_grid(spark, d))
    return c.groupBy("page").agg(F.count("*").alias("cells"), F.round(F.count_if(F.col("source_status") == "SOURCE_BLANK") / F.count("*"), 4).alias("blank_rate"))


@register("anti_index_refresh", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def anti_index_refresh(spark, d):
    known = read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate").join(known, "o_orderkey", "left_anti")


@register("numeric_qualifiers", "SELECT pages.page_id, array_to_string(regexp_extract_all(url, '[0-9]+'), ';') AS numbers FROM pages")
def numeric_qualifiers(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(T.numeric_qualifiers(F.col("url")), ";").alias("numbers"))
