"""Queries against their SQL on tables with nulls and ties, and on large pages."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import audit, forms, layout
from gaugeloom.plans import catalogue
from gaugeloom.plans import forms as plans, geometry  # noqa: F401  they register their queries

from test_catalogue import shape


def both(spark, at, name, **tables):
    """The shapes of a query's rows and of its SQL's, on one thread, over small tables (rows as SQL)."""
    c = duckdb.connect(config={"threads": 1})
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{at}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS FROM '{at}/{t}.parquet'")
    return shape(catalogue.QUERIES[name](spark, str(at)).toPandas()), shape(c.sql(catalogue.ORACLE[name]).df())


ORDERS = "SELECT k::BIGINT AS o_orderkey, 'F' AS o_orderstatus, 'p' || k % 2 AS o_orderpriority FROM unnest([1, 2, 3, 4, 5, 6, NULL]) u(k)"
LINES = """SELECT k::BIGINT AS l_orderkey, line::INT AS l_linenumber, part::BIGINT AS l_partkey, 30.0::DOUBLE AS l_quantity, status::VARCHAR AS l_linestatus
FROM (VALUES (1, 7, 5, 'F'), (1, 7, 5, 'O'), (2, 7, 5, 'O'), (2, 7, 5, 'F'), (3, 1, 5, 'F'), (3, 7, 5, NULL), (3, 2, 5, 'O'), (4, 7, NULL, 'O'), (4, 1, 1, 'F'), (5, 1, 1, NULL), (NULL, 1, 1, 'O')) v(k, line, part, status)"""


@pytest.mark.parametrize("name", ["fidelity_strict", "fidelity_summary_grouping_sets"])
def test_fidelity_with_ties_and_nulls(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, orders=ORDERS, lineitem=LINES)
    assert got == want


@pytest.mark.parametrize("orders", ["false", "o_orderkey > 99", "o_orderkey IS NULL"])
def test_fidelity_summary_of_no_rows_has_a_total(spark, tmp_path, orders):
    got, want = both(spark, tmp_path, "fidelity_summary_grouping_sets", orders=f"FROM ({ORDERS}) WHERE {orders}", lineitem=LINES)
    assert got == want
    assert got[0] == [("NULL", "3", "0", "NULL")]


def test_summary_keeps_groups_of_nulls(spark):
    rows = spark.createDataFrame([("x", None), (None, None), (None, "p")], "a string, b string")
    got = sorted(map(tuple, audit.summary(rows, "a", "b").collect()), key=repr)
    assert got == sorted([("x", None, 1, 1), (None, None, 2, 1), ("x", None, 1, 0), (None, None, 1, 0), (None, "p", 1, 0), (None, None, 3, 3)], key=repr)


def test_field_runs_with_nulls(spark, tmp_path):
    lines = "SELECT page::BIGINT AS l_orderkey, line::INT AS l_linenumber, part::BIGINT AS l_partkey FROM (VALUES (1, 1, 2), (1, 2, NULL), (1, 3, 5), (1, NULL, 10), (1, NULL, 7), (2, 1, 5), (2, NULL, 2), (NULL, 1, 2)) v(page, line, part)"
    got, want = both(spark, tmp_path, "field_runs", lineitem=lines)
    assert got == want


def test_field_runs_tied_tokens_have_one_order(spark):
    tied = [(1, 0, 10, "a"), (1, 20, 10, "b"), (1, 40, 10, "c"), (1, 60, 8, "5"), (1, 60, 30, "5"), (1, 100, 9, "bar")]
    t = spark.createDataFrame(tied, "k int, left int, width int, text string")
    for rows in (t.coalesce(1), t.coalesce(1).sortWithinPartitions(F.desc("width"))):
        got = forms.field_runs(rows, ["k"], F.col("text") == "5", F.col("text") == "bar", least=1.0, ratio=1.0).orderBy("run").collect()
        assert [(r["label"], r["value"]) for r in got] == [("a b c bar", "5 5")]


def plan(df):
    return df._jdf.queryExecution().toString()


def adopted(rows, titles, most=40.0):
    """Adopted titles of one page's rows by a plain loop."""
    free, got = sorted(titles), []
    for top, bottom, label in sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or "")):
        near = [(max(t - bottom, top - b), i) for i, (t, b, _) in enumerate(free)]
        near = [x for x in near if x[0] <= most] if not (label or "").strip() else []
        got.append((top, bottom, label, free.pop(min(near)[1])[2] if near else None))
    return got


def test_titles_are_adopted_in_batches_of_pages(spark):
    rnd = random.Random(3)
    rows = {k: [(float(t), float(t + rnd.randrange(30)), rnd.choice([None, " ", "own"])) for t in rnd.choices(range(900), k=n)] for k, n in [(1, 3000), *((k, k % 7) for k in range(2, 300))]}
    titles = {k: [(float(t), float(t + rnd.randrange(30)), f"T{i}") for i, t in enumerate(rnd.choices(range(900), k=len(v)))] for k, v in rows.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = forms.adopt_titles(
            spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "k int, top double, bottom double, label string"),
            spark.createDataFrame([(k, *r) for k, v in titles.items() for r in v], "k int, top double, bottom double, title string"), ["k"]
        )
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(((k, *r) for k, v in rows.items() for r in adopted(v, titles[k])), key=repr)
    assert "InPandas" not in plan(df)  # one call a page took minutes on 150,000 pages


def test_titles_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5.0, None), (1, 0.0, None, None), (1, 0.0, 5.0, None), (None, 0.0, 5.0, None)], "k int, top double, bottom double, label string")
    titles = spark.createDataFrame([(1, 900.0, 910.0, "far", None), (1, 8.0, 9.0, "a", None), (1, None, 9.0, "x", None), (None, 8.0, 9.0, "y", None)], "k int, top double, bottom double, title string, more string")
    got = forms.adopt_titles(rows, titles, ["k"]).collect()
    assert sorted(((r["k"], r["top"], r["bottom"], r["adopted"]) for r in got), key=repr) == sorted([(1, None, 5.0, None), (1, 0.0, None, None), (1, 0.0, 5.0, "a"), (None, 0.0, 5.0, None)], key=repr)


def test_schema_map_in_batches_of_rows(spark):
    leaves = [(k, x, float(v)) for k in range(300) for x, v in (("REF", 0), ("a", 11 + k % 3), ("b", 19), ("AVG", 30))] + [(300, "a", 1.0), (301, "AVG", None), (301, "REF", 1.0), (301, "a", 2.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = layout.schema_map(spark.createDataFrame(leaves, "k int, label string, x double"), ["k"], ["REF", "CALC", "MEAS", "AVG"])
        got = sorted(((r["k"], r["column"], r["label"], r["x"]) for r in df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, c, x, float(v)) for k in range(300) for c, x, v in (("REF", "REF", 0), ("CALC", "a", 11 + k % 3), ("MEAS", "b", 19), ("AVG", "AVG", 30))]
    assert got == sorted([*want, (301, "REF", "REF", 1.0), (301, "AVG", "AVG", None)], key=repr)
    assert "InPandas" not in plan(df)  # one call a row took minutes on 150,000 rows
