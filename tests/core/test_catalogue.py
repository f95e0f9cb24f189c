"""Every catalogue query against its SQL, and small cases of the operators."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import numbers as N
from gaugeloom.functions import text as T
from gaugeloom.operators import cluster, joins, query, rank
from gaugeloom.plans import catalogue
from gaugeloom.sources import io

DATA = "/root/testdata/sf0.001"


def shape(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else f"{v:.6g}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.itertuples(index=False))), sorted(df.columns)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, con, name):
    assert shape(catalogue.QUERIES[name](spark, DATA).toPandas()) == shape(con.sql(catalogue.ORACLE[name]).df())


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_numbers(spark):
    got = one(spark, ["CYL10", "TC3", "stable", "RPM84", "21:", "10", "-2.5)", "30/$", None, "", "1,5"], lambda c: N.parse_debris(c)["value"])
    assert got == [None, None, None, None, None, 10.0, -2.5, 30.0, None, None, 1.5]
    assert one(spark, ["a 12.5 b", "4/15/2025", "21:40", "x"], N.first_number) == [12.5, None, None, None]
    assert one(spark, ["610)", "61.0", "x1"], N.prefix_number) == [610.0, 61.0, None]
    assert [str(x) for x in one(spark, ["on 2025-04-15", "4/5/25", "12/31/2024", "25.0"], N.report_date)] == ["2025-04-15", "2025-04-05", "2024-12-31", "None"]


def test_text(spark):
    assert one(spark, ["Cyl 07.", "tc3", None, "/eng", "ref"], T.canonical_column) == ["CYL7", "TC3", "VALUE", "ENGINE", "REF"]
    assert one(spark, ["a | b|c", None], T.clean) == ["a b c", None]
    assert one(spark, ["<a&\"b\">"], T.escape_html) == ["&lt;a&amp;&quot;b&quot;&gt;"]


def test_page_range(spark):
    assert one(spark, ["1,3-5", "2, 2,1", "auto", "5-3"], io.page_range) == [[1, 3, 4, 5], [1, 2], [], [3, 4, 5]]


def test_clusters(spark):
    df = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate([0, 10, 14, 16, 40])], "k int, i int, y double")
    assert [r["row_id"] for r in cluster.anchor_rows(df, ["k"], "y", "i", 15.0).orderBy("i").collect()] == [0, 0, 0, 1, 2]
    assert [r["row_id"] for r in cluster.centroid_rows(df, ["k"], "y", "i", 5.0).orderBy("i").collect()] == [0, 1, 1, 1, 2]


def test_order_and_partitioning_do_not_matter(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", F.col("value").alias("y"))
    a = cluster.anchor_rows(e, ["user_id"], "y", "event_id", 15.0).toPandas()
    b = cluster.anchor_rows(e.orderBy(F.rand(1)).repartition(7), ["user_id"], "y", "event_id", 15.0).toPandas()
    assert shape(a) == shape(b)


def test_absent_is_not_blank(spark):
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cells = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, value double")
    got = {r["k"]: r["source_status"] for r in joins.fill_absent(grid, cells, ["k"], "value").collect()}
    assert got == {"a": "PRESENT", "b": "SOURCE_BLANK", "c": "SOURCE_ABSENT"}


def test_ambiguity(spark):
    s = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.9), (2, "x", 0.8), (2, "y", 0.3), (3, "x", 0.2)], "k int, n string, s double")
    got = {r["k"]: (r["n"], r["status"]) for r in rank.unambiguous(s, ["k"], "s", "n", 0.5, 0.001).collect()}
    assert got == {1: (None, "AMBIGUOUS"), 2: ("x", "MATCHED"), 3: (None, "NO_MATCH")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "report string, field string, value double, ordinal long")
    assert query.aggregate_field(none, ["max"]).count() == 0
    assert query.extreme_sources(none, True).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
