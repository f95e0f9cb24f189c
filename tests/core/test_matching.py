"""Matching and report queries against their SQL, and matching by brute force."""

import glob
import os
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import joins, matching, reports
from gaugeloom.plans import catalogue, extended  # noqa: F401  registers its queries

from test_catalogue import DATA, shape

NAMES = [n for n, f in vars(extended).items() if n in catalogue.ORACLE and getattr(f, "__module__", "") == extended.__name__]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    assert shape(catalogue.QUERIES[name](spark, DATA).toPandas()) == shape(con.sql(catalogue.ORACLE[name]).df())


def test_label_score(spark):
    pairs = [("Sea water temp", "sea water temp"), ("Seawater temp 12", "Sea water temp"), ("temp", "Sea water temp"), ("x y", "a b"), ("", "a"), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, label string, alias string")
    got = [r[0] for r in df.orderBy("i").select(matching.label_score(F.col("label"), F.col("alias"))).collect()]
    assert got[:4] == [1.0, 1.0, 0.0, 0.0] and got[4] == 0.0


def test_match_text(spark):
    index = spark.createDataFrame([(1, "fuel oil"), (2, "sea water temp"), (3, "ab")], "field int, alias string")
    texts = ["Fuel  oil", "the fuel oil mass", "sea watr temp", "nothing", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["field"], r["score"]) for r in matching.match_text(rows, "text", index, "field").collect()}
    ratio = round(SequenceMatcher(None, "sea watr temp", "sea water temp").ratio(), 6)
    assert got == {0: (1, 1.0), 1: (1, round(0.8 + 0.19 * 8 / 17, 6)), 2: (2, ratio), 3: (None, 0.0), 4: (None, 0.0), 5: (None, 0.0)}


def test_joins_of_odd_rows(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", 3.0)], "k string, x double")
    right = spark.createDataFrame([("a", 0.5, 7), ("a", 0.5, 9), (None, 1.0, 8), ("a", None, 1)], "k string, x double, p int")
    got = sorted(((r["k"], r["x"], r["p"]) for r in joins.asof_backward(left, right, ["k"], "x", ["p"]).collect()), key=str)
    assert got == sorted([("a", 1.0, 9), ("a", None, None), (None, 2.0, 8), ("b", 3.0, None)], key=str)
    near = sorted(((r["k"], r["x"], r["p"]) for r in joins.nearest(left, right, ["k"], "x", "p").collect()), key=str)
    assert near == sorted([("a", 1.0, 7), ("a", None, None), (None, 2.0, 8), ("b", 3.0, None)], key=str)
    assert joins.nearest(left.limit(0), right, ["k"], "x", "p").count() == 0
    assert joins.asof_backward(left, right.limit(0), ["k"], "x", ["p"]).where("p IS NULL").count() == 4


def test_nearest_of_one_large_key(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("x"))
    right = spark.range(40).select(F.lit(1).alias("k"), (F.col("id") * 100.0 + 3).alias("x"), F.col("id").alias("p"))
    got = {r["x"]: r["p"] for r in joins.nearest(left, right, ["k"], "x", "p").collect()}
    assert got == {float(x): min(range(40), key=lambda p: (abs(p * 100 + 3 - x), p)) for x in range(4000)}


def test_markdown(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    assert reports.markdown(df, "T").splitlines() == ["# T", "", "| name | n |", "|---|---|", "| a |  |", "| b | 2 |"]
