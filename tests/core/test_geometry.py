"""Layout and record operators: each query against its SQL, and small cases."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import layout, records
from gaugeloom.plans import catalogue, geometry

from test_catalogue import DATA, con, shape  # noqa: F401


@pytest.mark.parametrize("name", [n for n in geometry.QUERIES_HERE if n in catalogue.ORACLE])
def test_against_sql(spark, con, name):  # noqa: F811
    assert shape(catalogue.QUERIES[name](spark, DATA).toPandas()) == shape(con.sql(catalogue.ORACLE[name]).df())


def test_schema_map(spark):
    leaves = [(1, "MCR", 100.0), (1, "x", 205.0), (1, "y", 320.0), (1, "ENGINE", 400.0), (1, "z", 500.0), (2, "a", 1.0), (3, "ENGINE", 5.0), (3, "MCR", 5.0)]
    got = layout.schema_map(spark.createDataFrame(leaves, "k int, label string, x double"), ["k"], ["MCR", "A", "B", "ENGINE", "C"]).collect()
    assert {(r["k"], r["column"], r["label"]) for r in got} == {(1, "MCR", "MCR"), (1, "A", "x"), (1, "B", "y"), (1, "ENGINE", "ENGINE"), (3, "MCR", "MCR"), (3, "ENGINE", "ENGINE")}


def test_packed_and_absent(spark):
    t = spark.createDataFrame([(1, 1, 30.0, 91), (1, 2, 46.8, 96), (1, 3, 50.0, 10), (1, 4, 30.0, 99), (2, 1, 46.1, 90)], "k int, o int, value double, conf int")
    assert [r["value"] for r in records.packed(t, ["k"], ["o"]).collect()] == [46.8]
    got = records.fill_schema(t.where("k = 2"), ["k"], ["o"], ["REF", "CALC"]).orderBy("column").collect()
    assert [(r["column"], r["value"], r["source_status"]) for r in got] == [("CALC", None, "SOURCE_ABSENT"), ("REF", 46.1, "PRESENT")]


def test_reading_pages(spark):
    rows = [(r, p, "a Reading list" if p in hits else None) for r, hits in ((1, {1, 3, 5}), (2, {2}), (3, {4}), (4, set())) for p in range(1, 5 if r != 1 else 6)]
    got = records.reading_pages(spark.createDataFrame(rows, "report int, page int, text string")).orderBy("report").collect()
    assert [(r["n_hits"], r["first_page"], r["second_page"]) for r in got] == [(2, 3, 5), (1, 2, 3), (1, 3, 4), (0, 3, 4)]


def test_token_class_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("1.5",), ("kW",)], "v string")
    assert [r[0] for r in df.select(layout.token_class(F.col("v"), ["kw"])).collect()] == [None, "artifact", "number", "unit"]
