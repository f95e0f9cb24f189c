"""Header rows and label zones: each query against its SQL, and small cases."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import headers as H
from gaugeloom.plans import catalogue, headers

from test_catalogue import DATA, con, shape  # noqa: F401


@pytest.mark.parametrize("name", headers.QUERIES_HERE)
def test_against_sql(spark, con, name):  # noqa: F811
    got = shape(catalogue.QUERIES[name](spark, DATA).toPandas())
    assert got == shape(con.sql(catalogue.ORACLE[name]).df()) and len(got) > 0


def test_header_names(spark):
    want = {
        "Ref.": "REF", "cyl 07": "CYL7", "TC003": "TC3", "BRGY": "BRG9", "T1": "TC1", "CCYL": None, "AVG/ENG.": "AVG/ENG", "temp": "VALUE",
        "RPM": "rpm", "PUMP": None, "CYL0": "CYL0", "": None, None: None, "Engine power": None, "|MCR|": "MCR",
    }
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", H.header_name(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == want


def test_header_rows(spark):
    said = {
        1: ["by", "FI*", "rpm", "CYL", "4", "MCR", "%"],
        2: ["by", "rpm", "REF", None, "XPERT"],
        3: ["by", "TC", "03", "AVG"],
        4: ["REF", "Great", "power"],
        5: [None],
    }
    rows = [(k, 10 * i, 4, w) for k, ws in said.items() for i, w in enumerate(ws)]
    t = spark.createDataFrame(rows, "page int, left int, width int, text string")
    got = [(r["page"], r["ordinal"], r["column"], r["x"]) for r in H.header_rows(t, ["page"]).orderBy("page", "ordinal").collect()]
    assert got == [
        (1, 1, "by FI*rpm", 12.0), (1, 2, "CYL4", 37.0), (1, 3, "MCR_%", 57.0),
        (2, 1, "by rpm", 7.0), (2, 2, "REF", 22.0), (2, 3, "XPERT", 37.0),  # with the word without letters before it
        (3, 1, "TC3", 17.0), (3, 2, "AVG", 32.0),
    ]
    assert H.header_rows(t.limit(0), ["page"]).count() == 0


def test_label_zones(spark):
    said = {1: ["Firing", "(mean)", "bar", "kW"], 2: ["bar"], 3: [None, " "], 4: ["SUM", "power:", "x", "bar", None]}
    rows = [(k, i, w) for k, ws in said.items() for i, w in enumerate(ws)]
    t = spark.createDataFrame(rows, "page int, left int, text string")
    shape_ = F.col("text").isin("bar", "kW")
    got = {r["page"]: (r["label"], r["unit"], r["qualifiers"]) for r in H.label_zones(t, ["page"], F.lit(False), shape_).collect()}
    # a unit's shape counts at the end of several words only, and a blank word may be that end
    assert got == {1: ("Firing bar", "kW", "(mean)"), 2: ("bar", "", ""), 3: ("", "", ""), 4: ("x bar", "", "SUM power:")}
    aligned = H.label_zones(t, ["page"], F.col("text") == "bar", F.lit(None).cast("boolean")).where("page = 2").first()
    assert (aligned["label"], aligned["unit"]) == ("", "bar")
    assert H.label_zones(t.limit(0), ["page"], F.lit(False), shape_).count() == 0
