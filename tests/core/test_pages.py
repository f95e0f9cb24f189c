"""Band classes, recording times and header anchors: each query against its SQL, and small cases."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import pages as P
from gaugeloom.plans import catalogue, pages

from test_catalogue import DATA, con, shape  # noqa: F401


@pytest.mark.parametrize("name", pages.QUERIES_HERE)
def test_against_sql(spark, con, name):  # noqa: F811
    got = shape(catalogue.QUERIES[name](spark, DATA).toPandas())
    assert got == shape(con.sql(catalogue.ORACLE[name]).df()) and len(got) > 0


def test_bands(spark):
    rows = [
        ("h", 0, 60, 0, "REF"), ("h", 500, 60, 0, "CYL"), ("h", 565, 20, 0, "4"), ("h", 900, 60, 0, "AVG"),
        ("d", 0, 80, 40, "Engine"), ("d", 600, 40, 40, "12.5"),
        ("t", 0, 80, 80, "Reading"), ("t", 100, 80, 80, "list"),
        ("n", 700, 40, 120, "7"), ("l", 0, 90, 140, "Engine power"), ("s", 5, 4, 160, "|"), ("z", 5, 4, 180, None),
    ]
    t = spark.createDataFrame([(1, b, x, w, y, 16, s) for b, x, w, y, s in rows], "page int, band string, left int, width int, top int, height int, text string")
    got = {r["band"]: r["row_type"] for r in P.band_classes(t, ["page"]).collect()}
    assert got == {"h": "header", "d": "data", "t": "title", "n": "data", "l": "data", "s": "separator", "z": "separator"}
    assert P.band_classes(t.limit(0), ["page"]).count() == 0


def test_recording_time(spark):
    rows = {1: "Date 4/5/24 10 : 34", 2: "1/2/2025 21:40 STW 19.00", 3: "21:40 only", 4: "3/4/25 0 : 34", 5: "3/4/25 19.00", 6: "3/4/25 08:00 5/6/25 09:30"}
    t = spark.createDataFrame([(k, i, w) for k, s in rows.items() for i, w in enumerate(s.split())] + [(7, 0, None)], "row int, left int, text string")
    got = {r["row"]: r["recorded"] for r in P.recording_time(t, ["row"]).collect()}
    assert got == {1: "2024-04-05 10:34", 2: "2025-01-02 21:40", 3: None, 4: "2025-03-04", 5: "2025-03-04", 6: "2025-05-06 09:30", 7: None}


def test_anchors(spark):
    near, far = [("REF", 3.0), ("CYL1", 101.0), ("CYL2", 152.0)], [("REF", 40.0), ("BRG1", 7.0), ("BRG2", 8.0), ("BRG3", 9.0)]
    rows = [(1, 0, "REF", 0.0), (1, 0, "TC2", 150.0)] + [(1, 2, c, x) for c, x in near] + [(1, 1, c, x) for c, x in far]
    h = spark.createDataFrame(rows, "page int, header int, column string, x double")
    got = P.sibling_anchors(h, ["page"], ["REF", "TC1", "TC2", "TC3"], ["REF"], F.col("header") == 0).collect()
    assert {(r["column"], r["x"], r["filled"]) for r in got} == {("REF", 0.0, False), ("TC2", 150.0, False), ("TC1", 101.0, True)}
