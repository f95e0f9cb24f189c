"""Line dedup against its SQL on lines that differ in the spaces around them."""

import duckdb

from gaugeloom.llm import line_dedup, queries


def test_spaces_around_lines(spark, tmp_path):
    c = duckdb.connect()
    blank = [chr(i) for i in (9, 11, 12, 13, 0x1C, 0x85, 0x200B, 0x2028, 0xFEFF)] + list(line_dedup.SPACES)
    rows = [(i, f"own {i}\n{b}All rights　reserved{b}\n{b}", f"s{i}") for i, b in enumerate(blank)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(line_dedup.ORACLE_SQL).fetchall()
    got = queries.op2_line_dedup(spark, str(tmp_path)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_removed"] for r in got) == len(line_dedup.SPACES)
