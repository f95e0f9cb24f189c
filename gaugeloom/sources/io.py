"""Artifact scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_SCHEMA = (
    "report_id string, page int, region string, ordinal long, text string, left int, top int, width int, height int, conf double"
)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact with a declared schema; malformed records give nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """OCR tokens as JSON lines, without empty texts and negative confidences."""
    t = spark.read.schema(TOKEN_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return t.where("length(trim(text)) > 0 AND conf >= 0")


def page_range(spec: Column) -> Column:
    """'1,3-5' -> sorted distinct pages."""
    parts = F.filter(F.split(F.regexp_replace(spec, " ", ""), ","), lambda p: p.rlike("^[0-9]+(-[0-9]+)?$"))
    lo = lambda p: F.substring_index(p, "-", 1).cast("int")
    hi = lambda p: F.substring_index(p, "-", -1).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.least(lo(p), hi(p)), F.greatest(lo(p), hi(p)))))))


def export(measurements: DataFrame, path: str) -> None:
    """Long and wide forms as JSON and CSV."""
    measurements.write.mode("overwrite").json(f"{path}/measurements_json")
    measurements.write.mode("overwrite").option("header", True).csv(f"{path}/measurements_csv")


def wide(cells: DataFrame, keys: list[str], column: str, value: str, order: str, columns: list) -> DataFrame:
    """Pivot with the first non-null value by ``order``; all-null rows stay."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return cells.groupBy(*keys).pivot(column, columns).agg(first)
