"""A corpus pipeline over ``documents``: each stage is one operator of the llm
subpackage and works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.llm import bpe, langid, line_dedup, minmax, mixing
from gaugeloom.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without an identifiable language (und); lang becomes the predicted one."""
    named = langid.identify(docs, langid.learn(docs), lang_col="__lang", score_col="__score")
    lang = F.col("__lang").alias("lang")
    return named.where("__lang <> 'und'").select(*[lang if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines from the texts; n_chars follows."""
    out = line_dedup.drop_boilerplate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, with the smallest id (null last).

    Where ids repeat or are null every row gets a key of its own, so such rows
    are grouped by their texts too.  Texts without words are near to nothing; of
    rows with the same id and such a text one stays.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        gone = stored(minmax.near_duplicates(docs).where("NOT kept").select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id")), "pipeline-copies")
        # only rows that may be copies are shuffled
        return minmax.marked(gone, docs, "doc_id", absent=True).unionByName(minmax.marked(gone, docs, "doc_id").join(gone, "doc_id", "left_anti"))
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = minmax.near_duplicates(rows, id_col="__row").select(F.col("id").alias("__row"), "n_shingles", "component_id")
    named = rows.select("__row", "doc_id", F.md5("text").alias("digest")).join(groups, "__row")
    empty = F.col("n_shingles") == 0
    group = [
        F.when(~empty, F.col("component_id")).alias("g"),
        F.when(empty, F.struct("doc_id", "digest")).alias("h"),
    ]
    kept = named.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("m")).select("m.__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents sampled by calibrated probabilities."""
    return mixing.mix(docs).where("sampled").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: ids' and decoded bytes' digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, digests=True).drop("text")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("mixing", mixture),
    ("byte-level BPE", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
