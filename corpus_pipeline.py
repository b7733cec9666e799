"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.columns import neutral_names
from lexmill.llm.linededup import dedup_lines
from lexmill.llm.mixing import mix
from lexmill.llm.packing import pack
from lexmill.llm.quality import judge_quality
from lexmill.llm.simhash import one_per_group
from lexmill.session import scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
USED = ("doc_id", "text", "source", "n_chars")


def same_columns(stage: Stage) -> Stage:
    """Let a stage see columns it does not use under neutral names, so that no name of an
    input clashes with one of its own, and give them back as they were."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = neutral_names(docs.columns, USED)
        return stage(spark, docs.toDF(*neutral), sf_dir).select(*neutral).toDF(*docs.columns)

    return run_stage


@same_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and repeat little of themselves."""
    return judge_quality(docs).where("_kept").select(*docs.columns)


@same_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line runs seen before; a document with no line left goes."""
    rows = dedup_lines(docs)
    left = rows.where("_n_deleted < _n_lines or _n_lines = 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("_n_deleted") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


@same_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id; where no row has one, the row whose text
    digest is smallest."""
    return one_per_group(docs)


@same_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, range-sorted by training position: the
    order in which the rows are written is the curriculum."""
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. The order of the written rows is kept
    in ranges: sequence ids ascend with it. Rows that were not read from files have no order."""
    bpe = public_tokenizers.path("word_bpe_49k.json")
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        placed = docs.select(
            "doc_id", "text", F.when(part != "", part).cast("long").alias("part"),
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"),
        )
    except AnalysisException:  # no file metadata
        return pack(docs, bpe)
    return pack(placed, bpe, order=["part", "file", "row"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: Fingerprint groups and tokenization have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
