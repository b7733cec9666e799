"""Texts out to a translation service in numbered batches, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.functions.text import strip_newlines


def number_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Add ``batch`` and the position ``pos`` inside it, in key order."""
    indexed = ordered_scan(df, [], [key], {"_i": ("row_number",)})
    index = F.col("_i") - 1
    return indexed.select(
        *df.columns, F.floor(index / size).alias("batch"), (index % size).alias("pos")
    )


def export_translation_batches(df: DataFrame, key: str, text: str, size: int, path: str) -> None:
    """Lines ``batch <tab> line number <tab> text`` in key order. Batches share files and
    keep together in them, so that millions of batches are not millions of folders."""
    rows = number_batches(df, key, size).select("batch", "pos", strip_newlines(text).alias("value"))
    write_lines(rows.select("batch", F.col("pos").alias("line_no"), "value"), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (batch, line_no, value) as text."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartitionByRange(parts, "batch", "line_no").sortWithinPartitions("batch", "line_no")
    placed.select(F.concat_ws("\t", F.col("batch").cast("string"), F.col("line_no").cast("string"), F.coalesce("value", F.lit(""))).alias("value")).write.text(path)


def read_translated_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their batch and place: (batch, line_no, value); tabs in the text stay."""
    piece = F.split("value", "\t", 3)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.get(piece, F.lit(0)).cast("long").alias("batch"), F.get(piece, F.lit(1)).cast("long").alias("line_no"), F.get(piece, F.lit(2)).alias("value")
    )


def import_translations(source: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """Attach translated lines to their source rows.

    ``source`` has (batch, pos, ...) from ``number_batches``; ``lines`` has (lang,
    batch, line_no, value). Services answer with blank lines between items, so
    blanks are dropped before lines are counted. A batch holds at most ``size``
    items, which bounds each counting group; lines beyond that are left out.
    """
    from pyspark.sql import Window

    text = strip_newlines("value")
    kept = lines.select("lang", "batch", "line_no", text.alias("translation")).where(F.trim(text) != "")
    w = Window.partitionBy("lang", "batch").orderBy("line_no")
    placed = kept.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).where(F.col("pos") < size).drop("line_no")
    return source.join(placed, ["batch", "pos"])
