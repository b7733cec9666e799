"""Encoded examples: three integer vectors and a label, stored as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

VECTORS = ("input_ids", "attention_mask", "token_type_ids")


def write_encoded(df: DataFrame, path: str) -> None:
    keys = [c for c in df.columns if c not in (*VECTORS, "label")]
    df.select(
        *keys,
        *[F.col(v).cast("array<int>").alias(v) for v in VECTORS],
        F.col("label").cast("long").alias("label"),
    ).write.parquet(path)


def read_encoded(spark: SparkSession, path: str, max_len: int = 128) -> DataFrame:
    """Read many files; a missing label is 0, a vector of another length is an error."""
    df = spark.read.parquet(path)
    checked = [
        F.when(F.size(v) == max_len, F.col(v))
        .otherwise(F.raise_error(F.concat(F.lit(f"{v}: expected {max_len} values, got "), F.size(v).cast("string"))))
        .alias(v)
        for v in VECTORS
    ]
    label = F.coalesce(F.col("label"), F.lit(0)).cast("long") if "label" in df.columns else F.lit(0).cast("long")
    keys = [c for c in df.columns if c not in (*VECTORS, "label")]
    return df.select(*keys, *checked, label.alias("label"))


def round_trip(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows on each side and rows that only one side has. Both sides are
    reduced to counted row hashes first, so equal rows cancel in one shuffle."""
    cols = sorted(a.columns)

    def counted(df: DataFrame, sign: int) -> DataFrame:
        row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
        return df.select(row.alias("h"), F.lit(sign).alias("side"))

    per_row = (
        counted(a, 1)
        .unionByName(counted(b, -1))
        .groupBy("h")
        .agg(F.count_if(F.col("side") == 1).alias("na"), F.count_if(F.col("side") == -1).alias("nb"))
    )
    return per_row.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_written"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("only_written"),
        F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("only_read"),
    )


def assert_round_trip(a: DataFrame, b: DataFrame) -> int:
    """Raise when the two sides differ; return the number of rows."""
    r = round_trip(a, b).first()
    if r.only_written or r.only_read:
        raise AssertionError(f"{r.only_written} rows were lost and {r.only_read} appeared")
    return r.rows_read


def instances(df: DataFrame, fields: Sequence[str] = VECTORS) -> DataFrame:
    """Prediction instances: one JSON object per row, keys in alphabetical order."""
    return df.select(
        *[c for c in df.columns if c not in (*fields, "label")],
        F.to_json(F.struct(*sorted(fields))).alias("value"),
    )


def write_instances(df: DataFrame, path: str, fields: Sequence[str] = VECTORS) -> None:
    instances(df, fields).select("value").write.text(path)
