"""Preparation of tables with mixed columns for a classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from lexmill.functions.ordered import ordered_scan
from lexmill.operators.shape import union_tagged
from lexmill.session import materialize


def category_codes(df: DataFrame, lists: dict[str, Sequence[str]]) -> DataFrame:
    """Replace categories by their place in a fixed list; null or unknown is -1."""
    codes = {
        c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1, F.lit(-1)).cast("int")
        for c, values in lists.items()
    }
    return df.withColumns(codes)


def numeric_to_float(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Integer columns as 32-bit floats."""
    ints = (T.IntegerType, T.LongType)
    return df.withColumns(
        {f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, ints) and f.name not in skip}
    )


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType)]


def standardize(train: DataFrame, evaluation: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Z-scores with the mean and sample deviation of both parts together; the
    result is the union with a ``part`` column, so either part is one filter."""
    both = union_tagged({"train": train, "eval": evaluation})
    cols = list(cols or float_columns(both))
    stats = both.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]
    )
    row = stats.select(F.struct("*")).scalar()
    scaled = both.withColumn("_s", row)
    return scaled.withColumns({c: (F.col(c) - F.col(f"_s.m_{c}")) / F.col(f"_s.s_{c}") for c in cols}).drop("_s")


def prepare_tabular(
    train: DataFrame, evaluation: DataFrame, key: str, unused: Sequence[str], lists: dict[str, Sequence[str]], label: str
) -> DataFrame:
    """Drop unused columns, code categories, cast integers, take the label out and
    standardise: (key, features..., label FLOAT, part)."""

    def prepared(df: DataFrame) -> DataFrame:
        floats = numeric_to_float(df.drop(*unused), skip=[key])
        return category_codes(floats, lists).withColumn(label, F.col(label).cast("float"))

    a, b = prepared(train), prepared(evaluation)
    return standardize(a, b, [c for c in float_columns(a) if c != label])


def class_table(df: DataFrame, label: str) -> DataFrame:
    """(class, code): the distinct labels with their 0-based place in order."""
    found = materialize(df.where(F.col(label).isNotNull()).select(F.col(label).alias("class")).distinct(), "classes")
    placed = ordered_scan(found, [], ["class"], {"_n": ("row_number",)})
    return placed.select("class", (F.col("_n") - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, label: str, classes: DataFrame | None = None, out: str = "code") -> DataFrame:
    """0-based place of the label in alphabetical order; null for unknown labels. The classes
    are a table, however many there are."""
    known = (class_table(df, label) if classes is None else classes).select(F.col("class").alias(label), F.col("code").alias(out))
    return df.join(known, label, "left").select(*df.columns, out)


def decode_labels(df: DataFrame, code: str, classes: DataFrame, out: str = "label") -> DataFrame:
    known = classes.select(F.col("code").alias(code), F.col("class").alias(out))
    return df.join(known, code, "left").select(*df.columns, out)


def with_class_weight(df: DataFrame, weights: dict, label: str = "label", default: float = 1.0) -> DataFrame:
    """Attach the weight of the row's class, for use as a weight column."""
    weight = F.lit(float(default))
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, F.lit(float(w))).otherwise(weight)
    return df.withColumn("weight", weight)
