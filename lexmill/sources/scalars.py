"""Training logs as long tables (run, tag, step, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.ordered import ordered_scan


def read_scalars(events: DataFrame) -> DataFrame:
    """An event log as scalars: the step is the row's place in its run and tag."""
    rows = events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("tag"), "event_id", "ts", "value"
    )
    numbered = ordered_scan(rows, ["run", "tag"], ["ts", "event_id"], {"step": ("row_number",)})
    return numbered.select("run", "tag", F.col("step").cast("long").alias("step"), "value")


def run_steps(events: DataFrame) -> DataFrame:
    """(run, step, tag, ts, value) with the step counted over the whole run."""
    rows = events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("tag"), "event_id", "ts", "value"
    )
    return ordered_scan(rows, ["run"], ["ts", "event_id"], {"step": ("row_number",)}).select(
        "run", F.col("step").cast("long").alias("step"), "tag", "ts", "event_id", "value"
    )


def scalar_series(scalars: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Step and value arrays per (run, tag), in chunks of at most ``chunk`` steps so
    that a very long run is several rows rather than one huge array."""
    part = F.floor((F.col("step") - 1) / chunk).alias("part")
    packed = F.array_sort(F.collect_list(F.struct("step", "value")))
    return (
        scalars.groupBy("run", "tag", part)
        .agg(packed.alias("s"))
        .select("run", "tag", "part", F.col("s.step").alias("steps"), F.col("s.value").alias("series"))
    )


def write_history(df: DataFrame, path: str) -> None:
    """Per-step history, clustered by run and step: the files' statistics let a reader of
    some runs skip the others, however many runs there are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, "run", "step").sortWithinPartitions("run", "step").write.parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
