"""Training telemetry: histories, durations, learning-rate scans.

A single run may hold a large share of all steps, so everything that needs the
order inside a run goes through ``ordered_scan``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions.decay import decay, decay_per_n
from lexmill.functions.joins import null_safe_join
from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


def with_decay(df: DataFrame, kind: str, step: str, lr0: float, s: float = 0.5, drop: float = 1.0, name: str = "lr") -> DataFrame:
    return df.withColumn(name, decay(kind, F.col(step), lr0, s, drop))


def with_decay_per_n(df: DataFrame, kind: str, batch: str, n: int, lr0: float, s: float = 0.5, drop: float = 1.0, name: str = "lr") -> DataFrame:
    return df.withColumn(name, decay_per_n(kind, F.col(batch), n, lr0, s, drop))


def number_steps(df: DataFrame, run: str, order: Sequence[str], name: str = "step") -> DataFrame:
    """1-based place of every row in its run."""
    out = ordered_scan(df, [run], list(order), {"_n": ("row_number",)})
    return out.select(*df.columns, F.col("_n").cast("long").alias(name))


def step_history(train: DataFrame, validation: DataFrame, n: int) -> DataFrame:
    """Training steps (run, step, loss) with the i-th validation (run, i, val_loss,
    seconds) of the run at step ``i * n``."""
    placed = validation.select("run", (F.col("i") * n).alias("step"), "val_loss", "seconds")
    return train.join(placed, ["run", "step"], "left")


def epoch_timing(marks: DataFrame) -> DataFrame:
    """(run, phase, epoch, seconds) from begin and end marks (run, phase, mark, ts,
    event_id): an end is timed from the latest begin before it."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = marks.select("run", "phase", "mark", us.alias("us"), "event_id")
    scanned = ordered_scan(
        rows, ["run", "phase"], ["us", "event_id"],
        {"began": ("last", F.when(F.col("mark") == "begin", F.col("us"))), "epoch": ("sum", (F.col("mark") == "end").cast("long"))},
    )
    return scanned.where((F.col("mark") == "end") & F.col("began").isNotNull()).select(
        "run", "phase", F.col("epoch").cast("long").alias("epoch"), ((F.col("us") - F.col("began")) / 1e6).alias("seconds")
    )


def final_metric(df: DataFrame, by: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """The value at the highest step of each group."""
    return df.groupBy(*by).agg(F.max(step).alias("last_step"), F.max_by(value, step).alias("final_value"))


def smoothed_loss(df: DataFrame, beta: float = 0.98, chunk: int | None = None) -> DataFrame:
    """(run, n, loss, smooth): bias-corrected exponential average of the losses; ``n``
    counts a run's steps from 1.

    The average is a weighted sum, so steps are cut into chunks: inside a chunk it is a
    running sum of losses scaled by ``beta ** -j``. A chunk is as long as that factor
    stays a finite number (about ``600 / -ln(beta)`` steps), so what reaches past the next
    chunk is below the precision of a double and only the end of the chunk before counts.
    A shorter ``chunk`` is exact only while ``beta ** chunk`` is that small.
    """
    if not 0 <= beta < 1:
        raise ValueError("beta must be in [0, 1)")
    chunk = chunk or (max(1, int(600 / -math.log(beta))) if beta > 0 else 1)
    fade = F.lit(float(beta))
    part = F.floor((F.col("n") - 1) / chunk)
    j = (F.col("n") - 1) % chunk
    rows = df.select("run", "n", "loss", part.alias("part"), j.alias("j"), (F.col("loss") * F.pow(fade, -j)).alias("scaled"))
    w = Window.partitionBy("run", "part").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("inside", (1 - beta) * F.pow(fade, F.col("j")) * F.sum("scaled").over(w))
    ends = rows.groupBy("run", "part").agg(((1 - beta) * F.pow(fade, F.max("j")) * F.sum("scaled")).alias("carry"))
    ends = ends.select("run", (F.col("part") + 1).alias("part"), "carry")  # what the next chunk starts from
    average = F.col("inside") + F.coalesce("carry", F.lit(0.0)) * F.pow(fade, F.col("j") + 1)
    return inside.join(ends, ["run", "part"], "left").select(
        "run", "n", "loss", (average / (1 - F.pow(fade, F.col("n")))).alias("smooth")
    )


# Fixed values of a learning-rate scan: fade of the average, stop factor, first and last
# rate, updates between them, points left out at the start.
SCAN = {"beta": 0.98, "stop_factor": 4.0, "start_lr": 1e-10, "end_lr": 10.0, "updates": 3900, "skip": 10}


def lr_finder(
    df: DataFrame, beta: float = SCAN["beta"], stop_factor: float = SCAN["stop_factor"], start_lr: float = SCAN["start_lr"],
    end_lr: float = SCAN["end_lr"], updates: int = SCAN["updates"], skip: int = SCAN["skip"],
) -> DataFrame:
    """(run, n, lr, smooth) of a learning-rate scan over (run, n, loss): the scan
    stops at the first smoothed loss above ``stop_factor`` times the best one before
    it; the first ``skip`` points and the last one are left out."""
    smooth = materialize(smoothed_loss(df, beta), "smooth")
    scanned = ordered_scan(smooth, ["run"], ["n"], {"best": ("min_before", "smooth")})
    over = (F.col("n") > 1) & (F.col("smooth") > stop_factor * F.col("best"))
    stops = scanned.groupBy("run").agg(F.coalesce(F.min(F.when(over, F.col("n"))), F.max("n")).alias("stop"))
    rate = F.lit(start_lr) * F.pow(F.lit((end_lr / start_lr) ** (1.0 / updates)), F.col("n") - 1)
    return (
        null_safe_join(smooth, stops, ["run"])
        .where((F.col("n") > skip) & (F.col("n") < F.col("stop")))
        .select("run", "n", rate.alias("lr"), "smooth")
    )


def epoch_jumps(df: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Change of the value at the first step of every epoch but the first."""
    scanned = ordered_scan(df, ["run"], ["step"], {"previous": ("lag", "value")})
    first = (F.col("step") > 1) & (F.col("step") % steps_per_epoch == (1 if steps_per_epoch > 1 else 0))
    return scanned.where(first).select(
        "run", ((F.col("step") - 1) / steps_per_epoch).cast("long").alias("epoch"), "step", (F.col("value") - F.col("previous")).alias("jump")
    )
