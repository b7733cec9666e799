"""Ranking metrics and ROC curves, exact and without a single-task sort.

Rows are counted per (group, score). Running totals over descending scores come
from ``ordered_scan``, so the number of distinct scores is not limited by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.joins import null_safe_join
from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


def _curve(df: DataFrame, by: Sequence[str], score: str, hit: str) -> DataFrame:
    """(by..., score, pos, neg, tp, fp, p_total, n_total, next_pos, next_neg, rank),
    one row per distinct score in descending order. ``hit`` is 0 or 1."""
    by = list(by)
    grouped = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(hit)).cast("long").alias("pos"), F.sum(1 - F.col(hit)).cast("long").alias("neg")
    )
    counts = materialize(grouped.withColumn("neg_score", -F.col("score")), "scores")
    placed = ordered_scan(
        counts, by, ["neg_score"],
        {"tp": ("sum", "pos"), "fp": ("sum", "neg"), "next_pos": ("lead", "pos"), "next_neg": ("lead", "neg"), "rank": ("row_number",)},
    )
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p_total"), F.sum("neg").alias("n_total"))
    if by:
        return null_safe_join(placed, totals, by)
    row = totals.select(F.struct("*")).scalar()
    return placed.withColumn("_t", row).select("*", "_t.p_total", "_t.n_total").drop("_t")


def ranking(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by..., average_precision, auc) of 0/1 labels; AUC is null with one class."""
    c = _curve(df.select(*by, score, F.col(label).cast("int").alias("hit")), by, score, "hit")
    p, n = F.max("p_total"), F.max("n_total")
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    return c.groupBy(*by).agg(
        F.when(p == 0, F.lit(0.0)).otherwise(F.sum(step) / p).alias("average_precision"),
        (F.sum(area) / F.nullif(p * n, F.lit(0))).alias("auc"),
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return ranking(df, score, label).select("average_precision")


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return ranking(df, score, label).select("auc")


def class_scores(df: DataFrame, classes: Sequence, prob: str = "prob", label: str = "label") -> DataFrame:
    """One row per (row, class): the score of the class and whether it is the label."""
    names = F.array(*[F.lit(c) for c in classes])
    long = df.select(F.col(label).alias("_y"), F.posexplode_outer(prob).alias("_i", "score")).where("_i IS NOT NULL")
    return long.select(F.get(names, F.col("_i")).alias("class"), "score", (F.get(names, F.col("_i")) == F.col("_y")).cast("int").alias("hit"))


def _points(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., threshold, fpr, tpr) without points on a straight segment, and with
    the origin, whose threshold is the highest score plus one."""
    by = list(by)
    bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    kept = curve.where((F.col("rank") == 1) | F.col("next_pos").isNull() | bends)
    rates = [
        (F.col("fp") / F.nullif(F.col("n_total"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("p_total"), F.lit(0))).alias("tpr"),
    ]
    points = kept.select(*by, F.col("score").alias("threshold"), *rates)
    origin = curve.where(F.col("rank") == 1).select(
        *by, (F.col("score") + 1).alias("threshold"),
        F.when(F.col("n_total") > 0, F.lit(0.0)).alias("fpr"), F.when(F.col("p_total") > 0, F.lit(0.0)).alias("tpr"),
    )
    return points.unionByName(origin)


def roc_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", hit: str = "hit") -> DataFrame:
    return _points(_curve(df, by, score, hit), by)


def roc_per_class(df: DataFrame, classes: Sequence, prob: str = "prob", label: str = "label") -> DataFrame:
    """One-against-the-rest curve of every class."""
    return roc_curve(class_scores(df, classes, prob, label), ["class"])


def auc_per_class(df: DataFrame, classes: Sequence, prob: str = "prob", label: str = "label") -> DataFrame:
    return ranking(class_scores(df, classes, prob, label), "score", "hit", ["class"]).select("class", "auc")


def roc_micro(df: DataFrame, classes: Sequence, prob: str = "prob", label: str = "label") -> DataFrame:
    """Curve over all (row, class) pairs pooled."""
    return roc_curve(class_scores(df, classes, prob, label))


def roc_macro(df: DataFrame, classes: Sequence, prob: str = "prob", label: str = "label") -> DataFrame:
    """(fpr, tpr): the mean of the class curves on the union of their rates. Between
    two points a curve is linear; at a rate with several points its highest counts. One
    sweep over the knots of all curves; no curve is evaluated at the rates of another."""
    points = roc_per_class(df, classes, prob, label).where("fpr IS NOT NULL")
    knots = points.groupBy("class", "fpr").agg(F.max("tpr").alias("high"), F.min("tpr").alias("low"))
    around = ordered_scan(
        materialize(knots, "knots"), ["class"], ["fpr"],
        {"x0": ("lag", "fpr"), "y0": ("lag", "high"), "x1": ("lead", "fpr"), "y1": ("lead", "low")},
    )
    # Every class changes the sum of the curves at its own knots only: by a jump there, and
    # by another slope from there on. A class without positives has no rates and adds nothing.
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    before = zero((F.col("low") - F.col("y0")) / (F.col("fpr") - F.col("x0")))
    after = zero((F.col("y1") - F.col("high")) / (F.col("x1") - F.col("fpr")))
    jump = zero(F.col("high")) - F.when(F.col("x0").isNull(), F.lit(0.0)).otherwise(zero(F.col("low")))
    events = around.groupBy("fpr").agg(F.sum(after - before).alias("turn"), F.sum(jump).alias("jump"), F.count("high").alias("known"))
    slopes = ordered_scan(materialize(events, "events"), [], ["fpr"], {"slope": ("sum", "turn"), "x0": ("lag", "fpr")})
    rise = F.coalesce((F.col("slope") - F.col("turn")) * (F.col("fpr") - F.col("x0")), F.lit(0.0)) + F.col("jump")
    summed = ordered_scan(materialize(slopes.select("fpr", rise.alias("rise"), "known"), "rises"), [], ["fpr"], {"total": ("sum", "rise"), "seen": ("sum", "known")})
    return summed.select("fpr", F.when(F.col("seen") > 0, F.col("total") / len(classes)).alias("tpr"))


def curve_area(points: DataFrame) -> DataFrame:
    """Area under (fpr, tpr) points with distinct rates, by trapezoids."""
    steps = ordered_scan(materialize(points, "curve"), [], ["fpr"], {"x0": ("lag", "fpr"), "y0": ("lag", "tpr")})
    return steps.agg(F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2).alias("auc"))
