"""Ordered scans against plain windows, with one group holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from lexmill.functions.ordered import ordered_scan, range_bucket
from lexmill.operators import profile, shape

SPECS = {
    "rn": ("row_number",), "s": ("sum", "x"), "m": ("min", "x"), "mb": ("min_before", "x"),
    "lg": ("lag", "x"), "ld": ("lead", "x"), "la": ("last", "y"), "ne": ("next", "y"),
}


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    group = F.when(i % 3 == 0, "hot").when(i % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (i % 41).cast("string")))
    return spark.range(3000).select(
        i, (i * 7919 % 3001).alias("o"), (i % 50).alias("coarse"), group.alias("g"), (i * 31 % 17).alias("x"),
        F.when(i % 5 == 0, i).alias("y"),
    )


def plain(df, by, order):
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return df.select(
        "*", F.row_number().over(w).cast("long").alias("rn"), F.sum("x").over(upto).alias("s"), F.min("x").over(upto).alias("m"),
        F.min("x").over(before).alias("mb"), F.lag("x").over(w).alias("lg"), F.lead("x").over(w).alias("ld"),
        F.last("y", True).over(upto).alias("la"), F.first("y", True).over(ahead).alias("ne"),
    )


@pytest.mark.parametrize("by,order,buckets", [([], ["o"], 8), (["g"], ["o"], 5), (["g"], ["coarse", "o"], 16), ([], ["coarse", "o"], 3), (["g"], ["o"], 2)])
def test_same_as_window(skewed, by, order, buckets):
    got = ordered_scan(skewed, by, order, SPECS, buckets).withColumn("rn", F.col("rn").cast("long"))
    want = plain(skewed, by, order)
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert got.count() == 3000


def test_ranges_are_even_and_ordered(skewed):
    for order in (["o"], ["coarse", "o"]):
        r = range_bucket(skewed, order, 8).groupBy("_range").agg(
            F.count("*").alias("n"), F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")
        ).orderBy("_range").collect()
        assert max(x.n for x in r) < 3000 / 8 * 2.5
        assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(r, r[1:]))


def test_empty_and_single(spark):
    empty = spark.range(0).withColumn("x", F.lit(1.0))
    assert ordered_scan(empty, [], ["id"], {"s": ("sum", "x")}).count() == 0
    one = spark.range(1).withColumn("x", F.lit(1.0))
    assert ordered_scan(one, [], ["id"], {"s": ("sum", "x"), "n": ("row_number",)}).collect()[0].s == 1.0


def test_index_does_not_depend_on_partitioning(spark, skewed):
    a = shape.with_index(skewed.select("id", "o").repartition(1), ["o"])
    b = shape.with_index(skewed.select("id", "o").repartition(8), ["o"])
    assert a.exceptAll(b).count() == 0
    assert sorted(r.idx for r in a.collect()) == list(range(3000))


def test_no_unpartitioned_window_over_rows(skewed):
    plan = shape.with_index(skewed, ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(400, 5.0), rng.normal(5, 2, 801)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = profile.quantiles(df, "v", qs).first().quantiles
    assert np.allclose(got, np.quantile(values, qs))
    d = profile.describe_numeric(df, "v").first()
    assert np.allclose([d["mean"], d["std"], d["min"], d["max"]], [values.mean(), values.std(ddof=1), values.min(), values.max()])


def test_histograms(spark):
    rng = np.random.default_rng(4)
    values = rng.gamma(2.0, 3.0, 700)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for bins in (50, "auto"):
        counts, edges = np.histogram(values, bins=bins)
        got = profile.histogram(df, "v", bins).orderBy("bin").collect()
        assert [r.n for r in got] == list(counts)
        assert np.allclose([r.left_edge for r in got], edges[:-1])
    flat = spark.createDataFrame([(2.0,)] * 9, "v double")
    for bins in (4, "auto"):
        got = profile.histogram(flat, "v", bins).collect()
        assert sum(r.n for r in got) == 9 and len(got) == (4 if bins == 4 else 1)


def test_ecdf_and_null_values(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    assert {(r.value, round(r.cdf, 6)) for r in profile.ecdf(df, "v").collect()} == {(1, 0.666667), (2, 1.0)}


def test_percentile_of_score_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert profile.percentile_of_score(df, "v", 3).first()[0] == 75.0  # scipy's documented example
    assert profile.percentile_of_score(df, "v", 2.5).first()[0] == 50.0
    counts = {r["column"]: r.n_null for r in profile.null_counts(spark.createDataFrame([(1, None), (None, "a")], "a int, b string")).collect()}
    assert counts == {"a": 1, "b": 1}


def test_hashed_order_needs_no_statistics(spark, skewed):
    keyed = skewed.withColumn("h", F.md5(F.col("id").cast("string")))
    got = ordered_scan(keyed, ["g"], ["h", "id"], SPECS, 6, hashed=True).withColumn("rn", F.col("rn").cast("long"))
    want = plain(keyed, ["g"], ["h", "id"])
    assert got.select(want.columns).exceptAll(want).count() == 0
    sizes = [r["count"] for r in range_bucket(keyed, ["h"], 6, True).groupBy("_range").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 700


def test_rows_of_a_grouped_scan_move_once(spark):
    rows = spark.range(1000).selectExpr("id % 7 as g", "id", "repeat('x', 100) as payload")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scanned = ordered_scan(rows, ["g"], ["id"], {"n": ("row_number",)})
        plan = scanned._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # the rows once; then one row per group and range: partial totals, their scan, the carries
    assert len(moves) == 4 and all("_group_key" in line for line in moves)
    assert plan.index("Window [row_number()") < plan.index("Exchange hashpartitioning")
    assert scanned.count() == 1000
