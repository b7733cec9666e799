"""Ordered computations that never put one group into one task.

A window over a whole table, or over one group that holds a third of it, runs in
a single task. ``ordered_scan`` gives the same results from three parallel steps:

1. cut the order key into ranges of about equal row count (``range_bucket``);
2. reduce every (group, range) to one row and scan those few rows in order;
3. run the window inside each (group, range) and add what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BUCKET, GROUP = "_range", "_group_key"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _bounds(df: DataFrame, order: Sequence[str], buckets: int) -> Column:
    """Sorted array of at most ``buckets - 1`` cut points, as a scalar subquery."""
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, _NUMERIC):
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        return df.agg(F.percentile_approx(order[0], shares, 20 * buckets)).scalar()
    # Composite or text keys: about 32 sampled keys per range. The sample only
    # places the cut points; it does not touch the result.
    key = F.struct(*order)
    every = df.agg(F.greatest(F.lit(1).cast("long"), F.expr(f"count(1) div {32 * buckets}"))).scalar()
    sample = df.where(F.pmod(F.xxhash64(*order), every) == 0).agg(F.array_sort(F.collect_list(key)).alias("s"))
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(buckets)).cast("int")),
    )
    return sample.select(F.filter(picks, lambda b: b.isNotNull())).scalar()


def range_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None, hashed: bool = False) -> DataFrame:
    """Add ``_range``: how many cut points are at or below the row's key. Any cut
    points give right results; good ones give even ranges. ``hashed`` says that the
    first order column is an md5 text, whose even cut points need no look at the data."""
    order = list(order)
    buckets = buckets or _default_buckets(df)
    if hashed:
        head = F.conv(F.substring(order[0], 1, 8), 16, 10).cast("long")
        return df.withColumn(BUCKET, F.coalesce(F.floor(head * buckets / 2**32).cast("int"), F.lit(0)))
    key = F.col(order[0]) if len(order) == 1 and isinstance(df.schema[order[0]].dataType, _NUMERIC) else F.struct(*order)
    df = df.withColumn("_cuts", _bounds(df, order, buckets)).withColumn("_key", key)
    steps = [2**i for i in reversed(range(max(1, buckets.bit_length())))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col("_key"), at + step).otherwise(at),
    )
    # never null, so that the join on the range adds no filter that computes it again
    return df.withColumn(BUCKET, F.coalesce(found, F.lit(0))).drop("_cuts", "_key")


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple],
    buckets: int | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Add one column per entry of ``specs``: name -> (kind, column).

    kinds: ``row_number`` (1-based), ``sum`` / ``min`` (running, row included),
    ``min_before`` (row excluded), ``lag``, ``lead``, ``last`` (latest non-null up
    to the row), ``next`` (first non-null from the row on). ``order`` is ascending
    and must be unique inside a group.

    The input is read three times (cut points, range totals, rows), the first two with
    few columns: pass a stored table, or a ``materialize``d one when it is costly.
    """
    by, order = list(by), list(order)
    rows = range_bucket(df, order, buckets, hashed).withColumn(GROUP, F.struct(*by) if by else F.lit(0))
    key = F.struct(*order)
    inside = Window.partitionBy(GROUP, BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = Window.partitionBy(GROUP).orderBy(BUCKET)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    after = ranges.rowsBetween(1, Window.unboundedFollowing)

    aggs, carries, locals_, finals = [], [], [], []
    for i, (name, spec) in enumerate(specs.items()):
        kind = spec[0]
        c = (F.col(spec[1]) if isinstance(spec[1], str) else spec[1]) if len(spec) > 1 else F.lit(1)
        part, carry, own, edge = f"_part{i}", f"_carry{i}", f"_own{i}", f"_edge{i}"
        at_edge = None
        if kind == "row_number":
            aggs.append(F.count(F.lit(1)).alias(part))
            carries.append(F.coalesce(F.sum(part).over(before), F.lit(0)).alias(carry))
            local, out = F.row_number().over(inside), F.col(own) + F.col(carry)
        elif kind == "sum":
            aggs.append(F.sum(c).alias(part))
            carries.append(F.coalesce(F.sum(part).over(before), F.lit(0)).alias(carry))
            local, out = F.coalesce(F.sum(c).over(upto), F.lit(0)), F.col(own) + F.col(carry)
        elif kind in ("min", "min_before"):
            aggs.append(F.min(c).alias(part))
            carries.append(F.min(part).over(before).alias(carry))
            frame = upto if kind == "min" else inside.rowsBetween(Window.unboundedPreceding, -1)
            local, out = F.min(c).over(frame), F.least(F.col(own), F.col(carry))
        elif kind == "lag":
            aggs.append(F.max_by(c, key).alias(part))
            carries.append(F.lag(part).over(ranges).alias(carry))
            at_edge = F.row_number().over(inside) == 1
            local, out = F.lag(c).over(inside), F.when(F.col(edge), F.col(carry)).otherwise(F.col(own))
        elif kind == "lead":
            aggs.append(F.min_by(c, key).alias(part))
            carries.append(F.lead(part).over(ranges).alias(carry))
            at_edge = F.lead(F.lit(1)).over(inside).isNull()
            local, out = F.lead(c).over(inside), F.when(F.col(edge), F.col(carry)).otherwise(F.col(own))
        elif kind == "last":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), key)).alias(part))
            carries.append(F.last(part, True).over(before).alias(carry))
            local, out = F.last(c, True).over(upto), F.coalesce(F.col(own), F.col(carry))
        elif kind == "next":
            aggs.append(F.min_by(c, F.when(c.isNotNull(), key)).alias(part))
            carries.append(F.first(part, True).over(after).alias(carry))
            ahead = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            local, out = F.first(c, True).over(ahead), F.coalesce(F.col(own), F.col(carry))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
        locals_.append(local.alias(own))
        if at_edge is not None:
            locals_.append(at_edge.alias(edge))
        finals.append(out.alias(name))

    totals = rows.groupBy(GROUP, BUCKET).agg(*aggs)
    carried = totals.select(GROUP, BUCKET, *carries)
    # The window comes first: the join then finds the rows already dealt by (group, range)
    # and only the carries, one row per group and range, are exchanged for it. A null
    # group is a struct with a null field, which is equal to itself.
    local_rows = rows.select("*", *locals_)
    if by:
        met = local_rows.join(carried, [GROUP, BUCKET])
    else:
        # one row per range: bounded by the number of ranges, not by the data
        met = local_rows.join(F.broadcast(carried.drop(GROUP)), BUCKET)
    return met.select(*[F.col(c) for c in df.columns], *finals)
