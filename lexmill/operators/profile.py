"""Profiles of corpora: counts, shares, quantiles, histograms.

Quantiles, cumulative shares and top values are exact. A quantile is selected by narrowing;
for cumulative shares values are counted first and summed by ``ordered_scan``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lexmill.functions.joins import null_safe_join
from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


def rows() -> Column:
    return F.count(F.lit(1))


def yearly_rate(df: DataFrame, ts: str, condition: Column, low: int, high: int) -> DataFrame:
    """Rows and percentage that meets ``condition`` per year in ``low``..``high``."""
    return (
        df.groupBy(F.year(ts).alias("year"))
        .agg(rows().alias("n_rows"), F.round(100 * F.sum(F.when(condition, 1).otherwise(0)) / rows(), 1).alias("pct"))
        .where(F.col("year").between(low, high))
        .orderBy("year")
    )


def dataset_card(df: DataFrame, splits: Sequence[str], split: str = "split", label: str = "label") -> DataFrame:
    """Per known split: rows, labels in order, number of labels; splits without rows
    are reported with ``is_defined`` false."""
    found = (
        df.groupBy(split, label)
        .agg(rows().alias("n"))
        .groupBy(split)
        .agg(
            F.sum("n").alias("n_rows"),
            F.array_join(F.transform(F.array_sort(F.collect_list(label)), lambda x: x.cast("string")), ",").alias("labels"),
            F.count(label).alias("n_labels"),
        )
    )
    known = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias(split))
    return known.join(found, split, "left").select(
        split,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.col("n_rows").isNotNull().alias("is_defined"),
    )


def structure_card(df: DataFrame, key: str) -> DataFrame:
    """Per column: type, rows, nulls, the shortest and longest array, and the value of
    the row with the lowest key that has one."""
    aggs = []
    for f in df.schema.fields:
        size = F.size(f.name).cast("long") if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(None).cast("long")
        aggs.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                rows().alias("n_rows"),
                (rows() - F.count(f.name)).alias("n_null"),
                F.min(size).alias("min_size"),
                F.max(size).alias("max_size"),
                F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col(key))).cast("string").alias("example"),
            ).alias(f"c{len(aggs)}")
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` rows with the lowest keys, as a reader would look at first."""
    return df.orderBy(key).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], one.columns, "column", "n_null")


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value, null included, most frequent first."""
    return df.groupBy(*cols).agg(rows().alias("n")).orderBy(F.desc("n"), *cols)


def class_balance(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """Rows and percentage of each label inside each group."""
    counts = df.groupBy(*by, label).agg(rows().alias("n"))
    whole = Window.partitionBy(*by)  # one row per label
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(whole))


def positive_share(df: DataFrame, label: str = "label", *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(label).alias("positive_share"))


# ---- quantiles ------------------------------------------------------------

def counted_values(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n), written once because quantiles scan it several times."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(rows().alias("n"))
    return materialize(counts, "counts")


#: Accuracy of the sketch that brackets a rank, and the group size up to which the whole
#: range is the bracket. They decide how many rows the second pass counts, never the result.
ACCURACY, SMALL = 10_000, 100_000


def _narrow(df: DataFrame, col: str, by: Sequence[str], stored: bool) -> DataFrame:
    """(by..., value) without nulls; written when it is costly to compute twice."""
    rows_of = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("value"))
    return rows_of if stored else materialize(rows_of, "values")


def _selected(values: DataFrame, sketch: DataFrame, qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., quantiles) from values and a ``sketch`` row per group (total, low, high, near):
    ``near`` holds two values around every quantile, whose ranks are at most 3 / ACCURACY of
    the group away. Only rows between the two are counted by value; those below are a number."""
    by = list(by)
    ends = [F.struct(F.get("near", F.lit(2 * i)).alias("lo"), F.get("near", F.lit(2 * i + 1)).alias("hi")) for i in range(len(qs))]
    whole = F.array(F.struct(F.col("low").alias("lo"), F.col("high").alias("hi")))
    brackets = F.when(F.col("total") <= SMALL, whole).otherwise(F.array(*ends))
    sketch = materialize(sketch.withColumn("brackets", brackets).select(*by, "total", "brackets"), "brackets")
    if by:
        met = null_safe_join(values, sketch.select(*by, "brackets"), by)
    else:
        met = values.withColumn("brackets", sketch.select("brackets").scalar())
    none = F.lit(None).cast("double")
    places = F.transform(
        "brackets",
        lambda b, j: F.when(F.col("value") < b["lo"], F.struct(j.alias("j"), none.alias("v")))
        .when(F.col("value") <= b["hi"], F.struct(j.alias("j"), F.col("value").alias("v"))),
    )
    counts = met.select(*by, F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).groupBy(*by, "p.j", "p.v").agg(rows().alias("n"))
    # the rows below a bracket come first, as their value is null
    placed = ordered_scan(materialize(counts, "counts"), [*by, "j"], ["v"], {"upto": ("sum", "n")})
    ranked = null_safe_join(placed, sketch.select(*by, "total"), by) if by else placed.withColumn("total", sketch.select("total").scalar())

    def at(i: int, rank: Column) -> Column:
        mine = F.col("j") == F.when(F.col("total") <= SMALL, 0).otherwise(i)
        return F.max(F.when(mine & (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("total") - 1)
        low, high = at(i, F.floor(pos)), at(i, F.ceil(pos))
        aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(f"q{i}"))
    return ranked.groupBy(*by).agg(*aggs).select(*by, F.array(*[f"q{i}" for i in range(len(qs))]).alias("quantiles"))


def _sketch(qs: Sequence[float]) -> list[Column]:
    near = [p for q in qs for p in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    return [
        rows().alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", F.array(*map(F.lit, near)), ACCURACY).alias("near"),
    ]


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Exact quantiles by linear interpolation: one array ``quantiles`` per group.

    Selection by narrowing: a mergeable sketch of every group names two values around each
    wanted rank, and one more pass counts what lies between them. Neither all distinct values
    nor a sort of them is needed. ``stored``: ``df`` is a table that is cheap to scan twice.
    """
    values = _narrow(df, col, by, stored)
    return _selected(values, values.groupBy(*by).agg(*_sketch(qs)), qs, by)


def quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    return quantiles(df, col, [q]).select(F.get("quantiles", F.lit(0)).alias("quantile"))


def describe_numeric(df: DataFrame, col: str, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max; one pass for the moments and
    the sketch, one for the quartiles."""
    by, qs = list(by), [0.25, 0.5, 0.75]
    values = _narrow(df, col, by, stored)
    basic = values.groupBy(*by).agg(*_sketch(qs), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    basic = materialize(basic, "moments")
    quarts = _selected(values, basic, qs, by)
    q = F.col("quantiles")
    joined = null_safe_join(basic, quarts, by) if by else basic.withColumn("quantiles", quarts.scalar())
    return joined.select(
        *by, F.col("total").alias("count"), "mean", "std", F.col("low").alias("min"),
        F.get(q, F.lit(0)).alias("q25"), F.get(q, F.lit(1)).alias("q50"), F.get(q, F.lit(2)).alias("q75"), F.col("high").alias("max"),
    )


def length_stats(df: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    n = F.octet_length(text)
    return df.groupBy(*by).agg(
        F.max(n).alias("longest"), F.min(n).alias("shortest"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")
    )


def percentile_of_score(df: DataFrame, col: str, value: float) -> DataFrame:
    """Percentile rank of ``value``: mean of the strict and the weak rank."""
    x = F.col(col)
    less = F.count_if(x < value)
    less_equal = F.count_if(x <= value)
    bump = F.when(less_equal > less, 1).otherwise(0)
    return df.agg(((less + less_equal + bump) * 50.0 / F.nullif(F.count(x), F.lit(0))).alias("percentile"))


def fraction_below(df: DataFrame, col: str, sizes: Sequence[float]) -> DataFrame:
    """Share of rows strictly below each threshold, in one pass."""
    one = df.agg(*[(F.count_if(F.col(col) < s) / F.nullif(rows(), F.lit(0))).alias(str(s)) for s in sizes])
    return one.unpivot([], one.columns, "threshold", "share").withColumn("threshold", F.col("threshold").cast("double"))


# ---- histograms -----------------------------------------------------------

def _edges(stats: DataFrame) -> DataFrame:
    """One row (lo, hi, bins); a constant column gets a range of width one."""
    flat = F.col("lo") == F.col("hi")
    return stats.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.col("bins").cast("int").alias("bins"),
    )


def _binned(df: DataFrame, col: str, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin, empty bins included; the last bin is closed."""
    e = edges.select(F.struct("lo", "hi", "bins")).scalar()
    at = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x")).withColumn("_e", e)
    place = F.floor((F.col("_x") - F.col("_e.lo")) * F.col("_e.bins") / (F.col("_e.hi") - F.col("_e.lo")))
    bin_no = F.least(place, F.col("_e.bins") - 1).cast("int")
    counts = at.groupBy(*by, bin_no.alias("bin")).agg(rows().alias("n"))
    groups = df.select(*by).distinct().withColumn("_e", e) if by else edges.select(F.struct("lo", "hi", "bins").alias("_e"))
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_e.bins") - 1)))
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.col("_e.bins")
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin",
        (F.col("_e.lo") + F.col("bin") * width).alias("left_edge"),
        width.alias("width"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _range_row(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))


def auto_bins(df: DataFrame, col: str, stored: bool = False) -> DataFrame:
    """(lo, hi, bins): the narrower of the Sturges and Freedman-Diaconis widths,
    the latter ignored when the quartiles coincide."""
    d = describe_numeric(df, col, stored=stored)
    span, n = F.col("max") - F.col("min"), F.col("count")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * (F.col("q75") - F.col("q25")) / F.pow(n, F.lit(1.0 / 3.0))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    bins = F.when(width > 0, F.ceil(span / width)).otherwise(1)
    return d.select(F.col("min").alias("lo"), F.col("max").alias("hi"), bins.alias("bins"))


def _numbers(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value), written: what the number is taken from is read once."""
    return materialize(df.select(*by, F.col(col).cast("double").alias("value")), "numbers")


def histogram(df: DataFrame, col: str, bins: int | str = 50) -> DataFrame:
    """Range, bins and counts from numbers that are taken from ``df`` in one scan."""
    values = _numbers(df, col)
    stats = auto_bins(values, "value", stored=True) if bins == "auto" else _range_row(values, "value").withColumn("bins", F.lit(bins))
    return _binned(values, "value", _edges(stats))


def histogram_density(df: DataFrame, col: str, by: str, bins: int = 50) -> DataFrame:
    """Histogram per group on shared bins, each scaled to area one."""
    values = _numbers(df, col, [by])
    edges = _edges(_range_row(values, "value").withColumn("bins", F.lit(bins)))
    counts = _binned(values, "value", edges, [by])
    whole = Window.partitionBy(by)  # one row per bin
    return counts.withColumn("density", F.col("n") / (F.nullif(F.sum("n").over(whole), F.lit(0)) * F.col("width")))


def ecdf(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, cdf): share of the group's rows at or below each value."""
    by = list(by)
    counts = counted_values(df, col, by)
    placed = ordered_scan(counts, by, ["value"], {"upto": ("sum", "n")})
    if by:
        placed = null_safe_join(placed, counts.groupBy(*by).agg(F.sum("n").alias("total")), by)
    else:
        placed = placed.withColumn("total", counts.agg(F.sum("n")).scalar())
    return placed.select(*by, "value", (F.col("upto") / F.col("total")).alias("cdf"))


# ---- many columns at once -------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_stats_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: rows, missing, mean, deviation, zeros, min, median, max."""
    cols = list(cols or numeric_columns(df))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    structs = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_missing"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count_if(F.col(c) == 0).alias("n_zero"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ]
    one = wide.agg(*structs)
    basic = one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
    medians = quantiles(wide.unpivot([], cols, "column", "value"), "value", [0.5], ["column"], stored=True)
    return basic.join(medians, "column", "left").select(
        *basic.columns, F.get("quantiles", F.lit(0)).alias("median")
    )


def feature_stats_string(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column: rows, missing, distinct values, top value, mean length."""
    cols = list(cols or string_columns(df))
    counts = df.select(*cols).unpivot([], cols, "column", "value").groupBy("column", "value").agg(rows().alias("n"))
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))))
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
        best.alias("_best"),
        (F.sum(F.length("value") * F.col("n")) / F.nullif(F.sum(F.when(known, F.col("n"))), F.lit(0))).alias("mean_length"),
    ).select(
        "column", "n_rows", "n_missing", "n_unique",
        F.col("_best.value").alias("top_value"), (-F.col("_best.neg")).alias("top_count"), "mean_length",
    )


def _heavy_hitters(values: DataFrame, cols: Sequence[str], capacity: int) -> DataFrame:
    """(column, value, n, lost): per task and column the values of a Misra-Gries summary. A
    value's count is between ``n`` and ``n`` plus the tasks' ``lost``, which comes with a null value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = [Counter() for _ in cols], [0] * len(cols)
        for batch in batches:
            for i in range(len(cols)):
                found = pc.value_counts(batch.column(i).drop_null())
                held[i].update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
                if len(held[i]) > 2 * capacity:
                    cut = sorted(held[i].values(), reverse=True)[capacity]
                    held[i] = Counter({v: n - cut for v, n in held[i].items() if n > cut})
                    lost[i] += cut
        out = [(c, v, n, 0) for i, c in enumerate(cols) for v, n in held[i].items()] + [(c, None, 0, lost[i]) for i, c in enumerate(cols)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["column", "value", "n", "lost"])

    return values.mapInArrow(run, "column string, value string, n long, lost long")


def top_values(df: DataFrame, k: int = 10, cols: Sequence[str] | None = None, capacity: int = 1_024) -> DataFrame:
    """(column, rank, value, n): the ``k`` most frequent values of every text column, ties by
    value, nulls left out. Exact.

    Summaries of bounded size name the candidates, which are counted in a second pass. What
    is no candidate occurs at most as often as the summaries have lost; a column whose k-th
    count is not above that (its values are too many and too even) is grouped in full.
    """
    cols = list(cols or string_columns(df))
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    found = materialize(_heavy_hitters(texts, cols, capacity), "hitters")
    lost = {r["column"]: r["lost"] for r in found.groupBy("column").agg(F.sum("lost").alias("lost")).collect()}  # one row per column
    sums = found.where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = lambda counts: counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    least = {r["column"]: r["n"] for r in ranked(sums).groupBy("column").agg(F.min("n").alias("n")).collect()}
    bound = F.create_map(*(F.lit(x) for c in cols for x in (c, max(0, least.get(c, 0) - lost.get(c, 0)))))
    candidates = sums.where(F.col("n") >= F.element_at(bound, F.col("column"))).select("column", "value")
    long = texts.unpivot([], cols, "column", "value").where("value is not null")
    counted = materialize(ranked(long.join(candidates, ["column", "value"]).groupBy("column", "value").agg(rows().alias("n"))), "counted")
    smallest = {r["column"]: (r["n"], r["m"]) for r in counted.groupBy("column").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    open_ = [c for c in cols if lost.get(c) and (c not in smallest or smallest[c][1] < k or smallest[c][0] <= lost[c])]
    if open_:
        whole = texts.select(*open_).unpivot([], open_, "column", "value").where("value is not null").groupBy("column", "value").agg(rows().alias("n"))
        counted = counted.where(~F.col("column").isin(open_)).unionByName(ranked(whole))
    return counted.select("column", "rank", "value", "n")


def feature_histograms(df: DataFrame, bins: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Equal-width histogram of every numeric column on its own range."""
    cols = list(cols or numeric_columns(df))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    structs = [
        F.struct(F.lit(c).alias("column"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"s{i}") for i, c in enumerate(cols)
    ]
    one = wide.agg(*structs)
    ranges = one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "column", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    long = wide.unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    # one row per column of the table: bounded by the schema
    place = F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    counts = (
        long.join(F.broadcast(ranges), "column")
        .groupBy("column", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(rows().alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins)).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def group_total(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Characters per group."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))


def text_lengths(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"))


def translation_volume(df: DataFrame, n_lang: int = 2, text: str = "text") -> DataFrame:
    """Characters of the corpus and characters a translation into ``n_lang``
    languages would send."""
    total = F.coalesce(F.sum(F.length(text)), F.lit(0))
    return df.agg(total.alias("total_chars"), (total * n_lang).alias("translated_chars"))
