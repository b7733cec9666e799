"""Splits, samples, indexes, batches and set operations over keyed rows.

Rows have no implied order: every operator that needs one takes a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.hashing import fast_bucket, hash_bucket, shuffle_key
from lexmill.functions.joins import hinted, null_safe_join
from lexmill.functions.ordered import ordered_scan


# ---- splits and samples ---------------------------------------------------

def hash_split(df: DataFrame, key: str, eval_pct: int = 20, portable: bool = True) -> DataFrame:
    """Add ``part``: 'eval' for ``eval_pct`` percent of the keys, else 'train'."""
    bucket = hash_bucket(key) if portable else fast_bucket(key)
    return df.withColumn("part", F.when(bucket < eval_pct, "eval").otherwise("train"))


def sample_fraction(df: DataFrame, key: str, frac: float, seed: str = "sample") -> DataFrame:
    """A repeatable share of the rows; all rows unless ``0 < frac < 1``."""
    if not 0 < frac < 1:
        return df
    return df.where(hash_bucket(key, 1_000_000, seed) < int(round(frac * 1_000_000)))


def stratified_split(df: DataFrame, key: str, label: str, frac: float = 0.5, seed: str = "split") -> DataFrame:
    """Add ``part``: per class the first ``quota`` rows in shuffled order are 'train'.
    Quotas add up to ``floor(n * frac)``; largest remainders are served first."""
    exact = F.col("n") * F.lit(frac)
    all_classes = Window.partitionBy()  # one row per class
    by_rest = Window.orderBy(F.desc(exact - F.floor(exact)), F.col(label))
    missing = F.floor(F.sum("n").over(all_classes) * F.lit(frac)) - F.sum(F.floor(exact)).over(all_classes)
    quota = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            label,
            (F.floor(exact) + F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0)).alias("_quota"),
        )
    )
    ranked = ordered_scan(
        df.withColumn("_shuffle", shuffle_key(key, seed)), [label], ["_shuffle", key], {"_rank": ("row_number",)}, hashed=True
    )
    part = F.when(F.col("_rank") <= F.col("_quota"), "train").otherwise("test")
    return null_safe_join(ranked, quota, [label]).select(*df.columns, part.alias("part"))


def split_positional(df: DataFrame, key: str, frac: float = 0.6) -> DataFrame:
    """Add ``part``: the first ``floor(n * frac)`` rows in key order are 'train'."""
    n = df.agg(F.count(F.lit(1))).scalar()
    first = F.col("_i") < F.floor(n * F.lit(frac))
    return with_index(df, [key], name="_i").select(
        *df.columns, F.when(first, "train").otherwise("test").alias("part")
    )


def take_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows ``low`` (included) to ``high`` (excluded) in key order."""
    if low == 0:
        return df.orderBy(key).limit(high)
    return with_index(df, [key], name="_i").where((F.col("_i") >= low) & (F.col("_i") < high)).drop("_i")


def head_rows(df: DataFrame, cols: Sequence[str], n: int, key: str) -> DataFrame:
    """Named columns of the first ``n`` rows in key order."""
    return df.orderBy(key).limit(n).select(*cols)


def long_documents(df: DataFrame, text: str = "text", n_bytes: int = 7500) -> DataFrame:
    return df.where(F.octet_length(text) > n_bytes)


# ---- indexes, order and batches -------------------------------------------

def with_index(df: DataFrame, order_by: Sequence[str], shift: int | Column = 0, name: str = "idx", hashed: bool = False) -> DataFrame:
    """Dense 0-based index in key order, plus ``shift``."""
    moved = shift if isinstance(shift, Column) else F.lit(shift)
    out = ordered_scan(df, [], order_by, {"_n": ("row_number",)}, hashed=hashed)
    return out.select(*df.columns, (F.col("_n") - 1 + moved).cast("long").alias(name))


def to_canonical(df: DataFrame, key: str, text: str, label: str, shift: int | Column = 0) -> DataFrame:
    """Rows (idx INT, label LONG, sentence STRING)."""
    return with_index(df.select(key, text, label), [key], shift).select(
        F.col("idx").cast("int").alias("idx"),
        F.col(label).cast("long").alias("label"),
        F.col(text).cast("string").alias("sentence"),
    )


def shuffle(df: DataFrame, key: str, seed: str = "shuffle") -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(shuffle_key(key, seed), key)


def shuffled_index(df: DataFrame, key: str, seed: str = "shuffle", name: str = "pos") -> DataFrame:
    keyed = df.withColumn("_shuffle", shuffle_key(key, seed))
    return with_index(keyed, ["_shuffle", key], name=name, hashed=True).drop("_shuffle")


def batch(df: DataFrame, size: int, key: str, cols: Sequence[str]) -> DataFrame:
    """Consecutive rows in key order packed into arrays; a short last batch stays."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("_i"), *cols)))
    return (
        with_index(df.select(key, *[c for c in cols if c != key]), [key], name="_i")
        .groupBy(F.floor(F.col("_i") / size).alias("batch_id"))
        .agg(packed.alias("_rows"))
        .select("batch_id", *[F.col(f"_rows.{c}").alias(c) for c in cols])
    )


def unbatch(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Arrays of equal length back to one row per position."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_r")).select(
        *keep, "pos", *[F.col(f"_r.{c}").alias(c) for c in cols]
    )


def repeat(df: DataFrame, n: int, key: str, seed: str = "epoch") -> DataFrame:
    """``n`` copies of the rows; every epoch has its own order, given by ``pos``."""
    copies = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string")))
    keyed = copies.withColumn("_shuffle", order)
    out = ordered_scan(keyed, ["epoch"], ["_shuffle", key], {"_n": ("row_number",)}, hashed=True)
    return out.select(*copies.columns, (F.col("_n") - 1).cast("long").alias("pos"))


def batch_plan(df: DataFrame, sizes: dict[str, int], epochs: int) -> DataFrame:
    """Rows, steps and steps of all repeats for every split that has a batch size."""
    size = F.lit(None).cast("int")
    for name, value in sizes.items():
        size = F.when(F.col("split") == name, F.lit(value)).otherwise(size)
    return (
        df.groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("batch_size", size)
        .where(F.col("batch_size").isNotNull())
        .withColumn("steps", F.ceil(F.col("n_rows") / F.col("batch_size")))
        .withColumn("total_steps", F.col("steps") * (epochs + 1))
    )


# ---- set operations -------------------------------------------------------

def union_tagged(parts: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    """Union by name with the name of each part as a column."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def label_cardinality(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows and distinct labels per split. Counting by label first keeps a split
    that holds most rows from becoming one large distinct set."""
    return (
        df.groupBy(split, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(split)
        .agg(F.sum("n").alias("n_rows"), F.count(label).alias("n_labels"))
    )


def top_bottom(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """The k largest and k smallest rows, marked by ``side``."""
    top = df.orderBy(F.desc(col), F.asc(tie)).limit(k).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.asc(col), F.asc(tie)).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


# ---- joins ----------------------------------------------------------------

def zip_on_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both frames side by side for equal keys."""
    return a.join(b, key)


def lookup(df: DataFrame, mapping: DataFrame, key: str, max_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join with a map table, broadcast by hint only when its size is proven."""
    return df.join(hinted(mapping, max_rows), key, how)


def trial_table(scores: DataFrame, params: DataFrame) -> DataFrame:
    return scores.join(params, "trial", "inner")


def attach_truth(pred: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    return pred.join(truth, key, "inner")


def compare_runs(a: DataFrame, b: DataFrame, step: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """Two runs side by side, or many pairs of runs named by ``by``; steps that only one run
    has stay, with nulls."""
    left = a.select(*by, F.col(step), F.col("value").alias("value_a"))
    right = b.select(*by, F.col(step), F.col("value").alias("value_b"))
    return left.join(right, [*by, step], "full").withColumn("diff", F.col("value_b") - F.col("value_a"))


def join_validation(train: DataFrame, val: DataFrame, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    """Every training step, with the validation value where one was measured."""
    return train.join(val, list(keys), "left")
