"""Multinomial Naive Bayes for any number of classes, all parts of the model as tables.

A term's smoothed likelihood differs from that of an unseen term only in classes that hold
it, so the model keeps rows (term, class) for those, and one line per class for the rest:
the score of a class is ``prior + weight * base`` plus the gains of the document's terms that
the class holds, where ``weight`` is the sum of the document's term weights. Gains are never
negative. So the best class of a document is either the best of those that share a term with
it, or the highest of all lines at its weight. The lines' upper envelope answers the second
question by one ordered scan over documents and envelope together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize

#: Scores that agree to so many digits are a tie, which the first class wins.
DIGITS = 6
#: (document, term) cells of a block, and classes that are scored in one task.
CELLS, PART = 1 << 19, 1 << 10


@dataclass(frozen=True)
class ClassModel:
    """``gains`` (term, class, gain), ``classes`` (class, prior, base), ``common`` (term): the
    terms with more than a fixed part of all gains, at most 4 per shuffle partition."""

    gains: DataFrame
    classes: DataFrame
    common: DataFrame


def _shards(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fit_classes(weights: DataFrame, docs: DataFrame, alpha: float = 1.0, key: str = "doc_id", label: str = "label") -> ClassModel:
    """From ``weights`` (key, term, weight > 0) and ``docs`` (key, label), one row per key.
    Rows without a label are ignored. Nothing of the model reaches the driver."""
    known = docs.where(F.col(label).isNotNull()).select(key, F.col(label).alias("class"))
    sums = weights.select(key, "term", "weight").join(known, key).groupBy("term", "class").agg(F.sum("weight").alias("s"))
    sums = materialize(sums, "class_sums")
    size = sums.agg(F.count_distinct("term")).scalar()
    totals = sums.groupBy("class").agg(F.sum("s").alias("total"))
    counts = known.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    base = F.log(F.lit(alpha)) - F.log(F.coalesce("total", F.lit(0.0)) + F.lit(alpha) * size)
    classes = counts.join(totals, "class", "left").select("class", F.log(F.col("n") / whole).alias("prior"), F.coalesce(base, F.lit(0.0)).alias("base"))
    gains = sums.select("term", "class", F.log1p(F.col("s") / F.lit(alpha)).alias("gain"))
    held = sums.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    common = held.where(F.col("n") * 4 * _shards(sums) > sums.agg(F.count(F.lit(1))).scalar()).select("term")
    return ClassModel(gains, materialize(classes, "classes"), materialize(common, "common"))


def envelope(classes: DataFrame, buckets: int | None = None) -> DataFrame:
    """(start, class, prior, base): the class whose line prior + weight * base is highest
    from the weight ``start`` on, for weights above 0. Buckets of classes are reduced by
    themselves first; only lines that are highest somewhere in their bucket meet."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = pdf.sort_values(["base", "prior", "class"], ascending=[True, False, True], kind="stable")
        kept: list[tuple] = []
        for name, prior, base in zip(lines["class"], lines["prior"], lines["base"]):
            start = 0.0
            while kept:
                at, _, p, b = kept[-1]
                if b == base:  # same slope: the higher one came first
                    start = None
                    break
                start = (p - prior) / (base - b)
                if start > at:
                    break
                kept.pop()
                start = 0.0
            if start is not None:
                kept.append((max(start, 0.0), name, prior, base))
        return pd.DataFrame(kept, columns=["start", "class", "prior", "base"])

    kind = classes.schema["class"].dataType.simpleString()
    schema = f"start double, class {kind}, prior double, base double"
    own = F.pmod(F.xxhash64("class"), F.lit(buckets or _shards(classes)))
    first = classes.withColumn("_b", own).groupBy("_b").applyInPandas(lambda p: hull(p[["class", "prior", "base"]]), schema)
    return first.drop("start").withColumn("_b", F.lit(0)).groupBy("_b").applyInPandas(lambda p: hull(p[["class", "prior", "base"]]), schema)


def _best_shared(weights: DataFrame, sizes: DataFrame, model: ClassModel, key: str, kind: str) -> DataFrame:
    """(key, class, score): for every document and part of the classes the best class that
    shares a term with it. Documents come in blocks of about ``CELLS`` cells, and a block gets
    the gains of its terms once, as one row per term; so neither the rows of (document, term,
    class) nor the scores of (document, class) are ever exchanged."""
    blocks = max(1, math.ceil((sizes.agg(F.sum("_n")).first()[0] or 0) / CELLS))
    numbered = ordered_scan(model.classes, [], ["class"], {"_no": ("row_number",)})
    place = (F.col("_no") - 1).cast("long")
    numbered = materialize(
        numbered.select("class", "prior", "base", F.floor(place / PART).cast("int").alias("part"), (place % PART).cast("int").alias("at")), "numbered"
    )
    rows = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    gains = model.gains.join(numbered.select("class", "part", "at"), "class").groupBy("term", "part").agg(rows("at", "gain").alias("_g"))
    gains = gains.select("term", "part", F.col("_g.at").alias("at"), F.col("_g.gain").alias("gain"))
    lines = numbered.groupBy("part").agg(rows("at", "prior", "base").alias("_c"))
    lines = materialize(lines.select("part", F.col("_c.prior").alias("prior"), F.col("_c.base").alias("base")), "class_lines")
    cells = weights.where(F.col(key).isNotNull()).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    held = cells.select("block", "term").distinct().join(gains, "term")
    none = F.lit(None)
    given = held.select(F.col("block").alias("to"), F.col("part").alias("of"), F.col("term").alias("word"), "at", "gain", none.cast("array<double>").alias("prior"), none.cast("array<double>").alias("base"))
    dealt = lines.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = given.unionByName(dealt.select("to", F.col("part").alias("of"), none.cast("string").alias("word"), none.cast("array<int>").alias("at"), none.cast("array<double>").alias("gain"), "prior", "base"))
    asked = cells.crossJoin(F.broadcast(lines.select("part"))).select("block", "part", F.col(key).alias("key"), "term", "weight")

    def best(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out_key, out_at, out_score = [], [], []
        terms, line = table[table["word"].notna()], table[table["word"].isna()]
        if len(part) and len(terms):
            prior, base = (np.asarray(line[c].iloc[0], dtype="float64") for c in ("prior", "base"))
            at, gain = terms["at"].to_list(), terms["gain"].to_list()
            part = part.assign(code=pd.Index(terms["word"]).get_indexer(part["term"]))
            for name, doc in part.groupby("key", sort=False):
                weight, code = doc["weight"].to_numpy(), doc["code"].to_numpy()
                met = [(at[c], w * gain[c]) for c, w in zip(code, weight) if c >= 0]
                if met:
                    place = np.concatenate([m[0] for m in met])
                    sums = np.bincount(place, np.concatenate([m[1] for m in met]), len(prior))
                    score = np.where(np.bincount(place, minlength=len(prior)) > 0, prior + weight.sum() * base + sums, -np.inf)
                    first = int(np.argmax(np.round(score, DIGITS)))
                    out_key.append(name), out_at.append(first), out_score.append(score[first])
        number = int(table["of"].iloc[0]) if len(table) else 0
        return pd.DataFrame({"key": pd.Series(out_key, dtype=part["key"].dtype), "part": np.int32(number), "at": np.array(out_at, dtype="int32"), "score": np.array(out_score, dtype="float64")})

    found = asked.groupBy("block", "part").cogroup(given.groupBy("to", "of")).applyInPandas(best, f"key {kind}, part int, at int, score double")
    return found.join(numbered.select("class", "part", "at"), ["part", "at"]).select(F.col("key").alias(key), "class", "score")


def predict_classes(weights: DataFrame, docs: DataFrame, model: ClassModel, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``prediction`` and its log score ``joint``. ``weights`` holds terms of the
    model's vocabulary only. Documents without terms get the most frequent class."""
    weights = weights.select(key, "term", "weight")
    sizes = materialize(weights.groupBy(key).agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n")), "sizes")
    shared = _best_shared(weights, sizes, model, key, docs.schema[key].dataType.simpleString())
    # the smallest struct: highest score, then first class
    shared = shared.groupBy(key).agg(F.min(F.struct((-F.round("score", DIGITS)).alias("down"), "class")).alias("best"))
    # the highest line at each document's weight, by one scan over lines and documents
    lines = envelope(model.classes).select(
        F.col("start").alias("_w"), F.lit(0).alias("kind"), F.lit(None).cast(docs.schema[key].dataType).alias(key), F.struct("class", "prior", "base").alias("line")
    )
    asked = sizes.select("_w", F.lit(1).alias("kind"), key, F.lit(None).cast(lines.schema["line"].dataType).alias("line"))
    scanned = ordered_scan(materialize(lines.unionByName(asked), "lines"), [], ["_w", "kind", key], {"under": ("last", "line")})
    under = scanned.where("kind = 1").select(
        key, F.struct((-F.round(F.col("under.prior") + F.col("_w") * F.col("under.base"), DIGITS)).alias("down"), F.col("under.class").alias("class")).alias("line_best")
    )
    most = model.classes.agg(F.min(F.struct((-F.round("prior", DIGITS)).alias("down"), "class"))).scalar()
    found = docs.join(shared, key, "left").join(under, key, "left")
    best = F.coalesce(F.least("best", "line_best"), most)
    return found.withColumn("_best", best).select(*docs.columns, F.col("_best.class").alias("prediction"), (-F.col("_best.down")).alias("joint"))
