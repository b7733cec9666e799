"""Multinomial Naive Bayes over a long weight table.

Several models over the same documents (folds, training sizes, smoothing values)
are fitted together: one grouped pass over the terms with one conditional sum per
model and class, and one grouped pass over the documents with one score per model
and class. No model is fitted in a driver loop and no rows are copied per model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import vectors as vx
from lexmill.functions.joins import hinted
from lexmill.operators import shape, tokens
from lexmill.operators.feature_sets import Features
from lexmill.session import materialize


@dataclass(frozen=True)
class Variant:
    """One model: which documents train it, its smoothing, and the place of its features
    when every row has an array of weights."""

    member: Column
    alpha: float = 1.0
    features: int | None = None

    def weight(self) -> Column:
        return F.col("weight") if self.features is None else F.get("weight", F.lit(self.features))


@dataclass(frozen=True)
class BayesModel:
    """``table``: (term, ll) with one log likelihood per variant and class;
    ``prior``: a list of the same layout; ``classes`` in order."""

    classes: list
    table: DataFrame
    prior: list[float]
    n_variants: int = 1
    max_terms: int | None = None
    variants: tuple[Variant, ...] = ()

    def at(self, values: str, variant: int) -> Column:
        """The slice of one variant from an array with one entry per class."""
        n = len(self.classes)
        return F.slice(values, variant * n + 1, n)


def label_classes(docs: DataFrame, label: str = "label") -> list:
    """Distinct labels in order; a model has one coefficient row for each."""
    return sorted(r[0] for r in docs.where(F.col(label).isNotNull()).select(label).distinct().collect())


def nb_fit_many(
    weights: DataFrame, docs: DataFrame, variants: Sequence[Variant], key: str = "doc_id", label: str = "label",
    max_terms: int | None = None,
) -> BayesModel:
    """``weights`` (key, term, weight) joined to ``docs`` (key, label, ...); the
    member conditions refer to columns of ``docs``."""
    classes = label_classes(docs, label)
    cells = [(v, c) for v in variants for c in classes]
    rows = weights.select(key, "term", "weight").join(docs, key)
    sums = rows.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when(v.member & (F.col(label) == c), v.weight())), F.lit(0.0)).alias(f"s{j}")
            for j, (v, c) in enumerate(cells)
        ],
        *[F.max(v.weight()).isNotNull().alias(f"k{i}") for i, v in enumerate(variants)],
    )
    return _model(sums, docs, classes, variants, label, max_terms)


def _model(sums: DataFrame, docs: DataFrame, classes: list, variants: Sequence[Variant], label: str, max_terms: int | None) -> BayesModel:
    """From (term, s0, s1, ..., k0, ...): a weight sum per variant and class, and whether the
    variant knows the term."""
    cells = [(v, c) for v in variants for c in classes]
    sums = materialize(sums, "class_sums")  # read for the totals and for the rows
    # A few numbers per class and variant: the fitted parameters of the model.
    found = sums.agg(*[F.count_if(f"k{i}") for i in range(len(variants))], *[F.sum(f"s{j}") for j in range(len(cells))]).first()
    sizes, totals = found[: len(variants)], found[len(variants):]
    whole = [(totals[j] or 0.0) + sizes[j // max(1, len(classes))] * v.alpha for j, (v, _) in enumerate(cells)]
    ll = [F.log((F.col(f"s{j}") + v.alpha) / F.lit(whole[j])) for j, (v, _) in enumerate(cells)]
    table = sums.select("term", F.array(*ll).alias("ll"))

    known = F.col(label).isNotNull()
    counted = docs.agg(
        *[F.count_if(v.member & (F.col(label) == c)) for v, c in cells], *[F.count_if(v.member & known) for v, _ in cells]
    ).first()
    pairs = zip(counted[: len(cells)], counted[len(cells):])
    prior = [math.log(n / whole) if n else -math.inf for n, whole in pairs]
    return BayesModel(classes, table, prior, len(variants), max_terms, tuple(variants))


def nb_fit_sets(features: Features, docs: DataFrame, variants: Sequence[Variant], label: str = "label") -> BayesModel:
    """``nb_fit_many`` over features that are kept as factors."""
    classes, key = label_classes(docs, label), features.key
    cells = [(v, c) for v in variants for c in classes]
    of = lambda name, i: F.get(name, F.lit(i))
    # rows of a document that train a cell, over the document's length in the cell's set
    hits = docs.groupBy(key).agg(F.array(*[F.count_if(v.member & (F.col(label) == c)) for v, c in cells]).alias("hits"))
    share = [F.when(of("length", v.features) > 0, of("hits", j) / of("length", v.features)).otherwise(0.0) for j, (v, _) in enumerate(cells)]
    keyed = features.counts.select("block", key).distinct().join(features.lengths, key).join(hits, key)
    found = features.per_term(keyed.select("block", key, F.array(*share).alias("v")), len(cells)) if cells else None
    table = features.idf.join(found, "term", "left") if cells else features.idf
    sums = table.select(
        "term",
        *[F.coalesce(of("idf", v.features) * of("sums", j), F.lit(0.0)).alias(f"s{j}") for j, (v, _) in enumerate(cells)],
        *[of("idf", v.features).isNotNull().alias(f"k{i}") for i, v in enumerate(variants)],
    )
    return _model(sums, docs, classes, variants, label, None)


def nb_scores_sets(features: Features, docs: DataFrame, model: BayesModel) -> DataFrame:
    """``nb_scores`` over features that are kept as factors."""
    k, key = len(model.classes), features.key
    at = [v.features for v in model.variants for _ in range(k)]
    gain = [F.coalesce(F.get("idf", F.lit(i)) * F.get("ll", F.lit(j)), F.lit(0.0)) for j, i in enumerate(at)]
    values = features.idf.join(model.table, "term").select("term", F.array(*gain).alias("v"))
    sums = features.per_document(values, [1] * len(at)).join(features.lengths, key)
    scaled = [F.when(F.get("length", F.lit(i)) > 0, F.get("sums", F.lit(j)) / F.get("length", F.lit(i))) for j, i in enumerate(at)]
    sums = sums.select(key, F.array(*scaled).alias("_sums"))
    joint = F.array(*[F.lit(model.prior[j]) + F.coalesce(F.get("_sums", F.lit(j)), F.lit(0.0)) for j in range(len(at))])
    return docs.join(sums, key, "left").select(*docs.columns, joint.alias("joint"))


def nb_fit(weights: DataFrame, docs: DataFrame, alpha: float = 1.0, key: str = "doc_id", label: str = "label", max_terms: int | None = None) -> BayesModel:
    return nb_fit_many(weights, docs, [Variant(F.lit(True), alpha)], key, label, max_terms)


def nb_scores(weights: DataFrame, docs: DataFrame, model: BayesModel, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``joint``: log joint likelihood per variant and class. Documents
    without a known term have the prior."""
    n = model.n_variants * len(model.classes)
    joined = weights.select(key, "term", "weight").join(hinted(model.table, model.max_terms), "term")
    weight = [v.weight() for v in model.variants] or [F.col("weight")] * model.n_variants
    k = max(1, len(model.classes))
    sums = joined.groupBy(key).agg(*[F.sum(weight[j // k] * F.get("ll", F.lit(j))).alias(f"j{j}") for j in range(n)])
    joint = F.array(*[F.lit(model.prior[j]) + F.coalesce(F.col(f"j{j}"), F.lit(0.0)) for j in range(n)])
    return docs.join(sums, key, "left").select(*docs.columns, joint.alias("joint"))


def class_of(model: BayesModel, values: Column) -> Column:
    """The class with the highest value, the first one on a tie."""
    return F.get(F.array(*[F.lit(c) for c in model.classes]), vx.argmax(values))


def nb_predict(weights: DataFrame, docs: DataFrame, model: BayesModel, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``prediction`` and class probabilities ``prob``."""
    scored = nb_scores(weights, docs, model, key)
    return scored.select(
        *docs.columns, class_of(model, F.col("joint")).alias("prediction"), vx.softmax("joint").alias("prob")
    )


def top_coefficients(model: BayesModel, k: int = 20, class_index: int = -1) -> DataFrame:
    """Terms with the largest and smallest log likelihood of one class; by default
    the last class, which is the second one of a binary model."""
    at = class_index % len(model.classes)
    return tokens.extremes(model.table.select("term", F.get("ll", F.lit(at)).alias("loglik")), "loglik", k, k)


@dataclass(frozen=True)
class TrainedText:
    """Everything needed to score text: term weights, model and the norm."""

    weights: DataFrame
    model: BayesModel
    norm: str | None = "l2"

    def save(self, path: str) -> None:
        """Write the model as three Parquet tables: term weights, log likelihoods, and one
        row with the classes, priors and settings."""
        m, spark = self.model, self.weights.sparkSession
        self.weights.write.parquet(f"{path}/weights")
        m.table.write.parquet(f"{path}/likelihoods")
        settings = {"classes": m.classes, "prior": m.prior, "n_variants": m.n_variants, "max_terms": m.max_terms, "norm": self.norm}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TrainedText":
        s = json.loads(spark.read.parquet(f"{path}/settings").first().settings)
        model = BayesModel(s["classes"], spark.read.parquet(f"{path}/likelihoods"), s["prior"], s["n_variants"], s["max_terms"])
        return cls(spark.read.parquet(f"{path}/weights"), model, s["norm"])

    def features(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return tokens.transform_features(df, self.weights, self.norm, key, text, self.model.max_terms)

    def predict(self, df: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
        docs = df.select(key, *keep)
        return nb_predict(self.features(df, key, text), docs, self.model, key)


def train(
    df: DataFrame, min_df: float | int = 1, max_df: float | int = 1.0, max_features: int | None = 10_000, norm: str | None = "l2",
    alpha: float = 1.0, key: str = "doc_id", text: str = "text", label: str = "label",
) -> TrainedText:
    """Fit vocabulary, weights and model on labelled documents."""
    return train_many(df, [alpha], min_df, max_df, max_features, norm, key, text, label)[0]


def train_many(
    df: DataFrame, alphas: Sequence[float], min_df: float | int = 1, max_df: float | int = 1.0, max_features: int | None = 10_000,
    norm: str | None = "l2", key: str = "doc_id", text: str = "text", label: str = "label",
) -> list[TrainedText]:
    """``train`` for several smoothing values, which share vocabulary, weights and one pass."""
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = materialize(tokens.term_counts(df, key, text), "counts")  # read for the vocabulary and the weights
    weights = materialize(tokens.idf(tokens.build_vocab(counts, n, min_df, max_df, max_features), n), "weights")
    variants = [Variant(F.lit(True), a) for a in alphas]
    model = nb_fit_many(tokens.tfidf(counts, weights, norm, key, max_features), df.select(key, label), variants, key, label, max_features)
    k = len(model.classes)
    tables = [model.table.select("term", model.at("ll", i).alias("ll")) for i in range(len(alphas))]
    return [TrainedText(weights, BayesModel(model.classes, t, model.prior[i * k : i * k + k], 1, max_features), norm) for i, t in enumerate(tables)]


def train_and_evaluate(
    df: DataFrame, eval_pct: int = 20, key: str = "doc_id", label: str = "label", text: str = "text", min_df: float | int = 1,
    max_df: float | int = 1.0, max_features: int | None = 10_000, norm: str | None = "l2", alpha: float = 1.0,
) -> DataFrame:
    """The whole job: split, features, fit, accuracy per part. The texts of both parts are
    counted once; vocabulary, weights and model see the training part alone."""
    docs = shape.hash_split(df.select(key, label), key, eval_pct)
    counts = materialize(tokens.term_counts(df, key, text), "counts")
    seen = shape.hash_split(counts, key, eval_pct).where("part = 'train'")
    n = docs.where("part = 'train'").agg(F.count(F.lit(1))).scalar()
    weights = materialize(tokens.idf(tokens.build_vocab(seen, n, min_df, max_df, max_features), n), "weights")
    features = materialize(tokens.tfidf(counts, weights, norm, key, max_features), "features")
    model = nb_fit_many(features, docs, [Variant(F.col("part") == "train", alpha)], key, label, max_features)
    scored = nb_predict(features, docs, model, key)
    return scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col(label) == F.col("prediction")).cast("int")).alias("accuracy")
    )
