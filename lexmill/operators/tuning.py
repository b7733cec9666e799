"""Cross-validation, learning curves and trial tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions.hashing import shuffle_key
from lexmill.functions.ordered import ordered_scan
from lexmill.operators.feature_sets import FeatureSet, fit_features
from lexmill.operators.naive_bayes import BayesModel, Variant, class_of, nb_fit_sets, nb_scores_sets
from lexmill.session import materialize


def with_fold(df: DataFrame, key: str, label: str, folds: int, seed: str = "fold") -> DataFrame:
    """Stratified folds: inside each label, shuffled rows are dealt out in turn."""
    dealt = ordered_scan(
        df.withColumn("_shuffle", shuffle_key(key, seed)), [label], ["_shuffle", key], {"_n": ("row_number",)}, hashed=True
    )
    return dealt.select(*df.columns, ((F.col("_n") - 1) % folds).cast("int").alias("fold"))


def _accuracy(scored: DataFrame, model: BayesModel, masks: Sequence[dict[str, Column]], label: str) -> DataFrame:
    """One row per variant and mask name: share of masked rows predicted right."""
    aggs = []
    for i, parts in enumerate(masks):
        right = class_of(model, model.at("joint", i)) == F.col(label)
        for name, mask in parts.items():
            score = F.avg(F.when(mask, right.cast("int")))
            aggs.append(
                F.struct(F.lit(i).alias("variant"), F.lit(name).alias("part"), F.count_if(mask).alias("n_rows"), score.alias("score")).alias(f"a{len(aggs)}")
            )
    one = scored.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def grid_search_nb(
    counts: DataFrame, docs: DataFrame, alphas: Sequence[float], folds: int = 3, key: str = "doc_id", label: str = "label", **limits
) -> DataFrame:
    """(trial, alpha, fold, part, n_rows, score) for every smoothing value and fold.

    ``counts``: (key, term, tf). Vocabulary and IDF are fitted inside each training set;
    ``limits`` are those of a ``FeatureSet``.
    """
    dealt = materialize(with_fold(docs.select(key, label), key, label, folds), "folds")
    members = [F.col("fold") != f for f in range(folds)]
    features = fit_features(counts, dealt, members, [FeatureSet(f, **limits) for f in range(folds)], key)
    trials = [(t, a, f) for t, a in enumerate(alphas) for f in range(folds)]
    model = nb_fit_sets(features, dealt, [Variant(members[f], a, f) for _, a, f in trials], label)
    masks = [{"train": members[f], "test": F.col("fold") == f} for _, _, f in trials]
    scores = _accuracy(nb_scores_sets(features, dealt, model), model, masks, label)
    names = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(float(a)).alias("alpha"), F.lit(f).alias("fold")) for t, a, f in trials])
    return scores.withColumn("_v", F.get(names, F.col("variant"))).select("_v.*", "part", "n_rows", "score")


def search_objective(counts: DataFrame, docs: DataFrame, settings: Sequence[dict], folds: int = 3, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(trial, test_score, std, train_score) for every proposed setting, all in one pass.

    A setting names ``alpha`` and any limits of a ``FeatureSet``; what it leaves out has the
    default. The score is the mean test accuracy over the folds, each with a vocabulary and
    IDF of its own training set.
    """
    dealt = materialize(with_fold(docs.select(key, label), key, label, folds), "folds")
    members = [F.col("fold") != f for f in range(folds)]
    cells = [(t, f) for t in range(len(settings)) for f in range(folds)]
    sets = [FeatureSet(f, **{k: v for k, v in settings[t].items() if k != "alpha"}) for t, f in cells]
    features = fit_features(counts, dealt, members, sets, key)
    variants = [Variant(members[f], settings[t].get("alpha", 1.0), i) for i, (t, f) in enumerate(cells)]
    model = nb_fit_sets(features, dealt, variants, label)
    masks = [{"train": members[f], "test": F.col("fold") == f} for _, f in cells]
    scores = _accuracy(nb_scores_sets(features, dealt, model), model, masks, label)
    scores = scores.withColumn("trial", F.floor(F.col("variant") / folds).cast("int"))
    return cv_summary(scores, [], folds).drop("cv_folds")


def cv_summary(results: DataFrame, params: Sequence[str], folds: int, steps: dict[str, str] | None = None, date: str | None = None) -> DataFrame:
    """One row per trial: mean and population deviation of the test scores, mean
    train score, folds, parameters, and optionally a date and the named steps."""
    test = F.when(F.col("part") == "test", F.col("score"))
    train = F.when(F.col("part") == "train", F.col("score"))
    out = results.groupBy("trial", *params).agg(
        F.avg(test).alias("test_score"), F.stddev_pop(test).alias("std"), F.avg(train).alias("train_score"),
        F.lit(float(folds)).alias("cv_folds"),
    )
    if date is not None:
        out = out.withColumn("date", F.lit(date))
    for name, text in (steps or {}).items():
        out = out.withColumn(name, F.lit(text))
    return out


def append_summary(summary: DataFrame, path: str) -> None:
    """Add the rows to a folder of ';' CSV files, each with a header."""
    summary.write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were ever appended to the folder."""
    return spark.read.option("sep", ";").option("header", True).option("inferSchema", True).csv(path)


def best_params(summary: DataFrame, params: Sequence[str]) -> DataFrame:
    """The trial with the best mean test score, the first one on a tie."""
    best = F.min(F.struct((-F.col("test_score")).alias("neg"), F.col("trial"), *params))
    return summary.agg(best.alias("b")).select("b.trial", *[f"b.{p}" for p in params], (-F.col("b.neg")).alias("test_score"))


def round_params(df: DataFrame, is_int: dict[str, bool]) -> DataFrame:
    """Parameters a search proposed as doubles: whole numbers where required."""
    return df.withColumns(
        {c: (F.bround(F.col(c), 0).cast("int") if whole else F.col(c).cast("double")) for c, whole in is_int.items()}
    )


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    cond = F.lit(True)
    for name, (low, high) in ranges.items():
        cond = cond & F.col(name).between(low, high)
    return cond


def cv_history_filter(df: DataFrame, ranges: dict[str, tuple[float, float]], folds: int) -> DataFrame:
    """Earlier results that a new search can start from: same fold count, inside the
    ranges, each setting once with its best score as ``target``."""
    params = list(ranges)
    return (
        df.where((F.col("cv_folds") == folds) & in_ranges(ranges))
        .groupBy(*params)
        .agg(F.max("test_score").alias("target"))
    )


def best_trial(df: DataFrame, ranges: dict[str, tuple[float, float]], metric: str, study: str = "study", maximize: bool = True) -> DataFrame:
    """Per study the best trial among those inside the allowed ranges; ties go to
    the lowest trial number."""
    value = -F.col(metric) if maximize else F.col(metric)
    best = F.min(F.struct(value.alias("v"), F.col("trial"), *list(ranges)))
    return (
        df.where(in_ranges(ranges) & F.col(metric).isNotNull())
        .groupBy(study)
        .agg(F.count(F.lit(1)).alias("n_trials"), best.alias("b"))
        .select(study, "n_trials", "b.trial", *[f"b.{p}" for p in ranges], (-F.col("b.v") if maximize else F.col("b.v")).alias(metric))
    )


def learning_curve(
    counts: DataFrame, docs: DataFrame, sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5,
    alpha: float = 1.0, key: str = "doc_id", label: str = "label", seed: str = "curve", **limits,
) -> DataFrame:
    """(size, n_train, train_mean, train_std, test_mean, test_std).

    The training rows of a fold are ranked in shuffled order; a size takes the
    first share of them, so smaller sizes are prefixes of larger ones. Vocabulary and
    IDF come from the rows of that size alone; ``limits`` are those of a ``FeatureSet``.
    """
    dealt = with_fold(docs.select(key, label), key, label, folds)
    # one copy per fold that the row trains
    copies = dealt.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("train_fold <> fold")
    order = shuffle_key(F.concat(F.col("train_fold").cast("string"), F.lit("-"), F.col(key).cast("string")), seed)
    ranked = ordered_scan(
        materialize(copies.withColumn("_shuffle", order), "copies"), ["train_fold"], ["_shuffle", key], {"_n": ("row_number",)},
        hashed=True,
    )
    per_fold = copies.groupBy("train_fold").agg(F.count(F.lit(1)).alias("_size"))
    share = [F.floor(F.col("_size") * F.lit(s)) for s in sizes]
    tier = F.lit(len(sizes))
    for i in reversed(range(len(sizes))):
        tier = F.when(F.col("_n") <= share[i], F.lit(i)).otherwise(tier)
    tiers = (
        ranked.join(F.broadcast(per_fold), "train_fold")  # one row per fold
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("train_fold", tier.alias("tier")))).alias("tiers"))
    )
    ready = materialize(dealt.join(tiers, key, "left"), "tiers")
    cells = [(f, i) for f in range(folds) for i in range(len(sizes))]

    def member(f: int, i: int) -> Column:
        return F.coalesce(F.try_element_at("tiers", F.lit(f)) <= i, F.lit(False))

    members = [member(f, i) for f, i in cells]
    features = fit_features(counts, ready, members, [FeatureSet(v, **limits) for v in range(len(cells))], key)
    model = nb_fit_sets(features, ready, [Variant(m, alpha, v) for v, m in enumerate(members)], label)
    masks = [{"train": member(f, i), "test": F.col("fold") == f} for f, i in cells]
    scores = _accuracy(nb_scores_sets(features, ready, model), model, masks, label)
    at = (F.col("variant") % len(sizes)).cast("int")
    test, train = (F.when(F.col("part") == p, F.col("score")) for p in ("test", "train"))
    return (
        scores.withColumn("size", F.get(F.array(*[F.lit(float(s)) for s in sizes]), at))
        .groupBy("size")
        .agg(
            F.avg(F.when(F.col("part") == "train", F.col("n_rows"))).alias("n_train"),
            F.avg(train).alias("train_mean"), F.stddev_pop(train).alias("train_std"),
            F.avg(test).alias("test_mean"), F.stddev_pop(test).alias("test_std"),
        )
    )
