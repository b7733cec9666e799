"""Naive Bayes, evaluation, tuning and telemetry against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F, types as T

from lexmill.operators import embeddings, estimators, feature_sets, logistic, metrics, naive_bayes, roc, search, telemetry, tokens, tuning
from lexmill.operators.feature_sets import FeatureSet, feature_weights
from lexmill.session import materialize, scratch_path
from lexmill.streaming import jobs

WORDS = ["red", "blue", "green", "cold", "warm", "wind"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        label = int(i % 3 == 0)
        p = np.array([4, 1, 1, 1, 3, 1] if label else [1, 4, 1, 3, 1, 1], dtype=float)
        rows.append((i, " ".join(rng.choice(WORDS, size=6, p=p / p.sum())), label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int").cache()


@pytest.fixture(scope="module")
def weighted(spark, corpus):
    n = corpus.agg(F.count("*")).scalar()
    counts = tokens.term_counts(corpus)
    return tokens.tfidf(counts, tokens.idf(tokens.build_vocab(counts, n), n)).cache()


def test_likelihoods_equal_mllib(spark, corpus, weighted):
    ids = {w: i for i, w in enumerate(sorted(WORDS))}
    pdf = weighted.toPandas().merge(corpus.select("doc_id", "label").toPandas(), on="doc_id")
    rows = [
        (float(g.label.iloc[0]), Vectors.sparse(6, sorted((ids[t], w) for t, w in zip(g.term, g.weight)))) for _, g in pdf.groupby("doc_id")
    ]
    ml = NaiveBayes(smoothing=1.0).fit(spark.createDataFrame(rows, ["label", "features"]))
    ours = naive_bayes.nb_fit(weighted, corpus.select("doc_id", "label"))
    table = {r.term: r.ll for r in ours.table.collect()}
    for w, i in ids.items():
        assert np.allclose(table[w], [ml.theta[c, i] for c in range(2)])
    assert np.allclose(ours.prior, [math.log(80 / 120), math.log(40 / 120)])


def test_prediction_edge_cases(spark, corpus):
    fitted = naive_bayes.train(corpus)
    odd = spark.createDataFrame([(900, "unknown words only", 7), (901, "", 1), (902, "red red warm", 1)], "doc_id long, text string, label int")
    got = {r.doc_id: r for r in fitted.predict(odd, keep=["label"]).collect()}
    assert got[900].prediction == 0 and got[901].prediction == 0 and got[902].prediction == 1  # prior favours 0
    assert np.allclose(got[900].prob, [2 / 3, 1 / 3]) and got[900].label == 7
    tie = spark.createDataFrame([(1, "red", "b"), (2, "red", "a")], "doc_id long, text string, label string")
    even = naive_bayes.train(tie).predict(spark.createDataFrame([(5, "red")], "doc_id long, text string"))
    assert even.first().prediction == "a"


def test_grid_search_equals_separate_fits(corpus):
    """Each fold's model equals one trained on that fold's rows alone."""
    docs = corpus.select("doc_id", "label")
    counts = tokens.term_counts(corpus).cache()
    got = {(r.trial, r.fold, r.part): (r.n_rows, r.score) for r in tuning.grid_search_nb(counts, docs, [0.2, 2.0], 3, min_df=2).collect()}
    folds = tuning.with_fold(corpus, "doc_id", "label", 3).cache()
    assert {r["count"] for r in folds.groupBy("fold", "label").count().collect()} <= {13, 14, 26, 27}
    own = naive_bayes.train(folds.where("fold <> 1"), min_df=2, alpha=2.0, max_features=None).predict(folds, keep=["label", "fold"])
    test = metrics.accuracy(own.where("fold = 1")).first()[0]
    assert got[(1, 1, "test")] == (folds.where("fold = 1").count(), pytest.approx(test))
    assert got[(1, 1, "train")][0] == folds.where("fold <> 1").count()


@pytest.mark.parametrize("limits", [{}, {"min_df": 3, "max_df": 0.4}, {"max_features": 4, "norm": "l1"}, {"max_features": 5, "norm": None}, {"max_features": 100}])
def test_feature_weights_equal_single_sets(spark, limits):
    """Every set's weights equal those fitted on its rows alone, ties at the cap included."""
    rng = np.random.default_rng(2)
    words = list("abcdefghij")
    rows = [(i, " ".join(w * 2 for w in rng.choice(words, size=rng.integers(0, 9))), i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fold int").cache()
    counts = tokens.term_counts(df).cache()
    members = [F.col("fold") != 0, F.col("fold") == 2]
    found = feature_weights(counts, df.select("doc_id", "fold"), members, [FeatureSet(1, **limits), FeatureSet(0, **limits)])
    got = found.collect()
    own = {k: v for k, v in limits.items() if k != "norm"}
    for place, member in ((0, members[1]), (1, members[0])):
        part = df.where(member)
        n = part.agg(F.count("*")).scalar()
        vocab = tokens.build_vocab(tokens.term_counts(part), n, **({"max_features": None} | own))
        wanted = {(r.doc_id, r.term): r.weight for r in tokens.tfidf(counts, tokens.idf(vocab, n), limits.get("norm", "l2")).collect()}
        have = {(r.doc_id, r.term): r.weight[place] for r in got if r.weight[place] is not None}
        assert have.keys() == wanted.keys() and all(have[k] == pytest.approx(wanted[k]) for k in have)


def test_search_objective_and_proposals(corpus):
    docs, counts = corpus.select("doc_id", "label"), tokens.term_counts(corpus).cache()
    settings = [{"alpha": 0.2, "min_df": 2}, {"alpha": 2.0, "max_features": 3, "norm": "l1"}]
    got = {r.trial: r.test_score for r in tuning.search_objective(counts, docs, settings, 3).collect()}
    alone = tuning.grid_search_nb(counts, docs, [0.2], 3, min_df=2).where("part = 'test'").agg(F.avg("score")).first()[0]
    assert got[0] == pytest.approx(alone) and len(got) == 2
    space = {"x": search.Real(0.0, 1.0), "n": search.Whole(1, 9), "norm": search.Choice(None, "l1", "l2")}

    def run():
        s = search.Search(space, seed=4)
        for _ in range(10):
            asked = s.ask(3)
            assert all(isinstance(a["n"], int) and 1 <= a["n"] <= 9 and 0 <= a["x"] <= 1 for a in asked)
            s.tell(asked, [-((a["x"] - 0.3) ** 2) - 0.01 * abs(a["n"] - 5) - (a["norm"] == "l1") for a in asked])
        return s

    one, two = run(), run()
    assert one.told == two.told  # reruns agree
    assert len({tuple(a.items()) for a, _ in one.told}) == len(one.told)
    best = max(one.told, key=lambda t: t[1])
    assert best[1] > -0.03 and best[1] > max(v for _, v in one.told[:3])
    mean, spread = one.expected([a for a, _ in one.told], one.told)
    assert np.allclose(mean, [v for _, v in one.told], atol=0.1) and (spread < 0.1).all()


def test_logistic_equals_mllib(spark, corpus):
    counts = tokens.ngram_counts(corpus, 1, 2).cache()
    n = corpus.count()
    fit = logistic.fit_logistic(counts, corpus.select("doc_id", "label"), tolerance=1e-9, max_rounds=150)
    ids = {t: i for i, t in enumerate(sorted({r.term for r in counts.select("term").distinct().collect()}))}
    pdf = counts.toPandas()
    labels = {r.doc_id: r.label for r in corpus.collect()}
    rows = [(float(labels[k]), Vectors.sparse(len(ids), sorted((ids[t], float(v)) for t, v in zip(g.term, g.tf)))) for k, g in pdf.groupby("doc_id")]
    ml = LogisticRegression(regParam=1 / n, standardization=False, tol=1e-14, maxIter=1000).fit(spark.createDataFrame(rows, ["label", "features"]))
    have = {r.term: r.coef for r in fit.coefficients.collect()}
    assert have.keys() == ids.keys() and fit.gradient <= 1e-9
    assert np.allclose([have[t] for t in ids], [ml.coefficients[i] for i in ids.values()], atol=1e-6)
    assert fit.intercept == pytest.approx(ml.intercept, abs=1e-6)
    slope = logistic.gradient_at(fit, counts, corpus.select("doc_id", "label"))
    assert slope.count() == len(ids) + 1 and slope.agg(F.max(F.abs("gradient"))).first()[0] <= 2e-9
    odd = spark.createDataFrame([(900, "nothing known"), (901, "")], "doc_id long, text string")
    prior = [r.prob for r in fit.predict(tokens.ngram_counts(odd, 1, 2), odd.select("doc_id")).collect()]
    assert prior == [pytest.approx(1 / (1 + math.exp(-fit.intercept)))] * 2
    # documents without a label are left out, those without terms count
    more = corpus.select("doc_id", "label").unionByName(spark.createDataFrame([(500, None), (501, 1)], "doc_id long, label int"))
    wider = logistic.fit_logistic(counts, more, tolerance=1e-4)
    assert wider.coefficients.count() == len(ids)


def test_logistic_settles_on_values_of_many_sizes(spark, monkeypatch):
    """A hundred rounds left a gradient far above the tolerance. Several blocks and groups; a
    key that comes twice counts twice, rows without a key count in the intercept only."""
    monkeypatch.setattr(logistic, "BLOCK_DOCS", 16, raising=False)
    monkeypatch.setattr(logistic, "GROUP_CELLS", 100, raising=False)
    rng = np.random.default_rng(5)
    rows = [
        (i, f"t{c:02d}", int(rng.integers(1, 4)) * 30 ** int(rng.integers(0, 3)))
        for i in range(60) for c in np.flatnonzero(rng.random(30) < 0.4)
    ]
    labels = [(i, int(rng.random() < 0.5)) for i in range(60)]
    values = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    docs = spark.createDataFrame([*labels, (3, 0), (3, 1), (None, 1)], "doc_id long, label int")
    fit = logistic.fit_logistic(values, docs, tolerance=1e-5)
    assert fit.gradient <= 1e-5
    # the gradient from scratch, in one array
    coef = {r.term: r.coef for r in fit.coefficients.collect()}
    terms = sorted(coef)
    x = np.zeros((60, len(terms)))
    for i, t, v in rows:
        x[i, terms.index(t)] = v
    at = [(x[i], y) for i, y in [*labels, (3, 0), (3, 1)]] + [(np.zeros(len(terms)), 1)]
    u = np.array([coef[t] for t in terms])
    rest = [1 / (1 + np.exp(-(row @ u + fit.intercept))) - y for row, y in at]
    g = sum(r * row for r, (row, _) in zip(rest, at)) / len(at) + u / len(at)
    assert np.abs(g).max() <= 2e-5 and abs(sum(rest)) / len(at) <= 2e-5


def test_logistic_rounds_are_one_job_each(spark, corpus, monkeypatch):
    """Rounds wrote and read tables, several jobs each. With more documents than the driver
    takes they still do, and the fit is the same."""
    counts = materialize(tokens.ngram_counts(corpus, 1, 2), "grams")
    docs = corpus.select("doc_id", "label")

    def run(group):
        spark.sparkContext.setJobGroup(group, group)
        fit = logistic.fit_logistic(counts, docs, tolerance=1e-6)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return fit, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    fit, jobs = run("few documents")
    assert fit.rounds > 10 and jobs <= fit.rounds + 50
    monkeypatch.setattr(logistic, "TOLD", 0)
    monkeypatch.setattr(logistic, "PACK_CELLS", 50)
    tables, more = run("many documents")
    assert more > jobs
    want = {r.term: r.coef for r in tables.coefficients.collect()}
    have = {r.term: r.coef for r in fit.coefficients.collect()}
    assert have.keys() == want.keys() and np.allclose([have[t] for t in want], list(want.values()), atol=1e-4)
    assert fit.intercept == pytest.approx(tables.intercept, abs=1e-4)


def test_logistic_terms_with_equal_cells_are_one_column():
    doc, tf = np.array([0, 1, 0, 1, 1, 2, 1]), np.array([2.0, 1, 2, 1, 1, 1, 1])
    cols = logistic._equal_columns(doc, tf, np.array([0, 2, 4, 5, 6]))
    assert cols[0] == cols[1] and cols[2] == cols[4] and sorted(set(cols)) == [0, 1, 2]


def test_equal_columns_share_a_coefficient(spark):
    rows = [(1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1), (2, "e", 1)]
    terms, columns = logistic.equal_columns(spark.createDataFrame(rows, "doc_id long, term string, tf long"))
    found = {r.term: r.col for r in terms.collect()}
    assert found["a"] == found["b"] and found["c"] == found["e"] and len(set(found.values())) == 3
    assert sorted((r.term, r.twins) for r in columns.collect()) == [("a", 2), ("c", 2), ("d", 1)]


def test_cv_tables(spark):
    rows = [(0, 0.5, "test", 0.8), (0, 0.5, "test", 0.6), (0, 0.5, "train", 0.9), (1, 1.0, "test", 0.7), (1, 1.0, "test", 0.7), (1, 1.0, "train", 1.0)]
    s = tuning.cv_summary(spark.createDataFrame(rows, "trial int, alpha double, part string, score double"), ["alpha"], 2, {"nb": "multinomial"}, "2020.01.01 10:00")
    got = {r.trial: r for r in s.collect()}
    assert got[0]["std"] == pytest.approx(0.1) and got[0].test_score == pytest.approx(0.7) and got[1].date == "2020.01.01 10:00"
    assert tuning.best_params(s, ["alpha"]).first().trial == 0
    path = scratch_path(spark, "cv")
    tuning.append_summary(s, path)
    tuning.append_summary(s, path)
    back = tuning.read_summaries(spark, path)
    assert back.count() == 4
    kept = tuning.cv_history_filter(back, {"alpha": (0.1, 0.7)}, 2).collect()
    assert [(r.alpha, r.target) for r in kept] == [(0.5, pytest.approx(0.7))]
    near = spark.createDataFrame([(2.5, 1.2), (3.5, 0.1)], "a double, b double")
    assert [r.a for r in tuning.round_params(near, {"a": True, "b": False}).collect()] == [2, 4]


def test_learning_curve_uses_all_rows_at_the_end(corpus):
    counts = tokens.term_counts(corpus)
    got = {r["size"]: r for r in tuning.learning_curve(counts, corpus.select("doc_id", "label"), (0.1, 0.5, 1.0), 4).collect()}
    assert got[1.0].n_train == 90 and got[0.1].n_train == 9
    assert got[1.0].test_mean > 0.6


# ---- evaluation -----------------------------------------------------------

def sk_curve(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps, fps = np.cumsum(y)[idx], 1 + idx - np.cumsum(y)[idx]
    thr = s[idx]
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        tps, fps, thr = tps[keep], fps[keep], thr[keep]
    return np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1], np.r_[thr[0] + 1, thr]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 300).round(2)
    y = np.array([rng.choice(3, p=q / q.sum()) for q in p])
    df = spark.createDataFrame([(int(a), [float(v) for v in q]) for a, q in zip(y, p)], "label int, prob array<double>")
    return df.cache(), y, p


def test_roc_curves(scores):
    df, y, p = scores
    got = roc.roc_per_class(df, [0, 1, 2]).toPandas()
    aucs = {r["class"]: r.auc for r in roc.auc_per_class(df, [0, 1, 2]).collect()}
    curves = []
    for c in range(3):
        fpr, tpr, thr = sk_curve((y == c).astype(int), p[:, c])
        g = got[got["class"] == c].sort_values("threshold", ascending=False)
        assert np.allclose(g.fpr, fpr) and np.allclose(g.tpr, tpr) and np.allclose(g.threshold, thr)
        assert aucs[c] == pytest.approx(np.trapezoid(tpr, fpr))
        curves.append((fpr, tpr))
    fpr, tpr, _ = sk_curve((y[:, None] == np.arange(3)).astype(int).ravel(), p.ravel())
    micro = roc.roc_micro(df, [0, 1, 2]).toPandas().sort_values("threshold", ascending=False)
    assert np.allclose(micro.fpr, fpr) and np.allclose(micro.tpr, tpr)
    grid = np.unique(np.concatenate([f for f, _ in curves]))
    mean = sum(np.interp(grid, f, t) for f, t in curves) / 3
    macro_df = roc.roc_macro(df, [0, 1, 2])
    macro = macro_df.toPandas().sort_values("fpr")
    assert np.allclose(macro.fpr, grid) and np.allclose(macro.tpr, mean)
    assert roc.curve_area(macro_df).first().auc == pytest.approx(np.trapezoid(mean, grid))


def test_one_class_and_ties(spark):
    one = spark.createDataFrame([(0.3, 1), (0.3, 1)], "score double, label int")
    r = roc.ranking(one).first()
    assert r.auc is None and r.average_precision == 1.0
    none = spark.createDataFrame([(0.3, 0)], "score double, label int")
    assert roc.ranking(none).first().average_precision == 0.0
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "score double, label int")
    assert roc.ranking(tied).first()[:] == (pytest.approx(1 / 3), 0.5)


def test_counts_agree(spark, scores):
    df, y, p = scores
    pred = df.withColumn("prediction", (F.array_position("prob", F.array_max("prob")) - 1).cast("int"))
    cm = metrics.confusion_matrix(pred).collect()
    assert sum(r.n for r in cm) == 300 and len(cm) == 9
    micro = metrics.precision_avg(pred).first().precision_micro
    assert micro == pytest.approx(metrics.accuracy(pred).first()[0])
    rep = {r["class"]: r for r in metrics.classification_report(pred).collect()}
    assert rep["weighted avg"].recall == pytest.approx(micro) and rep["macro avg"].support == 300


def test_confidence_and_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, [0.6, 0.4]), (1, 0, [0.9, 0.1])], "label int, prediction int, prob array<double>")
    assert metrics.confidence_report(df, 0.95).first()[:] == (0.0, 0.0, 0.5)
    assert metrics.confidence_report(df, 0.7).first()[:] == (0.0, 0.5, 0.5)
    assert metrics.binary_prf(df).first()[:] == (0.0, 0.0, 0.0)
    seen = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(df).collect()}
    assert seen == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


# ---- telemetry ------------------------------------------------------------

def finder(losses, beta=0.98, factor=4.0):
    avg, best, out = 0.0, 1e9, []
    for n, loss in enumerate(losses, 1):
        avg = beta * avg + (1 - beta) * loss
        smooth = avg / (1 - beta**n)
        out.append(smooth)
        if n > 1 and smooth > factor * best:
            break
        if n == 1 or smooth < best:
            best = smooth
    return out


def test_lr_finder_with_chunks(spark):
    rng = np.random.default_rng(8)
    runs = {"hot": np.r_[rng.uniform(0.5, 1.5, 900), rng.uniform(50, 90, 300)], "flat": rng.uniform(1, 2, 130), "short": rng.uniform(1, 2, 5)}
    df = spark.createDataFrame([(r, i + 1, float(v)) for r, vs in runs.items() for i, v in enumerate(vs)], "run string, n long, loss double")
    smooth = telemetry.smoothed_loss(df).toPandas().sort_values("n")
    for r, vs in runs.items():
        want = finder(vs, factor=1e12)
        assert np.allclose(smooth[smooth.run == r].smooth, want)
    got = telemetry.lr_finder(df).toPandas().sort_values("n")
    for r, vs in runs.items():
        want = finder(vs)[10:-1]
        assert np.allclose(got[got.run == r].smooth, want), r
    assert len(got[got.run == "hot"]) < 1150


def test_smoothed_loss_of_quick_fades(spark):
    values = np.random.default_rng(9).uniform(0.5, 1.5, 20_000)
    df = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(values)], "run string, n long, loss double")
    for beta in (0.0, 0.5, 0.8, 0.9999):
        got = telemetry.smoothed_loss(df, beta).toPandas().sort_values("n").smooth.to_numpy()
        average, want = 0.0, []
        for n, v in enumerate(values, 1):
            average = beta * average + (1 - beta) * v
            want.append(average / (1 - beta**n))
        assert np.allclose(got, want, rtol=1e-9), beta


def test_metric_sheet_refuses_a_third_label(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "label int, prediction int")
    with pytest.raises(ValueError):
        metrics.metric_sheet(df, "test")


def test_every_gram_is_kept_and_long_words_are_split(spark):
    from lexmill.operators import encode

    vocab = spark.createDataFrame([("a",), ("##a",), ("##aaaa",)], "piece string")
    got = encode.subword_tokens(spark.createDataFrame([("a" * 150,)], "word string"), vocab).first().pieces
    assert "".join(got).replace("##", "") == "a" * 150


def test_large_weights_are_not_broadcast(spark):
    counts = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as term", "1L as tf")
    weights = spark.range(100).selectExpr("cast(id as string) as term", "1.0 as idf")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tokens.tfidf(counts, weights)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def test_epoch_timing(spark):
    t = pd.Timestamp("2024-01-01")
    marks = [("begin", 0), ("end", 5), ("end", 7), ("begin", 8), ("begin", 9), ("end", 12)]
    df = spark.createDataFrame([("r", "epoch", m, (t + pd.Timedelta(seconds=s)).to_pydatetime(), i) for i, (m, s) in enumerate(marks)],
                               "run string, phase string, mark string, ts timestamp, event_id int")
    assert sorted((r.epoch, r.seconds) for r in telemetry.epoch_timing(df).collect()) == [(1, 5.0), (2, 7.0), (3, 3.0)]


# ---- vectors --------------------------------------------------------------

def brute(pdf, k):
    m = np.array(pdf.v.tolist())
    size = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(size == 0, 1, size)
    cos = np.round(m @ m.T, 9)
    out = set()
    for i in range(len(pdf)):
        c = sorted((-cos[i, j], pdf.id[j]) for j in range(len(pdf)) if pdf.g[j] != pdf.g[i])[:k]
        out |= {(pdf.id[i], r, nb) for r, (_, nb) in enumerate(c, 1)}
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_equal_brute_force(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = rng.normal(size=(360, 8)) if not clustered else centres[np.arange(360) % 6] + 0.05 * rng.normal(size=(360, 8))
    v[::3] = v[0]  # a third of the rows are copies
    v[1] = v[2] = 0.0  # and two have no direction
    pdf = pd.DataFrame({"id": np.arange(360), "g": [f"g{(i * 7) % 4}" for i in range(360)], "v": [list(map(float, x)) for x in v]})
    got = embeddings.cross_group_neighbours(spark.createDataFrame(pdf, "id long, g string, v array<double>"), "id", "g", "v", 4, block=16, fan=4)
    assert {(r.key, r["rank"], r.neighbour) for r in got.collect()} == brute(pdf, 4)


def test_neighbours_move_by_teams_of_leaves(spark, monkeypatch):
    """Cells little above the limit are not cut to splinters, and a vector moves once for
    each team of leaves in reach, whatever the number of leaves."""
    monkeypatch.setattr(embeddings, "TEAM", 200)
    monkeypatch.setattr(embeddings, "CELLS", 100)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8))
    v[::5] = v[0]
    pdf = pd.DataFrame({"id": np.arange(600), "g": np.arange(600) % 4, "v": [list(map(float, x)) for x in v]})
    df = spark.createDataFrame(pdf, "id long, g long, v array<double>")
    reps = df.selectExpr("id as rep", "g as grp", "v as vec", "array(id) as keys").where("id % 5 <> 0")
    leaves, _, depth = embeddings._grow(reps, 16, 32)
    found = embeddings._teams(leaves).collect()
    assert depth > 1 and len(found) <= 4 * 600 / 16 and len({t.team for t in found}) <= 3
    got = embeddings.cross_group_neighbours(df, "id", "g", "v", 3, block=16, fan=32)
    assert {(r.key, r["rank"], r.neighbour) for r in got.collect()} == brute(pdf, 3)


def test_single_group_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], "id long, g string, v array<double>")
    assert embeddings.cross_group_neighbours(df, "id", "g", "v", 2).count() == 0


def test_rows_without_a_vector_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", None), (4, None, [1.0, 1.0])], "id long, g string, v array<double>")
    got = {(r.key, r["rank"], r.neighbour) for r in embeddings.cross_group_neighbours(df, "id", "g", "v", 2).collect()}
    assert got == {(1, 1, 4), (1, 2, 2), (2, 1, 4), (2, 2, 1), (4, 1, 1), (4, 2, 2)}
    assert embeddings.cross_group_neighbours(df.limit(0), "id", "g", "v", 2).count() == 0


def test_anchor_projection(spark):
    df = spark.createDataFrame([("s", 0, [1.0, 2.0, 0.0]), ("s", 1, [0.5, 1.5, 3.0]), ("s", 2, [0.0, 1.0, 1.0]), ("t", 0, [2.0, 0.0, 0.0]),
                               ("p", 0, [1.0, 1.0, 0.0]), ("p", 1, [1.0, 0.0, 5.0]), ("p", 2, [2.0, 2.0, 0.0]), ("z", 0, [0.0, 0.0, 0.0])],
                               "g string, pos int, v array<double>")
    got = {(r.g, r.pos): (r.u, r.v) for r in embeddings.anchor_projection(df, "g", "pos", "v").collect()}
    b = np.array([[1.0, 2, 0], [0, 1, 1]])
    assert np.allclose(got[("s", 1)], np.linalg.pinv(b.T) @ np.array([0.5, 1.5, 3.0]))
    assert np.allclose(got[("s", 0)], (1, 0)) and np.allclose(got[("s", 2)], (0, 1)) and np.allclose(got[("t", 0)], (0.5, 0.5))
    parallel = np.array([[1.0, 1, 0], [2, 2, 0]])
    assert np.allclose(got[("p", 1)], np.linalg.pinv(parallel.T) @ np.array([1.0, 0, 5]))
    assert got[("z", 0)] == (None, None)


# ---- pipelines and streams ------------------------------------------------

def test_smooth_idf_stage_equals_long_table(spark, corpus, weighted):
    counted = CountVectorizer(inputCol="words", outputCol="counts")
    stages = [estimators.word_tokenizer(), counted, estimators.SmoothIdf(inputCol="counts", outputCol="w"), Normalizer(p=2.0, inputCol="w", outputCol="normed")]
    chain = Pipeline(stages=stages).fit(corpus)
    vocab = chain.stages[1].vocabulary
    rows = chain.transform(corpus).select("doc_id", "normed").collect()
    want = {(r.doc_id, r.term): r.weight for r in weighted.collect()}
    for r in rows[:20]:
        for i, w in zip(r.normed.indices, r.normed.values):
            assert want[(r.doc_id, vocab[i])] == pytest.approx(float(w))


def test_grid_search_fits_smoothing_values_together(corpus, monkeypatch):
    """Each value built the vocabulary of every fold anew."""
    chain = estimators.nb_chain()
    bayes = chain.getStages()[-1]
    search = lambda alphas: {r.params["alpha"]: (r.test_score, r.std) for r in estimators.grid_search(corpus, chain, {bayes.alpha: alphas}, folds=2)[1].collect()}
    alone = search([0.5])
    built, build = [], tokens.build_vocab
    monkeypatch.setattr(tokens, "build_vocab", lambda *a, **k: built.append(1) or build(*a, **k))
    both = search([0.5, 50.0])
    assert both[0.5] == alone[0.5] and len(both) == 2 and len(built) == 3  # two folds and the fit on all rows


def test_chain_keeps_every_term(corpus):
    model = estimators.nb_chain().fit(corpus)
    assert model.stages[0].trained.model.max_terms is None
    assert model.transform(corpus).where("prediction = label").count() > 80


def test_stream_goes_on_after_a_restart(spark, corpus):
    trained = naive_bayes.train(corpus)
    source, sink, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    read = lambda: spark.readStream.schema("doc_id LONG, text STRING, label INT").parquet(source)
    corpus.where("doc_id < 50").write.parquet(source)
    jobs.score_stream(read(), trained, sink, state, ["label"]).awaitTermination()
    corpus.where("doc_id >= 50").write.mode("append").parquet(source)
    jobs.score_stream(read(), trained, sink, state, ["label"]).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 120 == out.select("doc_id").distinct().count()
    batch = trained.predict(corpus, keep=["label"]).select("doc_id", "prediction")
    assert out.select("doc_id", "prediction").exceptAll(batch).count() == 0


def test_no_row_of_counts_is_stored_with_the_numbers_of_all_sets(spark, monkeypatch):
    """Learning curves keep weights as factors, and factors give the sums of the weights."""
    rows = [(i, "ab cd" if i % 3 else f"ef gh w{i % 4}", i % 2) for i in range(60)] + [(None, "ab zz", 1), (90, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    stored = []

    def kept(frame, name="table"):
        stored.append(frame.schema)
        return materialize(frame, name)

    for module in (tuning, naive_bayes, feature_sets):
        monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(feature_sets, "BLOCK_ROWS", 16)
    counts, docs = materialize(tokens.term_counts(df), "counts"), df.select("doc_id", "label")
    curve = tuning.learning_curve(counts, docs, min_df=2).collect()
    assert len(curve) == 5
    for schema in stored:
        wide = any(isinstance(f.dataType, T.ArrayType) for f in schema)
        assert not (wide and {"doc_id", "term"} <= set(schema.names))

    # folds by key: two sets and norms, null and repeated keys included
    df = df.union(spark.createDataFrame([(7, "ab yy", 0)], df.schema))
    counts, docs = materialize(tokens.term_counts(df), "counts"), df.select("doc_id", "label")
    dealt = docs.withColumn("fold", F.coalesce(F.col("doc_id") % 2, F.lit(0)))
    members = [F.col("fold") != f for f in range(2)]
    sets = [feature_sets.FeatureSet(0, min_df=2), feature_sets.FeatureSet(1, norm="l1"), feature_sets.FeatureSet(1, norm=None)]
    variants = [naive_bayes.Variant(members[s.member], 0.5 + i, i) for i, s in enumerate(sets)]
    weights = feature_sets.feature_weights(counts, dealt, members, sets)
    old = naive_bayes.nb_fit_many(weights, dealt, variants)
    features = feature_sets.fit_features(counts, dealt, members, sets)
    new = naive_bayes.nb_fit_sets(features, dealt, variants)
    assert features.counts.select("block").distinct().count() > 1
    assert new.prior == old.prior
    expected, found = ({r.term: r.ll for r in m.table.collect()} for m in (old, new))
    assert found.keys() == expected.keys() and all(found[t] == pytest.approx(expected[t]) for t in found)
    scored = lambda frame: sorted((str(r.doc_id), r.label, *r.joint) for r in frame.collect())
    a, b = scored(naive_bayes.nb_scores(weights, dealt, old)), scored(naive_bayes.nb_scores_sets(features, dealt, new))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x for r in b for x in r[2:]] == pytest.approx([x for r in a for x in r[2:]])
