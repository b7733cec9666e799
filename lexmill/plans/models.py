"""Naive Bayes, tuning and learning curves as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import vectors as vx
from lexmill.operators import many_classes, naive_bayes, shape, tokens, tuning
from lexmill.operators.search import Choice, Real, Search, Whole
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS, LABELLED, WORDS, extremes_sql, md5_bucket, md5_key, vocab_sql
from lexmill.session import materialize, scratch_path
from lexmill.sources import tables


def labelled(spark, d):
    return tables.load_corpus(spark, d).where("label IS NOT NULL").select("doc_id", "text", "lang", "label", "split")


def fitted(spark, d, alpha=1.0):
    return naive_bayes.train(labelled(spark, d).where("split = 'train'"), min_df=2, alpha=alpha)


NB = LABELLED + f""", toks AS (SELECT doc_id, label, split, unnest({WORDS}) AS term FROM labelled),
  allc AS (SELECT doc_id, label, split, term, count(*) AS tf FROM toks GROUP BY ALL),
  counts AS (SELECT * FROM allc WHERE split = 'train')""" + vocab_sql() + """,
  nd AS (SELECT count(*) AS n FROM labelled WHERE split = 'train'),
  weights AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab, nd),
  raw AS (SELECT doc_id, label, split, term, tf * idf AS w FROM allc JOIN weights USING (term)),
  tfidf AS (SELECT doc_id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw),
  classes AS (SELECT DISTINCT label FROM labelled WHERE split = 'train'),
  prior AS (SELECT label, ln(count(*) / (SELECT n FROM nd)) AS lp FROM labelled WHERE split = 'train' GROUP BY 1),
  sums AS (SELECT label, term, sum(weight) AS s FROM tfidf WHERE split = 'train' GROUP BY 1, 2),
  grid AS (SELECT c.label, v.term, coalesce(s, 0) AS s FROM classes c CROSS JOIN vocab v LEFT JOIN sums ON sums.label = c.label AND sums.term = v.term),
  ll AS (SELECT label, term, ln((s + 1.0::DOUBLE) / (sum(s) OVER (PARTITION BY label) + (SELECT count(*) FROM vocab))) AS ll FROM grid),
  hit AS (SELECT doc_id, l.label AS class, sum(weight * ll) AS s FROM tfidf t JOIN ll l USING (term) GROUP BY 1, 2),
  joint AS (SELECT d.doc_id, d.label, d.split, p.label AS class, lp + coalesce(h.s, 0) AS j FROM labelled d CROSS JOIN prior p
    LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.class = p.label),
  pred AS (SELECT doc_id, label, split, first(class ORDER BY j DESC, class) AS prediction FROM joint GROUP BY ALL)"""


@query("m1_nb_fit", f"WITH {NB} SELECT label, term, round(ll, 6) AS loglik FROM ll")
def m1(spark, d):
    model = fitted(spark, d).model
    names = F.array(*[F.lit(c) for c in model.classes])
    return model.table.select("term", F.posexplode("ll").alias("i", "loglik")).select(
        F.get(names, F.col("i")).alias("label"), "term", F.round("loglik", 6).alias("loglik")
    )


@query(
    "m2_nb_predict",
    f"""WITH {NB}, z AS (SELECT doc_id, class, exp(j - max(j) OVER (PARTITION BY doc_id)) AS e FROM joint),
        pr AS (SELECT doc_id, class, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM z)
        SELECT doc_id, pred.label, prediction, round(p, 6) AS prob_1 FROM pred JOIN pr USING (doc_id) WHERE pr.class = 1 AND split = 'test'""",
)
def m2(spark, d):
    scored = fitted(spark, d).predict(labelled(spark, d).where("split = 'test'"), keep=["label"])
    return scored.select("doc_id", "label", "prediction", F.round(F.get("prob", F.lit(1)), 6).alias("prob_1"))


@query(
    "m3_train_and_evaluate",
    f"""WITH {NB} SELECT CASE WHEN split = 'test' THEN 'eval' ELSE 'train' END AS part, count(*) AS n_rows,
        round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM pred GROUP BY 1""",
)
def m3(spark, d):
    return naive_bayes.train_and_evaluate(labelled(spark, d), 20, min_df=2).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "m3_report_by_language",
    f"""WITH {NB} SELECT lang, count(*) AS n_rows, round(avg(CASE WHEN pred.label = prediction THEN 1 ELSE 0 END), 6) AS accuracy
        FROM pred JOIN documents USING (doc_id) WHERE split = 'test' GROUP BY 1""",
)
def m3b(spark, d):
    test = labelled(spark, d).where("split = 'test'")
    scored = fitted(spark, d).predict(test, keep=["label", "lang"])
    right = (F.col("label") == F.col("prediction")).cast("int")
    return scored.groupBy("lang").agg(F.count("*").alias("n_rows"), F.round(F.avg(right), 6).alias("accuracy"))


MANY = NB.replace("labelled", "named").replace(LABELLED.replace("labelled", "named"), f"""{CORPUS},
  named AS (SELECT doc_id, text, lang || '-' || doc_id % 60 AS label, CASE WHEN {md5_bucket('doc_id')} < 20 THEN 'test' ELSE 'train' END AS split FROM documents)""").replace(
    vocab_sql(), vocab_sql(cap=None)
).replace("ORDER BY j DESC, class", "ORDER BY round(j, 6) DESC, class")


@query("m2_many_classes", f"WITH {MANY} SELECT doc_id, label, prediction FROM pred WHERE split = 'test'")
def m2_many(spark, d):
    """Hundreds of classes: languages by numbers. Model and classes stay tables."""
    docs = tables.load_corpus(spark, d).select("doc_id", "text", F.concat_ws("-", "lang", (F.col("doc_id") % 60).cast("string")).alias("label"))
    docs = shape.hash_split(docs, "doc_id", 20)
    train, test = docs.where("part = 'train'"), docs.where("part = 'eval'")
    n = train.agg(F.count(F.lit(1))).scalar()
    counts = materialize(tokens.term_counts(train), "counts")
    weights = materialize(tokens.idf(tokens.build_vocab(counts, n, 2, 1.0, None), n), "weights")
    model = many_classes.fit_classes(tokens.tfidf(counts, weights), train.select("doc_id", "label"))
    features = materialize(tokens.transform_features(test, weights), "features")
    return many_classes.predict_classes(features, test.select("doc_id", "label"), model).select("doc_id", "label", "prediction")


@query(
    "m7_softmax_argmax",
    """WITH x AS (SELECT vec_id, embedding AS v, list_max(embedding) AS top FROM embeddings),
       e AS (SELECT vec_id, v, list_transform(v, lambda z: exp(z::DOUBLE - top::DOUBLE)) AS e FROM x)
       SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top_prob, (list_position(v, list_max(v)) - 1)::INTEGER AS prediction FROM e""",
)
def m7(spark, d):
    logits = tables.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    prob = logits.select("vec_id", vx.softmax("z").alias("p"), vx.argmax("z").alias("prediction"))
    return prob.select("vec_id", F.round(F.array_max("p"), 6).alias("top_prob"), "prediction")


@query(
    "m9_top_coefficients",
    f"WITH {NB}, k AS (SELECT term, round(ll, 9) AS loglik FROM ll WHERE label = 1) " + extremes_sql("k", "loglik", places=6),
)
def m9(spark, d):
    model = fitted(spark, d).model
    table = model.table.withColumn("ll", F.transform("ll", lambda x: F.round(x, 9)))
    fixed = naive_bayes.BayesModel(model.classes, table, model.prior)
    return naive_bayes.top_coefficients(fixed, 20).withColumn("loglik", F.round("loglik", 6))


# ---- cross-validation -----------------------------------------------------

ALPHAS = (0.1, 0.5, 1.0)


def cv_inputs(spark, d):
    """Counts of all labelled documents, and the documents."""
    docs = labelled(spark, d)
    return materialize(tokens.term_counts(docs), "counts"), docs.select("doc_id", "label")


def folds_sql(n: int) -> str:
    return f"""(SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {md5_key('doc_id', 'fold')}, doc_id) - 1) % {n})::INTEGER AS fold FROM labelled)"""


def cv_sql(members: str, sets: str = "SELECT DISTINCT v, 2 AS low, 1e18 AS high, NULL::BIGINT AS cap, 'l2' AS norm, 1.0::DOUBLE AS alpha FROM mem") -> str:
    """Predictions ``pred`` (v, doc_id, label, prediction) of models that see nothing but the
    rows ``mem`` (v, doc_id, label) of their training set; limits and smoothing in ``sets``."""
    return LABELLED + f""", counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM labelled) GROUP BY ALL),
  mem AS ({members}), sets AS ({sets}),
  vn AS (SELECT v, count(*) AS n FROM mem GROUP BY v),
  vdf AS (SELECT v, term, count(*) AS df, sum(tf) AS total FROM mem JOIN counts USING (doc_id) GROUP BY v, term),
  vfit AS (SELECT v, term, df, n, row_number() OVER (PARTITION BY v ORDER BY total DESC, term) AS r, cap FROM vdf JOIN vn USING (v) JOIN sets USING (v) WHERE df >= low AND df <= high),
  vidf AS (SELECT v, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vfit WHERE cap IS NULL OR r <= cap),
  raw AS (SELECT v, doc_id, term, tf * idf AS w FROM counts JOIN vidf USING (term)),
  tfidf AS (SELECT v, doc_id, term, w / CASE norm WHEN 'l2' THEN sqrt(sum(w * w) OVER (PARTITION BY v, doc_id)) WHEN 'l1' THEN sum(w) OVER (PARTITION BY v, doc_id) ELSE 1 END AS weight
    FROM raw JOIN sets USING (v)),
  prior AS (SELECT v, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY v)) AS lp FROM mem GROUP BY 1, 2),
  sums AS (SELECT v, label, term, sum(weight) AS s FROM mem JOIN tfidf USING (v, doc_id) GROUP BY ALL),
  grid AS (SELECT p.v, p.label, t.term, coalesce(s, 0) AS s FROM prior p JOIN vidf t ON t.v = p.v LEFT JOIN sums ON sums.v = p.v AND sums.label = p.label AND sums.term = t.term),
  ll AS (SELECT v, label, term, ln((s + alpha) / (sum(s) OVER (PARTITION BY v, label) + count(*) OVER (PARTITION BY v, label) * alpha)) AS ll FROM grid JOIN sets USING (v)),
  hit AS (SELECT v, doc_id, ll.label AS class, sum(weight * ll) AS s FROM tfidf JOIN ll USING (v, term) GROUP BY ALL),
  joint AS (SELECT p.v, d.doc_id, d.label, p.label AS class, lp + coalesce(h.s, 0) AS j FROM labelled d CROSS JOIN prior p
    LEFT JOIN hit h ON h.v = p.v AND h.doc_id = d.doc_id AND h.class = p.label),
  pred AS (SELECT v, doc_id, label, first(class ORDER BY j DESC, class) AS prediction FROM joint GROUP BY ALL)"""


def fold_members(n: int, per_fold: int = 1) -> str:
    """Training rows of ``n`` folds, repeated for ``per_fold`` settings: v = setting * n + fold."""
    return f"SELECT t * {n} + f AS v, doc_id, label FROM {folds_sql(n)}, (SELECT unnest(range({n}))::INTEGER AS f), (SELECT unnest(range({per_fold}))::INTEGER AS t) WHERE fold <> f"


def fold_sets(settings: list[dict], n: int) -> str:
    """The feature sets of every setting and fold; shares of the training documents as counts."""
    rows = []
    for t, s in enumerate(settings):
        low, high = s.get("min_df", 1), s.get("max_df", 1.0)
        low = str(low) if isinstance(low, int) else ("1" if low == 1.0 else f"{low!r}::DOUBLE * n")
        high = str(high) if isinstance(high, int) else f"{high!r}::DOUBLE * n"
        cap, norm = s.get("max_features"), s.get("norm", "l2")
        rows.append(
            f"SELECT v, {low} AS low, {high} AS high, {'NULL' if cap is None else cap}::BIGINT AS cap, '{norm}' AS norm, {s.get('alpha', 1.0)!r}::DOUBLE AS alpha FROM vn0 WHERE v // {n} = {t}"
        )
    return f"WITH vn0 AS (SELECT v, count(*) AS n FROM mem GROUP BY v) " + " UNION ALL ".join(rows)


GRID = [{"min_df": 2, "alpha": a} for a in ALPHAS]


@query(
    "m10_grid_search_nb",
    f"WITH {cv_sql(fold_members(3, len(GRID)), fold_sets(GRID, 3))}"
    + f""" SELECT (v // 3)::INTEGER AS trial, {list(ALPHAS)}[v // 3 + 1]::DOUBLE AS alpha, (v % 3)::INTEGER AS fold, CASE WHEN fold = v % 3 THEN 'test' ELSE 'train' END AS part,
        count(*) AS n_rows, round(avg(CASE WHEN pred.label = prediction THEN 1 ELSE 0 END), 6) AS score FROM pred JOIN {folds_sql(3)} USING (doc_id) GROUP BY ALL""",
)
def m10(spark, d):
    counts, docs = cv_inputs(spark, d)
    return tuning.grid_search_nb(counts, docs, ALPHAS, 3, min_df=2).withColumn("score", F.round("score", 6))


# What a search may propose; whole numbers are rounded.
SPACE = {"min_df": Whole(1, 6), "max_df": Real(0.5, 1.0), "max_features": Whole(200, 5_000), "norm": Choice(None, "l1", "l2"), "alpha": Real(0.05, 2.0)}
FIRST = Search(SPACE, seed=1).ask(4)


@query(
    "m10_search_objective",
    f"WITH {cv_sql(fold_members(3, len(FIRST)), fold_sets(FIRST, 3))}"
    + f""", sc AS (SELECT v, avg(CASE WHEN pred.label = prediction THEN 1.0 ELSE 0.0 END) FILTER (fold = v % 3) AS te,
        avg(CASE WHEN pred.label = prediction THEN 1.0 ELSE 0.0 END) FILTER (fold <> v % 3) AS tr FROM pred JOIN {folds_sql(3)} USING (doc_id) GROUP BY v)
      SELECT (v // 3)::INTEGER AS trial, round(avg(te), 6) AS test_score, round(stddev_pop(te), 6) AS std, round(avg(tr), 6) AS train_score FROM sc GROUP BY 1""",
)
def m10_objective(spark, d):
    """The first settings that a search proposes, judged in one pass."""
    counts, docs = cv_inputs(spark, d)
    out = tuning.search_objective(counts, docs, FIRST)
    return out.select("trial", *(F.round(c, 6).alias(c) for c in ("test_score", "std", "train_score")))


@query("m10_search")
def m10_search(spark, d):
    """Two rounds of proposals; the second starts from the scores of the first."""
    counts, docs = cv_inputs(spark, d)
    search = Search(SPACE, seed=1)
    for _ in range(2):
        settings = search.ask(3)
        found = {r.trial: r.test_score for r in tuning.search_objective(counts, docs, settings).collect()}  # one row per setting
        search.tell(settings, [found[t] for t in range(len(settings))])
    rows = [(i, *(s[k] for k in SPACE), v) for i, (s, v) in enumerate(search.told)]
    return spark.createDataFrame(rows, "trial int, min_df int, max_df double, max_features int, norm string, alpha double, test_score double")


# A trial log read off the events: each user is a study, each event a trial.
def trial_log(spark, d):
    e = tables.table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("study"), F.col("event_id").alias("trial"),
        F.round(F.col("value") / 1000.0, 6).alias("learning_rate"),
        (F.col("event_id") % 7).cast("double").alias("epsilon"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.col("value")), 6).alias("accuracy"),
    )


TRIALS = """trials AS (SELECT user_id AS study, event_id AS trial, round("value" / 1000.0::DOUBLE, 6) AS learning_rate,
  (event_id % 7)::DOUBLE AS epsilon, round(1.0::DOUBLE / (1.0::DOUBLE + "value"), 6) AS accuracy FROM events)"""


def cv_results(spark, d):
    """Fold results read off the event log: (trial, alpha, fold, part, score)."""
    t = trial_log(spark, d)
    part = F.when(F.col("trial") % 2 == 0, "test").otherwise("train")
    return t.select(
        F.col("study").alias("trial"), (F.col("study") % 5).cast("double").alias("alpha"), part.alias("part"), F.col("accuracy").alias("score")
    )


@query(
    "m11_cv_summary",
    f"""WITH {TRIALS} SELECT study AS trial, (study % 5)::DOUBLE AS alpha, round(avg(accuracy) FILTER (trial % 2 = 0), 6) AS test_score,
        round(stddev_pop(accuracy) FILTER (trial % 2 = 0), 6) AS std, round(avg(accuracy) FILTER (trial % 2 = 1), 6) AS train_score,
        3.0::DOUBLE AS cv_folds FROM trials GROUP BY 1, 2""",
)
def m11(spark, d):
    out = tuning.cv_summary(cv_results(spark, d), ["alpha"], 3)
    return out.withColumns({c: F.round(c, 6) for c in ("test_score", "std", "train_score")})


@query(
    "m11_results_file",
    f"""WITH {TRIALS}, one AS (SELECT study AS trial, round(avg(accuracy) FILTER (trial % 2 = 0), 6) AS test_score,
        round(stddev_pop(accuracy) FILTER (trial % 2 = 0), 6) AS std, round(avg(accuracy) FILTER (trial % 2 = 1), 6) AS train_score FROM trials GROUP BY 1)
        SELECT one.*, run, 3.0::DOUBLE AS cv_folds, 'multinomial' AS nb FROM one, (VALUES ('first'), ('second')) AS t(run)""",
)
def m11_file(spark, d):
    """Summaries of two runs, appended to one results folder and read back."""
    path = scratch_path(spark, "results")
    for run in ("first", "second"):
        out = tuning.cv_summary(cv_results(spark, d), [], 3, {"nb": "multinomial"}, run)
        tuning.append_summary(out.withColumns({c: F.round(c, 6) for c in ("test_score", "std", "train_score")}), path)
    return tuning.read_summaries(spark, path).withColumnRenamed("date", "run").withColumn("trial", F.col("trial").cast("long"))


@query(
    "m12_cv_history_filter",
    f"""WITH {TRIALS} SELECT round(learning_rate, 2) AS learning_rate, epsilon, max(accuracy) AS target FROM trials
        WHERE study % 3 = 1 AND round(learning_rate, 2) BETWEEN 0.01 AND 0.2 AND epsilon BETWEEN 1 AND 5 GROUP BY ALL""",
)
def m12(spark, d):
    history = trial_log(spark, d).select(
        F.round("learning_rate", 2).alias("learning_rate"), "epsilon", F.col("accuracy").alias("test_score"),
        (F.col("study") % 3 + 2).cast("double").alias("cv_folds"),
    )
    return tuning.cv_history_filter(history, {"learning_rate": (0.01, 0.2), "epsilon": (1.0, 5.0)}, 3)


@query(
    "m13_best_trial",
    f"""WITH {TRIALS}, ok AS (SELECT * FROM trials WHERE learning_rate BETWEEN 0.001 AND 0.1 AND epsilon BETWEEN 1 AND 6),
        r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY accuracy DESC, trial) AS r, count(*) OVER (PARTITION BY study) AS n_trials FROM ok)
        SELECT study, n_trials, trial, learning_rate, epsilon, accuracy FROM r WHERE r = 1""",
)
def m13(spark, d):
    return tuning.best_trial(trial_log(spark, d), {"learning_rate": (0.001, 0.1), "epsilon": (1.0, 6.0)}, "accuracy")


@query(
    "m14_learning_curve",
    "WITH " + cv_sql(
        "SELECT f * 5 + i AS v, doc_id, label FROM cp, sz WHERE r <= floor(n * size)"
    ).replace(", counts AS", f""", folds5 AS {folds_sql(5)},
      cp AS (SELECT doc_id, label, f, row_number() OVER (PARTITION BY f ORDER BY md5('curve:' || f || '-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY f) AS n
        FROM folds5, (SELECT unnest(range(5))::INTEGER AS f) WHERE fold <> f),
      sz AS (SELECT unnest(range(5))::INTEGER AS i, unnest([0.1::DOUBLE, 0.325::DOUBLE, 0.55::DOUBLE, 0.775::DOUBLE, 1.0::DOUBLE]) AS size), counts AS""")
    + """, sc AS (SELECT pred.v, count(*) FILTER (mem.doc_id IS NOT NULL) AS n_train,
          avg(CASE WHEN pred.label = prediction THEN 1.0 ELSE 0.0 END) FILTER (mem.doc_id IS NOT NULL) AS tr,
          avg(CASE WHEN pred.label = prediction THEN 1.0 ELSE 0.0 END) FILTER (fold = pred.v // 5) AS te
        FROM pred JOIN folds5 USING (doc_id) LEFT JOIN mem ON mem.v = pred.v AND mem.doc_id = pred.doc_id GROUP BY 1)
      SELECT size, round(avg(n_train), 6) AS n_train, round(avg(tr), 6) AS train_mean, round(stddev_pop(tr), 6) AS train_std,
        round(avg(te), 6) AS test_mean, round(stddev_pop(te), 6) AS test_std FROM sc JOIN sz ON v % 5 = i GROUP BY 1""",
)
def m14(spark, d):
    counts, docs = cv_inputs(spark, d)
    out = tuning.learning_curve(counts, docs, min_df=2)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "size"})
