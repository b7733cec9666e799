"""Evaluation of two simple scorers of the corpus as queries.

``quality_scores`` rates a text by its length against the quality label;
``language_scores`` guesses the language from the counts of typical letter groups.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vectors as vx
from lexmill.operators import metrics, naive_bayes, roc, shape
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS
from lexmill.session import materialize
from lexmill.sources import tables

LANGS = ("de", "en", "es", "fr")
MARKS = ("sch", "th", "os", "eau")  # one letter group per language, same order


def quality_scores(spark, d):
    """(doc_id, lang, label, score, prediction) of labelled documents."""
    n = tx.word_count("text")
    score = F.round(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + n / F.lit(64.0)), 3)
    rows = tables.load_corpus(spark, d).where("label IS NOT NULL")
    return rows.select("doc_id", "lang", "label", score.alias("score")).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


QUALITY = CORPUS + """, q0 AS (SELECT doc_id, lang, label, round(1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + len(string_split(text, ' ')) / 64.0::DOUBLE), 3) AS score
    FROM corpus WHERE label IS NOT NULL),
  q AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM q0)"""


def language_scores(spark, d):
    """(doc_id, source, label, prob, prediction) of all documents. The scores are
    written once: a filter on a computed column would be pushed to the scan and
    compute every score again."""
    low = F.lower("text")
    hits = {f"h{i}": (F.length("text") - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m) + 1.0 for i, m in enumerate(MARKS)}
    docs = tables.table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("label"), "text")
    counted = docs.withColumns(hits).withColumn("total", F.col("h0") + F.col("h1") + F.col("h2") + F.col("h3"))
    scored = counted.select("doc_id", "source", "label", F.array(*[F.col(h) / F.col("total") for h in hits]).alias("prob"))
    names = F.array(*[F.lit(x) for x in LANGS])
    return materialize(scored, "scores").withColumn("prediction", F.get(names, vx.argmax("prob")))


def _hit_sql(m):
    return f"((length(text) - length(replace(lower(text), '{m}', ''))) / {len(m)} + 1.0::DOUBLE)"


LANGUAGE = f"""l0 AS (SELECT doc_id, source, lang AS label, {', '.join(f'{_hit_sql(m)} AS h{i}' for i, m in enumerate(MARKS))} FROM documents),
  l1 AS (SELECT doc_id, source, label, {', '.join(f'h{i} / (h0 + h1 + h2 + h3) AS p{i}' for i in range(4))} FROM l0),
  lang_scores AS (SELECT *, [p0, p1, p2, p3] AS prob,
    CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 'de' WHEN p1 THEN 'en' WHEN p2 THEN 'es' ELSE 'fr' END AS prediction FROM l1),
  class_scores AS (SELECT doc_id, unnest(['de', 'en', 'es', 'fr']) AS class, unnest(prob) AS score, label FROM lang_scores),
  cs AS (SELECT *, CASE WHEN class = label THEN 1 ELSE 0 END AS hit FROM class_scores)"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("e1_accuracy", f"WITH {QUALITY} SELECT lang, round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM q GROUP BY 1")
def e1(spark, d):
    return rounded(metrics.accuracy(quality_scores(spark, d), ["lang"]), "accuracy")


CELLS = QUALITY + """, b AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM q)"""
PREC = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END"
REC = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"


@query(
    "e2_binary_prf",
    f'WITH {CELLS} SELECT round({PREC}, 6) AS "precision", round({REC}, 6) AS recall, round({F1}, 6) AS f1 FROM b',
)
def e2(spark, d):
    return rounded(metrics.binary_prf(quality_scores(spark, d)), "precision", "recall", "f1")


PER_CLASS = LANGUAGE + """, k AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM lang_scores),
  pc AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (prediction = class) AS predicted,
    count(*) FILTER (label = class) AS support FROM k, lang_scores GROUP BY 1)"""


@query(
    "e3_precision_avg",
    f"""WITH {PER_CLASS} SELECT round(sum(tp) / sum(predicted), 6) AS precision_micro,
        round(avg(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END), 6) AS precision_macro FROM pc""",
)
def e3(spark, d):
    return rounded(metrics.precision_avg(language_scores(spark, d)), "precision_micro", "precision_macro")


RANK = """, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY 1),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p_total, sum(neg) OVER () AS n_total
    FROM g WINDOW w AS (ORDER BY score DESC)),
  rank_row AS (SELECT sum(pos / p_total * (tp / (tp + fp))) AS average_precision, sum(neg * (2 * tp - pos) / 2.0) / max(p_total * n_total) AS auc FROM c)"""


@query("e4_average_precision", f"WITH {QUALITY}{RANK.format(src='q')} SELECT round(average_precision, 6) AS average_precision FROM rank_row")
def e4(spark, d):
    return rounded(roc.average_precision(quality_scores(spark, d)), "average_precision")


@query("e5_roc_auc", f"WITH {QUALITY}{RANK.format(src='q')} SELECT round(auc, 6) AS auc FROM rank_row")
def e5(spark, d):
    return rounded(roc.roc_auc(quality_scores(spark, d)), "auc")


R2 = "1 - sum((label - prediction) * (label - prediction)) / sum((label - (SELECT avg(label) FROM q)) * (label - (SELECT avg(label) FROM q)))"


@query("e6_r2", f"WITH {QUALITY} SELECT round({R2}, 6) AS r2 FROM q")
def e6(spark, d):
    return rounded(metrics.r2(quality_scores(spark, d)), "r2")


HARD = ", hard AS (SELECT label, prediction AS score FROM q)" + RANK.format(src="hard")


@query(
    "e7_metric_sheet",
    f"""WITH {CELLS}{HARD}, s AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, {REC} AS recall, {PREC} AS "precision", {F1} AS f1,
          (tp + tn) / (tp + tn + fp + fn) AS precision_micro,
          (({PREC}) + CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END) / 2 AS precision_macro FROM b),
        one AS (SELECT round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round((SELECT auc FROM rank_row), 6) AS auc,
          round("precision", 6) AS "precision", round((SELECT average_precision FROM rank_row), 6) AS precision_avg,
          round(precision_micro, 6) AS precision_micro, round(precision_macro, 6) AS precision_macro, round(f1, 6) AS f1,
          (SELECT round({R2}, 6) FROM q) AS r2 FROM s),
        u AS (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)
        SELECT 'quality' AS dataset, metric, value FROM u""",
)
def e7(spark, d):
    return rounded(metrics.metric_sheet(quality_scores(spark, d), "quality"), "value")


MATRIX = LANGUAGE + """, k AS (SELECT DISTINCT unnest([label, prediction]) AS c FROM lang_scores),
  m AS (SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM lang_scores s WHERE s.label = a.c AND s.prediction = b.c) AS n FROM k a, k b)"""


@query("e8_confusion_matrix", f"WITH {MATRIX} SELECT label, prediction, n FROM m")
def e8(spark, d):
    return metrics.confusion_matrix(language_scores(spark, d))


@query("e8_confusion_matrix_normalized", f"WITH {MATRIX} SELECT label, prediction, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM m")
def e8b(spark, d):
    return rounded(metrics.confusion_matrix(language_scores(spark, d), normalize=True), "share")


@query(
    "e9_binary_summary",
    f"""WITH {CELLS} SELECT tn, fp, fn, tp, tn + fp AS true_negative_labels, fn + tp AS true_positive_labels, tn + fn AS predicted_negative,
        fp + tp AS predicted_positive, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round({PREC}, 6) AS "precision",
        round({REC}, 6) AS recall, round((fp + fn) / (tp + tn + fp + fn), 6) AS misclassification_rate, round({F1}, 6) AS f1 FROM b""",
)
def e9(spark, d):
    out = metrics.binary_summary(quality_scores(spark, d))
    return rounded(out, "accuracy", "precision", "recall", "misclassification_rate", "f1")


def report_sql(src: str, by: str = "") -> str:
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    same = f" AND s.{by} = k.{by}" if by else ""
    return f""", rk AS (SELECT DISTINCT {b}unnest([label, prediction]) AS class FROM {src}),
      rc AS (SELECT {''.join(f'k.{by}, ' if by else '')}class, count(*) FILTER (label = class AND prediction = class) AS tp,
        count(*) FILTER (prediction = class) AS predicted, count(*) FILTER (label = class) AS support FROM rk k JOIN {src} s ON TRUE{same} GROUP BY ALL),
      rr AS (SELECT {b}CAST(class AS VARCHAR) AS class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS "precision",
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1, support FROM rc),
      al AS (SELECT * FROM rr UNION ALL SELECT {b}'macro avg', avg("precision"), avg(recall), avg(f1), sum(support)::BIGINT FROM rr {g}
        UNION ALL SELECT {b}'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support)::BIGINT FROM rr {g})
      SELECT {b}class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM al"""


@query("e10_classification_report", f"WITH {LANGUAGE}" + report_sql("lang_scores"))
def e10(spark, d):
    return rounded(metrics.classification_report(language_scores(spark, d)), "precision", "recall", "f1")


@query("e10_report_by_language", f"WITH {QUALITY}" + report_sql("q", "lang"))
def e10b(spark, d):
    return rounded(metrics.classification_report(quality_scores(spark, d), ["lang"]), "precision", "recall", "f1")


def curve_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    b = f"{by}, " if by else ""
    return f""", rg AS (SELECT {b}score, sum(hit) AS pos, sum(1 - hit) AS neg FROM {src} GROUP BY ALL),
      rcv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by or '1'}) AS p_total,
        sum(neg) OVER (PARTITION BY {by or '1'}) AS n_total, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS r
        FROM rg WINDOW w AS ({part}ORDER BY score DESC)),
      pts AS (SELECT {b}score AS threshold, fp / n_total AS fpr, tp / p_total AS tpr FROM rcv WHERE r = 1 OR np IS NULL OR np <> pos OR nn <> neg
        UNION ALL SELECT {b}score + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM rcv WHERE r = 1)"""


POINTS = "round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts"


@query("e11_roc_per_class", f"WITH {LANGUAGE}{curve_sql('cs', 'class')} SELECT class, {POINTS}")
def e11(spark, d):
    return rounded(roc.roc_per_class(language_scores(spark, d), LANGS), "threshold", "fpr", "tpr")


@query(
    "e11_auc_per_class",
    f"""WITH {LANGUAGE}{curve_sql('cs', 'class')} SELECT class, round(sum(neg * (2 * tp - pos) / 2.0) / max(p_total * n_total), 6) AS auc FROM rcv GROUP BY 1""",
)
def e11b(spark, d):
    return rounded(roc.auc_per_class(language_scores(spark, d), LANGS), "auc")


@query("e12_roc_micro", f"WITH {LANGUAGE}{curve_sql('cs')} SELECT {POINTS}")
def e12(spark, d):
    return rounded(roc.roc_micro(language_scores(spark, d), LANGS), "threshold", "fpr", "tpr")


MACRO = LANGUAGE + curve_sql("cs", "class") + """, kn AS (SELECT class, fpr, max(tpr) AS hi, min(tpr) AS lo FROM pts GROUP BY 1, 2),
  gr AS (SELECT g.fpr, c.class, hi, lo FROM (SELECT DISTINCT fpr FROM kn) g CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS class) c
    LEFT JOIN kn ON kn.class = c.class AND kn.fpr = g.fpr),
  nb AS (SELECT *, last_value(CASE WHEN hi IS NOT NULL THEN fpr END IGNORE NULLS) OVER b AS x0, last_value(hi IGNORE NULLS) OVER b AS y0,
      first_value(CASE WHEN lo IS NOT NULL THEN fpr END IGNORE NULLS) OVER a AS x1, first_value(lo IGNORE NULLS) OVER a AS y1
    FROM gr WINDOW b AS (PARTITION BY class ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   a AS (PARTITION BY class ORDER BY fpr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  macro AS (SELECT fpr, sum(CASE WHEN hi IS NOT NULL THEN hi ELSE (y1 - y0) / (x1 - x0) * (fpr - x0) + y0 END) / 4 AS tpr FROM nb GROUP BY 1)"""


@query("e13_roc_macro", f"WITH {MACRO} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM macro")
def e13(spark, d):
    return rounded(roc.roc_macro(language_scores(spark, d), LANGS), "fpr", "tpr")


@query(
    "e13_roc_macro_auc",
    f"""WITH {MACRO}, st AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr) AS x0, lag(tpr) OVER (ORDER BY fpr) AS y0 FROM macro)
        SELECT round(sum((fpr - x0) * (tpr + y0) / 2), 6) AS auc FROM st""",
)
def e13b(spark, d):
    return rounded(roc.curve_area(roc.roc_macro(language_scores(spark, d), LANGS)), "auc")


@query("e14_roc_of_model")
def e14(spark, d):
    """Curve of a fitted Naive Bayes model on the test split."""
    labelled = tables.load_corpus(spark, d).where("label IS NOT NULL")
    fitted = naive_bayes.train(labelled.where("split = 'train'"), min_df=2)
    scored = fitted.predict(labelled.where("split = 'test'"), keep=["label"])
    return roc.roc_per_class(scored, fitted.model.classes)


@query(
    "e15_misclassified",
    f"WITH {LANGUAGE} SELECT doc_id, source, label, prediction, round(greatest(p0, p1, p2, p3), 6) AS confidence FROM lang_scores WHERE label <> prediction",
)
def e15(spark, d):
    wrong = metrics.misclassified(language_scores(spark, d))
    return wrong.select("doc_id", "source", "label", "prediction", F.round(F.array_max("prob"), 6).alias("confidence"))


@query("e15_correctly_classified", f"WITH {LANGUAGE} SELECT doc_id, source, label FROM lang_scores WHERE label = prediction")
def e15b(spark, d):
    return metrics.misclassified(language_scores(spark, d), correct=True).select("doc_id", "source", "label")


@query(
    "e16_confidence_report",
    f"""WITH {LANGUAGE} SELECT
        round(CASE WHEN count(*) FILTER (greatest(p0, p1, p2, p3) > 0.6) = 0 THEN 0 ELSE count(*) FILTER (greatest(p0, p1, p2, p3) > 0.6 AND label = prediction)
          / count(*) FILTER (greatest(p0, p1, p2, p3) > 0.6) END, 4) AS accuracy,
        round(count(*) FILTER (greatest(p0, p1, p2, p3) > 0.6) / count(*), 4) AS covered,
        round(count(*) FILTER (label = prediction) / count(*), 4) AS baseline FROM lang_scores""",
)
def e16(spark, d):
    return metrics.confidence_report(language_scores(spark, d), 0.6)


@query("e17_pair_predictions", f"WITH {LANGUAGE} SELECT doc_id, prediction, label FROM lang_scores")
def e17(spark, d):
    scored = language_scores(spark, d)
    batches = shape.batch(scored, 64, "doc_id", ["doc_id", "prediction"])
    return metrics.pair_predictions(batches, scored.select("doc_id", "label"), "doc_id", ["prediction"])
