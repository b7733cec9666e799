"""The flagship: class balance of the hash-split parts per language."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexmill.functions import text as tx
from lexmill.operators import shape
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS, md5_bucket
from lexmill.sources import tables


@query(
    "flagship_eval_balance",
    f"""WITH {CORPUS}, c AS (SELECT lang, CASE WHEN {md5_bucket('doc_id')} < 20 THEN 'eval' ELSE 'train' END AS part, label,
         len(string_split(regexp_replace(text, '(<br\\s*/><br\\s*/>)|(-)|(/)', ' ', 'g'), ' ')) AS n_words
         FROM corpus WHERE label IS NOT NULL),
       g AS (SELECT lang, part, label, count(*) AS n, round(avg(n_words), 6) AS mean_words FROM c GROUP BY 1, 2, 3)
       SELECT *, round(100 * n / sum(n) OVER (PARTITION BY lang, part), 6) AS pct FROM g""",
)
def eval_balance(spark, d):
    labelled = tables.load_corpus(spark, d).where("label IS NOT NULL")
    parts = shape.hash_split(labelled, "doc_id", 20)
    counts = parts.groupBy("lang", "part", "label").agg(
        F.count("*").alias("n"), F.round(F.avg(tx.word_count(tx.clean_review("text"))), 6).alias("mean_words")
    )
    whole = Window.partitionBy("lang", "part")  # one row per label
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(whole), 6))
