"""Indexes, batches, set operations and joins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import shape
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS, LABELLED, md5_key
from lexmill.session import scratch_path
from lexmill.sources import encoded, scalars, tables, translations


def corpus(spark, d):
    return tables.load_corpus(spark, d)


def labelled(spark, d):
    return corpus(spark, d).where("label IS NOT NULL")


@query("d1_with_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def d1(spark, d):
    return shape.with_index(tables.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "idx"
    )


@query(
    "d2_to_canonical",
    f"""WITH {LABELLED}, t AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS idx, label::BIGINT AS label, text FROM labelled WHERE split = 'train'),
        v AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1 + (SELECT count(*) FROM t))::INTEGER AS idx, label::BIGINT AS label, text FROM labelled WHERE split = 'test')
        SELECT idx, label, md5(text) AS sentence FROM (SELECT * FROM t UNION ALL SELECT * FROM v)""",
)
def d2(spark, d):
    rows = labelled(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    first = shape.to_canonical(train, "doc_id", "text", "label")
    second = shape.to_canonical(test, "doc_id", "text", "label", train.agg(F.count(F.lit(1))).scalar())
    return first.unionByName(second).withColumn("sentence", F.md5("sentence"))


@query(
    "d3_split_positional",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.6) THEN 'train' ELSE 'test' END AS part FROM documents""",
)
def d3(spark, d):
    return shape.split_positional(tables.table(spark, d, "documents").select("doc_id"), "doc_id", 0.6)


@query("d4_take_range", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100")
def d4(spark, d):
    return shape.take_range(tables.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, 200)


@query(
    "d5_stratified_split",
    f"""WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1),
        r AS (SELECT label, floor(n * 0.5) AS base, row_number() OVER (ORDER BY n * 0.5 - floor(n * 0.5) DESC, label) AS o,
          floor(sum(n) OVER () * 0.5) - sum(floor(n * 0.5)) OVER () AS missing FROM c),
        q AS (SELECT label, base + CASE WHEN o <= missing THEN 1 ELSE 0 END AS quota FROM r),
        k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5_key('doc_id', 'split')}, doc_id) AS rk FROM labelled)
        SELECT doc_id, label, CASE WHEN rk <= quota THEN 'train' ELSE 'test' END AS part FROM k JOIN q USING (label)""",
)
def d5(spark, d):
    return shape.stratified_split(labelled(spark, d).select("doc_id", "label"), "doc_id", "label", 0.5)


@query("d6_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {md5_key('doc_id', 'shuffle')}, doc_id) - 1 AS pos FROM documents")
def d6(spark, d):
    return shape.shuffled_index(tables.table(spark, d, "documents").select("doc_id"), "doc_id")


BATCHES = """ix AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"""


@query(
    "d7_batch",
    f"""WITH {BATCHES} SELECT i // 32 AS batch_id, count(*) AS n, array_to_string(list(doc_id ORDER BY i), ',') AS doc_ids,
        array_to_string(list(lang ORDER BY i), ',') AS langs FROM ix GROUP BY 1""",
)
def d7(spark, d):
    b = shape.batch(tables.table(spark, d, "documents"), 32, "doc_id", ["doc_id", "lang"])
    return b.select(
        "batch_id", F.size("doc_id").cast("long").alias("n"),
        F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("doc_ids"), F.array_join("lang", ",").alias("langs"),
    )


@query(
    "d8_repeat",
    """WITH e AS (SELECT doc_id, unnest(range(3))::INTEGER AS epoch FROM documents)
       SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('epoch:' || epoch || ':' || doc_id), doc_id) - 1 AS pos FROM e""",
)
def d8(spark, d):
    return shape.repeat(tables.table(spark, d, "documents").select("doc_id"), 3, "doc_id")


@query("d9_unbatch", f"WITH {BATCHES} SELECT i // 32 AS batch_id, (i % 32)::INTEGER AS pos, doc_id, lang FROM ix")
def d9(spark, d):
    return shape.unbatch(shape.batch(tables.table(spark, d, "documents"), 32, "doc_id", ["doc_id", "lang"]), ["doc_id", "lang"])


@query(
    "d10_batch_plan",
    f"""WITH {CORPUS}, c AS (SELECT split, count(*) AS n_rows, CASE split WHEN 'train' THEN 32 ELSE 64 END AS batch_size FROM corpus WHERE split IN ('train', 'test') GROUP BY 1)
        SELECT split, n_rows, batch_size, ceil(n_rows / batch_size)::BIGINT AS steps, (ceil(n_rows / batch_size) * 3)::BIGINT AS total_steps FROM c""",
)
def d10(spark, d):
    return shape.batch_plan(corpus(spark, d), {"train": 32, "test": 64}, 2)


@query("d11_cardinality", f"WITH {CORPUS} SELECT split, count(*) AS n_rows FROM corpus GROUP BY 1")
def d11(spark, d):
    return corpus(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"))


@query(
    "d12_union_tagged",
    f"WITH {CORPUS} SELECT doc_id, label, CASE split WHEN 'test' THEN 'eval' ELSE split END AS part FROM corpus WHERE split IN ('train', 'test')",
)
def d12(spark, d):
    rows = corpus(spark, d).select("doc_id", "label", "split")
    parts = {"train": rows.where("split = 'train'").drop("split"), "eval": rows.where("split = 'test'").drop("split")}
    return shape.union_tagged(parts)


@query("d13_label_cardinality", f"WITH {CORPUS} SELECT split, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM corpus GROUP BY 1")
def d13(spark, d):
    return shape.label_cardinality(corpus(spark, d))


@query(
    "d14_top_bottom",
    """SELECT * FROM (SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
       UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)""",
)
def d14(spark, d):
    return shape.top_bottom(tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("d15_zip_on_key", "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def d15(spark, d):
    a = tables.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return shape.zip_on_key(a, tables.table(spark, d, "labels"), "doc_id")


# ---- joins ----------------------------------------------------------------

@query(
    "j1_trial_table",
    """SELECT o_orderkey AS trial, o_totalprice AS score, c_mktsegment AS setting, c_acctbal AS learning_rate FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F'""",
)
def j1(spark, d):
    o = tables.table(spark, d, "orders").where("o_orderstatus = 'F'")
    scores = o.select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("score"))
    c = tables.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    params = o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("trial"), F.col("c_mktsegment").alias("setting"), F.col("c_acctbal").alias("learning_rate")
    )
    return shape.trial_table(scores, params)


@query(
    "j2_attach_truth",
    "SELECT d.doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS prediction, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def j2(spark, d):
    pred = tables.table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    return shape.attach_truth(pred, tables.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")))


@query(
    "j3_lookup",
    "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def j3(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return shape.lookup(c, tables.table(spark, d, "nation"), "n_nationkey", how="left").select("c_custkey", "n_name", "n_regionkey")


STEPS = """steps AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS tag, ts, event_id, "value" FROM events)"""


@query(
    "j4_compare_runs",
    f"""WITH {STEPS} SELECT coalesce(a.run, b.run - 1) AS run, coalesce(a.step, b.step) AS step, a."value" AS value_a, b."value" AS value_b,
        round(b."value" - a."value", 6) AS diff FROM steps a FULL JOIN steps b ON a.step = b.step AND b.run = a.run + 1""",
)
def j4(spark, d):
    """Every run beside the one with the next number."""
    steps = scalars.run_steps(tables.table(spark, d, "events"))
    out = shape.compare_runs(steps, steps.withColumn("run", F.col("run") - 1), by=["run"])
    return out.withColumn("diff", F.round("diff", 6))


@query(
    "j5_join_validation",
    f"""WITH {STEPS} SELECT t.run, t.step, t."value" AS loss, v."value" AS val_loss FROM steps t
        LEFT JOIN (SELECT * FROM steps WHERE step % 5 = 0) v ON t.run = v.run AND t.step = v.step""",
)
def j5(spark, d):
    steps = scalars.run_steps(tables.table(spark, d, "events"))
    train = steps.select("run", "step", F.col("value").alias("loss"))
    return shape.join_validation(train, steps.where("step % 5 = 0").select("run", "step", F.col("value").alias("val_loss")))


# ---- translations ---------------------------------------------------------

def short_texts(spark, d):
    return tables.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), "text")


ITEMS = """items AS (SELECT conv_id * 100 + turn AS item, text FROM conversations),
  pl AS (SELECT item, text, row_number() OVER (ORDER BY item) - 1 AS i FROM items)"""


@query(
    "s11_export_translation_batches",
    f"WITH {ITEMS} SELECT (i // 100)::INTEGER AS batch, (i % 100)::INTEGER AS line_no, md5(replace(text, chr(10), '')) AS line FROM pl",
)
def s11(spark, d):
    path = scratch_path(spark, "batches")
    translations.export_translation_batches(short_texts(spark, d), "item", "text", 100, path)
    back = translations.read_translated_lines(spark, path)
    return back.select(F.col("batch").cast("int").alias("batch"), F.col("line_no").cast("int").alias("line_no"), F.md5("value").alias("line"))


@query(
    "s12_import_translations",
    f"WITH {ITEMS} SELECT item, lang, md5(replace(replace(text, chr(10), ''), 'e', '3') || lang) AS translation FROM pl, (SELECT unnest(['de', 'it']) AS lang)",
)
def s12(spark, d):
    """The service is played by changing one letter; it answers with a file per language
    that has two blank lines after every item."""
    source = translations.number_batches(short_texts(spark, d), "item", 100)
    lang = F.explode(F.array(F.lit("de"), F.lit("it"))).alias("lang")
    sent = source.select(lang, "batch", "pos", F.replace(F.replace("text", F.lit("\n"), F.lit("")), F.lit("e"), F.lit("3")).alias("t"))
    lines = sent.select(
        "lang", "batch", (F.col("pos") * 3).alias("first"),
        F.posexplode(F.array(F.concat("t", "lang"), F.lit(""), F.lit(" "))).alias("k", "value"),
    ).select("lang", "batch", (F.col("first") + F.col("k")).alias("line_no"), "value")
    answers = None
    for name in ("de", "it"):
        path = scratch_path(spark, f"lines-{name}")
        translations.write_lines(lines.where(F.col("lang") == name).drop("lang"), path)
        read = translations.read_translated_lines(spark, path).withColumn("lang", F.lit(name))
        answers = read if answers is None else answers.unionByName(read)
    out = translations.import_translations(source, answers, 100)
    return out.select("item", "lang", F.md5("translation").alias("translation"))


@query("s7_round_trip_orders", "SELECT count(*) AS rows_written, count(*) AS rows_read, 0::BIGINT AS only_written, 0::BIGINT AS only_read FROM orders")
def s7(spark, d):
    rows = tables.table(spark, d, "orders")
    path = scratch_path(spark, "orders")
    rows.write.parquet(path)
    return encoded.round_trip(rows, spark.read.parquet(path))
