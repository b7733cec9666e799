"""Tabular preparation and vector analysis as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import embeddings, shape, tabular
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import md5_bucket
from lexmill.sources import tables

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")  # HOUSEHOLD stays unknown
SEG_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE -1 END"


def customer(spark, d):
    return tables.table(spark, d, "customer")


@query("t26_category_codes", f"SELECT c_custkey, {SEG_SQL} AS c_mktsegment FROM customer")
def t26(spark, d):
    return tabular.category_codes(customer(spark, d).select("c_custkey", "c_mktsegment"), {"c_mktsegment": SEGMENTS})


@query("t27_numeric_to_float", "SELECT p_partkey, p_type, CAST(p_size AS FLOAT) AS p_size, p_retailprice FROM part")
def t27(spark, d):
    p = tables.table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return tabular.numeric_to_float(p, skip=["p_partkey"])


STATS = "(SELECT avg(CAST({c} AS FLOAT)::DOUBLE) AS m, stddev_samp(CAST({c} AS FLOAT)::DOUBLE) AS s FROM {t})"


@query(
    "t28_standardize",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN {md5_bucket('l_orderkey')} < 20 THEN 'eval' ELSE 'train' END AS part,
        round((CAST(l_quantity AS FLOAT)::DOUBLE - q.m) / q.s, 6) AS l_quantity, round((CAST(l_tax AS FLOAT)::DOUBLE - t.m) / t.s, 6) AS l_tax
        FROM lineitem, {STATS.format(c='l_quantity', t='lineitem')} q, {STATS.format(c='l_tax', t='lineitem')} t""",
)
def t28(spark, d):
    rows = tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("l_quantity"), F.col("l_tax").cast("float").alias("l_tax")
    )
    parts = shape.hash_split(rows, "l_orderkey", 20)
    train, evaluation = (parts.where(F.col("part") == p).drop("part") for p in ("train", "eval"))
    return tabular.standardize(train, evaluation).withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


def census_like(spark, d):
    """Customers with a label column, in two parts."""
    rows = customer(spark, d).withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    parts = shape.hash_split(rows, "c_custkey", 20)
    return tuple(parts.where(F.col("part") == p).drop("part") for p in ("train", "eval"))


def prepared(spark, d):
    train, evaluation = census_like(spark, d)
    return tabular.prepare_tabular(train, evaluation, "c_custkey", ["c_name", "c_acctbal"], {"c_mktsegment": SEGMENTS}, "rich")


@query(
    "t29_prepare_tabular",
    f"""SELECT c_custkey, round((CAST(c_nationkey AS FLOAT)::DOUBLE - m) / s, 6) AS c_nationkey, {SEG_SQL} AS c_mktsegment,
        CAST(c_acctbal > 5000 AS FLOAT) AS rich, CASE WHEN {md5_bucket('c_custkey')} < 20 THEN 'eval' ELSE 'train' END AS part
        FROM customer, {STATS.format(c='c_nationkey', t='customer')}""",
)
def t29(spark, d):
    return prepared(spark, d).withColumn("c_nationkey", F.round("c_nationkey", 6))


@query(
    "t30_encode_labels",
    "SELECT c_custkey, c_mktsegment, (SELECT count(DISTINCT c_mktsegment) FROM customer b WHERE b.c_mktsegment < a.c_mktsegment)::INTEGER AS code FROM customer a",
)
def t30(spark, d):
    return tabular.encode_labels(customer(spark, d).select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("t30_decode_labels", "SELECT c_custkey, c_mktsegment AS label FROM customer")
def t30b(spark, d):
    rows = customer(spark, d).select("c_custkey", "c_mktsegment")
    classes = tabular.class_table(rows, "c_mktsegment")
    return tabular.decode_labels(tabular.encode_labels(rows, "c_mktsegment", classes), "code", classes).select("c_custkey", "label")


@query("t31_with_class_weight", "SELECT doc_id, quality AS label, CASE quality WHEN 0 THEN 3.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM labels")
def t31(spark, d):
    rows = tables.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return tabular.with_class_weight(rows, {0: 3.5, 1: 0.5})


# ---- vectors --------------------------------------------------------------

def vectors(spark, d):
    return tables.table(spark, d, "embeddings")


PLANE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
  a AS (SELECT label, arg_min(w, vec_id) AS b1, arg_max(w, vec_id) AS b2 FROM e GROUP BY 1),
  g AS (SELECT e.label, vec_id, list_dot_product(b1, b1) AS g11, list_dot_product(b1, b2) AS g12, list_dot_product(b2, b2) AS g22,
    list_dot_product(b1, w) AS x1, list_dot_product(b2, w) AS x2 FROM e JOIN a ON e.label = a.label),
  plane AS (SELECT label, vec_id, (g22 * x1 - g12 * x2) / (g11 * g22 - g12 * g12) AS u, (g11 * x2 - g12 * x1) / (g11 * g22 - g12 * g12) AS v FROM g)"""


@query("t32_anchor_projection", f"WITH {PLANE} SELECT label, vec_id, round(u, 6) AS u, round(v, 6) AS v FROM plane")
def t32(spark, d):
    out = embeddings.anchor_projection(vectors(spark, d), "label", "vec_id", "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("u", "v")})


@query(
    "t33_token_path",
    f"""WITH {PLANE} SELECT label, vec_id, round(u - lag(u) OVER w, 6) AS du, round(v - lag(v) OVER w, 6) AS dv,
        round(max(u) OVER p - min(u) OVER p, 6) AS range_u, round(max(v) OVER p - min(v) OVER p, 6) AS range_v
        FROM plane WINDOW w AS (PARTITION BY label ORDER BY vec_id), p AS (PARTITION BY label)""",
)
def t33(spark, d):
    projected = embeddings.anchor_projection(vectors(spark, d), "label", "vec_id", "embedding")
    out = embeddings.token_path(projected, "label", "vec_id")
    return out.withColumns({c: F.round(c, 6) for c in ("du", "dv", "range_u", "range_v")})


@query("t34_pca_2d")
def t34(spark, d):
    return embeddings.pca_2d(vectors(spark, d), "embedding", ["vec_id", "label"])


@query(
    "t35_cross_group_neighbours",
    """WITH e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
       e AS (SELECT vec_id, label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM e0),
       p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, round(list_dot_product(a.w, b.w), 9) AS cosine FROM e a JOIN e b ON a.label <> b.label),
       r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cosine DESC, neighbour) AS rank FROM p)
       SELECT key, rank, neighbour, round(cosine, 6) AS cosine FROM r WHERE rank <= 3""",
)
def t35(spark, d):
    out = embeddings.cross_group_neighbours(vectors(spark, d), "vec_id", "label", "embedding", 3)
    return out.withColumn("cosine", F.round("cosine", 6))
