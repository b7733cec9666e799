"""Sources, sinks, projections and filters as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions import text as tx
from lexmill.operators import shape
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS, POSTS, md5_bucket
from lexmill.session import scratch_path
from lexmill.sources import tables


def posts(spark, d) -> DataFrame:
    """Documents seen as posts: first line, rest (null without one), no code."""
    line = F.lit("\n")
    return tables.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.get(F.split("text", "\n", -1), F.lit(0)).alias("title"),
        F.when(F.contains("text", line), F.expr("substr(text, instr(text, '\n') + 1)")).alias("text_body"),
        F.lit("").alias("code_body"),
        F.array("lang", "source", "lang").alias("tags"),
    )


@query("s1_load_table", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45")
def s1(spark, d):
    return tables.table(spark, d, "lineitem").where("l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )


@query("s2_load_corpus", f"WITH {CORPUS} SELECT doc_id, lang, label, split, length(text) AS n_chars FROM corpus")
def s2(spark, d):
    return tables.load_corpus(spark, d).select("doc_id", "lang", "label", "split", F.length("text").alias("n_chars"))


def part_lines(spark, d) -> DataFrame:
    """Parts as raw CSV lines: blanks around, spaces after commas, a trailing stop
    on some, '?' for some sizes, and unusable lines without a comma."""
    p = tables.table(spark, d, "part")
    size = F.when(F.col("p_partkey") % 7 == 0, "?").otherwise(F.col("p_size").cast("string"))
    stop = F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("")
    good = F.concat(F.lit("  "), F.concat_ws(", ", F.col("p_partkey").cast("string"), "p_brand", "p_type", size), stop)
    return p.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "  no fields here ").otherwise(good).alias("value"))


PART_ROWS = """SELECT p_partkey AS id, p_brand AS brand, p_type AS kind,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size FROM part WHERE p_partkey % 11 <> 0"""


@query("s3_read_named_csv", PART_ROWS)
def s3(spark, d):
    path = scratch_path(spark, "csv")
    tables.clean_csv_lines(part_lines(spark, d)).select("value").write.text(path)
    return tables.read_named_csv(spark, path, "id LONG, brand STRING, kind STRING, size INT")


@query(
    "s4_clean_csv_lines",
    """SELECT p_partkey, p_partkey || ',' || p_brand || ',' || p_type || ',' ||
       CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE CAST(p_size AS VARCHAR) END AS value
       FROM part WHERE p_partkey % 11 <> 0""",
)
def s4(spark, d):
    return tables.clean_csv_lines(part_lines(spark, d))


@query("s4_parse_csv_lines", PART_ROWS)
def s4b(spark, d):
    lines = tables.clean_csv_lines(part_lines(spark, d)).select("value")
    return tables.parse_csv_lines(lines, "id LONG, brand STRING, kind STRING, size INT")


@query(
    "s9_to_json_records",
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal
       || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record FROM customer""",
)
def s9(spark, d):
    return tables.to_json_records(tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query(
    "s10_create_table_as",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
)
def s10(spark, d):
    path = scratch_path(spark, "ctas")
    name = "t_" + path.rsplit("-", 1)[1]
    found = tables.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    tables.create_table_as(found, name, path)
    return spark.table(name)


# ---- projections and filters ----------------------------------------------

@query(
    "p1_hash_split",
    f"SELECT doc_id, CASE WHEN {md5_bucket('doc_id')} < 20 THEN 'eval' ELSE 'train' END AS part FROM documents",
)
def p1(spark, d):
    return shape.hash_split(tables.table(spark, d, "documents").select("doc_id"), "doc_id", 20)


@query(
    "p2_sample_fraction",
    f"""SELECT doc_id, lang FROM documents
        WHERE {md5_bucket('doc_id', 1_000_000, 'sample')} < 250000 AND {md5_bucket('doc_id')} >= 20""",
)
def p2(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "lang")
    train = shape.hash_split(docs, "doc_id", 20).where("part = 'train'").drop("part")
    return shape.sample_fraction(train, "doc_id", 0.25)


TAGS = ("en", "fr", "src1", "src2", "src3")
TAG_LIST = ", ".join(f"'{t}'" for t in TAGS)


@query(
    "p3_keep_tags",
    f"WITH {POSTS} SELECT id, array_to_string(list_filter(tags, lambda t: t IN ({TAG_LIST})), '|') AS tags FROM posts",
)
def p3(spark, d):
    return posts(spark, d).select("id", F.array_join(tx.keep_tags("tags", TAGS), "|").alias("tags"))


@query(
    "p4_first_tag_label",
    f"""WITH {POSTS} SELECT id, coalesce(list_filter(tags, lambda t: t IN ({TAG_LIST}))[1], 'other-tags') AS label FROM posts""",
)
def p4(spark, d):
    return posts(spark, d).select("id", tx.first_tag_label(tx.keep_tags("tags", TAGS)).alias("label"))


@query(
    "p5_combine_text",
    f"WITH {POSTS} SELECT id, md5(title || text_body || code_body) AS digest, length(title || text_body || code_body) AS n FROM posts",
)
def p5(spark, d):
    both = tx.combine_text("title", "text_body", "code_body")
    return posts(spark, d).select("id", F.md5(both).alias("digest"), F.length(both).alias("n"))


@query("p6_drop_columns", "SELECT c_custkey AS id, c_nationkey, c_mktsegment AS segment FROM customer")
def p6(spark, d):
    spark_df = tables.table(spark, d, "customer")
    return (
        spark_df.drop("c_name", "c_acctbal")
        .withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"})
        .select("id", "c_nationkey", "segment")
    )


@query("p6_select_except", "SELECT * EXCLUDE (l_tax, l_discount, l_extendedprice, l_shipdate) FROM lineitem WHERE l_linenumber = 1")
def p6b(spark, d):
    return spark.sql(
        "SELECT * EXCEPT (l_tax, l_discount, l_extendedprice, l_shipdate) FROM {t} WHERE l_linenumber = 1",
        t=tables.table(spark, d, "lineitem"),
    )


@query("p7_features_label", f"WITH {CORPUS} SELECT doc_id, md5(text) AS feature, label FROM corpus WHERE split = 'train'")
def p7(spark, d):
    return tables.load_corpus(spark, d).where("split = 'train'").select("doc_id", F.md5("text").alias("feature"), "label")


@query("p8_decode_utf8", f"WITH {CORPUS} SELECT doc_id, md5(text) AS digest, length(text) AS n, label FROM corpus WHERE label IS NOT NULL")
def p8(spark, d):
    raw = tables.load_corpus(spark, d).where("label IS NOT NULL").select(
        "doc_id", F.encode("text", "UTF-8").alias("text"), F.encode(F.col("label").cast("string"), "UTF-8").alias("label")
    )
    t = tx.decode_text("text")
    return raw.select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"), tx.decode_label("label").alias("label"))


@query(
    "p9_clean_review",
    r"""SELECT page_id, md5(regexp_replace(html, '(<br\s*/><br\s*/>)|(-)|(/)', ' ', 'g')) AS digest,
        length(regexp_replace(html, '(<br\s*/><br\s*/>)|(-)|(/)', ' ', 'g')) AS n FROM pages""",
)
def p9(spark, d):
    c = tx.clean_review("html")
    return tables.table(spark, d, "pages").select("page_id", F.md5(c).alias("digest"), F.length(c).alias("n"))


@query(
    "p10_strip_punct",
    r"""SELECT doc_id, md5(regexp_replace(lower(text), '[.;:!''?,"()\[\]]', '', 'g')) AS digest FROM documents""",
)
def p10(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.md5(tx.strip_punct("text")).alias("digest"))


@query(
    "p11_restore_umlauts",
    """SELECT doc_id, md5(CASE WHEN lang = 'de' THEN replace(replace(replace(text, 'ae', 'ä'), 'oe', 'ö'), 'ue', 'ü')
       ELSE text END) AS digest FROM documents""",
)
def p11(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.md5(tx.restore_umlauts("text", "lang")).alias("digest"))


@query("p12_equality_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def p12(spark, d):
    return tables.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")


@query("p13_head_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10000")
def p13(spark, d):
    return shape.head_rows(tables.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], 10_000, "o_orderkey")


@query("p14_scale_by", "SELECT p_partkey, round(CAST(p_size AS FLOAT) / CAST(255 AS DOUBLE), 6) AS scaled FROM part")
def p14(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", F.round(tx.scale_by("p_size", 255), 6).alias("scaled"))


@query("p15_long_documents", "SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 7500")
def p15(spark, d):
    return shape.long_documents(tables.table(spark, d, "documents")).select("doc_id", F.octet_length("text").alias("n_bytes"))


@query("p16_strip_newlines", "SELECT doc_id, md5(replace(text, chr(10), '')) AS digest FROM documents")
def p16(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.md5(tx.strip_newlines("text")).alias("digest"))


@query(
    "u1_native_lambdas",
    f"""WITH {POSTS} SELECT id, coalesce(tags[1], 'other-tags') AS label, len(string_split(title, ' ')) AS n_words,
        list_sum(list_transform(tags, lambda t: length(t)))::BIGINT AS tag_chars FROM posts""",
)
def u1(spark, d):
    chars = F.aggregate("tags", F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    return posts(spark, d).select(
        "id", tx.first_tag_label("tags").alias("label"), tx.word_count("title").alias("n_words"), chars.alias("tag_chars")
    )
