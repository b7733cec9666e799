"""Profiles, counts and histograms as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import profile
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import CORPUS
from lexmill.sources import tables


def lengths(spark, d):
    """Corpus with the word count and the byte length of every text."""
    return tables.load_corpus(spark, d).select(
        "doc_id", "lang", "split", "label", tx.word_count("text").alias("n_words"), F.octet_length("text").alias("n_bytes")
    )


LENGTHS = CORPUS + """, lens AS (SELECT doc_id, lang, split, label, len(string_split(text, ' ')) AS n_words,
   strlen(text) AS n_bytes FROM corpus)"""


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "a1_yearly_rate",
    """SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS year, count(*) AS n_rows,
       round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 1) AS pct
       FROM orders GROUP BY 1 HAVING year BETWEEN 1993 AND 2000 ORDER BY 1""",
)
def a1(spark, d):
    return profile.yearly_rate(tables.table(spark, d, "orders"), "o_orderdate", F.col("o_orderstatus") == "F", 1993, 2000)


@query(
    "a2_dataset_card",
    f"""WITH {CORPUS}, known AS (SELECT unnest(['train', 'validation', 'test', 'unsupervised']) AS split),
       found AS (SELECT split, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels FROM corpus GROUP BY 1)
       SELECT k.split, coalesce(n_rows, 0) AS n_rows, coalesce(labels, '') AS labels, coalesce(n_labels, 0) AS n_labels,
       n_rows IS NOT NULL AS is_defined FROM known k LEFT JOIN found f ON k.split = f.split""",
)
def a2(spark, d):
    return profile.dataset_card(tables.load_corpus(spark, d), tables.SPLITS)


def _card_sql(column: str, kind: str, value: str = "{c}", size: str = "NULL") -> str:
    text = value.format(c=column)
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS n_rows, count(*) - count({column}) AS n_null,
      CAST(min({size}) AS BIGINT) AS min_size, CAST(max({size}) AS BIGINT) AS max_size,
      arg_min(CAST({text} AS VARCHAR), doc_id) FILTER ({column} IS NOT NULL) AS example FROM w"""


@query(
    "a3_structure_card",
    "WITH w AS (SELECT doc_id, lang, n_chars, string_split(text, ' ') AS words FROM documents) "
    + " UNION ALL ".join(
        [_card_sql("doc_id", "bigint"), _card_sql("lang", "string"), _card_sql("n_chars", "bigint"),
         _card_sql("words", "array<string>", "'[' || array_to_string({c}, ', ') || ']'", "len(words)")]
    ),
)
def a3(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.split("text", " ", -1).alias("words"))
    return profile.structure_card(rows, "doc_id")


@query("a3_sample_rows", "SELECT doc_id, lang, source, n_chars, text FROM documents ORDER BY doc_id LIMIT 5")
def a3b(spark, d):
    return profile.sample_rows(tables.table(spark, d, "documents"), "doc_id", 5).select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "a4_null_counts",
    f"""WITH {CORPUS}, one AS (SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(text) AS text, count(*) - count(lang) AS lang,
       count(*) - count(source) AS source, count(*) - count(label) AS label, count(*) - count(split) AS split FROM corpus)
       UNPIVOT one ON COLUMNS(*) INTO NAME "column" VALUE n_null""",
)
def a4(spark, d):
    return profile.null_counts(tables.load_corpus(spark, d))


@query("a5_value_counts", f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus GROUP BY 1")
def a5(spark, d):
    return profile.value_counts(tables.load_corpus(spark, d), "label")


@query(
    "a6_class_balance",
    f"""WITH {CORPUS}, c AS (SELECT split, label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY 1, 2)
       SELECT split, label, n, round(100 * n / sum(n) OVER (PARTITION BY split), 6) AS pct FROM c""",
)
def a6(spark, d):
    return rounded(profile.class_balance(tables.load_corpus(spark, d).where("label IS NOT NULL"), "split"), "pct")


@query("a7_positive_share", f"WITH {CORPUS} SELECT lang, round(avg(label), 6) AS positive_share FROM corpus WHERE label IS NOT NULL GROUP BY 1")
def a7(spark, d):
    return rounded(profile.positive_share(tables.load_corpus(spark, d).where("label IS NOT NULL"), "label", "lang"), "positive_share")


DESCRIBE = """count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS "min",
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS "max" """


@query("a8_describe_by_split", f"WITH {LENGTHS} SELECT split, {DESCRIBE.format(c='n_words')} FROM lens GROUP BY split")
def a8(spark, d):
    return rounded(profile.describe_numeric(lengths(spark, d), "n_words", ["split"]), "mean", "std", "q25", "q50", "q75")


@query("a8_describe_prices", f"SELECT {DESCRIBE.format(c='l_extendedprice')} FROM lineitem")
def a8b(spark, d):
    return rounded(
        profile.describe_numeric(tables.table(spark, d, "lineitem"), "l_extendedprice", stored=True), "mean", "std", "q25", "q50", "q75"
    )


@query(
    "a9_length_stats",
    """SELECT lang, max(strlen(text)) AS longest, min(strlen(text)) AS shortest, round(avg(strlen(text)), 6) AS mean,
       round(stddev_samp(strlen(text)), 6) AS std FROM documents GROUP BY 1""",
)
def a9(spark, d):
    return rounded(profile.length_stats(tables.table(spark, d, "documents"), "text", ["lang"]), "mean", "std")


@query("a10_quantile", f"WITH {LENGTHS} SELECT round(quantile_cont(n_words, 0.95), 6) AS quantile FROM lens")
def a10(spark, d):
    return rounded(profile.quantile(lengths(spark, d), "n_words", 0.95), "quantile")


@query(
    "a11_percentile_of_score",
    f"""WITH {LENGTHS} SELECT round((count(*) FILTER (n_words < 500) + count(*) FILTER (n_words <= 500)
       + CASE WHEN count(*) FILTER (n_words = 500) > 0 THEN 1 ELSE 0 END) * 50.0 / count(*), 6) AS percentile FROM lens""",
)
def a11(spark, d):
    return rounded(profile.percentile_of_score(lengths(spark, d), "n_words", 500), "percentile")


SIZES = (50, 100, 128, 250, 500, 1000)


@query(
    "a12_fraction_below",
    f"""WITH {LENGTHS}, t AS (SELECT CAST(unnest({list(SIZES)}) AS DOUBLE) AS threshold)
       SELECT threshold, round(count(*) FILTER (n_words < threshold) / count(*), 6) AS share FROM lens, t GROUP BY 1""",
)
def a12(spark, d):
    return rounded(profile.fraction_below(lengths(spark, d), "n_words", SIZES), "share")


def hist_sql(src: str, col: str, edges: str, by: str = "", extra: str = "") -> str:
    """Histogram SQL: ``edges`` is a query for one row (lo, hi, bins)."""
    b, bb = (f"{by}, ", f"g.{by}, ") if by else ("", "")
    groups = f"(SELECT DISTINCT {by} FROM {src})" if by else "(SELECT 1)"
    same = f" AND g.{by} = h.{by}" if by else ""
    return f""", e0 AS ({edges}), e AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
       CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, CAST(bins AS INTEGER) AS bins FROM e0),
       h AS (SELECT {b}least(CAST(floor((CAST({col} AS DOUBLE) - lo) * bins / (hi - lo)) AS INTEGER), bins - 1) AS bin, count(*) AS n
             FROM {src}, e WHERE {col} IS NOT NULL GROUP BY ALL),
       g AS (SELECT x.*, unnest(range(bins))::INTEGER AS bin, lo, (hi - lo) / bins AS width FROM {groups} x, e)
       SELECT {bb}g.bin, round(lo + g.bin * width, 6) AS left_edge, round(width, 6) AS width, coalesce(n, 0) AS n{extra}
       FROM g LEFT JOIN h ON g.bin = h.bin{same}"""


@query(
    "a13_histogram",
    f"WITH {LENGTHS}"
    + hist_sql("lens", "n_words", "SELECT CAST(min(n_words) AS DOUBLE) AS lo, CAST(max(n_words) AS DOUBLE) AS hi, 50 AS bins FROM lens"),
)
def a13(spark, d):
    return rounded(profile.histogram(lengths(spark, d), "n_words", 50), "left_edge", "width")


@query(
    "a14_histogram_auto",
    f"WITH {LENGTHS}"
    + hist_sql(
        "lens",
        "n_bytes",
        """SELECT lo, hi, CASE WHEN w > 0 THEN ceil((hi - lo) / w) ELSE 1 END AS bins FROM (
           SELECT lo, hi, CASE WHEN fd > 0 THEN least(st, fd) ELSE st END AS w FROM (
           SELECT CAST(min(n_bytes) AS DOUBLE) AS lo, CAST(max(n_bytes) AS DOUBLE) AS hi,
             (max(n_bytes) - min(n_bytes)) / (log2(count(*)) + 1) AS st,
             2 * (quantile_cont(n_bytes, 0.75) - quantile_cont(n_bytes, 0.25)) / pow(count(*), 1.0 / 3.0) AS fd FROM lens))""",
    ),
)
def a14(spark, d):
    return rounded(profile.histogram(lengths(spark, d), "n_bytes", "auto"), "left_edge", "width")


@query(
    "a15_histogram_density",
    f"WITH {LENGTHS}"
    + hist_sql(
        "lens",
        "n_words",
        "SELECT CAST(min(n_words) AS DOUBLE) AS lo, CAST(max(n_words) AS DOUBLE) AS hi, 50 AS bins FROM lens",
        by="split",
        extra=", round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.split) * width), 6) AS density",
    ),
)
def a15(spark, d):
    return rounded(profile.histogram_density(lengths(spark, d), "n_words", "split", 50), "left_edge", "width", "density")


@query(
    "a16_ecdf",
    f"""WITH {LENGTHS}, c AS (SELECT split, n_words AS value, count(*) AS n FROM lens GROUP BY 1, 2)
       SELECT split, value, round(sum(n) OVER (PARTITION BY split ORDER BY value) / sum(n) OVER (PARTITION BY split), 6) AS cdf FROM c""",
)
def a16(spark, d):
    return rounded(profile.ecdf(lengths(spark, d), "n_words", ["split"]), "cdf")


LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "a17_feature_stats_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n_rows, count(*) - count({c}) AS n_missing, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, count(*) FILTER ({c} = 0) AS n_zero, CAST(min({c}) AS DOUBLE) AS "min",
        CAST(max({c}) AS DOUBLE) AS "max", round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem"""
        for c in LINE_COLS
    ),
)
def a17(spark, d):
    return rounded(profile.feature_stats_numeric(tables.table(spark, d, "lineitem"), LINE_COLS), "mean", "std", "median")


TOP_COLUMNS = (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("documents", "source"), ("documents", "text"), ("events", "event_type"), ("events", "props"))
PART_TEXT = ("p_name", "p_brand", "p_type")


@query(
    "a17_feature_stats_string",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique,
        (SELECT {c} FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value,
        (SELECT count(*) FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top_count,
        round(avg(length({c})), 6) AS mean_length FROM part"""
        for c in PART_TEXT
    ),
)
def a17b(spark, d):
    return rounded(profile.feature_stats_string(tables.table(spark, d, "part"), PART_TEXT), "mean_length")


@query(
    "a17_top_values",
    "WITH c AS ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}""" for t, c in TOP_COLUMNS)
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM c)
      SELECT "column", rank, value, n FROM r WHERE rank <= 5""",
)
def a17d(spark, d):
    out = None
    for name in dict.fromkeys(t for t, _ in TOP_COLUMNS):
        found = profile.top_values(tables.table(spark, d, name), 5, [c for t, c in TOP_COLUMNS if t == name])
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "a17_feature_histograms",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", g.bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS left_edge, coalesce(n, 0) AS n FROM
        (SELECT unnest(range(10))::INTEGER AS bin, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) g
        LEFT JOIN (SELECT least(CAST(floor((CAST({c} AS DOUBLE) - lo) * 10 / (hi - lo)) AS INTEGER), 9) AS bin, count(*) AS n
          FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) GROUP BY 1) h
        ON g.bin = h.bin"""
        for c in LINE_COLS
    ),
)
def a17c(spark, d):
    return rounded(profile.feature_histograms(tables.table(spark, d, "lineitem"), 10, LINE_COLS), "left_edge")


@query("a18_group_total", "SELECT lang, source, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2")
def a18(spark, d):
    return profile.group_total(tables.table(spark, d, "documents"), ["lang", "source"])
