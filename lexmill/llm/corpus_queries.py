"""Queries over ``documents``: packing, quality rules, line dedup, mixing, SimHash."""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.linededup import dedup_lines
from lexmill.llm.mixing import SCHEDULES, mix_plan
from lexmill.llm.packing import pack
from lexmill.llm.quality import judge_quality
from lexmill.llm.registry import query
from lexmill.llm.simhash import simhash_groups

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    # a row's place in its file tells repeated rows apart
    docs = documents(spark, folder).select("doc_id", "text", "_metadata.file_name", "_metadata.row_index")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), apart=["file_name", "row_index"])


def repeated_sql(words: int) -> str:
    """Number of words per document inside windows of ``words`` words found twice or more."""
    return f"""
SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + {words})) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM (
      SELECT doc_id, i, list_slice(w, i, i + {words} - 1) AS w FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - {words} + 2)) AS i FROM t)))
  WHERE c > 1) GROUP BY doc_id"""


OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
three AS ({repeated_sql(3)}), eight AS ({repeated_sql(8)}),
far AS (SELECT DISTINCT doc_id FROM (
  SELECT doc_id, count(*) OVER (PARTITION BY doc_id, w) AS c FROM (
    SELECT doc_id, md5(array_to_string(list_slice(w, i, i + 200), ' ')) AS w FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 199)) AS i FROM t))) WHERE c > 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(three.n, 0)::BIGINT AS n_repeat_words,
    coalesce(eight.n, 0) AS covered, far.doc_id IS NOT NULL AS is_far
  FROM t LEFT JOIN three USING (doc_id) LEFT JOIN eight USING (doc_id) LEFT JOIN lines USING (doc_id)
    LEFT JOIN far ON far.doc_id = t.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND covered <= 0.3 * n_words AND NOT is_far AS kept
FROM failed"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = judge_quality(documents(spark, folder).select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"_{c}").alias(c) for c in names))


# Windows of lines with 50 words or more, forward from each start and backward to each end;
# a line goes when a window over it has the same lines as one that starts earlier.
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k, doc_id, text FROM documents),
l AS (SELECT k, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (
  SELECT k, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL)),
w AS (SELECT *, sum(len(regexp_extract_all(line, '{WORD}'))) OVER (PARTITION BY k ORDER BY i) AS upto,
  sum(len(regexp_extract_all(line, '{WORD}'))) OVER (PARTITION BY k ORDER BY i) - len(regexp_extract_all(line, '{WORD}')) AS before FROM l),
win AS (
  SELECT a.k, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON a.k = b.k AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY a.k, a.i
  UNION
  SELECT b.k, max(a.i) AS s, b.i AS e FROM w a JOIN w b ON a.k = b.k AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY b.k, b.i),
named AS (SELECT win.k, s, e, list(line ORDER BY i) AS c FROM win JOIN l ON l.k = win.k AND l.i BETWEEN s AND e GROUP BY win.k, s, e),
placed AS (SELECT k, s, e, row_number() OVER (PARTITION BY c ORDER BY k, s) AS r FROM named),
gone AS (SELECT DISTINCT l.k, l.i FROM placed JOIN l ON l.k = placed.k AND l.i BETWEEN s AND e WHERE r > 1),
kept AS (SELECT l.k, count(*) AS n, count(gone.i) AS m, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS t
  FROM l LEFT JOIN gone ON gone.k = l.k AND gone.i = l.i GROUP BY l.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_deleted,
  CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text
FROM d LEFT JOIN kept USING (k)"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text")


def _time_sql(share: str, knots: Sequence[float]) -> str:
    """Time at which the integral of a schedule of two knots has reached a share of its whole."""
    a, b = knots
    whole = (a + b) / 2
    return f"least(2 * ({share}) * {whole} / nullif({a} + sqrt(greatest({a * a} + 2 * ({b - a}) * ({share}) * {whole}, 0)), 0), 1.0)"


_PLACE = "least((r * source_size + placed + size / 2) / target, 1.0)"
_TIMES = " ".join(f"WHEN {k} THEN {_time_sql(_PLACE, knots)}" for k, knots in enumerate(SCHEDULES))
OP8_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
d AS (SELECT *, md5('mix:' || key || ':' || (row_number() OVER (PARTITION BY source, key) - 1)) AS u FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(k % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS ratio, sum(cap) OVER o AS caps, sum(weight) OVER o AS used,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM r WINDOW o AS (ORDER BY cap / weight, k)),
v AS (SELECT *, (total - (caps - cap)) / (weights - (used - weight)) AS level FROM f),
m AS (SELECT arg_min(level, (ratio, k)) AS level FROM v WHERE level <= ratio),
g AS (SELECT source, k, source_size, coalesce(least(cap, m.level * weight), 0.0) AS target FROM r, m),
c AS (SELECT d.doc_id, d.size, g.*, sum(size) OVER (PARTITION BY k ORDER BY u) - size AS placed, floor(target / nullif(source_size, 0)) AS q
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, (CASE WHEN target > 0 THEN least(q + CASE WHEN placed + size / 2 < target - q * source_size THEN 1 ELSE 0 END, 3) ELSE 0 END)::INT AS copies FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  coalesce(array_to_string(list_transform(range(copies), lambda r: round((CASE k % 3 {_TIMES} END)::DOUBLE * 1e9)::BIGINT), ','), '') AS positions
FROM n"""


@query("op8_mixing", OP8_SQL)
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(documents(spark, folder).select("doc_id", "source", "text"))
    taken = (F.col("size") * F.size("positions")).alias("taken")
    # times in billionths, one for each copy
    times = F.transform("positions", lambda x: F.round(x * 1e9).cast("long").cast("string"))
    return plan.select("doc_id", "size", "source_size", "target", taken, F.array_join(times, ",").alias("positions"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(documents(spark, folder))
