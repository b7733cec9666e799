"""Language ID and the two audits over ``documents``."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.divergence import audit_sources
from lexmill.llm.filteraudit import FILTERS, audit_filters
from lexmill.llm.langfilter import fit_languages, predict_languages
from lexmill.llm.registry import query
from lexmill.llm.search_queries import table


@query("op11_language_id")
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return predict_languages(docs, fit_languages(docs))


_ORDERS = ",".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN low IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > low) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
steps AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS own, substr(o, 1, k - 1) AS before
  FROM (VALUES {_ORDERS}) AS t(o), range(1, 6) AS r(k)),
seen AS (SELECT part, filter_order, step, own, n, good, bad, contains(fails, own) AS has, fails = own AS only_own,
  length(translate(fails, before, '')) < length(fails) AS gone FROM cells, steps),
rows_of AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE NOT gone AND NOT has), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE NOT gone AND has), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND has), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE only_own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE NOT gone AND has), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (WHERE NOT gone AND has), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows_of"""


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return audit_filters(docs, table(spark, folder, "labels"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT k, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
  (1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(s.total, 0) + 5 * v))::BIGINT AS p,
  (1 + 1000000000 * (kept.n + 5) // (l.total + 5 * v))::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(table(spark, folder, "documents").select("lang", "source", "text"))
