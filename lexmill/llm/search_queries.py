"""Sharding, url filters, embedding duplicates, main text and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.covertree import near_vectors
from lexmill.llm.maintext import main_text
from lexmill.llm.registry import query
from lexmill.llm.sharding import kd_shards
from lexmill.llm.toxicity import fit_toxicity, score_toxicity
from lexmill.llm.urlfilter import CANONICAL, HREF, LINK_TAG, META_TAG, REFRESH, TARGET, judge_urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _kd_sql(depth: int) -> str:
    """Median splits, one level after the other."""
    axes = ("size", "source", "lang", "id")
    out = f"""
WITH d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, md5(coalesce(text, '')) AS t,
  dense_rank() OVER (ORDER BY source NULLS FIRST) AS source, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS lang,
  coalesce(doc_id, -1) AS id FROM documents),
g0 AS (SELECT t, sum(size)::BIGINT AS w, any_value(size) AS size, min(source) AS source, min(lang) AS lang, min(id) AS id,
  0 AS node FROM d GROUP BY t),
n0 AS (SELECT t, w, size, dense_rank() OVER (ORDER BY source) AS source, dense_rank() OVER (ORDER BY lang) AS lang, id, node FROM g0),
x AS (SELECT {', '.join(f'(max({a}) - min({a}))::DOUBLE AS {a}' for a in axes)} FROM n0)"""
    for k in range(depth):
        half = 2 ** (depth - k - 1)
        widths = [f"coalesce((max(n.{a}) - min(n.{a}))::DOUBLE / nullif(any_value(x.{a}), 0), 0.0)" for a in axes]
        chosen = "CASE " + " ".join(f"WHEN ws[{i + 1}] = list_max(ws) THEN n.{a}" for i, a in enumerate(axes)) + " END"
        out += f""",
s{k} AS (SELECT node, sum(w) AS total, [{', '.join(widths)}] AS ws FROM n{k} n, x GROUP BY node),
v{k} AS (SELECT n.*, total, {chosen} AS v FROM n{k} n JOIN s{k} USING (node)),
r{k} AS (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY v, t) AS upto FROM v{k}),
n{k + 1} AS (SELECT t, w, size, source, lang, id, node + CASE WHEN 2 * upto - w < total THEN 0 ELSE {half} END AS node FROM r{k})"""
    return out


OP2_SQL = _kd_sql(4) + """
SELECT doc_id, d.size, t, 'bytes' AS law, node::INT AS shard, NULL::INT AS grown_shard,
  row_number() OVER (PARTITION BY node ORDER BY doc_id NULLS LAST, t) - 1 AS slot
FROM d JOIN n4 USING (t)"""


@query("op2_sharding")
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = kd_shards(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


PAGE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _rule_sql(host: str, path: str, what: int) -> str:
    out = "NULL"
    for r in sorted(PAGE_RULES, key=lambda r: len(r[0] + r[1])):
        value = r[2] if what else r[0] + r[1]
        out = f"CASE WHEN ({host} = '{r[0]}' OR {host} LIKE '%.{r[0]}') AND starts_with({path}, '{r[1]}') THEN '{value}' ELSE {out} END"
    return out


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"


def _key_sql(u: str) -> str:
    part = lambda k: f"regexp_extract({u}, '{_PARTS}', {k})"
    return f"CASE WHEN contains({u}, '://') THEN translate({part(1)}, '{_A}', '{_Z}') || '://' || translate({part(2)}, '{_A}', '{_Z}') || {part(3)} || {part(4)} END"


_ORIGIN = f"translate(regexp_extract(url, '{_PARTS}', 1), '{_A}', '{_Z}') || '://' || host"


def _targets(tag: str, kind: str, place: str) -> str:
    tag, kind, place = (x.replace("'", "''") for x in (tag, kind, place))
    tags = f"list_filter(regexp_extract_all(html, '{tag}'), lambda x: regexp_matches(x, '{kind}'))"
    return f"list_transform({tags}, lambda x: regexp_extract(x, '{place}', 1))"


OP4_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '{_PARTS}', 2), ''), '{_A}', '{_Z}') AS host,
    coalesce(regexp_extract(url, '{_PARTS}', 3), '') AS path, {_key_sql('url')} AS key FROM pages),
named AS (SELECT *, list_concat({_targets(LINK_TAG, CANONICAL, HREF)}, {_targets(META_TAG, REFRESH, TARGET)}) AS ts
  FROM p WHERE key IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
aims AS (SELECT url, key, host, path, replace(unnest(ts), '&amp;', '&') AS t FROM named),
full_aims AS (SELECT key, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN translate(regexp_extract(url, '{_PARTS}', 1), '{_A}', '{_Z}') || ':' || t
    WHEN starts_with(t, '/') THEN {_ORIGIN} || t WHEN starts_with(t, '?') THEN {_ORIGIN} || path || t
    WHEN t = '' OR starts_with(t, '#') THEN NULL
    ELSE {_ORIGIN} || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || t END AS t FROM aims),
e AS (SELECT DISTINCT key AS a, {_key_sql('t')} AS b FROM full_aims WHERE t IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
parts AS (SELECT a, b, translate(regexp_extract(b, '{_PARTS}', 2), '{_A}', '{_Z}') AS h, regexp_extract(b, '{_PARTS}', 3) AS q FROM reach),
hit AS (SELECT a, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS blocked FROM (
  SELECT a, {_rule_sql('h', 'q', 1)} AS v FROM parts) GROUP BY a)
SELECT page_id, host, path, {_rule_sql('host', 'path', 0)} AS rule,
  coalesce({_rule_sql('host', 'path', 1)}, CASE WHEN hit.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN hit ON hit.a = p.key"""


@query("op4_url_filters", OP4_SQL)
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT reach.a AS k, min(v.vec_id) AS low FROM reach JOIN v ON v.k = reach.b GROUP BY reach.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id,
  coalesce(vec_id = coalesce(low, vec_id), false) AS kept
FROM v LEFT JOIN n USING (k) LEFT JOIN c USING (k)"""


@query("op5_embedding_groups", OP5_SQL)
def op5_embedding_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
