"""SQL fragments shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations


def md5_bucket(expr: str, buckets: int = 100, salt: str = "") -> str:
    text = f"'{salt}:' || CAST({expr} AS VARCHAR)" if salt else f"CAST({expr} AS VARCHAR)"
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT % {buckets})"


def md5_key(expr: str, seed: str) -> str:
    return f"md5('{seed}:' || CAST({expr} AS VARCHAR))"


CORPUS = f"""corpus AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS label,
         CASE WHEN l.quality IS NULL THEN 'unsupervised'
              WHEN {md5_bucket('d.doc_id')} < 20 THEN 'test' ELSE 'train' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

LABELLED = CORPUS + ", labelled AS (SELECT * FROM corpus WHERE label IS NOT NULL)"

POSTS = r"""posts AS (
  SELECT doc_id AS id,
         string_split(text, chr(10))[1] AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE NULL END AS text_body,
         '' AS code_body,
         [lang, source, lang] AS tags
  FROM documents)"""

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

TOKENS = f"""tokens AS (
  SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token
  FROM (SELECT doc_id, {WORDS} AS w FROM documents))"""

COUNTS = TOKENS + ", counts AS (SELECT doc_id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2)"

def vocab_sql(min_df: str = "df >= 2", max_df: str = "TRUE", cap: int | None = 10_000) -> str:
    limit = "" if cap is None else f"ORDER BY tf DESC, term LIMIT {cap}"
    return f""", v0 AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM counts GROUP BY 1),
  vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, df, tf FROM
    (SELECT * FROM v0 WHERE {min_df} AND {max_df} {limit}))"""


N_DOCS = "(SELECT count(*) FROM documents)"
VOCAB = COUNTS + vocab_sql()
IDF = VOCAB + f", weights AS (SELECT *, ln((1 + {N_DOCS}) / (1 + df)) + 1 AS idf FROM vocab)"
TFIDF = IDF + """, raw AS (SELECT doc_id, term, c.tf, c.tf * idf AS w FROM counts c JOIN weights USING (term)),
  tfidf AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def extremes_sql(src: str, col: str, k_top: int = 20, k_bottom: int = 20, places: int | None = None) -> str:
    out = f"round({col}, {places})" if places is not None else col
    return f"""SELECT 'top' AS side, rank, term, {out} AS {col} FROM (SELECT *, row_number() OVER (ORDER BY {col} DESC, term) AS rank FROM {src})
      WHERE rank <= {k_top} UNION ALL
      SELECT 'bottom' AS side, rank, term, {out} AS {col} FROM (SELECT *, row_number() OVER (ORDER BY {col}, term) AS rank FROM {src})
      WHERE rank <= {k_bottom}"""
