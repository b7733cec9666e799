"""Tokens, vocabularies and encodings as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import sequences as sq
from lexmill.functions import text as tx
from lexmill.operators import encode, profile, shape, tokens
from lexmill.plans.registry import query
from lexmill.plans.sqlparts import COUNTS, IDF, TFIDF, TOKENS, VOCAB, WORDS, extremes_sql, vocab_sql
from lexmill.session import materialize, scratch_path
from lexmill.sources import tables

CAP = 10_000


#: Vocabulary without a cap.
ALL_TERMS = COUNTS + vocab_sql(cap=None)


def docs(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", "text", "lang")


def n_docs(spark, d):
    return tables.table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()


def vocab(spark, d, min_df=2, cap=CAP):
    return tokens.build_vocab(tokens.term_counts(docs(spark, d)), n_docs(spark, d), min_df, 1.0, cap)


def weights(spark, d):
    return tokens.idf(vocab(spark, d), n_docs(spark, d))


@query("t1_word_count", "SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents")
def t1(spark, d):
    return docs(spark, d).select("doc_id", tx.word_count("text").alias("n_words"))


@query("t2_text_lengths", "SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def t2(spark, d):
    return profile.text_lengths(docs(spark, d))


@query(
    "t2_translation_volume",
    "SELECT sum(length(text))::BIGINT AS total_chars, (sum(length(text)) * 2)::BIGINT AS translated_chars FROM documents",
)
def t2b(spark, d):
    return profile.translation_volume(docs(spark, d), 2)


@query(
    "t3_tokenize",
    f"""WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, sum((pos + 1) * length(token))::BIGINT AS weighted_length,
        min(token) AS first_token, max(token) AS last_token FROM tokens GROUP BY 1""",
)
def t3(spark, d):
    return tokens.tokenize(docs(spark, d)).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum((F.col("pos") + 1) * F.length("token")).alias("weighted_length"),
        F.min("token").alias("first_token"),
        F.max("token").alias("last_token"),
    )


@query(
    "t4_term_counts",
    f"""WITH {COUNTS} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf,
        sum(tf * tf)::BIGINT AS sum_squares FROM counts GROUP BY 1""",
)
def t4(spark, d):
    return tokens.term_counts(docs(spark, d)).groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"),
        F.sum(F.col("tf") * F.col("tf")).alias("sum_squares"),
    )


@query("t5_build_vocab", f"WITH {VOCAB} SELECT term, term_id, df, tf FROM vocab")
def t5(spark, d):
    return vocab(spark, d)


@query(
    "t5_build_vocab_shares",
    f"WITH {COUNTS}" + vocab_sql("df >= 0.01 * (SELECT count(*) FROM documents)", "df <= 0.5 * (SELECT count(*) FROM documents)", 10**9)
    + " SELECT term, term_id, df, tf FROM vocab",
)
def t5b(spark, d):
    return tokens.build_vocab(tokens.term_counts(docs(spark, d)), n_docs(spark, d), 0.01, 0.5, None)


@query(
    "t6_ngrams",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_concat(w,
          list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
          list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
        c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2)
        SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams, sum(tf * length(term))::BIGINT AS chars, max(term) AS last_term
        FROM c GROUP BY 1""",
)
def t6(spark, d):
    return tokens.ngram_counts(docs(spark, d), 1, 3).groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"),
        F.sum(F.col("tf") * F.length("term")).alias("chars"), F.max("term").alias("last_term"),
    )


@query("t7_idf", f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM weights")
def t7(spark, d):
    return weights(spark, d).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_sums(weighted):
    return weighted.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("sum_squares"), F.round(F.max("weight"), 6).alias("max_weight"),
    )


SUMS = """SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight, round(sum(weight * weight), 6) AS sum_squares,
          round(max(weight), 6) AS max_weight FROM {src} GROUP BY 1"""


@query("t8_tfidf_l2", f"WITH {TFIDF} " + SUMS.format(src="tfidf"))
def t8(spark, d):
    return tfidf_sums(tokens.tfidf(tokens.term_counts(docs(spark, d)), weights(spark, d), "l2", max_features=CAP))


@query("t8_tfidf_l1", f"WITH {TFIDF}, l1 AS (SELECT doc_id, w / sum(abs(w)) OVER (PARTITION BY doc_id) AS weight FROM raw) " + SUMS.format(src="l1"))
def t8b(spark, d):
    return tfidf_sums(tokens.tfidf(tokens.term_counts(docs(spark, d)), weights(spark, d), "l1", max_features=CAP))


@query("t8_tfidf_none", f"WITH {TFIDF}, l0 AS (SELECT doc_id, w AS weight FROM raw) " + SUMS.format(src="l0"))
def t8c(spark, d):
    return tfidf_sums(tokens.tfidf(tokens.term_counts(docs(spark, d)), weights(spark, d), "None", max_features=CAP))


@query(
    "t9_transform_features",
    f"""WITH {IDF}, bt AS (SELECT item_id, unnest({WORDS}) AS term FROM benchmark),
        bc AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY 1, 2),
        br AS (SELECT item_id, term, c.tf, c.tf * idf AS w FROM bc c JOIN weights USING (term))
        SELECT item_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM br""",
)
def t9(spark, d):
    unseen = tables.table(spark, d, "benchmark")
    out = tokens.transform_features(unseen, weights(spark, d), "l2", "item_id")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "t10_term_totals",
    f"WITH {COUNTS}, t AS (SELECT term, sum(tf)::BIGINT AS total FROM counts GROUP BY 1) " + extremes_sql("t", "total", 30, 10),
)
def t10(spark, d):
    return tokens.term_totals(tokens.term_counts(docs(spark, d)), 30, 10)


@query(
    "t11_vocab_report",
    f"""WITH {VOCAB} SELECT count(*) AS size,
        (SELECT term FROM vocab ORDER BY length(term) DESC, term LIMIT 1) AS longest,
        (SELECT term FROM vocab ORDER BY length(term), term LIMIT 1) AS shortest,
        (SELECT term FROM vocab ORDER BY term_id LIMIT 1) AS first_by_index,
        (SELECT term FROM vocab ORDER BY term_id DESC LIMIT 1) AS last_by_index,
        (SELECT term FROM vocab ORDER BY tf DESC, term LIMIT 1) AS most_frequent,
        (SELECT term FROM vocab ORDER BY tf, term LIMIT 1) AS least_frequent FROM vocab""",
)
def t11(spark, d):
    return tokens.vocab_report(vocab(spark, d))


@query(
    "t12_mean_tfidf",
    f"""WITH {TFIDF}, m AS (SELECT term, round(sum(weight) / (SELECT count(*) FROM documents), 9) AS mean_weight FROM tfidf GROUP BY 1) """
    + extremes_sql("m", "mean_weight", places=6),
)
def t12(spark, d):
    weighted = tokens.tfidf(tokens.term_counts(docs(spark, d)), weights(spark, d), max_features=CAP)
    means = tokens.mean_tfidf(weighted, n_docs(spark, d), 20)
    return means.withColumn("mean_weight", F.round("mean_weight", 6))


@query("t13_idf_extremes", f"WITH {IDF} " + extremes_sql("weights", "idf", places=6))
def t13(spark, d):
    return tokens.idf_extremes(weights(spark, d), 20).withColumn("idf", F.round("idf", 6))


BLANKED = r"""translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), '                                  ')"""
INDEX = f"""iw AS (SELECT doc_id, list_filter(string_split({BLANKED}, ' '), lambda w: w <> '') AS w FROM documents),
  ix AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM iw),
  ig AS (SELECT word, count(*) AS n, min(struct_pack(k := doc_id, p := pos)) AS f FROM ix GROUP BY 1),
  windex AS (SELECT word, (row_number() OVER (ORDER BY n DESC, f))::INTEGER AS idx, n FROM ig)"""


@query("t14_word_index", f"WITH {INDEX} SELECT word, idx, n FROM windex")
def t14(spark, d):
    return tokens.word_index(docs(spark, d))


SEQ = INDEX + """, ids AS (SELECT doc_id, list(idx ORDER BY pos) FILTER (idx < 10000) AS ids FROM ix JOIN windex USING (word) GROUP BY 1),
  seqs AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN ids USING (doc_id))"""


def sequences(spark, d):
    return tokens.to_sequences(docs(spark, d), tokens.word_index(docs(spark, d), num_words=CAP), CAP)


@query("t15_to_sequences", f"WITH {SEQ} SELECT doc_id, len(ids) AS n, md5(array_to_string(ids, ' ')) AS digest FROM seqs")
def t15(spark, d):
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return sequences(spark, d).select("doc_id", F.size("ids").alias("n"), F.md5(ids).alias("digest"))


@query(
    "t16_pad_sequences",
    f"""WITH {SEQ} SELECT doc_id, 500::BIGINT AS n, md5(array_to_string(list_concat(
          list_transform(range(greatest(500 - len(ids), 0)), lambda i: 0),
          ids[greatest(len(ids) - 500, 0) + 1 : ]), ' ')) AS digest FROM seqs""",
)
def t16(spark, d):
    padded = sq.pad_front("ids", 500)
    return sequences(spark, d).select("doc_id", padded.alias("p")).select(
        "doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.col("p").cast("array<string>"), " ")).alias("digest")
    )


# ---- fixed-length encodings -----------------------------------------------

def token_vocab(spark, d):
    """The corpus vocabulary with ids after the special ones."""
    return vocab(spark, d).select("term", (F.col("term_id") + 1000).alias("token_id"))


def encoded(spark, d, max_len=128):
    return encode.encode_fixed(docs(spark, d), token_vocab(spark, d), ["doc_id"], "text", max_len, CAP)


ENCODED = VOCAB + f""", ew AS (SELECT doc_id, ({WORDS})[1:126] AS w FROM documents),
  ep AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM ew),
  ei AS (SELECT doc_id, list(coalesce(term_id + 1000, 100) ORDER BY pos) AS ids FROM ep LEFT JOIN vocab USING (term) GROUP BY 1),
  er AS (SELECT doc_id, list_concat([101], coalesce(ids, []), [102]) AS r FROM documents LEFT JOIN ei USING (doc_id)),
  enc AS (SELECT doc_id, list_concat(r, list_transform(range(128 - len(r)), lambda i: 0)) AS input_ids,
    list_concat(list_transform(r, lambda i: 1), list_transform(range(128 - len(r)), lambda i: 0)) AS attention_mask,
    list_transform(range(128), lambda i: 0) AS token_type_ids FROM er)"""


def joined(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query(
    "t17_encode_fixed",
    f"""WITH {ENCODED} SELECT doc_id, md5(array_to_string(input_ids, ' ')) AS ids, list_sum(attention_mask)::BIGINT AS n_real,
        array_to_string(token_type_ids, '') AS types FROM enc""",
)
def t17(spark, d):
    return encoded(spark, d).select(
        "doc_id", F.md5(joined("input_ids")).alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n_real"),
        F.array_join(F.col("token_type_ids").cast("array<string>"), "").alias("types"),
    )


def turn_ids(spark, d):
    """Conversation turns as word ids."""
    turns = tables.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return tokens.to_ids(turns, token_vocab(spark, d), ["conv_id", "turn"], "text", sq.UNK_ID, None, CAP)


TURNS = VOCAB + f""", tw AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
  tp AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS term FROM tw),
  ti AS (SELECT conv_id, turn, list(coalesce(term_id + 1000, 100) ORDER BY pos) AS ids FROM tp LEFT JOIN vocab USING (term) GROUP BY 1, 2),
  turns AS (SELECT c.conv_id, c.turn, coalesce(ids, []) AS ids FROM conversations c LEFT JOIN ti ON c.conv_id = ti.conv_id AND c.turn = ti.turn),
  pairs AS (SELECT a.conv_id, a.turn, a.ids AS ids_a, b.ids AS ids_b FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query(
    "t18_encode_pair",
    f"""WITH {TURNS}, l AS (SELECT *, len(ids_a) AS la, len(ids_b) AS lb, greatest(len(ids_a) + len(ids_b) - 61, 0) AS ex FROM pairs),
        m AS (SELECT *, least(ex, abs(la - lb)) AS d FROM l),
        k AS (SELECT *, la - CASE WHEN la > lb THEN d ELSE 0 END - (ex - d) // 2 AS ka,
                        lb - CASE WHEN lb > la THEN d ELSE 0 END - ((ex - d + 1) // 2) AS kb FROM m),
        r AS (SELECT conv_id, turn, ka, kb, list_concat([101], ids_a[1:ka], [102], ids_b[1:kb], [102]) AS r FROM k)
        SELECT conv_id, turn, md5(array_to_string(list_concat(r, list_transform(range(64 - len(r)), lambda i: 0)), ' ')) AS ids,
        len(r)::BIGINT AS n_real, (kb + 1)::BIGINT AS n_second FROM r""",
)
def t18(spark, d):
    pairs = encode.consecutive_pairs(turn_ids(spark, d), "conv_id", "turn", ["ids"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    return encode.encode_pair(pairs, "ids_a", "ids_b", ["conv_id", "turn"], 64).select(
        "conv_id", "turn", F.md5(joined("input_ids")).alias("ids"),
        total("attention_mask").alias("n_real"), total("token_type_ids").alias("n_second"),
    )


def pieces_vocab(spark, d):
    """Sub-word pieces from the corpus: every character, frequent starts and ends."""
    v = materialize(vocab(spark, d), "vocab")  # read four times below
    chars = F.explode(F.split(F.regexp_replace("term", "(?s)(.)", "$1\u0001"), "\u0001"))
    single = v.select(chars.alias("c")).where(F.length("c") == 1).distinct()
    starts = v.where(F.length("term") >= 3).groupBy(F.substring("term", 1, 3).alias("p")).count().where("count >= 5")
    ends = v.where(F.length("term") >= 4).groupBy(F.expr("right(term, 3)").alias("p")).count().where("count >= 5")
    pieces = (
        single.where("c <> 'q'").select(F.col("c").alias("piece"))
        .union(single.where("c <> 'z'").select(F.concat(F.lit("##"), "c")))
        .union(starts.select("p")).union(ends.select(F.concat(F.lit("##"), "p")))
        .distinct()
    )
    return materialize(pieces, "pieces")


@query(
    "t19_subword_tokens",
    f"""WITH RECURSIVE {VOCAB}, single AS (SELECT DISTINCT unnest(string_split(term, '')) AS c FROM vocab),
        pv AS (SELECT c AS piece FROM single WHERE c <> 'q' UNION SELECT '##' || c FROM single WHERE c <> 'z'
          UNION SELECT substr(term, 1, 3) FROM vocab WHERE length(term) >= 3 GROUP BY 1 HAVING count(*) >= 5
          UNION SELECT '##' || right(term, 3) FROM vocab WHERE length(term) >= 4 GROUP BY 1 HAVING count(*) >= 5),
        words AS (SELECT DISTINCT token AS word FROM tokens),
        step AS (SELECT word, 1 AS p0, '' AS pieces FROM words
          UNION ALL
          SELECT word, p0 + n, pieces || ' ' || p FROM (
            SELECT s.word, s.p0, s.pieces, v.p, v.n, row_number() OVER (PARTITION BY s.word ORDER BY v.n DESC) AS r FROM step s
            JOIN (SELECT piece AS p, replace(piece, '##', '') AS body, length(replace(piece, '##', '')) AS n,
                    starts_with(piece, '##') AS i FROM pv) v
              ON v.i = (s.p0 > 1) AND v.body = substr(s.word, s.p0, v.n) AND v.n <= length(s.word) - s.p0 + 1
            WHERE s.p0 <= length(s.word)) WHERE r = 1),
        done AS (SELECT word, trim(pieces) AS pieces FROM step WHERE p0 = length(word) + 1)
        SELECT word, coalesce(pieces, '[UNK]') AS pieces FROM words LEFT JOIN done USING (word)""",
)
def t19(spark, d):
    words = tokens.tokenize(docs(spark, d)).select(F.col("token").alias("word")).distinct()
    return encode.subword_tokens(words, pieces_vocab(spark, d)).select("word", F.array_join("pieces", " ").alias("pieces"))


@query(
    "t20_token_detail",
    f"""WITH {ENCODED}, z AS (SELECT doc_id, unnest(range(20))::INTEGER AS pos, unnest(input_ids[1:20]) AS token_id,
          unnest(attention_mask[1:20]) AS attention_mask, unnest(token_type_ids[1:20]) AS token_type_id FROM enc)
        SELECT doc_id, pos, token_id, attention_mask, token_type_id,
          CASE token_id WHEN 0 THEN '[PAD]' WHEN 100 THEN '[UNK]' WHEN 101 THEN '[CLS]' WHEN 102 THEN '[SEP]' ELSE term END AS token_text
        FROM z LEFT JOIN vocab ON token_id = term_id + 1000""",
)
def t20(spark, d):
    return encode.token_detail(encoded(spark, d), token_vocab(spark, d), ["doc_id"], 20)


@query(
    "t21_compare_tokenizers",
    r"""WITH s AS (SELECT lang, len(string_split(text, ' ')) AS space, len(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS cased,
          len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}')) AS uncased FROM documents)
        SELECT lang, count(*) AS n_docs, sum(space)::BIGINT AS space_tokens, sum(cased)::BIGINT AS cased_tokens, sum(uncased)::BIGINT AS uncased_tokens,
          round(avg(space), 6) AS space_mean, round(avg(cased), 6) AS cased_mean, round(avg(uncased), 6) AS uncased_mean FROM s GROUP BY 1""",
)
def t21(spark, d):
    out = tokens.compare_tokenizers(docs(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_mean")})


@query(
    "t22_align_tokens",
    f"""WITH {TURNS}, z AS (SELECT conv_id, turn, unnest(range(greatest(len(ids_a), len(ids_b))))::INTEGER AS pos, ids_a, ids_b FROM pairs)
        SELECT conv_id, turn, pos, coalesce(ids_a[pos + 1], 0)::INTEGER AS id_a, coalesce(ids_b[pos + 1], 0)::INTEGER AS id_b FROM z""",
)
def t22(spark, d):
    pairs = encode.consecutive_pairs(turn_ids(spark, d), "conv_id", "turn", ["ids"])
    return tokens.align_tokens(pairs, "ids_a", "ids_b", ["conv_id", "turn"])


@query(
    "t23_case_collisions",
    r"""WITH f AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS form FROM documents) GROUP BY 1)
        SELECT lower(form) AS word, count(*) AS n_forms, sum(n)::BIGINT AS n_tokens, string_agg(form, '|' ORDER BY form) AS forms
        FROM f GROUP BY 1 HAVING count(*) > 1""",
)
def t23(spark, d):
    return tokens.case_collisions(docs(spark, d))


@query(
    "t24_truncation_report",
    f"""WITH s AS (SELECT lang, len({WORDS}) AS n FROM documents), l AS (SELECT lang, n, greatest(n - 126, 0) AS lost FROM s)
        SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, sum(lost)::BIGINT AS lost_tokens,
        count(*) FILTER (lost > 0) AS cut_docs, round(count(*) FILTER (lost > 0) / count(*), 6) AS cut_share FROM l GROUP BY 1""",
)
def t24(spark, d):
    return tokens.truncation_report(docs(spark, d), 128).withColumn("cut_share", F.round("cut_share", 6))


def word_vectors(spark, d):
    """A vector file written from the embeddings, read back. A vector is named by the
    term with its number, or by the number itself where the vocabulary has no such term."""
    emb = tables.table(spark, d, "embeddings")
    terms = vocab(spark, d, cap=None).select("term_id", "term")
    named = emb.join(terms, F.col("term_id") == F.col("vec_id"), "left")
    named = named.withColumn("term", F.coalesce("term", F.concat(F.lit("vector_"), F.col("vec_id").cast("string"))))
    line = F.concat_ws(" ", "term", F.array_join(F.col("embedding").cast("array<string>"), " "))
    path = scratch_path(spark, "vectors")
    named.select(line.alias("value")).write.text(path)
    return tables.read_word_vectors(spark, path)


@query(
    "s13_read_word_vectors",
    f"""WITH {ALL_TERMS} SELECT coalesce(term, 'vector_' || vec_id) AS word, len(embedding)::BIGINT AS n_dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings LEFT JOIN vocab ON term_id = vec_id""",
)
def s13(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return word_vectors(spark, d).select(
        "word", F.size("vector").cast("long").alias("n_dims"),
        F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_value"), F.round(total, 5).alias("total"),
    )


@query(
    "t25_vector_coverage",
    f"""WITH {ALL_TERMS}, known AS (SELECT coalesce(term, 'vector_' || vec_id) AS term FROM embeddings LEFT JOIN vocab ON term_id = vec_id),
        lt AS (SELECT lang, token AS word, count(*) AS n FROM tokens JOIN documents USING (doc_id) GROUP BY 1, 2),
        f AS (SELECT lang, n, CASE WHEN k.term IS NULL THEN 0 ELSE 1 END AS found FROM lt LEFT JOIN known k ON k.term = lt.word)
        SELECT lang, sum(n)::BIGINT AS n_tokens, count(*) AS n_words, round(sum(n * found) / sum(n), 6) AS token_coverage,
        round(avg(found), 6) AS word_coverage FROM f GROUP BY 1""",
)
def t25(spark, d):
    out = tokens.vector_coverage(docs(spark, d), word_vectors(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("token_coverage", "word_coverage")})


# ---- encoded files --------------------------------------------------------

def labelled_encoded(spark, d):
    labels = tables.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return encoded(spark, d).join(labels, "doc_id", "left")


@query(
    "s5_write_encoded",
    f"""WITH {ENCODED} SELECT doc_id, md5(array_to_string(input_ids, ' ')) AS ids, list_sum(attention_mask)::BIGINT AS n_real, quality::BIGINT AS label
        FROM enc LEFT JOIN labels USING (doc_id)""",
)
def s5(spark, d):
    from lexmill.sources.encoded import write_encoded

    path = scratch_path(spark, "encoded")
    write_encoded(labelled_encoded(spark, d), path)
    return spark.read.parquet(path).select(
        "doc_id", F.md5(joined("input_ids")).alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n_real"), "label",
    )


@query(
    "s6_read_encoded",
    f"""WITH {ENCODED} SELECT doc_id, md5(array_to_string(input_ids, ' ')) AS ids, coalesce(quality, 0)::BIGINT AS label
        FROM enc LEFT JOIN labels USING (doc_id)""",
)
def s6(spark, d):
    from lexmill.sources.encoded import read_encoded, write_encoded

    path = scratch_path(spark, "encoded")
    write_encoded(labelled_encoded(spark, d), path)
    return read_encoded(spark, path).select("doc_id", F.md5(joined("input_ids")).alias("ids"), "label")


@query(
    "s7_round_trip",
    "SELECT count(*) AS rows_written, count(*) AS rows_read, 0::BIGINT AS only_written, 0::BIGINT AS only_read FROM documents",
)
def s7(spark, d):
    from lexmill.sources.encoded import read_encoded, round_trip, write_encoded

    path = scratch_path(spark, "encoded")
    rows = labelled_encoded(spark, d).withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))
    write_encoded(rows, path)
    return round_trip(rows, read_encoded(spark, path))


@query(
    "s8_write_instances",
    f"""WITH {ENCODED} SELECT '{{"attention_mask":[' || array_to_string(attention_mask, ',') || '],"input_ids":[' || array_to_string(input_ids, ',')
        || '],"token_type_ids":[' || array_to_string(token_type_ids, ',') || ']}}' AS value FROM enc""",
)
def s8(spark, d):
    from lexmill.sources.encoded import write_instances

    path = scratch_path(spark, "instances")
    write_instances(encoded(spark, d), path)
    return spark.read.text(path)
