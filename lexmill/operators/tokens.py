"""Tokens, vocabularies and term weights as long tables.

Texts are exchanged once on the document key, before they are taken apart: raw text
is the smallest form, long documents spread out, and every later step of a document
(counts, weights, norms, scores) runs on that partitioning without another shuffle.
Spark reuses the exchange when two branches need the same texts. Taken apart, a text is
some twenty times as large, so the number of tasks follows the bytes of text (``spread``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions import text as tx
from lexmill.functions.joins import hinted
from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


#: Bytes of text that one task takes apart. It holds their words twice while it counts them.
TASK_BYTES = 6 << 20


def spread(df: DataFrame, keys: Sequence[str], text: str = "text", forms: int = 1) -> DataFrame:
    """``df`` dealt by key to as many tasks as its text needs, at least the usual number;
    ``forms`` is how often each word returns in what is made of it. The sizes are read first,
    since an exchange of a fixed number of tasks, or one sized by the raw text, gives each
    task more words to hold as the table grows."""
    if df.isStreaming:
        return df.repartition(*keys)
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, math.ceil(size * forms / TASK_BYTES)), *keys)


def each(df: DataFrame, keys: Sequence[str], words: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per word. The outer form is used because the inner one makes the
    optimizer compute the words a second time, to filter out empty documents before
    the exchange; the null row of an empty document is dropped afterwards."""
    out = F.posexplode_outer(words).alias(pos, name) if pos else F.explode_outer(words).alias(name)
    return df.select(*keys, out).where(F.col(name).isNotNull())


def document_words(df: DataFrame, key: str = "doc_id", text: str = "text", forms: int = 1) -> DataFrame:
    """(key, words)."""
    return spread(df.select(key, text), [key], text, forms).select(key, tx.words(text).alias("words"))


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token)."""
    return each(spread(df.select(key, text), [key], text), [key], tx.words(text), "token", "pos")


def term_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) from documents."""
    exploded = each(document_words(df, key, text), [key], F.col("words"), "term")
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def ngram_counts(df: DataFrame, low: int = 1, high: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) where terms are word n-grams."""
    grams = tx.word_ngrams("words", low, high)
    forms = (high * (high + 1) - low * (low - 1)) // 2  # words of all grams that end at a word
    exploded = each(document_words(df, key, text, forms), [key], grams, "term")
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


# ---- vocabulary -----------------------------------------------------------

def _limit(value: float | int, n_docs: Column) -> Column:
    """A share of the documents when float, a count when int; 1.0 as a lower limit
    is the count 1 and as an upper limit all documents."""
    return F.lit(value) if isinstance(value, int) else F.lit(value) * n_docs


def build_vocab(
    counts: DataFrame,
    n_docs: Column,
    min_df: float | int = 1,
    max_df: float | int = 1.0,
    max_features: int | None = 10_000,
) -> DataFrame:
    """(term, term_id, df, tf). Terms between both document limits; of those the
    ``max_features`` most frequent, ties by term; ids in alphabetical order."""
    low = 1 if min_df == 1.0 else min_df
    terms = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        .where((F.col("df") >= _limit(low, n_docs)) & (F.col("df") <= _limit(max_df, n_docs)))
    )
    if max_features is None:
        out = ordered_scan(materialize(terms, "terms"), [], ["term"], {"_n": ("row_number",)})
        return out.select("term", (F.col("_n") - 1).cast("int").alias("term_id"), "df", "tf")
    # at most max_features rows reach this window
    top = terms.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), "df", "tf")


def idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """Vocabulary with the smooth inverse document frequency."""
    return vocab.withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)


def tfidf(
    counts: DataFrame, weights: DataFrame, norm: str | None = "l2", key: str = "doc_id", max_features: int | None = None
) -> DataFrame:
    """(key, term, tf, weight); terms outside the vocabulary are dropped. ``max_features``
    is the cap that ``weights`` was built with; without it nothing is broadcast by hint."""
    raw = counts.join(hinted(weights.select("term", "idf"), max_features), "term").withColumn(
        "weight", F.col("tf") * F.col("idf")
    )
    if norm not in (None, "None"):
        doc = Window.partitionBy(key)  # the terms of one document
        size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(doc)) if norm == "l2" else F.sum(F.abs("weight")).over(doc)
        raw = raw.withColumn("weight", F.col("weight") / size)
    return raw.select(key, "term", "tf", "weight")


def transform_features(
    df: DataFrame, weights: DataFrame, norm: str | None = "l2", key: str = "doc_id", text: str = "text", max_features: int | None = None
) -> DataFrame:
    """Weights of unseen texts under a fitted vocabulary."""
    return tfidf(term_counts(df, key, text), weights, norm, key, max_features)


# ---- reports --------------------------------------------------------------

def extremes(df: DataFrame, col: str, k_top: int, k_bottom: int, tie: str = "term") -> DataFrame:
    """The largest and smallest rows by ``col``, with their rank."""
    def side(name: str, order: Column, k: int) -> DataFrame:
        # at most k rows reach the window
        w = Window.orderBy(order, F.asc(tie))
        return df.orderBy(order, F.asc(tie)).limit(k).select(
            F.lit(name).alias("side"), F.row_number().over(w).alias("rank"), tie, col
        )

    return side("top", F.desc(col), k_top).unionByName(side("bottom", F.asc(col), k_bottom))


def term_totals(counts: DataFrame, k_top: int = 20, k_bottom: int = 20) -> DataFrame:
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"))
    return extremes(totals, "total", k_top, k_bottom)


def mean_tfidf(weights: DataFrame, n_docs: Column, k: int = 20) -> DataFrame:
    """Mean weight per term over all documents; absent terms count as zero."""
    means = weights.groupBy("term").agg((F.sum("weight") / n_docs).alias("mean_weight"))
    return extremes(means, "mean_weight", k, k)


def idf_extremes(weights: DataFrame, k: int = 20) -> DataFrame:
    return extremes(weights, "idf", k, k)


def vocab_report(vocab: DataFrame) -> DataFrame:
    """One row: size, longest and shortest word, first and last word by index, most
    and least frequent word. Ties go to the alphabetically first word."""
    n = F.length("term")
    return vocab.agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct((-n).alias("n"), "term")).getField("term").alias("longest"),
        F.min(F.struct(n.alias("n"), "term")).getField("term").alias("shortest"),
        F.min_by("term", "term_id").alias("first_by_index"),
        F.max_by("term", "term_id").alias("last_by_index"),
        F.min(F.struct((-F.col("tf")).alias("n"), "term")).getField("term").alias("most_frequent"),
        F.min(F.struct(F.col("tf").alias("n"), "term")).getField("term").alias("least_frequent"),
    )


# ---- frequency-ranked index -----------------------------------------------

def _ranked_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n, neg_n, first_key, first_pos)."""
    exploded = each(spread(df.select(key, text), [key], text), [key], tx.index_words(text), "word", "pos")
    first = F.min(F.struct(F.col(key).alias("k"), F.col("pos").alias("p")))
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select(
        "word", "n", (-F.col("n")).alias("neg_n"), F.col("f.k").alias("first_key"), F.col("f.p").alias("first_pos")
    )


def word_index(df: DataFrame, key: str = "doc_id", text: str = "text", num_words: int | None = None) -> DataFrame:
    """(word, idx, n): 1 is the most frequent word, ties by first appearance. With
    ``num_words`` only ids below it are computed."""
    ranked = _ranked_words(df, key, text)
    order = ["neg_n", "first_key", "first_pos"]
    if num_words is not None:
        top = ranked.orderBy(*order).limit(num_words - 1)  # bounds the window below
        return top.select("word", F.row_number().over(Window.orderBy(*order)).alias("idx"), "n")
    out = ordered_scan(materialize(ranked, "words"), [], order, {"idx": ("row_number",)})
    return out.select("word", F.col("idx").cast("int").alias("idx"), "n")


def _gather(exploded: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ids of each document in text order; documents without ids get an empty array."""
    packed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("pos", F.col(value).alias("id")))))
    return exploded.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.col("_p.id").cast("array<int>").alias("ids"))


def to_sequences(df: DataFrame, index: DataFrame, num_words: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids below ``num_words`` in text order, other words dropped."""
    small = index.where(F.col("idx") < num_words).select("word", "idx")
    exploded = (
        spread(df.select(key, text), [key], text)
        .select(key, F.posexplode_outer(tx.index_words(text)).alias("pos", "word"))
    )
    return _gather(exploded.join(hinted(small, num_words), "word", "left"), [key], "idx")


def to_ids(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    unk_id: int = 100,
    first: int | None = None,
    max_features: int | None = None,
) -> DataFrame:
    """(keys, ids) under a (term, token_id) table; unknown words get ``unk_id``.
    ``first`` keeps only as many words as a fixed-length encoding can hold."""
    words = tx.words(text)
    words = F.slice(words, 1, first) if first is not None else words
    exploded = (
        spread(df.select(*keys, text), keys, text)
        .select(*keys, F.posexplode_outer(words).alias("pos", "term"))
    )
    coded = exploded.join(hinted(vocab.select("term", "token_id"), max_features), "term", "left").withColumn(
        "token_id", F.when(F.col("term").isNotNull(), F.coalesce("token_id", F.lit(unk_id)))
    )
    return _gather(coded, keys, "token_id")


# ---- comparisons ----------------------------------------------------------

def compare_tokenizers(df: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """Tokens per group under three schemes, in one pass."""
    plain = tx.strip_accents(F.lower(F.col(text)))
    sizes = df.select(
        by,
        tx.word_count(text).alias("space"),
        F.size(tx.cased_words(text)).alias("cased"),
        F.size(F.regexp_extract_all(plain, F.lit(tx.WORD_PATTERN), F.lit(0))).alias("uncased"),
    )
    return sizes.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(c).alias(f"{c}_tokens") for c in ("space", "cased", "uncased")],
        *[F.avg(c).alias(f"{c}_mean") for c in ("space", "cased", "uncased")],
    )


def align_tokens(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, id_a, id_b), zero where the shorter sequence has ended."""
    zipped = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    return df.select(*keys, F.posexplode(zipped).alias("pos", "_z")).select(
        *keys, "pos",
        F.coalesce(F.col("_z").getField("x"), F.lit(0)).alias("id_a"),
        F.coalesce(F.col("_z").getField("y"), F.lit(0)).alias("id_b"),
    )


def case_collisions(df: DataFrame, text: str = "text") -> DataFrame:
    """Lower-case words that several cased forms share, with those forms."""
    forms = each(df, [], tx.cased_words(text), "form").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return (
        forms.groupBy(F.lower("form").alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n_forms"),
            F.sum("n").alias("n_tokens"),
            F.array_join(F.array_sort(F.collect_list("form")), "|").alias("forms"),
        )
        .where("n_forms > 1")
    )


def truncation_report(df: DataFrame, max_len: int = 128, by: str = "lang", text: str = "text") -> DataFrame:
    """Tokens and documents that a length limit (with two special tokens) cuts."""
    n = F.size(tx.words(text))
    lost = F.greatest(n - (max_len - 2), F.lit(0))
    sized = df.select(by, n.alias("n"), lost.alias("lost"))
    return sized.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n").alias("n_tokens"),
        F.sum("lost").alias("lost_tokens"),
        F.count_if(F.col("lost") > 0).alias("cut_docs"),
        (F.count_if(F.col("lost") > 0) / F.count(F.lit(1))).alias("cut_share"),
    )


def vector_coverage(df: DataFrame, vectors: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """Share of tokens and of distinct words that have a vector. Words are counted
    first, so the join sees each (group, word) once."""
    counted = each(df, [by], tx.words(text), "word").groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    known = vectors.select("word", F.lit(1).alias("found"))
    joined = counted.join(known, "word", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.groupBy(by).agg(
        F.sum("n").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_words"),
        (F.sum(F.col("n") * F.col("found")) / F.sum("n")).alias("token_coverage"),
        F.avg("found").alias("word_coverage"),
    )
