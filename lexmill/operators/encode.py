"""Fixed-length encodings and sub-word tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.functions import sequences as sq
from lexmill.operators.tokens import to_ids

# Fixed names of the special tokens.
SPECIAL = {sq.PAD_ID: "[PAD]", sq.UNK_ID: "[UNK]", sq.CLS_ID: "[CLS]", sq.SEP_ID: "[SEP]"}


def encode_fixed(
    df: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", max_len: int = 128,
    max_features: int | None = None,
) -> DataFrame:
    """(keys, input_ids, attention_mask, token_type_ids) of length ``max_len``."""
    ids = to_ids(df, vocab, keys, text, sq.UNK_ID, max_len - 2, max_features)
    return ids.select(*keys, sq.encode_ids("ids", max_len).alias("e")).select(*keys, "e.*")


def consecutive_pairs(df: DataFrame, group: str, pos: str, cols: Sequence[str]) -> DataFrame:
    """Each row with its successor in the group, by an equi-join on the position."""
    first = df.select(group, pos, *[F.col(c).alias(f"{c}_a") for c in cols])
    second = df.select(group, (F.col(pos) - 1).alias(pos), *[F.col(c).alias(f"{c}_b") for c in cols])
    return first.join(second, [group, pos])


def encode_pair(df: DataFrame, a: str, b: str, keys: Sequence[str], max_len: int = 128) -> DataFrame:
    return df.select(*keys, sq.encode_pair_ids(a, b, max_len).alias("e")).select(*keys, "e.*")


def token_detail(encoded: DataFrame, vocab: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` positions of every example with id, mask, type and text."""
    zipped = F.arrays_zip(*[F.slice(c, 1, n).alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")])
    rows = encoded.select(*keys, F.posexplode(zipped).alias("pos", "_z")).select(
        *keys, "pos",
        F.col("_z.input_ids").alias("token_id"),
        F.col("_z.attention_mask").alias("attention_mask"),
        F.col("_z.token_type_ids").alias("token_type_id"),
    )
    special = F.lit(None).cast("string")
    for code, name in SPECIAL.items():
        special = F.when(F.col("token_id") == code, name).otherwise(special)
    # special tokens, most of all padding, are in no vocabulary: they are dealt by position
    dealt = F.when(special.isNull(), F.col("token_id").cast("bigint")).otherwise(-1 - F.pmod(F.xxhash64(*keys, "pos"), F.lit(1 << 30)))
    terms = vocab.select(F.col("token_id").cast("bigint").alias("_id"), "term")
    return rows.withColumn("_id", dealt).join(terms, "_id", "left").select(
        *keys, "pos", "token_id", "attention_mask", "token_type_id", F.coalesce(special, "term").alias("token_text")
    )


class PieceTrie:
    """Pieces as a trie: edges (node, character) -> node, and the length of the piece that
    ends at a node. First pieces and continuations have roots of their own."""

    FIRST, INNER = 0, 1

    def __init__(self, pieces: Iterable[str]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends = [False, False]
        for piece in pieces:
            inner = piece.startswith("##")
            body = piece[2:] if inner else piece
            node = self.INNER if inner else self.FIRST
            for c in body:
                node = self.edges.setdefault((node, c), len(self.ends))
                if node == len(self.ends):
                    self.ends.append(False)
            if body:
                self.ends[node] = True

    def longest(self, word: str, start: int) -> int:
        """Length of the longest piece at ``start``; 0 when there is none."""
        node, found, edges, ends = self.INNER if start else self.FIRST, 0, self.edges, self.ends
        for at in range(start, len(word)):
            node = edges.get((node, word[at]))
            if node is None:
                break
            if ends[node]:
                found = at + 1 - start
        return found

    def walk(self, word: str) -> list[str] | None:
        at, pieces = 0, []
        while at < len(word):
            size = self.longest(word, at)
            if not size:
                return None
            pieces.append(("##" if at else "") + word[at : at + size])
            at += size
        return pieces or None


def subword_tokens(words: DataFrame, vocab: DataFrame, max_chars: int | None = None, max_pieces: int = 200_000) -> DataFrame:
    """(word, pieces) by greedy longest match.

    ``words`` holds distinct words, ``vocab`` the pieces, continuations marked by '##'. The
    pieces travel with the tasks as a trie; ``max_pieces`` bounds and checks their number. A
    word is walked once, in time that grows with its length times that of the longest piece
    at most. A word with a gap, or longer than ``max_chars`` if that is given, is [UNK].
    """
    pieces = [r[0] for r in vocab.where("piece IS NOT NULL").select("piece").distinct().limit(max_pieces + 1).collect()]
    if len(pieces) > max_pieces:
        raise ValueError(f"more than {max_pieces} pieces; raise max_pieces if executors can hold them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(pieces)
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                fits = word is not None and (max_chars is None or len(word) <= max_chars)
                found.append((trie.walk(word) if fits else None) or ["[UNK]"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["word", "pieces"])

    return words.select("word").mapInArrow(run, "word string, pieces array<string>")
