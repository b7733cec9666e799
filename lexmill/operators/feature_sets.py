"""TF-IDF features of many training sets from one count table.

Every training set (a fold's rest, a prefix of a learning curve) has a vocabulary and an
inverse document frequency of its own, fitted on its documents alone. Document frequencies
and totals of all sets are columns of one grouping by term; the limits and the largest
vocabularies are decided from those. No text is tokenized again, and no row is copied per set.

A row of counts never meets its numbers of all sets in an exchange or on disk, where they
would be as wide as the sets are many: weights stay factors (``Features``), a number per term
and set and a number per document and set. Sums over them are taken in blocks of documents;
to a block go its counts and one row per distinct term.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


#: Rows of counts in a block.
BLOCK_ROWS = 1 << 19


@dataclass(frozen=True)
class FeatureSet:
    """``member``: which of the training sets it is fitted on; limits as in a vocabulary:
    a share of the training documents when float, a count when int."""

    member: int
    min_df: float | int = 1
    max_df: float | int = 1.0
    max_features: int | None = None
    norm: str | None = "l2"

    def limits(self, n: int) -> tuple[float, float]:
        low = 1 if self.min_df == 1.0 else self.min_df
        low, high = (v if isinstance(v, int) else v * n for v in (low, self.max_df))
        return max(low, 1), high


def _most_frequent(stats: DataFrame, sets: Sequence[FeatureSet], fits: Sequence[Column]) -> tuple[list[Column], DataFrame | None]:
    """Conditions that keep each set's ``max_features`` most frequent terms, ties by term, and
    (term, tied) with the sets that keep a term of their smallest total.

    The terms per total are counted and summed from the top, for all sets at once; that gives
    one total per set from which on terms stay, and how many of the terms with just that total
    do. Only these are ranked by name.
    """
    capped = [i for i, s in enumerate(sets) if s.max_features is not None]
    if not capped:
        return list(fits), None
    cells = [F.struct(F.lit(i).alias("s"), F.col(f"tf{sets[i].member}").alias("tf"), fits[i].alias("ok")) for i in capped]
    flat = stats.select("term", F.explode(F.array(*cells)).alias("c")).where("c.ok").select("term", "c.s", "c.tf")
    totals = materialize(flat.groupBy("s", "tf").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("tf")), "totals")
    upto = ordered_scan(totals, ["s"], ["down"], {"upto": ("sum", "n")})
    caps = F.get(F.array(*(F.lit(s.max_features) for s in sets)), F.col("s"))
    cut = upto.where(F.col("upto") >= caps).groupBy("s").agg(F.min(F.struct("down", "upto", "n")).alias("m"))
    cuts = {r["s"]: r["m"] for r in cut.collect()}  # one row per set
    out = list(fits)
    ties = None
    for i, m in cuts.items():
        tf = F.col(f"tf{sets[i].member}")
        wanted = sets[i].max_features - (m["upto"] - m["n"])
        if wanted == m["n"]:
            out[i] = fits[i] & (tf >= -m["down"])
            continue
        out[i] = fits[i] & ((tf > -m["down"]) | ((tf == -m["down"]) & F.array_contains("tied", i)))
        part = flat.where((F.col("s") == i) & (F.col("tf") == -m["down"])).select("s", "term", F.lit(wanted).alias("wanted"))
        ties = part if ties is None else ties.unionByName(part)
    if ties is not None:
        ranked = ordered_scan(materialize(ties, "ties"), ["s"], ["term"], {"r": ("row_number",)}).where("r <= wanted")
        ties = ranked.groupBy("term").agg(F.collect_list("s").alias("tied"))
    return out, ties


def _vocabulary(counts: DataFrame, docs: DataFrame, members: Sequence[Column], sets: Sequence[FeatureSet], key: str) -> DataFrame:
    """(term, idf): one number per feature set, null where the term is not in its vocabulary."""
    rows = counts.select(key, "term", "tf").join(docs, key)
    held = [(F.count_if(m).alias(f"df{i}"), F.coalesce(F.sum(F.when(m, F.col("tf"))), F.lit(0)).alias(f"tf{i}")) for i, m in enumerate(members)]
    stats = materialize(rows.groupBy("term").agg(*(c for pair in held for c in pair)), "stats")
    sizes = docs.agg(*(F.count_if(m) for m in members)).first()  # one number per training set
    fits = []
    for s in sets:
        low, high = s.limits(sizes[s.member])
        fits.append((F.col(f"df{s.member}") >= F.lit(low)) & (F.col(f"df{s.member}") <= F.lit(high)))
    kept, ties = _most_frequent(stats, sets, fits)
    found = stats
    if ties is not None:
        found = stats.join(ties, "term", "left").withColumn("tied", F.coalesce("tied", F.array().cast("array<int>")))
    idf = [F.when(k, F.log(F.lit(sizes[s.member] + 1.0) / (F.col(f"df{s.member}") + 1)) + 1) for s, k in zip(sets, kept)]
    vocab = found.select("term", F.array(*idf).alias("idf")).where(F.exists("idf", lambda x: x.isNotNull()))
    return materialize(vocab, "vocab")


@dataclass(frozen=True)
class Features:
    """Weights of many sets as factors: ``counts`` (block, key, term, tf), ``idf`` (term, idf)
    and ``lengths`` (key, length) with one number per set; a weight is tf * idf / length."""

    counts: DataFrame
    idf: DataFrame
    lengths: DataFrame
    key: str = "doc_id"

    def per_document(self, values: DataFrame, powers: Sequence[int]) -> DataFrame:
        """(key, sums): over the document's terms, tf to its power times ``values`` (term, v)."""
        needed = self.counts.select("block", "term").distinct().join(values, "term")
        return _block_sums(self.counts, needed, "term", self.key, powers)

    def per_term(self, values: DataFrame, width: int) -> DataFrame:
        """(term, sums): over the term's documents, tf times ``values`` (block, key, v)."""
        parts = _block_sums(self.counts, values, self.key, "term", [1] * width)
        return parts.groupBy("term").agg(F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))


def _block_sums(counts: DataFrame, values: DataFrame, on: str, by: str, powers: Sequence[int]) -> DataFrame:
    """(by, sums) of every block: tf to the power of its column times the ``v`` that the row
    finds under ``on``; rows that find none add nothing."""
    width = len(powers)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        groups = rows[by].combine_chunks().dictionary_encode()
        place = pc.index_in(rows[on], value_set=found["_on"].combine_chunks())
        known = place.is_valid().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy()[known]
        at = groups.indices.to_numpy()[known]
        tf = rows["tf"].to_numpy().astype(np.float64)[known]
        sums = np.zeros((len(groups.dictionary), width))
        if len(at):
            lists = found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for j, power in enumerate(powers):
                sums[:, j] = np.bincount(at, lists[:, j][place] * tf**power, len(sums))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        return pa.Table.from_arrays([groups.dictionary, lists], names=[by, "sums"])

    kind = counts.schema[by].dataType.simpleString()
    # both sides stem from ``counts``: new names keep them apart
    left = counts.select(F.col("block").alias("_b"), on, by, "tf").groupBy("_b")
    right = values.select(F.col("block").alias("_c"), F.col(on).alias("_on"), "v").groupBy("_c")
    return left.cogroup(right).applyInArrow(run, f"{by} {kind}, sums array<double>")


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def fit_features(
    counts: DataFrame, docs: DataFrame, members: Sequence[Column], sets: Sequence[FeatureSet], key: str = "doc_id"
) -> Features:
    """The features of ``feature_weights`` as factors. ``counts`` is read several times: pass
    a stored table."""
    vocab = _vocabulary(counts, docs, members, sets, key)
    rows = counts.where(F.col(key).isNotNull()).select(key, "term", F.col("tf").cast("long").alias("tf"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("block", block_of(key, blocks))
    found = Features(dealt, vocab, rows, key)
    squared = [s.norm == "l2" for s in sets]
    size = [F.coalesce(F.pow(x, F.lit(2)) if sq else F.abs(x), F.lit(0.0)) for sq, x in zip(squared, (F.get("idf", F.lit(i)) for i in range(len(sets))))]
    sums = found.per_document(vocab.select("term", F.array(*size).alias("v")), [2 if sq else 1 for sq in squared])
    length = [
        F.lit(1.0) if s.norm in (None, "None") else (F.sqrt(x) if sq else x)
        for s, sq, x in zip(sets, squared, (F.get("sums", F.lit(i)) for i in range(len(sets))))
    ]
    lengths = materialize(sums.select(key, F.array(*length).alias("length")), "lengths")
    return Features(dealt, vocab, lengths, key)


def feature_weights(counts: DataFrame, docs: DataFrame, members: Sequence[Column], sets: Sequence[FeatureSet], key: str = "doc_id") -> DataFrame:
    """(key, term, weight): ``weight`` has one number per feature set, null where the term is
    not in the set's vocabulary. ``counts``: (key, term, tf); ``members``: conditions on the
    columns of ``docs``, one row per key. All documents get weights, in the set or not."""
    vocab = _vocabulary(counts, docs, members, sets, key)
    raw = counts.select(key, "term", "tf").join(vocab, "term").select(key, "term", F.transform("idf", lambda x: x * F.col("tf")).alias("raw"))
    doc = Window.partitionBy(key)  # the terms of one document
    lengths = []
    for i, s in enumerate(sets):
        value = F.get("raw", F.lit(i))
        if s.norm in (None, "None"):
            lengths.append(F.lit(1.0))
        else:
            lengths.append(F.sqrt(F.sum(value * value).over(doc)) if s.norm == "l2" else F.sum(F.abs(value)).over(doc))
    sized = raw.withColumn("length", F.array(*lengths))
    return sized.select(key, "term", F.zip_with("raw", "length", lambda a, b: a / b).alias("weight"))
