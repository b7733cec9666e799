"""K-d tree sharding with DataFrame operations only.

Equal texts form a group that stays in one shard. Groups are points in a space of
metadata; a tree node takes the dimension whose extent, relative to the extent over all
groups, is largest, and is cut at the weighted median of that dimension, ties broken by
the text digest. All nodes of a level are cut at once: a running sum of bytes per node,
taken per (node, range) so that no node is one task, tells each group its side. The
depth grows with the logarithm of the number of shards; only their number is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize

#: Metadata dimensions, first one first when extents are equal.
DIMENSIONS = ("_size", "_source", "_lang", "_id")


def _coded(groups: DataFrame, c: str) -> DataFrame:
    """``groups`` with the column as a number: the place of its value among the distinct
    values in code-point order, null first. Every value has a place of its own."""
    values = materialize(groups.select(c).distinct(), "values")
    placed = ordered_scan(values, [], [c], {"_place": ("row_number",)}).withColumnRenamed(c, "_value")
    met = groups.join(placed, F.col(c) == F.col("_value"))
    return met.drop(c, "_value").withColumnRenamed("_place", c)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.md5(text.cast("binary")).alias("_text"),
        *(F.struct(F.col(c).isNotNull().alias("has"), F.coalesce(c, F.lit("")).alias("v")).alias(f"_{c}") for c in ("source", "lang")),
        F.coalesce("doc_id", F.lit(-1)).alias("_id"),
    )


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (int), slot (bigint).

    ``size`` is the UTF-8 bytes of the text plus 1; a null text is equal to an empty one.
    Shards are as near to equal in bytes as whole groups of equal texts allow. ``slot``
    counts a shard's documents from 0 by (doc_id, nulls last, digest). Repeated rows take
    a slot each; other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(_rows(docs), "sizes")
    least = [F.min(c).alias(c) for c in ("_source", "_lang", "_id")]
    groups = rows.groupBy("_text").agg(F.sum("_size").alias("_weight"), F.first("_size").alias("_size"), *least)
    # struct minima order as the values do, null first; the distinct values are few
    groups = _coded(_coded(materialize(groups, "groups"), "_source"), "_lang").select("_text", "_weight", *DIMENSIONS)
    nodes = materialize(groups.withColumns({"_node": F.lit(0), "_leaves": F.lit(shards), "_first": F.lit(0)}), "groups")
    whole = nodes.agg(F.struct(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in DIMENSIONS])).scalar()
    for _ in range((shards - 1).bit_length()):
        spread = [(F.max(c) - F.min(c)).cast("double").alias(f"_own{c}") for c in DIMENSIONS]
        # one row per tree node, never more than there are shards
        stats = nodes.groupBy("_node").agg(F.sum("_weight").alias("_total"), *spread)
        widths = [F.coalesce(F.try_divide(F.col(f"_own{c}"), whole.getField(c)), F.lit(0.0)) for c in DIMENSIONS]
        axis = (F.array_position(F.array(*widths), F.greatest(*widths)) - 1).cast("int")
        stats = stats.select("_node", "_total", axis.alias("_axis"))
        placed = nodes.join(F.broadcast(stats), "_node").withColumn("_v", F.get(F.array(*DIMENSIONS), F.col("_axis")))
        placed = materialize(placed, "nodes")
        scanned = ordered_scan(placed, ["_node"], ["_v", "_text"], {"_upto": ("sum", "_weight")})
        low = F.floor(F.col("_leaves") / 2).cast("int")
        left = (2 * F.col("_upto") - F.col("_weight")) * F.col("_leaves") < 2 * F.col("_total") * low
        nodes = scanned.withColumn("_left", left & (F.col("_leaves") > 1)).select(
            "_text",
            "_weight",
            *DIMENSIONS,
            F.when(F.col("_leaves") == 1, F.col("_first")).when(F.col("_left"), F.col("_first")).otherwise(F.col("_first") + low).alias("_first"),
            F.when(F.col("_leaves") == 1, 1).when(F.col("_left"), low).otherwise(F.col("_leaves") - low).cast("int").alias("_leaves"),
        )
        nodes = materialize(nodes.withColumn("_node", F.col("_first")), "nodes")
    owned = rows.join(nodes.select("_text", F.col("_first").alias("shard")), "_text")
    owned = materialize(owned.withColumn("_order", F.coalesce("doc_id", F.lit(2**63 - 1))).select("doc_id", "_size", "_crc", "_text", "_order", "shard"), "owned")
    numbered = ordered_scan(owned, ["shard"], ["_order", "_text"], {"_slot": ("row_number",)})
    return numbered.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_slot") - 1).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write whole documents to one folder per shard."""
    own = kd_shards(docs, shards).select("doc_id", "text_crc32", "size", "shard").distinct()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_crc": F.crc32(text.cast("binary")), "_size": (F.octet_length(text) + 1).cast("long")})
    same = keyed["doc_id"].eqNullSafe(own["doc_id"]) & (keyed["_crc"] == own["text_crc32"]) & (keyed["_size"] == own["size"])
    rows = keyed.join(own, same).select(*[keyed[c] for c in docs.columns], own["shard"].alias("_shard"))
    rows.write.partitionBy("_shard").parquet(path)
