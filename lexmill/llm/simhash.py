"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Distinct
fingerprints are dealt into shards by a vantage-point tree: a node sends a fingerprint
left when its Hamming distance to the vantage point is below the node's limit. A
fingerprint lives in one shard. By the triangle inequality two fingerprints within
``radius`` can fall on both sides of a limit only when the right one is closer than
``limit + radius``; such a one also visits the left side as a query. So every close pair
meets in exactly one shard, and the result does not depend on which vantage points were
drawn. Inside a shard the same split goes on until small buckets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.columns import passing_through
from lexmill.llm.components import connected
from lexmill.session import materialize

SEED = 42
#: The tree over shards is fitted on so many fingerprints and has so many leaves at most;
#: it is the only thing that travels with the tasks. Larger shards split again by themselves.
SAMPLE, MAX_LEAVES = 16_384, 8_192
LEAF, BUCKET = 2_048, 512


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text. ``bytes.lower`` and ``bytes.split`` touch ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter((b" ".join(words),))
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for low in range(0, count, 1 << 16):  # bounded memory for very long texts
        part = hashes[low : low + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp (bigint) for every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            *kept, texts = batch.columns
            found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*keep, F.col("text").cast("binary"))
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])
    return rows.mapInArrow(run, schema)


def _choose(points: np.ndarray, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """Vantage point and limit: a near-even split that few points have to cross."""
    rng = np.random.default_rng(seed)
    best = None
    for at in rng.choice(len(points), min(12, len(points)), replace=False):
        counts = np.bincount(np.bitwise_count(points ^ points[at]), minlength=66)
        below = np.concatenate([[0], np.cumsum(counts)])  # below[m]: distance under m
        for m in range(1, 65):
            left = below[m] / len(points)
            if 0.25 <= left <= 0.75:
                crossing = (below[min(65, m + radius)] - below[m]) / len(points)
                cost = crossing + abs(left - 0.5) * 0.5
                if best is None or cost < best[0]:
                    best = (cost, points[at], m)
    return best and (best[1], best[2])


def fit_tree(sample: np.ndarray, total: int, radius: int) -> list[tuple]:
    """Nodes (vantage, limit, left, right) or (None, leaf number); the root is first."""
    nodes: list[tuple] = [()]
    todo, leaves = [(0, sample, 1)], 0
    while todo:
        at, points, share = todo.pop(0)
        split = None
        if total * len(points) / max(1, len(sample)) > LEAF and len(points) >= 32 and len(todo) + leaves < MAX_LEAVES:
            split = _choose(points, radius, at)
        if split is None:
            nodes[at] = (None, leaves)
            leaves += 1
            continue
        vantage, limit = split
        near = np.bitwise_count(points ^ vantage) < limit
        nodes[at] = (vantage, limit, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[near], share), (len(nodes) + 1, points[~near], share)]
        nodes += [(), ()]
    return nodes


def sides(d: np.ndarray, home: np.ndarray, limit: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who goes left, who goes right, and who still lives where it goes to the left."""
    near = d < limit
    left = near | (d < limit + radius)
    right = np.where(home, ~near, d >= limit - radius)
    return left, right, home & near


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, index, home) for every shard that the points live in or must ask."""
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        if nodes[at][0] is None:
            out.append((nodes[at][1], idx, home))
            continue
        vantage, limit, low, high = nodes[at]
        left, right, stays = sides(np.bitwise_count(points[idx] ^ vantage).astype(np.int64), home, limit, radius)
        todo += [(low, idx[left], stays[left]), (high, idx[right], home[right])]
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_edges(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what lies within ``radius`` (resident-resident and
    query-resident): of each compared block only a spanning star per component."""
    found_a, found_b = [], []
    todo = [(np.arange(len(points)), home, 0)]
    while todo:
        idx, lives, depth = todo.pop()
        own = idx[lives]
        if not len(own):
            continue
        split = _choose(points[own], radius, depth) if len(own) > BUCKET and depth < 40 else None
        if split is not None:
            d = np.bitwise_count(points[idx] ^ split[0]).astype(np.int64)
            left, right, stays = sides(d, lives, split[1], radius)
            todo += [(idx[left], stays[left], depth + 1), (idx[right], lives[right], depth + 1)]
            continue
        for i in range(0, len(own), BUCKET):
            rows = own[i : i + BUCKET]
            for j in range(0, len(idx), BUCKET):
                cols = idx[j : j + BUCKET]
                r, c = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= radius)
                apart = rows[r] != cols[c]
                if apart.any():
                    names, back = np.unique(np.concatenate([rows[r][apart], cols[c][apart]]), return_inverse=True)
                    half = len(back) // 2
                    root = local_roots(len(names), back[:half], back[half:])
                    found_a.append(names[root != np.arange(len(names))])
                    found_b.append(names[root[root != np.arange(len(names))]])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    root = local_roots(len(points), a, b)
    moved = np.nonzero(root != np.arange(len(points)))[0]
    return moved, root[moved]


def near_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column ``fp``), as many as connect
    everything within ``radius`` and no more than one per fingerprint and shard."""
    total = prints.count()
    drawn = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    nodes = fit_tree(np.array([r[0] for r in drawn], np.int64).view(np.uint64), total, radius)

    def deal(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, idx, home in route(points, nodes, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), leaf, np.int32)), pa.array(points[idx].view(np.int64)), pa.array(home)],
                    names=["leaf", "fp", "home"],
                )

    def compare(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        a, b = near_edges(points, home, radius)
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    dealt = prints.select("fp").mapInArrow(deal, "leaf int, fp bigint, home boolean")
    return dealt.groupBy("leaf").applyInArrow(compare, "a bigint, b bigint")


def _rooted(prints: DataFrame, low: Column, radius: int) -> DataFrame:
    """(fp, low, root) of each distinct fingerprint, ``low`` aggregated over its rows."""
    distinct = materialize(prints.groupBy("fp").agg(low.alias("low")), "distinct")
    roots = connected(near_fingerprints(distinct, radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of ``radius`` or fewer
    differing bits. Empty, blank and null texts have fingerprint zero and link like any
    other. Rows with a null doc_id take part and get the group's smallest id (null if the
    group has none). Repeated rows stay repeated; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    named = _rooted(prints, F.min("doc_id"), radius)
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Which document a row is: ids first, then a 128-bit digest of the text. None is ever null.
_KEY = ["_unnamed", "_id", "_h1", "_h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.withColumns(
        {"_unnamed": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)).cast("bigint"), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(7), text)}
    )


@passing_through("doc_id", "text")
def one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of ``simhash_groups``.

    It is a row with the smallest (doc_id, text digest), null ids last, so a row without
    id stays only where its group has no ids. Of rows with equal id and text the one
    whose other columns come first as JSON stays. Repeated rows are reduced before they are
    exchanged, so a document that is repeated many times does not fill one task.
    """
    prints = materialize(fingerprints(_keyed(docs), shingle, tuple(_KEY)), "prints")
    named = _rooted(prints, F.min(F.struct(*_KEY)), radius)
    stays = named.groupBy("root").agg(F.min("low").alias("low")).select("low.*")
    order = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    row = F.min_by(F.struct(*docs.columns), order).alias("_row")
    # an inner join, which does not move below the aggregate as a semi-join would
    return _keyed(docs).groupBy(*_KEY).agg(row).join(stays, _KEY).select("_row.*")
