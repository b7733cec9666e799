"""Exact near-duplicate embeddings by dual traversal of cover trees.

Vectors of one label are compared on the unit sphere, where a cosine of ``c`` or more is
a distance of ``sqrt(2 - 2c)`` or less. Identical vectors are one point with a count. The
points of a label are dealt into blocks around pivots; every block gets a cover tree:
nested levels of centres whose radii halve, each node with its true covering radius. Blocks
stand in an order that keeps near pivots together, and nodes over 16 neighbours each, with
covering radii of their own, make a tree over them up to one root per label. Pairs of its
nodes are pruned when their centres are farther apart than both radii and the limit
together; this descent goes level by level from the root, as joins of the pairs that are
left with their children, and ends at teams of 16 blocks. Two teams meet in a task, which
goes on inside the same way: pairs of blocks, then of nodes of their trees, and what is
left at the points is compared exactly. A block travels to the teams it may have links
with and not to their single blocks. A meeting returns a count of links and a spanning star
per point, never the pairs.

A block that is larger than its share only costs time. Vectors without any structure
leave little to prune: then the work above the leaves grows with the square of the number
of distinct clusters of a label, spread over team pairs.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.llm.components import connected
from lexmill.llm.simhash import local_roots
from lexmill.session import materialize

THRESHOLD = 0.93
#: Points of a block; pivots, drawn from all labels by hash, that shape the blocks.
BLOCK, PIVOTS = 512, 512
#: Blocks of a team and children of a node above it.
TEAM = 16
RADII = (1.0, 0.5, 0.25, 0.125)


def build_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Order of the points, levels of (centre, covering radius, parent), and each ordered
    point's node on the last level. ``x`` holds unit vectors; centres are places in the
    order. The first level is the root."""
    n = len(x)
    groups = [np.arange(n)]
    found = [(np.array([0]), np.zeros(1, np.int64))]
    for radius in RADII:
        below, centres, parents = [], [], []
        for g, points in enumerate(groups):
            rest = points
            while len(rest):  # the parent's centre comes first: levels are nested
                near = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[rest[0]]))) <= radius
                near[0] = True
                below.append(rest[near])
                centres.append(rest[0])
                parents.append(g)
                rest = rest[~near]
        groups = below
        found.append((np.array(centres), np.array(parents)))
    order = np.concatenate(groups)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    node = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    levels, own = [], node
    for centres, parents in reversed(found):
        far = np.zeros(len(centres))
        np.maximum.at(far, own, np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x[order], x[centres[own]]))))
        levels.append((place[centres], far, parents))
        own = parents[own]
    return order, levels[::-1], node


def dual_links(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs with a cosine of ``threshold`` or more."""
    limit = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    alive = np.ones((1, 1), bool)
    for (ca, ra, pa_), (cb, rb, pb) in zip(a["levels"], b["levels"]):
        alive = alive[pa_][:, pb]
        i, j = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
        if not len(i):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (a["unit"][ca[i]] @ b["unit"][cb[j]].T)))
        alive[np.ix_(i, j)] &= apart <= ra[i][:, None] + rb[j][None, :] + limit
    alive = alive[a["node"]][:, b["node"]]
    i, j = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cosine = (a["raw"][i] @ b["raw"][j].T) / (a["norm"][i][:, None] * b["norm"][j][None, :])
    r, c = np.nonzero(alive[np.ix_(i, j)] & (cosine >= threshold))
    return i[r], j[c]


def _save(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict:
    z = np.load(io.BytesIO(data))
    raw = z["x"].astype(np.float64)
    norm = np.linalg.norm(raw, axis=1)
    out = {"raw": raw, "norm": norm, "unit": raw / norm[:, None], "rep": z["rep"], "copies": z["copies"], "node": z["node"]}
    out["levels"] = [(z[f"c{k}"], z[f"r{k}"], z[f"p{k}"]) for k in range(len(RADII) + 1)]
    return out


def _build(table: pa.Table) -> pa.Table:
    x = np.array(table.column("embedding").to_pylist(), np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    order, levels, node = build_tree(unit)
    parts = {f"{n}{k}": v for k, level in enumerate(levels) for n, v in zip("crp", level)}
    data = _save(
        x=x[order], node=node, rep=table.column("rep").to_numpy()[order], copies=table.column("copies").to_numpy()[order], **parts
    )
    centre, radius = unit[order][levels[0][0][0]], levels[0][1][0]
    one = {"label": table.column("label")[:1], "block": table.column("block")[:1], "place": pa.array([min(table.column("cell").to_pylist())], pa.int64())}
    return pa.table(one | {"centre": pa.array([centre.tolist()]), "radius": pa.array([float(radius)]), "data": pa.array([data], pa.binary())})


def coherent(x: np.ndarray) -> np.ndarray:
    """An order of unit vectors in which neighbours are near: halves around two far ones, again
    and again."""
    out: list[int] = []
    stack = [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= 2:
            out += own.tolist()
            continue
        one = own[(x[own] @ x[own[0]]).argmin()]
        two = own[(x[own] @ x[one]).argmin()]
        side = x[own] @ (x[one] - x[two])
        order = np.argsort(-side, kind="stable")
        stack += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return np.array(out, np.int64)


def _points(vectors: DataFrame) -> DataFrame:
    """(label, embedding, low, copies, rep, h1, h2): one row per label and distinct vector."""
    e = F.col("embedding")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    good = vectors.where(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    return materialize(rows.withColumn("rep", F.monotonically_increasing_id()), "points")  # numbers hold once written


def _blocks(points: DataFrame) -> DataFrame:
    """One row per block: label, block, place, centre, radius, data."""
    drawn = points.orderBy(F.xxhash64("embedding"), "rep").limit(PIVOTS).select("embedding").collect()
    sizes: dict[int, list] = {}
    for r in drawn:
        sizes.setdefault(len(r[0]), []).append(r[0])
    pivots = {k: np.array(v, np.float64) for k, v in sizes.items()}
    pivots = {k: v / np.linalg.norm(v, axis=1)[:, None] for k, v in pivots.items()}
    pivots = {k: v[coherent(v)] for k, v in pivots.items()}

    def nearest(batches):
        for batch in batches:
            cells = []
            for e in batch.column(batch.num_columns - 1).to_pylist():
                known = pivots.get(len(e))
                cells.append(len(e) * PIVOTS + (0 if known is None else int((known @ np.array(e, np.float64)).argmax())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], names=["rep", "label", "cell"])

    placed = materialize(points.select("rep", "label", "embedding").mapInArrow(nearest, "rep bigint, label int, cell bigint"), "cells")
    # small cells of a label share blocks, in the order of their pivots; large ones are cut
    counts = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("cell")) - F.col("n")  # at most PIVOTS rows a label and length
    counts = counts.select("label", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).alias("cuts"), F.floor(before / BLOCK).alias("run"))
    width = F.when(F.col("cuts") > 1, F.struct(F.lit(1).alias("k"), F.col("cell").alias("c"), F.pmod(F.xxhash64("rep"), F.col("cuts")).alias("h")))
    shared = F.struct(F.lit(0).alias("k"), F.floor(F.col("cell") / PIVOTS).alias("c"), F.col("run").alias("h"))
    dealt = placed.join(counts, ["label", "cell"]).select("rep", "cell", F.xxhash64("label", F.coalesce(width, shared)).alias("block"))
    full = points.select("rep", "label", "embedding", "copies").join(dealt, "rep")
    schema = "label int, block bigint, place bigint, centre array<double>, radius double, data binary"
    return materialize(full.groupBy("label", "block").applyInArrow(_build, schema), "blocks")


def _gap(a: str, b: str):
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total)


def _nodes(below: DataFrame) -> DataFrame:
    """The level above ``below`` (label, len, node, centre, radius): one node for TEAM
    neighbours, around the first one's centre, with the radius that covers all of them."""
    up = F.floor(F.col("node") / TEAM).cast("long").alias("node")
    held = below.groupBy("label", "len", up).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("k"), "centre", "radius"))).alias("c"))
    held = held.withColumn("centre", F.get("c", F.lit(0))["centre"])
    reach = F.array_max(F.transform("c", lambda x: x["radius"] + _gap(x["centre"], "centre")))
    return materialize(held.select("label", "len", "node", "centre", reach.alias("radius")), "nodes")


def team_pairs(blocks: DataFrame, limit: float) -> DataFrame:
    """(label, len, a, b): teams a <= b of a label that may hold points within ``limit``.
    ``blocks``: (label, len, rank, centre, radius), ranks from 0 in each (label, len)."""
    levels = [_nodes(blocks.withColumnRenamed("rank", "node"))]
    while levels[-1].agg(F.max("node")).first()[0]:  # until every label has one node
        levels.append(_nodes(levels[-1]))
    pairs = levels[-1].select("label", "len", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("node") / TEAM).cast("long"))
        one = child.select("label", "len", F.col("up").alias("a"), F.col("node").alias("a2"), F.col("centre").alias("c1"), F.col("radius").alias("r1"))
        two = child.select("label", "len", F.col("up").alias("b"), F.col("node").alias("b2"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
        met = pairs.join(one, ["label", "len", "a"]).join(two, ["label", "len", "b"]).where("a2 <= b2")
        met = met.where((F.col("a2") == F.col("b2")) | (_gap("c1", "c2") <= F.col("r1") + F.col("r2") + F.lit(limit)))
        pairs = materialize(met.select("label", "len", F.col("a2").alias("a"), F.col("b2").alias("b")), "pairs")
    return pairs


def meet_teams(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """(rep, links, root) of the blocks of two teams, or of one team with itself."""
    reps, links, roots = [], [], []
    limit = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    if left.num_rows and right.num_rows:
        itself = left.column("a")[0].as_py() == left.column("b")[0].as_py()
        ours = [_load(d.as_py()) for d in left.column("data")]
        theirs = ours if itself else [_load(d.as_py()) for d in right.column("data")]
        for p, a in enumerate(ours):
            for q, b in enumerate(theirs):
                same = itself and p == q
                if itself and q < p:
                    continue
                (ca,), (ra,), (cb,), (rb,) = *a["levels"][0][:2], *b["levels"][0][:2]
                if not same and np.sqrt(max(0.0, 2 - 2 * float(a["unit"][ca] @ b["unit"][cb]))) > ra + rb + limit:
                    continue
                i, j = dual_links(a, b, threshold)
                if same:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                n = len(a["rep"])
                rep = a["rep"] if same else np.concatenate([a["rep"], b["rep"]])
                own = np.bincount(i, b["copies"][j], len(rep))
                if not same:
                    own += np.bincount(j + n, a["copies"][i], len(rep))
                root = local_roots(len(rep), i, j if same else j + n)
                hit = np.nonzero(own)[0]
                reps.append(rep[hit])
                links.append(own[hit].astype(np.int64))
                roots.append(rep[root[hit]])
    empty = [np.empty(0, np.int64)]
    return pa.table({n: np.concatenate(v or empty) for n, v in (("rep", reps), ("links", links), ("root", roots))})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links (bigint), component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double
    precision, is ``threshold`` or more. Null or zero vectors and those with null or
    non-finite parts link with nothing, neither do vectors of different length. Links of
    copies count one by one. A row without vec_id takes part; it is not kept and its
    component has the smallest id it reaches, or null. Other columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    points = _points(vectors)
    blocks = _blocks(points)
    slim = blocks.select("label", F.size("centre").alias("len"), "place", "block", "centre", "radius")
    ranked = ordered_scan(materialize(slim, "slim"), ["label", "len"], ["place", "block"], {"rank": ("row_number",)})
    ranked = materialize(ranked.withColumn("rank", F.col("rank") - 1), "ranked")
    limit = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    pairs = team_pairs(ranked.select("label", "len", "rank", "centre", "radius"), limit)
    members = ranked.select("label", "len", "block", F.floor(F.col("rank") / TEAM).cast("long").alias("team"))
    key = ["label", "len", "a", "b"]
    left = pairs.join(members.withColumnRenamed("team", "a"), ["label", "len", "a"]).select(*key, "block").join(blocks.select("block", "data"), "block")
    # a team that meets itself is sent once
    right = pairs.where("a < b").join(members.withColumnRenamed("team", "b"), ["label", "len", "b"]).select(*key, "block")
    one = pairs.where("a = b").join(members.withColumnRenamed("team", "b"), ["label", "len", "b"]).select(*key, F.lit(None).cast("bigint").alias("block"))
    right = right.join(blocks.select("block", "data"), "block").unionByName(one.select("block", *key, F.lit(b"").alias("data")).distinct())
    right = right.select(*(F.col(c).alias(c) for c in left.columns))  # columns of its own for the cogroup
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: meet_teams(a, b, threshold), "rep bigint, links bigint, root bigint")
    found = materialize(met, "links")
    components = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = points.join(components, points.rep == components.node, "left").drop("node").join(totals, "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    keyed = lambda df: df.withColumns({"_h1": F.xxhash64("label", "embedding"), "_h2": F.xxhash64(F.lit(7), "label", "embedding")})
    answers = keyed(named).join(lows, "root").select("_h1", "_h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed(vectors).join(answers, ["_h1", "_h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
