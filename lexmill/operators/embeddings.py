"""Sentence and token vectors: plane projections, maps and neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions import vectors as vx
from lexmill.functions.joins import hinted, null_safe_join
from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize


def anchor_projection(df: DataFrame, group: str, pos: str, vec: str) -> DataFrame:
    """(group, pos, u, v): coordinates of every vector in the plane of the group's
    first and last vector, which map to (1, 0) and (0, 1)."""
    ends = df.groupBy(group).agg(F.min_by(vec, pos).alias("b1"), F.max_by(vec, pos).alias("b2"))
    anchors = ends.select(
        group, "b1", "b2", vx.dot("b1", "b1").alias("g11"), vx.dot("b1", "b2").alias("g12"), vx.dot("b2", "b2").alias("g22"),
    )
    placed = null_safe_join(df.select(group, pos, vec), anchors, [group]).select(
        group, pos, "g11", "g12", "g22", vx.dot("b1", vec).alias("x1"), vx.dot("b2", vec).alias("x2")
    )
    det = F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12")
    # Parallel anchors span a line: the shortest coordinates that reach the point.
    ratio = F.col("g12") / F.nullif(F.col("g11"), F.lit(0.0))
    along = F.col("x1") / F.nullif(F.col("g11"), F.lit(0.0)) / (1 + ratio * ratio)
    u = F.when(det == 0, along).otherwise((F.col("g22") * F.col("x1") - F.col("g12") * F.col("x2")) / det)
    v = F.when(det == 0, along * ratio).otherwise((F.col("g11") * F.col("x2") - F.col("g12") * F.col("x1")) / det)
    return placed.select(group, pos, u.alias("u"), v.alias("v"))


def token_path(projected: DataFrame, group: str, pos: str) -> DataFrame:
    """Movement from the previous token in the plane, and the extent of the group."""
    points = materialize(projected, "points")
    moves = ordered_scan(points, [group], [pos], {"u0": ("lag", "u"), "v0": ("lag", "v")})
    extent = points.groupBy(group).agg((F.max("u") - F.min("u")).alias("range_u"), (F.max("v") - F.min("v")).alias("range_v"))
    return null_safe_join(moves, extent, [group]).select(
        group, pos, (F.col("u") - F.col("u0")).alias("du"), (F.col("v") - F.col("v0")).alias("dv"), "range_u", "range_v"
    )


def pca_2d(df: DataFrame, vec: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., x, y): the two main axes; the sign of an axis is free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    xy = vector_to_array("_p")
    return model.transform(rows).select(*keep, F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


# ---- nearest neighbours in another group ----------------------------------
#
# Exact search on unit vectors. A tree of cells is grown level by level: a cell with more
# than ``block`` vectors is cut by pivots drawn from it, until every leaf is small. Each
# leaf is also a block of queries. It first meets itself, which gives its queries a k-th
# best distance; then the tree is descended breadth-first, and a node is dropped when
#     distance(query, centre) - radius(node) > bound(query)
# holds for every query of the leaf. The nearest leaves that remain are met first, their
# results lower the bounds, and only leaves still in reach are met after that. Leaves meet in
# teams of neighbours in the tree; no task holds more than two teams, or one leaf and the
# centres of one level that it reaches.

SLACK = 1e-4  # covers rounding of cosines to 9 places
SLICE = 16_384  # rows of a cell that meet its pivots in one task
NEAREST = 8  # leaves met before the bounds are lowered
TEAM = 16_384  # vectors of leaves that stand side by side in the tree and meet in one task
CELLS = 1 << 22  # cosines held at once


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 1))


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def _best(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> pd.DataFrame:
    """(rep, neighbour, cosine): best k candidates of another group per query."""
    out_rep, out_nb, out_cos = [], [], []
    if len(queries) and len(cands):
        keys, reps = [list(x) for x in cands["keys"]], queries["rep"].to_numpy()
        vectors, columns = _matrix(queries["vec"]), _matrix(cands["vec"]).T
        qg, cg = queries["grp"].to_numpy(), cands["grp"].to_numpy()
        if qg.dtype == object or cg.dtype == object:
            codes = pd.factorize(np.concatenate([qg.astype(object), cg.astype(object)]), use_na_sentinel=False)[0]
            qg, cg = codes[: len(qg)], codes[len(qg) :]
        step = max(1, CELLS // len(cg))
        for low in range(0, len(reps), step):
            cos = vectors[low : low + step] @ columns
            cos[qg[low : low + step, None] == cg[None, :]] = -np.inf
            kth = np.partition(cos, len(cg) - k, axis=1)[:, len(cg) - k] if len(cg) > k else np.full(len(cos), -np.inf)
            # all that can reach the k-th place after rounding
            row, at = np.nonzero((cos >= kth[:, None] - 2e-9) & (cos > -np.inf))
            value = np.round(cos[row, at], 9)
            ends = np.searchsorted(row, np.arange(len(cos) + 1))
            for i in range(len(cos)):
                mine = slice(ends[i], ends[i + 1])
                found = sorted((-c, key) for c, j in zip(value[mine], at[mine]) for key in keys[j])[:k]
                out_rep += [reps[low + i]] * len(found)
                out_nb += [key for _, key in found]
                out_cos += [-c for c, _ in found]
    return pd.DataFrame({"rep": np.array(out_rep, dtype="int64"), "neighbour": np.array(out_nb, dtype="int64"), "cosine": np.array(out_cos, dtype="float64")})


def _grow(reps: DataFrame, block: int, fan: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Leaves (rows with ``leaf``, a path such as ``0/3/5``, and ``gaps``, the distance to
    the centre of each node on it), the centres (node, parent, centre), and the depth."""
    shape = f"rep long, grp {reps.schema['grp'].dataType.simpleString()}, vec array<double>, keys array<long>, leaf string, gaps array<double>"
    rows = reps.select("*", F.lit("0").alias("leaf"), F.array().cast("array<double>").alias("gaps"))
    done, centres, depth = None, None, 0
    while True:
        big = materialize(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "big")
        n_big = big.count()
        if n_big == 0:
            return (rows if done is None else done.unionByName(rows)), centres, depth
        depth += 1
        tagged = rows.join(hinted(big, n_big), "leaf", "left")
        small = tagged.where("n IS NULL").drop("n")
        done = small if done is None else done.unionByName(small)
        wide = tagged.where("n IS NOT NULL")
        draw = F.pmod(F.xxhash64("rep", "leaf"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = wide.where(draw * F.col("n") < max(128, 4 * fan)).groupBy("leaf", "n").agg(
            F.array_sort(F.collect_list(F.struct(draw.alias("draw"), "rep", "vec"))).alias("pivots")
        )
        # no more pivots than leaves needed: a cell little above the limit is not cut to splinters
        cuts = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / block))).cast("int")
        drawn = materialize(drawn.withColumn("pivots", F.slice("pivots", F.lit(1), cuts)), "pivots")
        slices = F.ceil(F.col("n") / SLICE).cast("int")
        dealt = wide.withColumn("slice", F.pmod(F.xxhash64("rep"), slices).cast("int")).drop("n")
        asked = drawn.select("leaf", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("pivots.vec").alias("pivots"))

        def deal(part: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
            gaps = _gaps(_matrix(part["vec"]), np.array(cell["pivots"].iloc[0].tolist(), dtype=np.float64))
            low = gaps.min(axis=1)
            near = gaps <= low[:, None] + 1e-9
            # vectors that no pivot tells apart are dealt in turn, so that every cut makes progress
            turn = part["rep"].to_numpy() % near.sum(axis=1)
            child = (np.cumsum(near, axis=1) > turn[:, None]).argmax(axis=1)
            own = gaps[np.arange(len(part)), child]
            return part.drop(columns="slice").assign(
                leaf=[f"{leaf}/{c}" for leaf, c in zip(part["leaf"], child)], gaps=[[*g, own[i]] for i, g in enumerate(part["gaps"])]
            )[["rep", "grp", "vec", "keys", "leaf", "gaps"]]

        rows = materialize(dealt.groupBy("leaf", "slice").cogroup(asked.groupBy("leaf", "slice")).applyInPandas(deal, shape), "cells")
        found = drawn.select(F.col("leaf").alias("parent"), F.posexplode("pivots.vec").alias("at", "centre")).select(
            F.concat_ws("/", "parent", F.col("at").cast("string")).alias("node"), "parent", "centre"
        )
        centres = found if centres is None else centres.unionByName(found)


def _with_bounds(leaves: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(q, rep, grp, vec, bound): the distance of the k-th neighbour known so far."""
    known = best.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("worst")).where(F.col("n") >= k)
    bound = F.when(F.col("worst").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))))
    return leaves.join(known, "rep", "left").select(F.col("leaf").alias("q"), "rep", "grp", "vec", F.coalesce(bound, F.lit(math.inf)).alias("bound"))


def _descend(asking: DataFrame, nodes: DataFrame, depth: int, k: int) -> DataFrame:
    """(q, node, near): leaves that may hold a neighbour of a query of leaf ``q``;
    ``near`` is a lower bound of the distance."""
    pairs = materialize(asking.select("q").distinct().select("q", F.lit("0").alias("node"), F.lit(math.inf).alias("upper")), "start")
    reached = None

    def look(part: pd.DataFrame, kids: pd.DataFrame) -> pd.DataFrame:
        gaps = _gaps(_matrix(part["vec"]), _matrix(kids["centre"]))
        radius, others = kids["radius"].to_numpy(), kids["others"].to_numpy()
        bound = np.minimum(part["bound"].to_numpy(), kids["upper"].iloc[0])
        # the nodes whose farthest members still are k others bound the distance, too
        far = np.where(others > 0, gaps + radius, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(others[order], axis=1) >= k
        row = np.arange(len(part))
        by_nodes = np.where(enough.any(axis=1), far[row, order[row, enough.argmax(axis=1)]], np.inf)
        limit = np.minimum(bound, by_nodes)
        keep = (gaps - radius <= limit[:, None] + SLACK).any(axis=0)
        near = (gaps - radius).min(axis=0)
        return pd.DataFrame({
            "q": part["q"].iloc[0], "node": kids["node"][keep].to_numpy(), "near": near[keep], "upper": limit.max(), "is_leaf": kids["is_leaf"][keep].to_numpy(),
        })

    def look_all(part: pd.DataFrame, kids: pd.DataFrame) -> pd.DataFrame:
        found = [look(part, own) for _, own in kids.groupby("parent")] if len(part) else []
        return pd.concat(found) if found else pd.DataFrame(columns=["q", "node", "near", "upper", "is_leaf"])

    for level in range(1, depth + 1):
        here = nodes.where(F.col("level") == level)
        kids = pairs.withColumnRenamed("node", "parent").join(hinted(here, here.count(), 10_000), "parent")
        # the queries of a leaf move once a level, the centres go to them
        found = asking.groupBy("q").cogroup(kids.groupBy("q")).applyInPandas(
            look_all, "q string, node string, near double, upper double, is_leaf boolean"
        )
        found = materialize(found, "reach")
        leaf_pairs = found.where("is_leaf AND q <> node").select("q", "node", "near")
        reached = leaf_pairs if reached is None else reached.unionByName(leaf_pairs)
        pairs = found.where("NOT is_leaf").select("q", "node", "upper")
    return reached


def _teams(leaves: DataFrame) -> DataFrame:
    """(leaf, at, team): leaves numbered in the order of the tree, some ``TEAM`` vectors to a team."""
    sizes = materialize(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = ordered_scan(sizes, [], ["leaf"], {"at": ("row_number",), "upto": ("sum", "n")})
    team = F.floor((F.col("upto") - F.col("n")) / TEAM)
    return materialize(placed.select("leaf", F.col("at").cast("int").alias("at"), team.cast("int").alias("team")), "teams")


def _meet(asking: DataFrame, leaves: DataFrame, pairs: DataFrame, teams: DataFrame, k: int) -> DataFrame:
    """(rep, neighbour, cosine) of the leaves in ``pairs``. Teams of leaves meet in a task, so
    that a vector moves once for each team in reach, not for each leaf."""
    def meet(part: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        found = [_best(part.iloc[:0], cands.iloc[:0], k)]
        cells = {}
        for at, cell in cands.groupby("at"):
            vectors = _matrix(cell["vec"])
            middle = vectors[(vectors @ vectors.mean(axis=0)).argmax()][None, :]
            cells[at] = cell, middle, _gaps(vectors, middle).max()
        for _, asked in part.groupby("q"):
            vectors, bound = _matrix(asked["vec"]), asked["bound"].to_numpy()
            near = {at: _gaps(vectors, cells[at][1])[:, 0] - cells[at][2] <= bound + SLACK for at in asked["nodes"].iloc[0]}
            reached = [at for at, hit in near.items() if hit.any()]
            if reached:
                some = np.logical_or.reduce([near[at] for at in reached])
                found.append(_best(asked[some], pd.concat([cells[at][0] for at in reached]), k))
        return pd.concat(found)

    of = lambda leaf, team: teams.select(F.col("leaf").alias(leaf), F.col("team").alias(team), F.col("at").alias(f"{leaf}_at"))
    met = materialize(pairs.select("q", "node").join(of("q", "asks"), "q").join(of("node", "holds"), "node"), "met")
    wanted = met.groupBy("q", "asks", "holds").agg(F.collect_set("node_at").alias("nodes"))
    left = asking.join(wanted, "q").select("asks", "holds", "q", "nodes", "rep", "grp", "vec", "bound")
    held = met.select(F.col("node").alias("leaf"), F.col("node_at").alias("at"), F.col("asks").alias("for"), F.col("holds").alias("of")).distinct()
    right = leaves.join(held, "leaf").select("for", "of", "at", "rep", "grp", "vec", "keys")
    return left.groupBy("asks", "holds").cogroup(right.groupBy("for", "of")).applyInPandas(meet, "rep long, neighbour long, cosine double")


def cross_group_neighbours(
    df: DataFrame, key: str, group: str, vec: str, k: int = 3, block: int = 2048, fan: int = 32
) -> DataFrame:
    """(key, rank, neighbour, cosine): the k most similar vectors of other groups,
    ties by key. ``key`` is an integer id; rows without a vector have no neighbours.
    Leaves hold at most ``block`` distinct vectors, and a cell is cut by ``fan`` pivots."""
    unit = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(group).alias("grp"), vx.normalised(vec).alias("vec"))
    # Copies: only the k lowest keys of equal vectors can be neighbours. The filter on
    # row_number is applied before the shuffle, so many copies stay few rows.
    low = Window.partitionBy("grp", "vec").orderBy("key")
    reps = (
        unit.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k)
        .groupBy("grp", "vec").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        .select(F.get("keys", F.lit(0)).alias("rep"), "grp", "vec", "keys")
    )
    reps = materialize(reps, "reps")
    leaves, centres, depth = _grow(reps, block, max(2, fan))
    top = Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    own = leaves.select("leaf", "rep", "grp", "vec", "keys").groupBy("leaf").applyInPandas(
        lambda pdf: _best(pdf, pdf, k), "rep long, neighbour long, cosine double"
    )
    if depth == 0:
        best = own
    else:
        best = materialize(own, "best")
        at = leaves.select("leaf", "grp", F.posexplode("gaps").alias("level", "gap")).withColumn("level", F.col("level") + 1)
        sums = (
            at.withColumn("node", F.expr("substring_index(leaf, '/', level + 1)"))
            .groupBy("node", "level", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"), F.max(F.col("leaf") == F.col("node")).alias("is_leaf"))
            .groupBy("node", "level").agg((F.sum("n") - F.max("n")).alias("others"), F.max("gap").alias("radius"), F.max("is_leaf").alias("is_leaf"))
        )
        nodes = materialize(centres.join(sums, "node"), "nodes")
        asking = materialize(_with_bounds(leaves, best, k), "asking")
        ordered = Window.partitionBy("q").orderBy("near", "node")
        pairs = materialize(_descend(asking, nodes, depth, k).withColumn("turn", F.row_number().over(ordered)), "pairs")
        teams = _teams(leaves)
        first = _meet(asking, leaves, pairs.where(F.col("turn") <= NEAREST), teams, k)
        best = materialize(ranked(best.unionByName(first)).drop("rank"), "best")
        asking = materialize(_with_bounds(leaves, best, k), "asking")
        reach = asking.groupBy("q").agg(F.max("bound").alias("bound"))
        rest = pairs.where(F.col("turn") > NEAREST).join(reach, "q").where(F.col("near") <= F.col("bound") + SLACK)
        best = best.unionByName(_meet(asking, leaves, rest, teams, k))
    per_vector = reps.select("rep", "grp", "vec").join(ranked(best), "rep")
    return null_safe_join(unit, per_vector, ["grp", "vec"]).select("key", "rank", "neighbour", "cosine")
