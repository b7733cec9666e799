"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight for its share of the whole mix and a schedule that says when in
training its words are wanted. The targets come from water-filling: a target stops at
``max_repeats`` times the source's size and the excess goes to the others by weight.
Inside a source rows stand in the order of a hash of id, text and copy number; whole passes
and one partial pass cover the target. The schedule's integral is the source's cumulative
demand for words; inverting it at the words placed so far gives a row its training
position, and the mix is range-sorted by position. The running sums are taken per (source,
hash range), so a source with a third of all rows is spread over many tasks, and so are the
repeats of one row, which have hashes of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.hashing import shuffle_key
from lexmill.functions.ordered import ordered_scan
from lexmill.llm.columns import passing_through
from lexmill.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating, and their schedules: relative
#: weights at equally spaced times from the start to the end of training.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SEED = "mix"


def position(share: Column, knots: Sequence[float]) -> Column:
    """Time in 0..1 at which the integral of a piecewise linear schedule has reached
    ``share`` of its whole."""
    steps = len(knots) - 1
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:])]
    out, done = None, sum(areas)
    for k in reversed(range(steps)):
        done -= areas[k]
        w, rise = knots[k], knots[k + 1] - knots[k]
        y = F.greatest(share * F.lit(sum(areas)) - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * rise) * y, F.lit(0.0)))
        time = (F.lit(float(k)) + F.try_divide(2 * y, F.lit(w) + root)) / F.lit(float(steps))
        out = time if out is None else F.when(share * F.lit(sum(areas)) < F.lit(done + areas[k]), time).otherwise(out)
    return F.least(F.coalesce(out, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(_none, _name, _sid, source_size, target) per source of ``sizes`` (_none, _name, size)."""
    own = materialize(sizes.groupBy("_none", "_name").agg(F.sum("size").alias("source_size")), "sources")
    ranked = ordered_scan(own, [], ["_none", "_name"], {"_sid": ("row_number",)})
    turn = ((F.col("_sid") - 1) % len(weights)).cast("int")
    ranked = ranked.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    ranked = materialize(ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight")), "sources")
    filled = ordered_scan(ranked, [], ["_ratio", "_sid"], {"_caps": ("sum", "_cap"), "_used": ("sum", "_weight")})
    total = ranked.agg(F.sum("source_size").cast("double")).scalar()
    shares = ranked.agg(F.sum("_weight")).scalar()
    level = (total - (F.col("_caps") - F.col("_cap"))) / (shares - (F.col("_used") - F.col("_weight")))
    # the first source, by cap per weight, that the level does not lift above its cap
    lifted = filled.withColumn("_level", level).where("_level <= _ratio")
    found = lifted.agg(F.min_by("_level", F.struct("_ratio", "_sid"))).scalar()
    target = F.coalesce(F.least(F.col("_cap"), found * F.col("_weight")), F.lit(0.0))
    return ranked.select("_none", "_name", "_sid", "source_size", target.alias("target"))


_UNIT = ["_none", "_name", "_unit", "_other"]


def _sized(docs: DataFrame) -> DataFrame:
    """Adds _none, _name (the source), _key (id and text as a digest), _other (a hash of the
    other columns) and _size."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return docs.withColumns(
        {
            "_none": F.col("source").isNull(),
            "_name": F.coalesce("source", F.lit("")),
            "_unit": name,
            "_other": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long"),
            "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        }
    )


def _rows(sized: DataFrame) -> DataFrame:
    """One line per row: its unit, doc_id, size and _u, the hash that gives its place. Rows
    with the same source, id and text are told apart by a copy number; they stand in the
    order of their other columns, and equal rows can stand in for each other."""
    cells = sized.groupBy(*_UNIT).agg(
        F.first("doc_id").alias("doc_id"), F.first("_size").alias("size"), F.count(F.lit(1)).alias("_n")
    )
    cells = materialize(cells, "units")
    placed = ordered_scan(cells, ["_none", "_name", "_unit"], ["_other"], {"_upto": ("sum", "_n")})
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)))
    return copies.select(*_UNIT, "doc_id", "size", shuffle_key(F.concat_ws(":", "_unit", F.col("_copy").cast("string")), SEED).alias("_u"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    max_repeats: int = 3,
) -> DataFrame:
    """One line per row of ``docs``: doc_id, size, source_size, target, copies (int) and
    positions (array<double>, one time in 0..1 for each copy), beside the keys of its unit.

    Every row is placed by itself, repeated rows and rows without id too. Null texts have
    size 0; null sources form one source, the last. A source without words has target 0
    and its rows get no copy. Reruns agree.
    """
    rows = materialize(_rows(_sized(docs)), "sizes")
    sources = materialize(source_targets(rows, weights, max_repeats), "targets")
    units = materialize(rows.join(sources, ["_none", "_name"]), "placed")
    laid = ordered_scan(units, ["_sid"], ["_u"], {"_upto": ("sum", "size")}, hashed=True)
    laid = laid.withColumn("_from", (F.col("_upto") - F.col("size")).cast("double"))
    passes = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    rest = F.col("target") - passes * F.col("source_size")
    more = F.when(F.col("_from") + F.col("size") / 2 < rest, 1).otherwise(0)
    copies = F.coalesce(F.least(passes + more, F.lit(max_repeats)), F.lit(0)).cast("int")
    laid = laid.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(0))
    middle = lambda r: (r * F.col("source_size") + F.col("_from") + F.col("size") / 2) / F.col("target")
    turn = ((F.col("_sid") - 1) % len(schedules)).cast("int")

    def when(r: Column) -> Column:
        share = F.least(middle(r), F.lit(1.0))
        out = position(share, schedules[-1])
        for k in reversed(range(len(schedules) - 1)):
            out = F.when(turn == k, position(share, schedules[k])).otherwise(out)
        return out

    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    laid = laid.withColumn("positions", F.transform(numbers, when))
    return laid.select(*_UNIT, "_u", "doc_id", "size", "source_size", "target", "copies", "positions")


@passing_through("doc_id", "text", "source")
def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with _position: every row as often as the mix takes it, range-sorted by
    training position. Other columns pass through; one named _position gives way.

    Rows that are equal in all columns travel as one with their number.
    """
    sized = _sized(docs)
    taken = mix_plan(docs, **options).select(*_UNIT, "_u", F.explode("positions").alias("_position"))
    texts = sized.groupBy(*_UNIT).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    rows = taken.join(texts, _UNIT).select("_row.*", "_u", "_position")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "_position", "_u").sortWithinPartitions("_position", "_u").drop("_u")
