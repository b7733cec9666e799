"""Line dedup by a suffix array over line numbers, built by distributed prefix doubling.

All texts are one long sequence of lines: documents in the order of (doc_id, nulls last,
text digest), lines in their order. The rank of a position at depth 1 is the place of
its line among all lines; the rank at depth 2h comes from the pair of ranks at p and
p + h. Equal rank at depth h means: the same h lines. Only positions that share their
rank with another one go on to the next depth, so unique text, nearly all of it, drops
out in the first round, and no round sees a whole group in one task.

A run of lines is repeated when it occurs at an earlier place too, and it counts when it
has ``min_words`` words or more. Maximal repeated runs are longest-common-prefix
intervals of the suffix array. Their union is found without listing them: a run of
enough words is exactly the union of its shortest windows of enough words, taken forward
from each start and backward from each end (a line near the end of the run, too light to
start a window of its own, lies in the backward window that ends at it). A window of d
lines at s is the interval of depth d around suffix s, named by the ranks at depth
h = 2^floor(log2 d) of s and of s + d - h. Of every interval the first place stays and
the lines of all later ones go; per document they are united to runs (first, last).

A line or passage that is very common is a class of many rows. Such classes, of which there
can be only a few, travel to the rows; all others meet them in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.functions.ordered import ordered_scan
from lexmill.llm.columns import passing_through
from lexmill.session import materialize

_KEY = ["_k1", "_k2", "_k3"]


def _digest(c) -> tuple:
    """128 bits: two hashes whose seeds differ."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def _keyed(docs: DataFrame) -> DataFrame:
    """Document key: id (nulls last) and digest of the text."""
    one, two = _digest(F.col("text"))
    return docs.withColumns({"_k1": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "_k2": one, "_k3": two})


def _sequence(docs: DataFrame) -> DataFrame:
    """(_at, _end, lines): each distinct document with the place of its first line."""
    line = F.col("_line")
    one, two = _digest(line)
    flat = (
        _keyed(docs.select("doc_id", "text"))
        .where("text is not null")
        .select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("_no", "_line"))
        .select(*_KEY, "_no", one.alias("h1"), two.alias("h2"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    )
    # repeated rows of one document give each line more than once; one copy is enough
    rows = flat.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("_no", "h1", "h2", "words"))).alias("lines"))
    rows = materialize(rows.withColumn("_n", F.size("lines").cast("long")), "lines")
    placed = ordered_scan(rows, [], _KEY, {"_upto": ("sum", "_n")})
    return materialize(placed.select(*_KEY, (F.col("_upto") - F.col("_n")).alias("_at"), F.col("_upto").alias("_end"), "lines"), "lines")


def _spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], at: str = "at", share: int = 4) -> DataFrame:
    """Inner join of ``rows`` with ``classes`` (keys, n, one more column), whose ``n`` is the
    number of their rows. A class with more than a ``share`` * shards-th of all rows in classes
    is broadcast, so at most ``share`` * shards rows are; its rows are dealt by their place
    and not by the key."""
    shards = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (value,) = [c for c in classes.columns if c not in (*keys, "n")]
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    large = classes.where(F.col("n") * share * shards > total.scalar()).select(*keys, F.col(value).alias("_hot"))
    met = rows.join(F.broadcast(large), keys, "left")
    dealt = met.withColumns({f"_d{i}": F.when(F.col("_hot").isNotNull(), F.xxhash64(F.lit(i), at)).otherwise(F.col(k).cast("bigint")) for i, k in enumerate(keys)})
    small = classes.select(*(F.col(k).cast("bigint").alias(f"_d{i}") for i, k in enumerate(keys)), F.col(value).alias("_cold"))
    out = dealt.join(small, [f"_d{i}" for i in range(len(keys))], "left")
    return out.select(*rows.columns, F.coalesce("_hot", "_cold").alias(value)).where(F.col(value).isNotNull())


def _ranked(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose pair (a, b) occurs more than once, with ``rank``: the number of such
    rows that sort before the pair."""
    classes = materialize(rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    order = ordered_scan(classes, [], [a, b], {"upto": ("sum", "n")})
    order = order.select(a, b, "n", (F.col("upto") - F.col("n")).alias("rank"))
    return _spread_join(rows, order, [a, b]).drop(a, b)


def _windows(min_words: int):
    """Shortest windows of enough words inside stretches of neighbouring active lines."""

    def cut(at: np.ndarray, end: np.ndarray, words: np.ndarray, fresh: np.ndarray):
        total = np.concatenate([[0], np.cumsum(words)])
        n = len(at)
        number = np.cumsum(fresh) - 1
        first = np.nonzero(fresh)[0][number]
        last = np.concatenate([np.nonzero(fresh)[0][1:], [n]])[number] - 1
        i = np.arange(n)
        stop = np.searchsorted(total[1:], total[:-1] + min_words)  # forward from every start
        ok = stop <= last
        start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # backward from every end
        back = (start >= first) & (total[1:] - total[np.maximum(start, 0)] >= min_words)
        s = np.concatenate([i[ok], start[back]])
        d = np.concatenate([stop[ok] - i[ok] + 1, i[back] - start[back] + 1])
        both = np.unique(np.stack([s, d]), axis=1) if len(s) else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(at[both[0]]), pa.array(both[1].astype(np.int64)), pa.array(end[both[0]])], names=["at", "d", "end"]
        )

    def run(batches):
        kept = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            if not len(now[0]):
                continue
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            at, end, words = now
            fresh = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(end) != 0)])
            cutoff = np.nonzero(fresh)[0][-1]  # the last stretch may go on in the next batch
            if cutoff:
                yield cut(at[:cutoff], end[:cutoff], words[:cutoff], fresh[:cutoff])
            kept = [x[cutoff:] for x in now]
        if kept is not None:
            at, end, words = kept
            yield cut(at, end, words, np.arange(len(at)) == 0)

    return run


def repeated_windows(seq: DataFrame, min_words: int) -> DataFrame:
    """(at, d, end): windows of d lines that occur at an earlier place too."""
    flat = seq.select("_at", F.col("_end").alias("end"), F.posexplode("lines").alias("i", "l"))
    flat = flat.select((F.col("_at") + F.col("i")).alias("at"), "end", F.col("l.words").alias("words"), F.col("l.h1").alias("a"), F.col("l.h2").alias("b"))
    level = materialize(_ranked(flat, "a", "b"), "ranks")
    shards = max(2, int(seq.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a document's lines stay together: a stretch is no longer than its text
    sorted_rows = level.select("at", "end", F.col("words").cast("long")).repartition(shards, "end").sortWithinPartitions("end", "at")
    windows = materialize(sorted_rows.mapInArrow(_windows(min_words), "at bigint, d bigint, end bigint"), "windows")
    longest = windows.agg(F.max("d")).first()[0]
    found, h = None, 1
    while longest is not None and h <= longest:
        mine = windows.where((F.col("d") >= h) & (F.col("d") < 2 * h))
        head = level.select("at", F.col("rank").alias("r1"))
        tail = level.select(F.col("at").alias("_t"), F.col("rank").alias("r2"))
        named = mine.join(head, "at").withColumn("_t", F.col("at") + F.col("d") - h).join(tail, "_t").drop("_t")
        named = materialize(named, "named")
        first = named.groupBy("d", "r1", "r2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = _spread_join(named, materialize(first, "first"), ["d", "r1", "r2"]).where("at > first").select("at", "d", "end")
        found = later if found is None else found.unionByName(later)
        h *= 2
        if h > longest:
            break
        ahead = level.select((F.col("at") - h // 2).alias("at"), F.col("end").alias("end2"), F.col("rank").alias("b"))
        pairs = level.select("at", "end", F.col("rank").alias("a")).join(ahead, "at").where("end = end2").drop("end2")
        level = materialize(_ranked(pairs, "a", "b"), "ranks")
    return windows.limit(0) if found is None else found


def _united(windows: DataFrame) -> DataFrame:
    """(end, first, stop): the union of each document's windows as runs of lines."""
    lines = Window.partitionBy("end").orderBy("at", "d")  # the windows of one document
    reached = F.max(F.col("at") + F.col("d")).over(lines.rowsBetween(Window.unboundedPreceding, -1))
    fresh = windows.select("end", "at", "d", (reached.isNull() | (F.col("at") > reached)).cast("int").alias("fresh"))
    runs = fresh.withColumn("run", F.sum("fresh").over(lines))
    return runs.groupBy("end", "run").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("d")).alias("stop")).drop("run")


@passing_through("doc_id", "text")
def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with text freed of repeated line runs, and _n_lines, _n_deleted (bigint).

    A line goes when it lies in a run of neighbouring lines with ``min_words`` words or
    more that also occurs at an earlier place (smaller doc_id, or higher up in the same
    text). Lines are the pieces between ``\\n``; words are what white space separates.
    Kept lines keep their order. A null text stays null with 0 lines; an empty text has
    one empty line. Documents with null ids come last. Rows with equal id and text are
    one document: they get the same result. Other columns pass through; one with the name
    of an added column gives way to it.
    """
    seq = _sequence(docs)
    windows = repeated_windows(seq, min_words)
    runs = _united(windows).groupBy("end").agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    places = seq.select(*_KEY, "_at", "_end").join(runs, F.col("_end") == F.col("end"))
    inside = F.transform("runs", lambda r: F.struct((r["first"] - F.col("_at")).cast("int").alias("first"), (r["stop"] - F.col("_at")).cast("int").alias("stop")))
    marks = materialize(places.select(*_KEY, F.array_sort(inside).alias("_gone")), "gone")
    # one strategy at every size: the marks grow with the documents
    joined = _keyed(docs).join(marks.hint("merge"), _KEY, "left").drop(*_KEY)
    names = docs.columns

    def rebuild(batches):
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("_gone")
            out, n, m = [], [], []
            for t, g in zip(texts, gone):
                text, drop = t.as_py(), g.as_py()
                count = 0 if text is None else text.count("\n") + 1
                if drop:
                    lines, left, at = text.split("\n"), [], 0
                    for run in drop:
                        left += lines[at : run["first"]]
                        at = run["stop"]
                    text = "\n".join(left + lines[at:])
                out.append(text)
                n.append(count)
                m.append(sum(run["stop"] - run["first"] for run in drop) if drop else 0)
            cols = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[*names, "_n_lines", "_n_deleted"])

    schema = StructType([*docs.schema.fields, StructField("_n_lines", LongType()), StructField("_n_deleted", LongType())])
    return joined.select(*names, "_gone").mapInArrow(rebuild, schema)
