"""Filter interaction audit by a table-driven byte transducer.

A finite-state transducer with the states GAP and WORD reads the UTF-8 bytes of a text
once. Two tables, indexed by (state, byte), give the next state and what the step emits:
a word begins, a capital, a code point, a symbol. Every byte fixes the state that follows
it, so a run over many bytes is a table lookup on the byte array and its predecessor
states. Word spans leave the pass with a hash and are inserted into an open-addressing
hash table; a slot that is taken counts as the same word only after its bytes have been
compared, so hash collisions never change a count.

Every document then is a mask of the filters it fails. All orders of the filters are
priced from the number of documents per (part, mask), at most 32 cells a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.session import materialize

# Fixed values of the filters: least words, least percent of distinct words, most percent
# of capitals, symbols. A filter's bit is its place in the name string.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\x0b\x0c\r"

GAP, WORD = 0, 1
BEGINS, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
#: Bytes that one run of the transducer reads at once, and bytes of whole texts that share
#: a hash table; they bound memory only. A longer text gets a table of its own.
PIECE, BATCH_BYTES = 1 << 20, 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission), both indexed by state * 256 + byte."""
    state = np.full((2, 256), WORD, np.uint8)
    emit = np.zeros((2, 256), np.uint8)
    state[:, list(SPACES)] = GAP
    emit[:, [b for b in range(256) if not 0x80 <= b < 0xC0]] |= POINT  # not a continuation byte
    emit[:, list(range(ord("A"), ord("Z") + 1))] |= CAPITAL
    emit[:, list(SYMBOLS)] |= SYMBOL
    emit[GAP, state[GAP] == WORD] |= BEGINS
    return state.ravel(), emit.ravel()


NEXT, EMIT = _tables()


def transduce(data: np.ndarray, breaks: np.ndarray, state: int = GAP) -> tuple[np.ndarray, np.ndarray, int]:
    """(emission, state) after each byte and the last state. ``breaks``: places at which a
    new text begins, where the state is set back to GAP."""
    after = NEXT[data]  # both states agree on where a byte leads
    before = np.empty(len(data), np.uint16)
    before[0:1], before[1:] = state, after[:-1]
    before[breaks] = GAP
    return EMIT[before * np.uint16(256) + data], after, int(after[-1]) if len(after) else state


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every span."""
    total = int(size.sum())
    if not total:
        return np.zeros(len(start), np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(total) - np.repeat(first, size)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    values = (data[np.repeat(start, size) + inside].astype(np.uint64) + np.uint64(1)) * power[inside]
    return np.add.reduceat(values, first)


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal size hold the same bytes, in steps of bounded memory."""
    out = np.ones(len(one), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(one):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        n = size[low:high]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(one[low:high], n) + inside] == data[np.repeat(two[low:high], n) + inside]
        out[low:high] = np.logical_and.reduceat(equal, first)
        low = high
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the spans that are the first of their word in their text (``owner``).

    All spans probe the table together: whoever finds a free slot takes it, spans that find
    their own word verified leave, the rest goes on to the next slot.
    """
    is_new = np.zeros(len(start), bool)
    bits = max(4, (2 * len(start)).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    mixed = (hashes ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD)
    at = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(len(start))
    while len(left):
        free = slots[at[left]] < 0
        slots[at[left][free][::-1]] = left[free][::-1]  # the earliest span of a slot wins
        holder = slots[at[left]]
        won = holder == left
        is_new[left[won]] = True
        left, holder = left[~won], holder[~won]
        like = (owner[left] == owner[holder]) & (size[left] == size[holder]) & (hashes[left] == hashes[holder])
        like[like] = _same_bytes(data, start[left[like]], start[holder[like]], size[left[like]])
        left = left[~like]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return is_new


def profile(texts: list[bytes]) -> np.ndarray:
    """Rows of words, distinct words, capitals, code points, symbols."""
    out = np.zeros((len(texts), 5), np.int64)
    low = 0
    while low < len(texts):
        high, held = low, 0
        while high < len(texts) and (high == low or held + len(texts[high]) <= BATCH_BYTES):
            held += len(texts[high])
            high += 1
        data = np.frombuffer(b"".join(texts[low:high]), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts[low:high]])])
        starts, stops, state = [], [], GAP
        for piece in range(0, len(data), PIECE):
            end = min(piece + PIECE, len(data))
            here = bounds[np.searchsorted(bounds, piece) : np.searchsorted(bounds, end)] - piece
            emit, after, last = transduce(data[piece:end], here, state)
            for column, what in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
                found = np.flatnonzero(emit & what) + piece
                out[low:high, column] += np.diff(np.searchsorted(found, bounds))
            begins = np.flatnonzero(emit & BEGINS)
            starts.append(begins + piece)
            # a word ends at a gap that follows it, or where the next text begins
            word = np.concatenate([[state], after])
            ends = (word[:-1] == WORD) & (word[1:] == GAP)
            ends[here] = word[:-1][here] == WORD
            stops.append(np.flatnonzero(ends) + piece)
            state = last
        if state == WORD:
            stops.append(np.array([len(data)]))
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        size = (np.concatenate(stops) if stops else np.empty(0, np.int64)) - start
        owner = np.searchsorted(bounds, start, side="right") - 1
        hashes = np.empty(len(start), np.uint64)
        reach = np.cumsum(size)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PIECE, side="right")))
            hashes[at:to] = _hashes(data, start[at:to], size[at:to])
            at = to
        is_new = distinct_spans(data, start, size, owner, hashes)
        out[low:high, 0] = np.bincount(owner, minlength=high - low)
        out[low:high, 1] = np.bincount(owner[is_new], minlength=high - low)
        low = high
    return out


def failures(counts: np.ndarray) -> np.ndarray:
    """Mask of the filters A to D that each row of ``profile`` fails."""
    words, distinct, capitals, points, symbols = counts.T
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(_id, _part, _mask) per row of ``docs``: its doc_id, source ('' for null) and the
    filters it fails, A to E as the bits 0 to 4.

    E holds for every row whose text another row with a smaller doc_id has too; rows
    without an id come after all others. Texts are compared by SHA-256.
    """

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 2_000):
                batch = whole.slice(low, 2_000)
                masks = failures(profile([t.as_py() for t in batch.column(3)]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks)], names=["_id", "_part", "_text", "_mask"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce("source", F.lit("")).alias("_part"),
        F.unhex(F.sha2(text, 256)).alias("_text"), text.alias("_bytes"),
    )
    rows = materialize(rows.mapInArrow(run, "_id bigint, _part string, _text binary, _mask bigint"), "masks")
    # A text's copies meet as partial minima only; the join is on (text, id), so a text with
    # many copies is spread by their ids.
    lowest = rows.groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    lowest = lowest.withColumn("_key", F.coalesce("_id", F.lit(-1)))
    met = rows.withColumn("_key", F.coalesce("_id", F.lit(-1))).join(
        lowest.select("_text", "_key", F.col("_id").alias("_low"), "_first"), ["_text", "_key"], "left"
    )
    is_first = F.col("_first").isNotNull() & F.col("_id").eqNullSafe(F.col("_low"))
    mask = F.col("_mask") + F.when(is_first, 0).otherwise(1 << FILTERS.index("E"))
    return met.select("_id", "_part", mask.cast("int").alias("_mask"))


def _with_steps(parts: DataFrame) -> DataFrame:
    """Each row of ``parts`` for every order and step, with the bit of the step's filter and
    the bits of the filters before it."""
    orders = ",".join(map("".join, permutations(FILTERS)))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letters = F.split("filter_order", "")
    bits = F.transform(letters, lambda x: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), x) - 1))
    rows = rows.withColumn("_bits", bits)
    before = F.aggregate(F.slice("_bits", 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    return rows.withColumns({"bit": F.get("_bits", F.col("step") - 1), "before": before}).drop("_bits")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step), zeros included: what the step's filter does in
    this order within the part. Columns: part, filter_order, step (int), and the counts
    (bigint) kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null source as ''. A document is good or toxic when any of
    its rows in ``labels`` says so; a null id has no label. Repeated rows count one by one;
    none of them is smaller than the other, so E does not hold among them alone. Without
    documents there are no parts and no rows. Other columns are ignored.
    """
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(says("quality").alias("_good"), says("toxic").alias("_bad"))
    rows = failure_masks(docs).join(marks, "_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cells = rows.groupBy("_part", "_mask").agg(F.count(F.lit(1)).alias("n"), count("_good").alias("good"), count("_bad").alias("bad"))
    # at most 32 cells a part
    parts = cells.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "bad")).alias("cells"))
    steps = _with_steps(parts.select(F.col("_part").alias("part"), "cells"))

    def total(value, held) -> Column:
        add = lambda at, x: at + F.when(held(x["_mask"]), value(x)).otherwise(F.lit(0))
        return F.aggregate("cells", F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    now = lambda m: ~gone(m) & fails(m)
    field = lambda name: lambda x: x[name]
    # a document is removed by the first of the k filters it fails: by each in a k-th of the orders
    turns = lambda x: x["n"] * F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(x["_mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(field("n"), lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total(field("n"), now).alias("removed"),
        total(field("n"), lambda m: gone(m) & fails(m)).alias("redundant"),
        total(field("n"), lambda m: m == F.col("bit")).alias("unique_fails"),
        total(field("good"), now).alias("good_lost"),
        total(field("bad"), now).alias("toxic_lost"),
        total(turns, fails).alias("shapley"),
    )
