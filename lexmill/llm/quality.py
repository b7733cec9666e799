"""Quality rules by suffix-array repetition.

For a batch of texts one suffix array over words is built by prefix doubling; suffixes of
different texts never compare equal, since the text's number is part of the first rank.
Only suffixes that are not yet alone go on, so a round costs what is still repeated.
Neighbours in the array give every suffix the longest prefix it shares with another one
of its text. Such common-prefix intervals are the maximal repeated substrings; the union
of their spans is the covered part of a text. A text is limited in the share of words
that repeats of ``min_run`` words or more may cover, and in its longest single repeat.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.columns import passing_through

# Fixed values of the base rules: symbols, fewest words, most percent of repeated words, window.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_PERCENT, WINDOW = 50, 50, 3
#: The method's limits: repeats of so many words count, they may cover this share of the
#: words, and no repeat may be longer than this.
MIN_RUN, MAX_COVERED, MAX_LONGEST = 8, 0.3, 200
#: Words in one suffix array; it bounds memory only. A longer text gets its own array.
BATCH_WORDS = 200_000

_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space; continuation bytes


def longest_repeats(ids: np.ndarray, text: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """For every position the number of words from it that also start at another position
    of the same text; 0 when fewer than ``least`` (2 at least). ``ids`` are word numbers,
    ``text`` is the ascending number of each word's text."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    end = np.searchsorted(text, text, side="right")
    key = text * (int(ids.max()) + 1) + ids
    array = np.argsort(key, kind="stable")
    # the rank of a suffix is the place of the first suffix that is equal so far
    first = np.concatenate([[True], np.diff(key[array]) != 0])
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    active, levels, h = array[~alone], [], 1
    while len(active):
        levels.append((h, rank.copy()))
        ahead = active + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)  # the end sorts first
        order = np.argsort(rank[active] * (n + 1) + second, kind="stable")
        a, r, s = active[order], rank[active][order], second[order]
        group = np.concatenate([[True], np.diff(r) != 0])
        step = group | np.concatenate([[True], np.diff(s) != 0])
        i = np.arange(len(a))
        rank[a] = r + np.maximum.accumulate(np.where(step, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        alone = step & np.append(step[1:], True)
        active, h = a[~alone], 2 * h
    array[rank] = np.arange(n)
    if len(levels) < 2:
        return longest
    two = levels[1][1]
    pairs = np.nonzero(two[array[:-1]] == two[array[1:]])[0]  # neighbours with two words in common
    p, q = array[pairs], array[pairs + 1]
    common = np.zeros(len(pairs), np.int64)
    for h, level in reversed(levels):
        at, to = p + common, q + common
        ok = (at < end[p]) & (to < end[q])
        ok[ok] = level[at[ok]] == level[to[ok]]
        common[ok] += h
    np.maximum.at(longest, p, common)
    np.maximum.at(longest, q, common)
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Mask of the words in the union of the spans of ``least`` words or more."""
    at = np.nonzero(longest >= least)[0]
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], min_run: int) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words,
    longest repeat."""
    out = np.zeros((len(texts), 7), np.int64)
    number: defaultdict = defaultdict(count().__next__)
    ids, sizes, low = [], [], 0

    def flush(high: int) -> None:
        nonlocal ids, sizes, low
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        longest = longest_repeats(np.array(ids, np.int64), owner)
        k = len(sizes)
        out[low:high, 4] = np.bincount(owner, covered(longest, WINDOW), k)
        out[low:high, 5] = np.bincount(owner, covered(longest, min_run), k)
        np.maximum.at(out[low:high, 6], owner, np.where(longest >= min_run, longest, 0))
        ids, sizes, low = [], [], high
        number.clear()

    for i, text in enumerate(texts):
        words = text.split()  # bytes.split() knows ASCII white space only
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, :4] = (
            len(words),
            len(text.translate(None, _NOT_COUNTED)),
            len(text.translate(None, _NOT_SYMBOL)),
            len(lines) - len(set(lines)),
        )
        if ids and len(ids) + len(words) > BATCH_WORDS:
            flush(i)
        ids += map(number.__getitem__, words)
        sizes.append(len(words))
    if sizes:
        flush(len(texts))
    return out


@passing_through("text")
def judge_quality(
    docs: DataFrame, min_run: int = MIN_RUN, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """``docs`` with the columns _n_words, _word_chars, _n_symbols, _n_dup_lines,
    _n_repeat_words, _covered, _longest (bigint), _base_failed and _kept (boolean).

    A null text counts as empty and fails the base rules like any text of few words. The
    decision depends on the row alone: repeated rows get equal answers, other columns pass
    through, no row is dropped; an input column with the name of an added one gives way to
    it. No data is exchanged between tasks.
    """
    names = docs.columns
    found = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_covered", "_longest"]

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 1_000):
                batch = whole.slice(low, 1_000)
                values = measure([t.as_py() or b"" for t in batch.column(batch.num_columns - 1)], min_run)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array(values[:, k]) for k in range(7))], names=[*names, *found]
                )

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in found)])
    rows = docs.withColumn("_bytes", F.col("text").cast("binary")).mapInArrow(run, schema)
    failed = (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_PERCENT * F.col("_n_words"))
    fine = (F.col("_covered") <= F.lit(max_covered) * F.col("_n_words")) & (F.col("_longest") <= max_longest)
    return rows.withColumn("_base_failed", failed).withColumn("_kept", ~failed & fine)
