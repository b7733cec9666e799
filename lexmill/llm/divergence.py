"""Source divergence audit by a sparse merge of count arrays in pair tasks.

The terms of a language that enough of its documents hold are numbered in code-point
order. A group is a (language, source); its counts are sorted (term number, count) arrays,
cut into blocks of term numbers, so that an array is bounded whatever the vocabulary. The
sources of a language are dealt into teams; a task cogroups the arrays of two teams for
one block and merges every unordered pair of sources that belongs to it. The merge gallops:
runs of the shorter array are bracketed in the longer one by doubling steps from where the
last run ended, and searched inside the bracket only. Terms that both groups hold are
priced together, terms of one side against the other side's price of an absent term, and
terms that neither holds by their number. The blocks' sums add up to the pair's value, which
counts for both directions.

Counting combines inside the tasks: a task keeps counts per group and sends each term once.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.session import materialize

# Fixed values of the prices: 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)).
SCALE, PRIOR = 1_000_000_000, 5
LEAST_DOCS, TOP_TERMS = 30, 50
#: Terms of a block, sources of a team, array entries bracketed at once, and terms a task
#: counts before it sends them on; speed and memory depend on these, results do not.
BLOCK_TERMS, TEAM, RUN, HELD_TERMS = 1 << 16, 8, 256, 1 << 20

#: Term bytes (letters and all bytes outside ASCII) stay, A-Z in lower case; the rest separates.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def price(count, total: int, terms: int):
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) for int64 arrays, exactly: long
    division in three steps of 1000, which fits while total + 5 terms < 9 * 10^15."""
    whole = total + PRIOR * terms
    rest = np.asarray(count, np.int64) + PRIOR
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in short, in long) of the values that both ascending arrays hold."""
    mine, theirs, low = [], [], 0
    for at in range(0, len(short), RUN):
        run = short[at : at + RUN]
        step = RUN
        while low + step < len(long) and long[low + step] < run[-1]:
            step *= 2
        bracket = long[low : low + step + 1]
        if not len(bracket):
            break
        place = np.searchsorted(bracket, run)
        met = np.flatnonzero(bracket[np.minimum(place, len(bracket) - 1)] == run)
        mine.append(met + at)
        theirs.append(place[met] + low)
        low += int(place[-1])
    if not mine:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(mine), np.concatenate(theirs)


def pair_value(a: tuple, b: tuple, terms_here: int, terms: int) -> int:
    """Sum of |p - q| over the ``terms_here`` terms of a block. A group is (ids, counts, total)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    p, q = price(a[1], a[2], terms), price(b[1], b[2], terms)
    p0, q0 = int(price(0, a[2], terms)), int(price(0, b[2], terms))
    i, j = gallop(a[0], b[0])
    one = np.abs(p - q0)
    two = np.abs(q - p0)
    both = np.abs(p[i] - q[j]).sum()
    absent = terms_here - len(p) - len(q) + len(i)
    return int(both + one.sum() - one[i].sum() + two.sum() - two[j].sum()) + absent * abs(p0 - q0)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents that hold it, one
    row per group and term. A group without terms has one row with a null term."""

    def send(counts, held):
        rows = [(*g, w, n, held[g][w]) for g, c in counts.items() for w, n in c.items()]
        rows += [(*g, None, 0, 0) for g, c in counts.items() if not c]
        lang, source, term, n, d = zip(*rows)
        columns = [pa.array(lang), pa.array(source), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
        columns[:3] = [c.cast(pa.string()) for c in columns[:3]]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts, held, seen = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or b"").translate(_TERMS).split()
                c = counts[lang, source]
                seen -= len(c)
                c.update(words)
                seen += len(c)
                held[lang, source].update(set(words))
                if seen > HELD_TERMS:
                    yield send(counts, held)
                    counts, held, seen = defaultdict(Counter), defaultdict(Counter), 0
        if counts:
            yield send(counts, held)

    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text")
    )
    rows = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _merge_teams(left: pa.Table, right: pa.Table) -> pa.Table:
    """Values of all pairs between two teams (or within one) for one block."""

    def groups(t: pa.Table) -> dict:
        ids, counts = t.column("ids"), t.column("counts")
        totals = t.column("total").to_pylist()
        return {
            s: (np.asarray(ids[k].values, np.int64), np.asarray(counts[k].values, np.int64), totals[k])
            for k, s in enumerate(t.column("source").to_pylist())
        }

    out = []
    if left.num_rows and right.num_rows:
        lang, here, terms = (left.column(c)[0].as_py() for c in ("lang", "here", "terms"))
        a, b = groups(left), groups(right)
        same = left.column("team")[0] == left.column("other")[0]
        out = [(lang, s, t, pair_value(a[s], b[t], here, terms) if here else 0) for s in a for t in b if not same or s < t]
    names = ("lang", "a", "b", "value")
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in zip(names, columns)})


def pair_values(rows: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, team: int = TEAM) -> DataFrame:
    """(lang, a, b, value) for every unordered pair of a language's sources.

    ``rows``: (lang, source, id, n) with the ids 0.. of the kept terms. ``groups``: (lang,
    source, place, sources, total, terms), one row per group, place from 1.
    """
    blocks = F.greatest(F.ceil(F.col("terms") / block_terms).cast("long"), F.lit(1))
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.withColumn("here", F.least(F.lit(block_terms).cast("long"), F.col("terms") - F.col("block") * block_terms))
    arrays = rows.groupBy("lang", "source", F.floor(F.col("id") / block_terms).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("id", "n"))).alias("c")
    )
    none = F.array().cast("array<bigint>")
    filled = spread.join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "here", "terms", "total", "sources",
        F.floor((F.col("place") - 1) / team).alias("mine"),
        F.coalesce(F.col("c.id"), none).alias("ids"), F.coalesce(F.col("c.n"), none).alias("counts"),
    )
    filled = materialize(filled, "arrays")
    last = F.floor((F.col("sources") - 1) / team)
    kept = ["lang", "source", "block", "here", "terms", "total", "ids", "counts"]
    left = filled.select(*kept, F.col("mine").alias("team"), F.explode(F.sequence(F.col("mine"), last)).alias("other"))
    right = filled.select(*kept, F.explode(F.sequence(F.lit(0).cast("long"), F.col("mine"))).alias("team"), F.col("mine").alias("other"))
    key = ["lang", "block", "team", "other"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_merge_teams, "lang string, a string, b string, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value (bigint), rank (int).

    Part ``pair``: how far each other source of the language is, in parts of 10^9, summed
    over the language's kept terms. Part ``term``: the ``top_terms`` terms that the source
    holds furthest above its language. Ranks go by value descending, then item.

    Null texts, languages and sources are read as ''. Every row is a document, also a
    repeated one. A language without kept terms has pairs of value 0 and no term rows; a
    language with one source has no pairs. An empty table gives no rows. Other columns are
    ignored.
    """
    counts = materialize(term_counts(docs), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    numbered = ordered_scan(kept, ["lang"], ["term"], {"id": ("row_number",)}).withColumn("id", F.col("id") - 1)
    rows = materialize(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "rows")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    names = counts.select("lang", "source").distinct()
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang")
    groups = materialize(groups.select("lang", "source", "sources", zero("total"), zero("terms"), zero("lang_total")), "groups")
    placed = ordered_scan(groups, ["lang"], ["source"], {"place": ("row_number",)})
    pairs = materialize(pair_values(rows, placed), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    def priced(count: str, total: str):
        # decimals hold the product exactly; the quotient is at most 10^9
        up = (F.col(count).cast("decimal(20,0)") + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
        return F.call_function("div", up, F.col(total) + F.lit(PRIOR) * F.col("terms")) + 1

    met = rows.join(groups.drop("sources"), ["lang", "source"]).where("n > 0")
    met = met.withColumn("value", priced("n", "total") - priced("lang_n", "lang_total")).where("value > 0")
    terms = met.select("lang", "source", F.col("term").alias("item"), "value")
    # the rank's limit is applied before the exchange too, so no group travels whole
    term_rows = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pair_rows.select(*names).unionByName(term_rows.select(*names))
