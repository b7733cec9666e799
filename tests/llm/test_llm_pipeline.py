"""The pipeline stage by stage against plain Python over the same rows."""

from collections import Counter

import pytest
from test_llm_operators import brute_lines, brute_print, check_pieces

import corpus_pipeline
from lexmill.llm import quality


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", None, 0), (5000, "", "en", None, 0)], docs.schema)
    return docs.unionByName(extra).selectExpr("*", "'x' as _kept", "1 as _size", "2 as _position", "3 as _gone")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "packing"]
    rows = docs.collect()
    one = stages["quality_rules"](spark, docs, "")
    values = quality.measure([(r.text or "").encode() for r in rows], quality.MIN_RUN)
    good = [
        r for r, v in zip(rows, values)
        if v[0] >= 50 and 100 * v[4] <= 50 * v[0] and v[5] <= quality.MAX_COVERED * v[0] and v[6] <= quality.MAX_LONGEST
    ]
    assert one.columns == docs.columns and rows_of(one) == Counter(map(tuple, good))

    two = stages["line_dedup"](spark, one, "")
    wanted = brute_lines([(r.doc_id, r.text) for r in good], 50)
    left = []
    for r in good:
        n, m, text = wanted[r.doc_id, r.text]
        if m < n:
            left.append((r.doc_id, text, r.lang, r.source, len(text) if m else r.n_chars, *r[5:]))
    assert two.columns == docs.columns and rows_of(two) == Counter(left)

    three = stages["near_duplicates"](spark, two, "")
    prints = {r[0]: brute_print(r[1]) for r in left}
    group = {k: k for k in prints}
    for _ in range(len(group)):
        new = {k: min(group[j] for j in prints if (prints[k] ^ prints[j]).bit_count() <= 2) for k in prints}
        if new == group:
            break
        group = new
    single = [r for r in left if group[r[0]] == r[0]]
    assert rows_of(three) == Counter(single)

    four = stages["mix_sources"](spark, three, "")
    taken = rows_of(four)
    assert four.columns == docs.columns and set(taken) <= set(single) and max(taken.values()) <= 3
    words = sum(len(r[1].split()) for r in single)
    assert abs(sum(n * len(r[1].split()) for r, n in taken.items()) - words) < 0.5 * words

    check_pieces(stages["packing"](spark, four, "").collect(), [r[:2] for r in four.collect()])


def test_near_duplicates_decide_by_row(spark):
    words = [" ".join(f"{w}{k}" for k in range(40)) for w in ("a", "b", "c", "d", "e", "f")]
    a, b, c, d, e, f = words
    rows = [
        (1, a, "x"), (1, a, "x"), (1, a, "w"),  # repeated rows of the smallest id
        (2, a, "x"), (None, a, "x"),            # copies with another id and without one
        (None, b, "x"), (None, b, "x"),         # a group without ids
        (3, c, "x"), (4, c, "x"), (4, d, "x"),  # one id with two texts, one of them a copy
        (5, e, None), (5, f, None),             # one id with two texts of their own
        (6, None, None), (7, "", None), (2**63 - 1, " ", None),
    ]
    docs = spark.createDataFrame([(i, t, s, {"k": 1}) for i, t, s in rows], "doc_id bigint, text string, source string, more map<string,int>").repartition(4)
    assert len({brute_print(w) for w in words}) == 6
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert left.columns == docs.columns
    wanted = [(1, a, "w"), (None, b, "x"), (3, c, "x"), (4, d, "x"), (5, e, None), (5, f, None), (6, None, None)]
    assert Counter(tuple(r)[:3] for r in left.collect()) == Counter(wanted)


def test_stages_of_nothing(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
