"""Text expressions, tokens, vocabularies and encodings on hand-made rows."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.functions import sequences as sq
from lexmill.functions import text as tx
from lexmill.operators import encode, shape, tabular, tokens
from lexmill.session import scratch_path
from lexmill.sources import encoded, tables, translations


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_tags(spark):
    df = spark.createDataFrame([(["b", "a", "b", None],), ([],), (None,), (["x"],)], "t array<string>")
    assert values(df, tx.keep_tags("t", ["a", "b"])) == [["b", "a", "b"], [], None, []]
    assert values(df, tx.first_tag_label("t")) == ["b", "other-tags", "other-tags", "x"]


def test_text_expressions(spark):
    df = spark.createDataFrame([("a<br /><br />b-c/d<br />e",), ("",), ("   ",), (None,)], "t string")
    assert values(df, tx.clean_review("t")) == ["a b c d<br  >e", "", "   ", None]
    assert values(df, tx.word_count("t"))[1:3] == [1, 4]
    assert values(df, tx.words("t"))[1:3] == [[], []]
    two = spark.createDataFrame([("x", None), ("x", "y")], "a string, b string")
    assert values(two, tx.combine_text("a", "b")) == [None, "xy"]
    de = spark.createDataFrame([("Fuer Muenchen", "de"), ("blue", "en")], "t string, l string")
    assert values(de, tx.restore_umlauts("t", "l")) == ["Für München", "blue"]
    raw = spark.createDataFrame([(b"\xc3\xa9t\xc3\xa9", b"1")], "t binary, l binary")
    assert raw.select(tx.decode_text("t"), tx.decode_label("l")).first()[:] == ("été", 1)
    assert values(spark.createDataFrame([("A.b; [c] (d)!",)], "t string"), tx.strip_punct("t")) == ["ab c d"]


def test_word_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert values(df, tx.word_ngrams("w", 1, 3)) == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 900])
def test_pad_front(spark, n):
    ids = list(range(1, n + 1))
    got = values(spark.createDataFrame([(ids,)], "s array<int>"), sq.pad_front("s", 500))[0]
    assert got == [0] * max(0, 500 - n) + ids[-500:] if n else got == [0] * 500


@pytest.mark.parametrize("n", [0, 125, 126, 127, 128, 129])
def test_encode_ids_at_the_limit(spark, n):
    ids = list(range(1000, 1000 + n))
    e = values(spark.createDataFrame([(ids,)], "s array<int>"), sq.encode_ids("s", 128))[0]
    kept = ids[:126]
    assert list(e.input_ids) == [101, *kept, 102] + [0] * (126 - len(kept))
    assert sum(e.attention_mask) == len(kept) + 2 and len(e.attention_mask) == len(e.token_type_ids) == 128
    blank = values(spark.createDataFrame([(None,)], "s array<int>"), sq.encode_ids("s", 8))[0]
    assert sum(blank.input_ids) + sum(blank.attention_mask) == 0


def test_pair_encoding_removes_one_by_one(spark):
    cases = [(la, lb) for la in range(0, 14, 1) for lb in range(0, 14, 3)]
    df = spark.createDataFrame([(list(range(1, a + 1)), list(range(501, 501 + b))) for a, b in cases], "a array<int>, b array<int>")
    got = values(df, sq.encode_pair_ids("a", "b", 13))
    for (la, lb), e in zip(cases, got):
        a, b = list(range(1, la + 1)), list(range(501, 501 + lb))
        while len(a) + len(b) > 10:
            (a if len(a) > len(b) else b).pop()
        real = [101, *a, 102, *b, 102]
        assert list(e.input_ids) == real + [0] * (13 - len(real))
        assert list(e.token_type_ids) == [0] * (len(a) + 2) + [1] * (len(b) + 1) + [0] * (13 - len(real))


DOCS = [(1, "aa bb bb cc"), (2, "bb cc dd"), (3, ""), (4, "  "), (5, "ee dd aa aa")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_vocabulary_limits_and_ties(spark, docs):
    counts, n = tokens.term_counts(docs), docs.agg(F.count("*")).scalar()
    terms = lambda *a: {r.term: r.term_id for r in tokens.build_vocab(counts, n, *a).collect()}
    assert terms() == {"aa": 0, "bb": 1, "cc": 2, "dd": 3, "ee": 4}
    assert terms(1, 1.0, 3) == {"aa": 0, "bb": 1, "cc": 2}  # aa and bb 3 times; cc beats dd by name
    assert set(terms(2, 1.0, None)) == {"aa", "bb", "cc", "dd"}
    assert set(terms(0.3, 1.0, None)) == {"aa", "bb", "cc", "dd"}
    assert set(terms(1.0, 1, None)) == {"ee"}
    assert set(terms(1.0, 0.2, None)) == {"ee"}


def test_weights_have_unit_norm(spark, docs):
    counts, n = tokens.term_counts(docs), docs.agg(F.count("*")).scalar()
    w = tokens.idf(tokens.build_vocab(counts, n), n)
    assert math.isclose(next(r.idf for r in w.collect() if r.term == "ee"), math.log(6 / 2) + 1)
    for norm, total in (("l2", F.sqrt(F.sum(F.col("weight") ** 2))), ("l1", F.sum("weight"))):
        assert all(math.isclose(r[1], 1.0) for r in tokens.tfidf(counts, w, norm).groupBy("doc_id").agg(total).collect())
    raw = {(r.doc_id, r.term): r.weight for r in tokens.tfidf(counts, w, "None").collect()}
    assert math.isclose(raw[(1, "bb")], 2 * (math.log(6 / 3) + 1))


def test_word_index_and_sequences(spark):
    df = spark.createDataFrame([(2, "b, a! a"), (1, "C b"), (3, ""), (4, "zz")], "doc_id long, text string")
    index = tokens.word_index(df)
    assert {r.word: r.idx for r in index.collect()} == {"b": 1, "a": 2, "c": 3, "zz": 4}  # b appears before a
    assert {r.word: r.idx for r in tokens.word_index(df, num_words=4).collect()} == {"b": 1, "a": 2, "c": 3}
    seq = {r.doc_id: list(r.ids) for r in tokens.to_sequences(df, index, 3).collect()}
    assert seq == {1: [1], 2: [1, 2, 2], 3: [], 4: []}


def test_case_collisions_and_alignment(spark):
    df = spark.createDataFrame([("Pierre pierre PIERRE Haus",)], "text string")
    r = tokens.case_collisions(df).collect()
    assert [(x.word, x.n_forms, x.forms) for x in r] == [("pierre", 3, "PIERRE|Pierre|pierre")]
    pair = spark.createDataFrame([(1, [5, 6, 7], [8])], "k int, a array<int>, b array<int>")
    assert [(x.pos, x.id_a, x.id_b) for x in tokens.align_tokens(pair, "a", "b", ["k"]).orderBy("pos").collect()] == [(0, 5, 8), (1, 6, 0), (2, 7, 0)]


def greedy(word, vocab, limit=None):
    if limit is not None and len(word) > limit:
        return ["[UNK]"]
    at, out = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out or ["[UNK]"]


def test_subwords_are_greedy(spark):
    vocab = ["un", "unb", "##b", "##elie", "##able", "##e", "##v", "##a", "a", "##ble", "b", "##aa"]
    words = ["unbeliev", "unbelievable", "unq", "a", "b", "aaaa", "a" * 100, "a" * 101, "baaab"]
    v = spark.createDataFrame([(p,) for p in vocab], "piece string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    for limit in (None, 100):  # no length limit unless one is asked for
        got = {r.word: list(r.pieces) for r in encode.subword_tokens(w, v, limit).collect()}
        assert got == {x: greedy(x, set(vocab), limit) for x in words}


def test_subwords_of_long_words_and_bounded_vocabularies(spark):
    v = spark.createDataFrame([("a",), ("##a",), ("##aa",), ("##",), ("",), (None,)], "piece string")
    w = spark.createDataFrame([("a" * 100_001,), ("",), (None,), ("a" * 100_000 + "b",)], "word string")
    got = {r.word: list(r.pieces) for r in encode.subword_tokens(w, v).collect()}
    assert got["a" * 100_001] == ["a"] + ["##aa"] * 50_000
    assert got[""] == got[None] == got["a" * 100_000 + "b"] == ["[UNK]"]
    with pytest.raises(ValueError):
        encode.subword_tokens(w, v, max_pieces=3)


def test_encoded_files(spark):
    e = spark.createDataFrame([(1, [1, 2], [1, 1], [0, 0], None), (2, [3, 0], [1, 0], [0, 0], 1)],
                              "doc_id long, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>, label long")
    path = scratch_path(spark, "t")
    encoded.write_encoded(e, path)
    back = encoded.read_encoded(spark, path, 2)
    assert {(r.doc_id, r.label) for r in back.collect()} == {(1, 0), (2, 1)}
    with pytest.raises(PySparkException):
        encoded.read_encoded(spark, path, 128).collect()
    with pytest.raises(AssertionError):
        encoded.assert_round_trip(e, back)
    assert encoded.assert_round_trip(back, encoded.read_encoded(spark, path, 2)) == 2
    twice = back.unionByName(back)
    assert encoded.round_trip(twice, back).first().only_written == 2


def test_csv_repair(spark):
    lines = spark.createDataFrame([(" 1, a, ?. ",), ("",), ("no comma",), ("2, b, 3",), ("\t3,c,4..",)], "value string")
    clean = tables.clean_csv_lines(lines)
    assert values(clean, F.col("value")) == ["1,a,?", "2,b,3", "3,c,4."]
    assert [tuple(r) for r in tables.parse_csv_lines(clean, "i int, s string, n double").collect()][:2] == [(1, "a", None), (2, "b", 3.0)]


def test_create_table_fails_when_it_exists(spark):
    path = scratch_path(spark, "t")
    name = "t_" + path[-12:]
    tables.create_table_as(spark.range(3), name, path)
    with pytest.raises(PySparkException):
        tables.create_table_as(spark.range(3), name, path)
    assert spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_translations_survive_blank_lines(spark):
    src = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "item long, text string")
    placed = translations.number_batches(src, "item", 2)
    assert sorted((r.batch, r.pos) for r in placed.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    lines = []
    for i in range(5):
        base = (i % 2) * 3
        lines += [("it", i // 2, base, f"u{i}\n"), ("it", i // 2, base + 1, ""), ("it", i // 2, base + 2, " ")]
    got = translations.import_translations(placed, spark.createDataFrame(lines, "lang string, batch long, line_no long, value string"), 2)
    assert sorted((r.item, r.translation) for r in got.collect()) == [(i, f"u{i}") for i in range(5)]


def test_split_properties(spark):
    df = spark.range(2000)
    a = shape.hash_split(df.repartition(1), "id", 20)
    b = shape.hash_split(df.repartition(8), "id", 20)
    assert a.exceptAll(b).count() == 0 and a.count() == 2000
    share = a.where("part = 'eval'").count() / 2000
    assert 0.16 < share < 0.24
    assert shape.hash_split(df, "id", 0).where("part = 'eval'").count() == 0
    for frac in (0, 1, 1.5, -1):
        assert shape.sample_fraction(df, "id", frac).count() == 2000
    assert 0 < shape.sample_fraction(df, "id", 0.1).count() < 400


def test_stratified_quota(spark):
    df = spark.range(103).withColumn("label", F.when(F.col("id") < 70, "a").when(F.col("id") < 101, "b"))
    got = shape.stratified_split(df, "id", "label", 0.5)
    counts = {(r.label, r.part): r["count"] for r in got.groupBy("label", "part").count().collect()}
    assert got.count() == 103 and sum(n for (_, p), n in counts.items() if p == "train") == 51
    assert counts[("a", "train")] == 35 and counts[("b", "train")] in (15, 16) and counts[(None, "train")] == 1


def test_batches_round_trip(spark):
    df = spark.range(70).withColumn("x", F.col("id") * 2)
    b = shape.batch(df, 32, "id", ["id", "x"])
    assert sorted(len(r.id) for r in b.collect()) == [6, 32, 32]
    assert shape.unbatch(b, ["id", "x"]).select("id", "x").exceptAll(df).count() == 0
    rep = shape.repeat(spark.range(10), 2, "id")
    assert sorted(r.pos for r in rep.where("epoch = 1").collect()) == list(range(10)) and rep.count() == 20
    order = [r.id for r in rep.where("epoch = 0").orderBy("pos").collect()]
    assert order != [r.id for r in rep.where("epoch = 1").orderBy("pos").collect()]


def test_canonical_shift(spark):
    df = spark.createDataFrame([(7, "b", 1), (3, "a", 0)], "k long, t string, l int")
    got = shape.to_canonical(df, "k", "t", "l", 100).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(100, 0, "a"), (101, 1, "b")]
    assert shape.to_canonical(df, "k", "t", "l").dtypes == [("idx", "int"), ("label", "bigint"), ("sentence", "string")]


def test_tabular(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "zz", 60)], "k long, c string, n int")
    assert values(tabular.category_codes(df, {"c": ["b", "a"]}), F.col("c")) == [1, -1, -1]
    z = tabular.standardize(tabular.numeric_to_float(df.where("k < 3"), ["k"]), tabular.numeric_to_float(df.where("k = 3"), ["k"]), ["n"])
    got = {r.k: (r.part, round(r.n, 6)) for r in z.collect()}
    assert got[3] == ("eval", round((60 - 30) / math.sqrt(700), 6)) and got[1][0] == "train"
    enc = tabular.encode_labels(df, "c")
    assert values(enc.orderBy("k"), F.col("code")) == [0, None, 1]
    classes = tabular.class_table(df, "c")
    assert values(tabular.decode_labels(enc, "code", classes, "back").orderBy("k"), F.col("back")) == ["a", None, "zz"]


def test_tasks_follow_the_bytes_of_text(spark, monkeypatch):
    """A task takes apart a bounded amount of text; repeated and null keys still meet."""
    rows = [(i % 90 if i % 10 else None, f"Ab cd ab w{i} x{i} y{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lambda: tokens.term_counts(df)
    grams = lambda: tokens.ngram_counts(df, 1, 3)
    usual = [sorted(map(tuple, f().collect()), key=str) for f in (counts, grams)]
    before = [f().rdd.getNumPartitions() for f in (counts, grams)]
    monkeypatch.setattr(tokens, "TASK_BYTES", 256)
    assert [sorted(map(tuple, f().collect()), key=str) for f in (counts, grams)] == usual
    size = sum(len(t) for _, t in rows)
    assert counts().rdd.getNumPartitions() == -(-size // 256) > before[0]
    assert grams().rdd.getNumPartitions() == -(-size * 6 // 256) > before[1]
    index = tokens.word_index(df, num_words=50)
    assert tokens.to_sequences(df, index, 50).count() == len({k for k, _ in rows})
