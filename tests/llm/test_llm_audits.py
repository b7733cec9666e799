"""Language ID and the two audits: brute force, nulls, ties, repeated rows, empty tables,
long texts and extra columns with clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from compare import compare, duck

from lexmill.llm import audit_queries, divergence, filteraudit, langfilter

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, term string, k int, _mask int, score string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3, "s", "p") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["Ab", "ab", "the", "of", "Éa", "éa", "x1y", "don't", "naïve", "ZZZ", "q", "#tag", "50%", "日本"] + [f"w{chr(97 + k)}" for k in range(20)]
    out = []
    for k in range(400):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", "\x0b", "\x1c", " ", ","]) for _ in range(r.choice([3, 20, 60, 120])))
        out.append((k, text, r.choice(["en", "de", "en", None]), r.choice(["a", "a", "a", "b", "", None, "z9"])))
    out += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "", None, "b"), (None, "", "en", "z"), (None, out[3][1], "fr", "only"), (3, *out[3][1:]), (600, out[7][1], "en", "b")]
    out += [(601, out[7][1], "de", "b"), (602, " \n ", "xx", "none"), (603, "y" * 3_000_000 + " end #", "en", "long"), (604, "ab the " * 400_000, "en", "long")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def duck_with(rows, labels=()):
    import pandas as pd

    con = duck("/root/testdata/sf0.001")
    # the SQL engine gets the same rows under the same names
    d = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    m = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64")  # noqa: F841
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM d")
    con.execute("CREATE OR REPLACE TEMP VIEW labels AS SELECT * FROM m")
    con.execute("CREATE TABLE keep_d AS SELECT * FROM documents")
    con.execute("CREATE TABLE keep_m AS SELECT * FROM labels")
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM keep_d")
    con.execute("CREATE OR REPLACE TEMP VIEW labels AS SELECT * FROM keep_m")
    return con


# ---- filter interaction audit


def spaced(text: bytes) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]


def test_transducer_counts(rows, monkeypatch):
    texts = [(t or "").encode() for _, t, _, _ in rows]
    wanted = []
    for t in texts:
        words = spaced(t)
        s = t.decode()
        wanted.append([len(words), len(set(words)), len(re.findall("[A-Z]", s)), len(s), len(re.findall(r"[#$%&*|]", s))])
    assert filteraudit.profile(texts).tolist() == wanted
    for piece in (1, 3, 64):  # words and characters cut by pieces, texts sharing tables or not
        monkeypatch.setattr(filteraudit, "PIECE", piece)
        monkeypatch.setattr(filteraudit, "BATCH_BYTES", 100 * piece)
        short = [t for t in texts if len(t) < 400][:60]
        assert filteraudit.profile(short).tolist() == [w for t, w in zip(texts, wanted) if len(t) < 400][:60]
    assert filteraudit.profile([]).shape == (0, 5)


def test_hash_table_verifies_bytes():
    """With all hashes equal the bytes alone decide."""
    data = np.frombuffer(b"ab ab cd ab ce cd", np.uint8)
    start, size = np.arange(0, 17, 3), np.full(6, 2)
    for owner, new in (([0] * 6, [1, 0, 1, 0, 1, 0]), ([0, 0, 0, 1, 1, 1], [1, 0, 1, 1, 1, 1])):
        found = filteraudit.distinct_spans(data, start, size, np.array(owner), np.zeros(6, np.uint64))
        assert found.tolist() == [bool(x) for x in new]


def brute_audit(rows, labels):
    good, bad = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    fails = []
    for i, t, _, s in rows:
        text = (t or "").encode()
        words, plain = spaced(text), text.decode()
        own = set()
        if len(words) < 50:
            own.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", plain)) > 5 * len(plain):
            own.add("C")
        if re.search(r"[#$%&*|]", plain):
            own.add("D")
        others = [j for j, u, *_ in rows if (u or "") == (t or "") and j is not None]
        if others and (i is None or min(others) < i):
            own.add("E")
        fails.append((s or "", frozenset(own), i in good and i is not None, i in bad and i is not None))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                mine = [x for x in fails if x[0] == part]
                left = [x for x in mine if not x[1] & set(order[:k])]
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                out[part, "".join(order), k + 1] = (
                    len(left) - len(gone), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone),
                )
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(k, k % 3 % 2, k % 7 == 0) for k in range(0, 300, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (600, None, None)]


def test_filter_audit(spark, docs, rows, empty):
    marks = [(i, q, None if t is None else int(t)) for i, q, t in LABELS]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = filteraudit.audit_filters(docs, labels)
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert got == brute_audit(rows, marks)
    assert compare(found, duck_with(rows, marks), audit_queries.OP13_SQL) == ""
    assert filteraudit.audit_filters(empty, labels).count() == 0
    bare = filteraudit.audit_filters(docs, labels.limit(0)).selectExpr("sum(good_lost) g", "sum(toxic_lost) t").first()
    assert tuple(bare) == (0, 0)


# ---- source divergence audit


def test_gallop():
    r = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (3, 10_000), (2_000, 100_000), (700, 700), (1, 1)):
        a, b = (np.sort(r.choice(120_000, k, replace=False)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_price_is_exact():
    for n, total, terms in ((0, 0, 1), (7, 10**15, 3), (10**14, 10**15, 10**6), (123456789012345, 123456789012346, 77)):
        assert int(divergence.price(np.array([n]), total, terms)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * terms)


@pytest.mark.parametrize("least", [1, 5, 10_000])
def test_pair_values(spark, docs, rows, least):
    """Small blocks and teams, so that every way through the merge is taken."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    found = divergence.audit_sources(docs, least_docs=least).collect()
    wanted = []
    for (lang, source), own in counts.items():
        kept = sorted((w for w, n in held[lang].items() if n >= least), key=str.encode)
        price = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p = price(own)
        others = [(s, price(c)) for (k, s), c in counts.items() if k == lang and s != source]
        pairs = [(s, sum(abs(p[w] - q[w]) for w in kept)) for s, q in others]
        every = price(sum((c for (k, _), c in counts.items() if k == lang), Counter()))
        terms = [(w, p[w] - every[w]) for w in kept if own[w] and p[w] > every[w]]
        for part, items, most in (("pair", pairs, 10**9), ("term", terms, 50)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            wanted += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    assert Counter(map(tuple, found)) == Counter(wanted)


def test_blocks_and_teams(spark, rows):
    docs = frame(spark, [(i, t, "en", f"s{i or 0}") for i, t, *_ in rows[:40]])
    counts = divergence.term_counts(docs).where("term is not null")
    terms = {w: k for k, w in enumerate(sorted({r.term for r in counts.select("term").collect()}, key=str.encode))}
    table = spark.createDataFrame([(r.lang, r.source, terms[r.term], r.n) for r in counts.collect()], "lang string, source string, id bigint, n bigint")
    names = sorted({r.source for r in table.collect()})
    totals = Counter()
    for r in table.collect():
        totals[r.source] += r.n
    groups = spark.createDataFrame(
        [("en", s, k + 1, len(names), totals[s], len(terms)) for k, s in enumerate(names)],
        "lang string, source string, place bigint, sources bigint, total bigint, terms bigint",
    )
    whole = Counter(map(tuple, divergence.pair_values(table, groups).collect()))
    assert len(whole) == len(names) * (len(names) - 1) // 2
    assert Counter(map(tuple, divergence.pair_values(table, groups, block_terms=7, team=3).collect())) == whole


def test_divergence_against_sql(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    assert compare(divergence.audit_sources(docs), duck_with(rows), audit_queries.OP12_SQL) == ""
    assert divergence.audit_sources(empty).count() == 0


# ---- language ID


def test_normalise():
    assert langfilter.normalise("Ab, ÇÀ!9z\n") == " ab çà z ".encode()
    assert langfilter.normalise("12 #\n") == langfilter.normalise("") == langfilter.normalise("́ ́") == b""


def made_texts(n=900):
    """Three made languages: stems of their own, some shared."""
    r = random.Random(8)
    stems = {"x": "zorp quil vand tesk".split(), "y": "blim orna fust eyle".split(), "z": "mura öken dås pyrt".split()}
    shared = "nolo vita bera".split()
    out = []
    for k in range(n):
        lang = r.choice("xxxyyz")
        words = [r.choice(stems[lang]) + r.choice(["", "en", "a", "ik"]) if r.random() < 0.7 else r.choice(shared) for _ in range(r.choice([4, 30, 90]))]
        out.append((k, " ".join(words), lang, "s"))
    return out


def test_language_filters(spark, empty):
    rows = made_texts()
    odd = [(1000, None, "x", None), (1001, "", "y", None), (1002, "12 %", "z", None), (1003, "zorp " * 300_000, None, None), (None, "Blim orna", "y", None)]
    odd += [rows[4], rows[4], (1004, "Ñandú", None, None)]
    docs = frame(spark, rows + odd)
    filters = langfilter.fit_languages(docs)
    assert sorted(filters.languages) == ["x", "y", "z"] and filters.languages[0] == "x"
    found = langfilter.predict_languages(docs, filters).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(by_id[r[0]].held_out == (r in held) for r in rows)
    assert sum(by_id[r[0]].lang_pred == r[2] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "x", "y"]
    assert langfilter.predict_languages(empty, filters).count() == 0
    none = langfilter.fit_languages(docs.where("lang is null"))
    assert {r.lang_pred for r in langfilter.predict_languages(docs, none).collect()} == {"und"}
    assert langfilter.fit_languages(empty).languages == []


def test_filters_hold_every_gram_and_correct_strangers(spark):
    """Against exact sets: no gram is missed, strangers pass at the expected rate, and the
    counts of whole texts, of pieces and of single n-grams agree."""
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(1, 2**40, n)) for n in (3_000, 500, 40)] + [np.unique(r.integers(1, 2**40, 900)) for _ in range(7)]
    rows = [(k, int(g)) for k, s in enumerate(sets) for g in s]
    filters = langfilter.build_filters(spark.createDataFrame(rows, "k int, gram bigint"), [f"l{k}" for k in range(10)])
    assert filters.masks.shape[1] == 2
    for k, s in enumerate(sets):
        masks = filters.languages_with(s.astype(np.uint64))
        assert ((masks[:, k // 8] >> (k % 8)) & 1).all()
    strange = r.integers(2**41, 2**42, 200_000).astype(np.uint64)
    passed = filters._popcounts(filters.languages_with(strange), np.array([0, len(strange)]))[0] / len(strange)
    assert np.allclose(passed, filters.wrong, rtol=0.15, atol=2e-4)


def test_counts_of_pieces(spark, monkeypatch):
    docs = frame(spark, made_texts(300))
    filters = langfilter.fit_languages(docs)
    texts = [langfilter.normalise(t) for _, t, _, _ in made_texts(60)] + [b"", b" a "]
    whole = filters.count(texts)
    for piece in (5, 50, 400):
        monkeypatch.setattr(langfilter, "PIECE", piece)
        cut = filters.count(texts)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()
    for text, hits, n in zip(texts, *whole):
        found = [(s, text[i : i + s]) for s in (3, 4) for i in range(len(text) - s + 1)]
        assert len(found) == n
        one = sum((filters._popcounts(filters.languages_with(langfilter.grams(np.frombuffer(g, np.uint8), s)), np.array([0, 1]))[0] for s, g in found), np.zeros(3, int))
        assert (one == hits).all()
