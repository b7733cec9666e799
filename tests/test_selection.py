"""Quantiles by narrowing, heavy hitters, the macro curve and Naive Bayes for many classes,
against direct computations."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import many_classes, profile, roc


@pytest.mark.parametrize("small", [0, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(profile, "SMALL", small)
    r = np.random.default_rng(5)
    rows = [(g, float(v)) for g, vs in {"a": r.normal(size=30_000), "b": r.integers(0, 5, 4_000), "c": 10.0 ** r.uniform(-300, 300, 25_000)}.items() for v in vs]
    rows += [("d", 7.0), (None, 1.0), (None, 2.0), ("a", None), ("e", None), ("a", -0.0), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    if small == 0:  # brackets need room on both sides of a rank
        groups = {g: v for g, v in groups.items() if len(v) > 20_000}
    found = {x.g: x for x in profile.describe_numeric(df, "v", ["g"]).collect()}
    many = {x.g: x.quantiles for x in profile.quantiles(df, "v", qs, ["g"]).collect()}
    assert small == 0 or set(many) == set(groups)
    for g, v in groups.items():
        own = [float(x) for x in np.sort(v)]
        wanted = []
        for q in qs:
            pos = q * (len(own) - 1)
            low, high = own[math.floor(pos)], own[math.ceil(pos)]
            wanted.append(low + (high - low) * (pos - math.floor(pos)) if low != high else low)
        assert many[g][:4] == pytest.approx(wanted[:4])
        assert found[g]["count"] == len(own) and found[g]["min"] == own[0] and found[g]["q50"] == pytest.approx(wanted[2])
    assert profile.quantiles(df.where("v is null"), "v", qs).where("quantiles[0] is not null").count() == 0


def test_quantile_plan_sorts_no_values(spark):
    """The second pass keeps what lies in the brackets only."""
    df = spark.range(300_000).selectExpr("cast(hash(id) as double) as v")
    values = profile._narrow(df, "v", [], True)
    near = values.agg(*profile._sketch([0.5])).first()
    assert near.total == 300_000
    inside = df.where((F.col("v") >= near.near[0]) & (F.col("v") <= near.near[1])).count()
    assert 0 < inside < 600
    own = np.sort([x.v for x in df.collect()])
    assert profile.quantiles(df, "v", [0.5]).first().quantiles == [pytest.approx(np.median(own))]


def test_top_values_are_exact(spark):
    r = np.random.default_rng(3)
    even = [f"e{k}" for k in range(3_000)] * 2
    skewed = [f"s{min(int(x), 4_000)}" for x in r.zipf(1.3, 6_000)]
    few = [None if k % 11 == 0 else "xyz"[k % 3] for k in range(6_000)]
    rows = list(zip(even, skewed, few, [None] * 6_000))
    df = spark.createDataFrame(rows, "even string, skewed string, few string, none string").repartition(5)
    for capacity in (16, 64, 5_000):
        got = defaultdict(list)
        for x in sorted(profile.top_values(df, 4, capacity=capacity).collect(), key=lambda x: x["rank"]):
            got[x["column"]].append((x["value"], x["n"]))
        for name, values in (("even", even), ("skewed", skewed), ("few", few)):
            counts = Counter(v for v in values if v is not None)
            assert got[name] == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:4]
        assert "none" not in got
    assert profile.top_values(df.limit(0), 4).count() == 0


def test_macro_curve_is_the_mean_of_the_curves(spark):
    r = np.random.default_rng(9)
    rows = [(int(y), [float(x) for x in np.round(r.random(4), 1)]) for y in r.integers(0, 3, 60)]  # class 3 has no positives
    df = spark.createDataFrame(rows, "label int, prob array<double>")
    points = defaultdict(list)
    for p in roc.roc_per_class(df, [0, 1, 2, 3]).collect():
        points[p["class"]].append((p.fpr, p.tpr))
    knots = {c: {x: (min(t for f, t in v if f == x), max(t for f, t in v if f == x)) for x, _ in v} for c, v in points.items() if v[0][1] is not None}

    def at(curve, x):
        if x in curve:
            return curve[x][1]
        a, b = max(k for k in curve if k < x), min(k for k in curve if k > x)
        return curve[a][1] + (curve[b][0] - curve[a][1]) * (x - a) / (b - a)

    rates = {x for v in points.values() for x, _ in v}
    got = {p.fpr: p.tpr for p in roc.roc_macro(df, [0, 1, 2, 3]).collect()}
    assert got.keys() == rates and len(knots) == 3
    for x in rates:
        assert got[x] == pytest.approx(sum(at(c, x) for c in knots.values()) / 4)


# ---- Naive Bayes for many classes


def brute_classes(train, test, alpha=1.0):
    sums, n = defaultdict(Counter), Counter()
    vocab = set()
    for key, label, words in train:
        if label is None:
            continue
        n[label] += 1
        for w, x in words.items():
            sums[label][w] += x
            vocab.add(w)
    out = {}
    for key, _, words in test:
        scores = {}
        for c in n:
            total = sum(sums[c].values()) + alpha * len(vocab)
            scores[c] = math.log(n[c] / sum(n.values())) + sum(x * math.log((sums[c][w] + alpha) / total) for w, x in words.items() if w in vocab)
        top = max(round(s, 6) for s in scores.values())
        out[key] = (min(c for c in scores if round(scores[c], 6) == top), top)
    return out


def test_many_classes_equal_brute_force(spark):
    r = np.random.default_rng(12)
    words = [f"w{k}" for k in range(300)] + ["the"]

    def doc(k, known):
        own = Counter(r.choice(words[:300] if known else words[250:], size=r.integers(1, 6)).tolist())
        own["the"] = int(r.integers(1, 4))
        return k, f"c{int(r.zipf(1.5)) % 150:03d}", {w: float(n) / 2 for w, n in own.items()}

    train = [doc(k, True) for k in range(500)] + [(900, None, {"w1": 5.0}), (901, "empty", {})]
    test = [doc(k, False) for k in range(1_000, 1_200)] + [(2_000, "x", {}), (2_001, "x", {"the": 1e-6}), (2_002, "x", {"the": 500.0})]
    wide = lambda rows: spark.createDataFrame([(k, w, x) for k, _, ws in rows for w, x in ws.items()], "doc_id long, term string, weight double")
    docs = lambda rows: spark.createDataFrame([(k, c) for k, c, _ in rows], "doc_id long, label string")
    model = many_classes.fit_classes(wide(train), docs(train))
    assert [x.term for x in model.common.collect()] == ["the"]  # dealt by document
    known = {w for _, c, ws in train if c is not None for w in ws}
    asked = [(k, c, {w: x for w, x in ws.items() if w in known}) for k, c, ws in test]
    found = {x.doc_id: (x.prediction, x.joint) for x in many_classes.predict_classes(wide(asked), docs(asked), model).collect()}
    wanted = brute_classes(train, asked)
    assert found.keys() == wanted.keys()
    for k, (name, score) in wanted.items():
        assert found[k] == (name, pytest.approx(score, abs=2e-6)), k


def test_many_classes_meet_by_blocks(spark, monkeypatch):
    """Blocks of documents meet parts of the classes; a document leaves with one row a part,
    not with one for each class that it shares a term with."""
    monkeypatch.setattr(many_classes, "CELLS", 40)
    monkeypatch.setattr(many_classes, "PART", 4)
    r = np.random.default_rng(7)
    doc = lambda k: (k, f"c{k % 18:02d}", {f"w{x}": float(n) for x, n in Counter(r.integers(0, 12, 5).tolist()).items()})
    train, asked = [doc(k) for k in range(150)], [doc(k) for k in range(200, 240)]
    wide = lambda rows: spark.createDataFrame([(k, w, x) for k, _, ws in rows for w, x in ws.items()], "doc_id long, term string, weight double")
    docs = lambda rows: spark.createDataFrame([(k, c) for k, c, _ in rows], "doc_id long, label string")
    model = many_classes.fit_classes(wide(train), docs(train))
    sizes = wide(asked).groupBy("doc_id").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"))
    rows = many_classes._best_shared(wide(asked), sizes, model, "doc_id", "bigint").collect()
    assert len(rows) <= 40 * 5 and len({x.doc_id for x in rows}) == 40
    found = {x.doc_id: (x.prediction, x.joint) for x in many_classes.predict_classes(wide(asked), docs(asked), model).collect()}
    for k, (name, score) in brute_classes(train, asked).items():
        assert found[k] == (name, pytest.approx(score, abs=2e-6)), k


def test_envelope_is_the_highest_line(spark):
    r = np.random.default_rng(4)
    lines = [(f"c{k}", float(np.round(r.normal(), 2)), float(np.round(-abs(r.normal()), 2))) for k in range(60)] + [("b", 0.1, -0.1), ("a", 0.1, -0.1)]
    found = sorted(map(tuple, many_classes.envelope(spark.createDataFrame(lines, "class string, prior double, base double"), 5).collect()))
    for w in [0.01, 0.3, 1.0, 2.5, 10.0, 1e6]:
        start, name, prior, base = [f for f in found if f[0] <= w][-1]
        assert prior + w * base == pytest.approx(max(p + w * b for _, p, b in lines))
    assert not any(f[1] == "b" for f in found)
