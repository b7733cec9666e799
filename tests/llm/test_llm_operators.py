"""Operators on small made-up rows: brute force, nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import covertree, maintext, packing, quality, simhash, toxicity
from lexmill.llm.components import connected
from lexmill.llm.covertree import near_vectors
from lexmill.llm.linededup import dedup_lines
from lexmill.llm.mixing import mix, mix_plan
from lexmill.llm.packing import pack
from lexmill.llm.quality import judge_quality
from lexmill.llm.sharding import kd_shards
from lexmill.llm.simhash import simhash_groups
from lexmill.llm.toxicity import fit_toxicity, score_toxicity
from lexmill.llm.urlfilter import judge_urls

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, _text string, label string"


def sentences(r, low, high):
    return " ".join(r.choice("ab abc the of tion ing ä ée").lower() + r.choice("xyzuvw") for _ in range(r.randint(low, high)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    lines = [sentences(r, 1, 30) for _ in range(40)]
    out = []
    for k in range(160):
        text = "\n".join(r.choices(lines, k=r.randint(1, 12)) if k % 3 else [sentences(r, 5, 40) for _ in range(r.randint(1, 9))])
        out.append([k, text])
    out += [[200, None], [201, ""], [202, ""], [None, "the only\nrow without id"], [203, " \t\n "], [204, "x" * 40_000]]
    out += [[205, sentences(r, 9_000, 9_000)], [7, out[7][1]], [7, out[7][1]], [206, out[5][1]], [207, "Öß ñ <|endoftext|> ½ Ω don't"]]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", "c", None]), None if t is None else len(t), "s", "f", "t", "l") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def nulls_last(x):
    return (x is None, x or 0)


# ---- packing


def check_pieces(found, rows):
    """Exact round trip: each id of each row lies in one piece, sequences are gapless and
    full or a power of two."""
    encode = Tokenizer.from_file(BPE).encode
    wanted = Counter()
    ids = defaultdict(list)
    for r in rows:
        own = encode(r[1] or "", add_special_tokens=False).ids + [1]
        wanted[r[0], len(own)] += len(own)
        ids[r[0]].append(np.array(own, "<u4").tobytes())
    have, ends = Counter(), defaultdict(list)
    for p in found:
        have[p.doc_id, p.doc_tokens] += p.length
        ends[p.sequence_id].append((p.offset, p.length))
        part = {zlib.crc32(x[4 * p.start : 4 * (p.start + p.length)]) for x in ids[p.doc_id] if len(x) == 4 * p.doc_tokens}
        assert p.ids_crc32 in part
    assert have == wanted
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_pack_round_trip(docs, rows):
    check_pieces(pack(docs, BPE, group_bytes=40_000).collect(), rows)


def test_pack_repeats_and_empty(docs, empty):
    first = sorted(map(tuple, pack(docs, BPE).collect()), key=str)
    assert first == sorted(map(tuple, pack(docs.repartition(5), BPE).collect()), key=str)
    assert pack(empty, BPE).count() == 0


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(1)
    sizes = [r.randint(1, 2047) for _ in range(300)]
    free, slow = [], []
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(2048)
            slow.append([])
        free[at] -= sizes[i]
        slow[at].append(i)
    assert packing.first_fit_decreasing(sizes, 2048) == slow


def test_piece_ids_equal_the_tokenizer():
    plain = Tokenizer.from_file(BPE)
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choices("aBcé ßñ.,'!#_9½ſΣΆİ \n\t<|>sdt\x1c-Ǆ", k=r.randint(0, 30)))
        own = np.frombuffer(packing.encoder(BPE).encode(text), "<u4").tolist()
        assert own == plain.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_take_their_own_way():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(BPE).known and not packing.encoder(path).known
    plain = Tokenizer.from_file(path)
    for text in ("Hello  World, it's 12 o'clock\n", "", "Ünïcode Ω"):
        assert np.frombuffer(packing.encoder(path).encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_copies_keep_apart(spark):
    r = random.Random(6)
    lengths = [r.randint(200, 900) for _ in range(60)]
    names = [k // 3 for k in range(180)]
    sequences = packing.pack_lengths([lengths[n] for n in names], 2048, names)
    for pieces in sequences[:-12]:  # the last few hold what is left
        docs = {d for d, _, _ in pieces}
        assert len({names[d] for d in docs}) == len(docs)
    text = sentences(r, 300, 300)
    rows = [(1, text, k) for k in range(400)] + [(k, sentences(r, 20, 90), k) for k in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place int")
    found = pack(docs, BPE, group_bytes=20_000, apart=["place"]).collect()
    check_pieces(found, rows)
    assert max(Counter(p.sequence_id >> 32 for p in found if p.doc_id == 1).values()) < 60


def test_packing_keeps_the_curriculum(spark):
    """Sources fade in and out over the sequences as their schedules say."""
    r = random.Random(7)
    rows = [(k, sentences(r, 40, 80), "abc"[k % 3]) for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix(docs, weights=(1.0, 1.0, 1.0)).cache()
    found = pack(mixed, BPE, group_bytes=8_000, order=["_position"]).collect()
    check_pieces(found, [(x.doc_id, x.text) for x in mixed.collect()])
    ids = sorted({p.sequence_id for p in found})
    tenth = {s: 10 * i // len(ids) for i, s in enumerate(ids)}
    tokens = Counter()
    for p in found:
        tokens["abc"[p.doc_id % 3], tenth[p.sequence_id]] += p.length
    for k in range(10):
        whole = sum(tokens[s, k] for s in "abc")
        for s, (a, b) in zip("abc", ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))):
            assert abs(tokens[s, k] / whole - (a + (b - a) * (k + 0.5) / 10) / 3) < 0.05


# ---- sharding


def test_shards(docs, rows, empty):
    found = kd_shards(docs, 5).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    group, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in found:
        group[r.text_crc32, r["size"]].add(r.shard)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in group.values()) and set(size) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards(empty).count() == 0


def test_shards_are_near_equal(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text", "'en' as lang", "if(id % 3 > 0, 'a', 'b') as source")
    size = kd_shards(docs).groupBy("shard").sum("size").collect()
    assert len(size) == 16 and max(r[1] for r in size) / min(r[1] for r in size) < 1.02


# ---- quality


def brute_longest(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while j != i and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_longest_repeats_by_brute_force():
    r = random.Random(4)
    texts = [[r.randint(0, 3) for _ in range(r.randint(0, 40))] for _ in range(40)] + [[1] * 33, [1, 2] * 17, []]
    ids = np.array([w for t in texts for w in t])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    wanted = [n if n >= 3 else 0 for t in texts for n in brute_longest(t)]
    assert quality.longest_repeats(ids, owner, 3).tolist() == wanted


def test_quality(docs, rows, empty):
    found = judge_quality(docs.withColumnRenamed("_text", "extra"))
    assert found.count() == len(rows) and set(found.columns) >= {"size", "fp", "_kept"}
    by = {r.doc_id: r for r in found.collect()}
    assert by[200]._n_words == 0 and by[200]._base_failed and not by[200]._kept
    assert by[204]._word_chars == 40_000 and by[204]._n_words == 1
    assert judge_quality(empty).count() == 0
    clean = " ".join(f"word{i}" for i in range(300))
    block = " ".join(f"again{i}" for i in range(60))
    spark = docs.sparkSession
    two = spark.createDataFrame([(1, clean), (2, f"{clean} {block} middle {block}"), (3, f"{clean[:600]} {block} m {block} n")], "doc_id int, text string")
    kept = {r.doc_id: (r._kept, r._longest, r._covered) for r in judge_quality(two).collect()}
    assert kept[1] == (True, 0, 0) and kept[2][1:] == (60, 120) and kept[2][0] and not kept[3][0]


def test_shards_tell_long_names_apart(spark):
    """Sources that begin alike are places of their own."""
    rows = [(k, f"text {k:02d}", "en", "https://the-same-beginning.org/" + "ab"[k % 2]) for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = kd_shards(docs.withColumn("doc_id", F.lit(1)), 2).collect()  # only the source differs much
    assert len(found) == 64 and {r.shard for r in found} == {0, 1}
    own = {r.text_crc32: r.shard for r in found}
    sides = [{own[zlib.crc32(t.encode())] for _, t, _, s in rows if s[-1] == x} for x in "ab"]
    assert sides[0].isdisjoint(sides[1])


# ---- line dedup


def brute_lines(rows, least):
    """Texts and numbers of deleted lines by comparing every pair of starts."""
    order = sorted({(nulls_last(r[0]), simhash.xxhash.xxh64_hexdigest(r[1] or ""), r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: x[0])
    lines = [(k, i, x) for k, d in enumerate(order) for i, x in enumerate(d[3].split("\n"))]
    gone = set()
    for p in range(len(lines)):
        for q in range(p):
            n = 0
            while p + n < len(lines) and lines[p + n][0] == lines[p][0] and lines[q + n][0] == lines[q][0] and lines[p + n][2] == lines[q + n][2]:
                n += 1
            if n and sum(len(x[2].split()) for x in lines[p : p + n]) >= least:
                gone.update(range(p, p + n))
    out = {}
    for k, d in enumerate(order):
        own = [(j, x[2]) for j, x in enumerate(lines) if x[0] == k]
        out[d[2], d[3]] = (len(own), sum(j in gone for j, _ in own), "\n".join(x for j, x in own if j not in gone))
    return out


@pytest.mark.parametrize("least", [1, 20, 50])
def test_dedup_lines_by_brute_force(spark, rows, least):
    small = [r[:2] for r in rows if r[0] is None or r[0] < 60 or r[0] > 199]
    docs = spark.createDataFrame([(*r, "x", "y") for r in small], "doc_id bigint, text string, lines string, at string")
    wanted = brute_lines(small, least)
    found = dedup_lines(docs, least)
    assert found.columns == ["doc_id", "text", "lines", "at", "_n_lines", "_n_deleted"]
    got = Counter((r.doc_id, r.text, r._n_lines, r._n_deleted) for r in found.collect())
    right = Counter((r[0], None, 0, 0) if r[1] is None else (r[0], wanted[r[0], r[1]][2], *wanted[r[0], r[1]][:2]) for r in small)
    assert got == right


def test_dedup_lines_with_many_blank_lines(spark):
    """Long windows of lines without words are united, not unfolded."""
    text = "\n" * 20_000 + " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nown")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert [found[k]._n_deleted for k in (1, 2, 3)] == [0, 20_001, 20_001]
    assert found[1].text == text and found[2].text == "" and found[3].text == "own"


def test_spread_join_of_large_classes(spark):
    from lexmill.llm.linededup import _spread_join

    rows = [(k, 0 if k % 2 else k % 40, 1) for k in range(2_000)]
    frame = spark.createDataFrame(rows, "at bigint, a bigint, b int")
    classes = spark.createDataFrame([(a, 1, n, 10 * a) for a, n in Counter(r[1] for r in rows).items() if a != 38], "a bigint, b int, n bigint, v bigint")
    found = sorted((r.at, r.a, r.b, r.v) for r in _spread_join(frame, classes, ["a", "b"]).collect())
    assert found == [(k, a, b, 10 * a) for k, a, b in rows if a != 38]


def test_dedup_lines_of_nothing(empty, spark):
    assert dedup_lines(empty).count() == 0
    alone = spark.createDataFrame([(1, "a b\nc")], "doc_id bigint, text string")
    assert dedup_lines(alone).collect()[0].text == "a b\nc"


# ---- mixing


def test_mix_reaches_its_targets(spark):
    docs = spark.range(6000).selectExpr(
        "id as doc_id", "array_join(array_repeat('w', cast(id % 40 as int)), ' ') as text", "case when id % 3 = 0 then 'a' when id % 50 = 1 then 'tiny' when id % 7 = 0 then null else 'b' end as source"
    )
    plan = mix_plan(docs).selectExpr("coalesce(source_size, 0) as s", "target", "size * copies as taken", "size", "copies", "positions")
    by = plan.groupBy("s", "target").agg({"taken": "sum"}).collect()
    total = sum(r.s for r in by)
    assert abs(sum(r.target for r in by) - total) < 1e-3
    for r in by:
        assert r.target <= 3 * r.s + 1e-6 and abs(r["sum(taken)"] - r.target) <= 40
    for r in plan.collect():
        assert r.taken <= 3 * r["size"] and len(r.positions) == r.copies and all(0 <= t <= 1 for t in r.positions)


def test_mix_edges(docs, rows, empty):
    assert mix_plan(empty).count() == 0 and mix(empty).count() == 0
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    placed = mix(docs)
    assert placed.columns == [*docs.columns, "_position"]
    assert placed.count() == sum(r.copies for r in plan)
    times = [r._position for r in placed.collect()]
    assert times == sorted(times)
    assert sorted(map(str, plan)) == sorted(map(str, mix_plan(docs.repartition(2)).collect()))


def test_mix_places_rows_not_units(spark):
    """Rows without id and of one size, with other columns or equal ones, meet the target."""
    rows = [(None, f"a b c d{k}", "s", k % 2) for k in range(50)] + [(7, "same four words here", "s", 0)] * 40
    rows += [(k, "w " * 4, "t", 0) for k in range(400)] + [(k, "w " * 4, "u", 0) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _position int").repartition(3)
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    for source in "stu":
        mine = [r for r in plan if r._name == source]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) <= 4
    taken = mix(docs)
    assert taken.columns == ["doc_id", "text", "source", "_position"]
    wanted = sum(r.copies for r in plan)
    assert taken.count() == wanted
    ours = Counter((r.doc_id, r.text) for r in taken.collect())
    assert set(ours) <= {r[:2] for r in rows} and ours[7, "same four words here"] == sum(r.copies for r in plan if (r._name, r.doc_id) == ("s", 7))


# ---- clashing columns


def test_clashing_columns_pass_through(spark, docs):
    added = {judge_quality: {"_kept", "_n_words"}, dedup_lines: {"_n_lines"}, mix: {"_position"}, simhash.one_per_group: set()}
    for fn, gives_way in added.items():
        names = ["_bytes", "_gone", "_k1", "_end", "_unnamed", "_id", "_h1", "_u", "_name", "_none", "_size", "_row", "other3", *sorted(gives_way)]
        wide = docs.select("doc_id", "text", "source", *(F.lit(f"mine {n}").alias(n) for n in names))
        out = fn(wide)
        assert len(set(out.columns)) == len(out.columns)
        first = out.first()
        for n in names:
            assert (first[n] == f"mine {n}") == (n not in gives_way)


# ---- SimHash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(docs, rows, empty):
    found = simhash_groups(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((r[0], f"{p:016x}") for r, p in zip(rows, prints))
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            group[i] = min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2)
    lows = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            lows[g] = min(lows.get(g, r[0]), r[0])
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((r[0], lows.get(g)) for g, r in zip(group, rows))
    assert simhash_groups(empty).count() == 0


def test_vantage_trees_find_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "BUCKET", 16)
    r = np.random.default_rng(5)
    points = r.integers(0, 2**63, 700, dtype=np.uint64)
    for bits in (1, 2, 3):
        flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (300, bits), dtype=np.uint64), axis=1)
        points = np.concatenate([points, points[r.integers(0, len(points), 300)] ^ flips])
    points = np.unique(points)
    nodes = simhash.fit_tree(points[::3], len(points), 2)
    assert sum(n[0] is None for n in nodes) > 4
    a, b, homes = [], [], np.zeros(len(points), int)
    for _, idx, home in simhash.route(points, nodes, 2):
        homes[idx[home]] += 1
        x, y = simhash.near_edges(points[idx], home, 2)
        a.append(idx[x])
        b.append(idx[y])
    assert (homes == 1).all()
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    wanted = simhash.local_roots(len(points), i, j)
    assert (simhash.local_roots(len(points), np.concatenate(a), np.concatenate(b)) == wanted).all()


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 50), 100 + r.randint(0, 50)) for _ in range(40)] + [(7, 7), (None, 3), (500, 499)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for x, y in edges:
            if x in root and y in root:
                root[x] = root[y] = min(root[x], root[y])
    assert got == root
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- url filters


def test_url_filters(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://Shop.NET/fr/a?x#y", None),
        (2, "https://mirror.org/p", link.format("http://shop.net/fr/a?x")),
        (3, "https://mirror.org/q", "<META HTTP-EQUIV=refresh content='0; url=/p'>"),
        (4, "https://ok.com/p", link.format("http://shop.net/fr/a?x")),
        (5, None, link.format("http://shop.net/fr/a?x")),
        (6, "no scheme", ""),
        (7, "http://www.example.com/en/1", ""),
        (8, "http://m.example.com/en/1", ""),
        (9, "http://notexample.com/en/1", ""),
        (10, "http://x.com", ""),
        (11, "https://lone.org/z", link.format("https://other.org/k/../z")),
        (12, "https://other2.org/a", link.format("http://shop.net/es/b")),
        (12, "https://other2.org/a", link.format("http://shop.net/es/b")),
        (None, "https://other3.org/a", link.format("//OTHER2.org/a#top")),
    ]
    found = judge_urls(spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, host string"))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())
    assert got == Counter(
        [
            (1, "shop.net", "/fr/a", "net/fr/", "block"),
            # the component of 1 to 4 holds an explicit allow, so the block does not spread
            (2, "mirror.org", "/p", None, "allow"),
            (3, "mirror.org", "/q", None, "allow"),
            (4, "ok.com", "/p", "com/", "allow"),
            (5, "", "", None, "allow"),
            (6, "", "", None, "allow"),
            (7, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
            (8, "m.example.com", "/en/1", "example.com/en/", "block"),
            (9, "notexample.com", "/en/1", "com/", "allow"),
            (10, "x.com", "", None, "allow"),
            (11, "lone.org", "/z", None, "allow"),
            (12, "other2.org", "/a", None, "block"),
            (12, "other2.org", "/a", None, "block"),
            (None, "other3.org", "/a", None, "block"),
        ]
    )
    assert judge_urls(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_every_link_of_a_page_counts(spark):
    bad = "http://shop.net/fr/a"
    heads = [
        f'<link rel="canonical" href="https://ok.org/1"><link rel="canonical" href="{bad}">',
        f'<link rel="alternate canonical" href="{bad}">',
        f"<LINK href={bad} rel=canonical>",
        f"<meta http-equiv='refresh' content='0; url=/x'><meta http-equiv='refresh' content='1; url={bad}'>",
        f'<link rel="canonical-not" href="{bad}">',
        f'<link data-rel="canonical" href="{bad}">',
    ]
    rows = [(k, f"https://site{k}.org/", h) for k, h in enumerate(heads)]
    found = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [found[k] for k in range(6)] == ["block"] * 4 + ["allow"] * 2


# ---- embeddings


@pytest.mark.parametrize("block, team", [(512, 16), (8, 2)])
def test_near_vectors_by_brute_force(spark, monkeypatch, block, team):
    """Also with small blocks and teams, so that the tree over them has several levels."""
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "TEAM", team)
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 16))
    rows = []
    for k in range(400):
        v = base[k % 40] * (1 + k % 3) + r.normal(size=16) * (0.05 if k % 2 else 0.3)
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    rows += [(500 + k, rows[3][1], 0) for k in range(30)] + [(3, rows[3][1], 0)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [1.0, None] * 8, 0), (604, rows[3][1], None), (None, rows[3][1], 0), (605, [], 0), (606, [1.0], 0)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<float>, label int, rep int")
    x = {i: np.array(v[1], np.float64) for i, v in enumerate(rows) if v[1] and None not in v[1] and np.isfinite(v[1]).all() and any(v[1]) and v[2] is not None}
    near = defaultdict(list)
    for i in x:
        for j in x:
            if i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93:
                near[i].append(j)
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    low = {}
    for i, g in enumerate(label):
        if rows[i][0] is not None:
            low[g] = min(low.get(g, rows[i][0]), rows[i][0])
    wanted = Counter((v[0], len(near[i]), low.get(label[i]), v[0] is not None and v[0] == low.get(label[i])) for i, v in enumerate(rows))
    assert Counter(map(tuple, near_vectors(docs).collect())) == wanted
    assert near_vectors(docs.limit(0)).count() == 0


def test_team_pairs_prune_far_clusters(spark, monkeypatch):
    """With clusters far apart most pairs of teams are never met, and none is missed."""
    monkeypatch.setattr(covertree, "TEAM", 2)
    r = np.random.default_rng(1)
    centres = r.normal(size=(16, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(1, 64, k, centres[k // 4].tolist(), 0.05) for k in range(64)]
    blocks = spark.createDataFrame(rows, "label int, len int, rank bigint, centre array<double>, radius double")
    pairs = {(p.a, p.b) for p in covertree.team_pairs(blocks, 0.37).collect()}
    wanted = {(a, b) for a in range(32) for b in range(a, 32) if a // 2 == b // 2}
    assert wanted <= pairs and len(pairs) < 80  # of 528
    order = covertree.coherent(centres[r.permutation(np.repeat(np.arange(16), 8))])
    assert sorted(order.tolist()) == list(range(128))


# ---- main text


def test_main_text(spark):
    rows = [
        (1, "u", "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=1>Menu</a></ul></nav><article><h1>A &amp; B</h1>"
            "<p>One\n two <b>three</b>.<p>Caf&eacute;<br>x<script>var p='</p>';</script></article><footer>&copy; me</footer></body></html>"),
        (2, None, None),
        (3, "v", ""),
        (3, "v", ""),
        (4, "w", "<div class='sidebar'><a href=1>Link</a></div><div class=post><p>The long text of a page, with commas, and more.</p>"
            "<p>Second part of it.</p></div><div id='comments'><div class=comment><p>I think so too.</p></div></div>"),
    ]
    found = {r.page_id: r.text for r in maintext.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")).collect()}
    assert found == {1: "A & B\nOne two three.\nCafé x", 2: "", 3: "", 4: "The long text of a page, with commas, and more.\nSecond part of it."}


BODY = "<article><h1>A long title of the page</h1><p>The long text of a page, with commas, and more.</p>{}<p>Second part of it, also long enough.</p></article>"
FIRST, SECOND = "A long title of the page\nThe long text of a page, with commas, and more.", "Second part of it, also long enough."


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body>" + BODY,
    "<html><head><meta charset=utf-8><title>x <script> y</title><link rel=a><script>1</script>" + BODY,
    "<html><head><title>x<body>" + BODY,
    "<html><title>x</title>" + BODY,
    "<html><head><title>x</title></head ><body>" + BODY,
    *("<body>" + BODY.replace("{}", piece) for piece in (
        '<svg viewBox="0 0 1 1"/>', "<math/>", "<svg><path d='M0'/><g><path d='M1'>", "<math><mi>", "<object data=x>", "<object data=x><param name=a></object>",
        "<select><option>one<option>two", "<select><option>one</select>", "<SELECT><optgroup label=a><option>one</option></optgroup></SELECT>",
        "<template-card></template-card>", "<object-view>", "<script-x></script-x>", "<svg-icon/>", "<head-line></head-line>",
        "<script>a</script-x>b</script >", "<style>p</style/>", "<iframe title='a>b'>x</iframe>", "<noscript>x</noscript>", "<textarea>x</textarea>",
        "<template><p>x</p></template>", "<svg><title>icon</title></svg>",
    )),
])
def test_main_text_unclosed(page):
    global _MODEL
    _MODEL = globals().get("_MODEL") or maintext.train(maintext.labelled_pages())
    assert _MODEL.text(page.replace("{}", "")) == f"{FIRST}\n{SECOND}"


def test_main_text_of_inline_parts():
    """Formulas, drawings and fallbacks are text of the block that they stand in."""
    texts = lambda page: [n.text for n in maintext.parse(page) if n.tag == "#text"]
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, is") == ["where x = 2, is"]
    assert texts("<p>see <object data=a>the <b>fallback</b></object> here") == ["see the fallback here"]
    assert texts("<p>one<svg><text>two</text><text>three</text></svg>four") == ["one two three four"]
    assert texts("<p>one<svg><text>two<p>three") == ["one two", "three"]
    assert texts("<head>stray text<title>x</title>") == ["stray text"]
    # as in a browser, what a script without its end tag holds is no text
    for tag in ("script", "style", "textarea", "iframe", "noscript", "template"):
        assert texts(f"<p>one<{tag}>two<p>three") == ["one"]
    assert texts("<p>" + "<title>" * 3000 + "<svg>" * 3000 + "x") == ["x"]
    assert texts("<head><title>" + "long <b>title " * 3000 + "</title></head><body><p>text") == ["text"]


def test_main_text_held_out_pages():
    model = maintext.train(maintext.labelled_pages())
    wrong = total = 0
    for nodes in maintext.labelled_pages(120, seed=99):
        for node, p in zip(nodes, model.marginals(nodes)):
            if node.tag == "#text":
                total += 1
                wrong += (p >= 0.5) != (node.label == 1)
    assert wrong < 0.01 * total


def test_marginals_are_exact():
    """Against the sum over all labellings of a small tree."""
    model = maintext.train(maintext.labelled_pages(60))
    nodes = maintext.parse("<div class=post><p>Some text here.</p><a href=1>x</a></div><div class=ad>y</div>")
    odds = [1 / (1 + np.exp(-(model.bias + sum(model.weights.get(t, 0.0) for t in names)))) for names in maintext.traits(nodes)]
    n, total, sums = len(nodes), 0.0, np.zeros(len(nodes))
    for code in range(2**n):
        s = [code >> k & 1 for k in range(n)]
        w = np.prod([o if x else 1 - o for o, x in zip(odds, s)])
        for k in range(1, n):
            e = model.edges.get(nodes[nodes[k].parent].tag, model.edges["*"])
            w *= e[2 * s[nodes[k].parent] + s[k]]
        total += w
        sums += w * np.array(s)
    assert np.allclose(model.marginals(nodes), sums / total)


# ---- toxicity


def test_toxicity(spark, empty):
    r = random.Random(9)
    rows, marks = [], []
    for k in range(500):
        words = [r.choice("alpha beta gamma delta river stone cloud light table house".split()) + r.choice("abcdef") for _ in range(60)]
        bad = k % 5 == 0
        if bad:
            for w in ("blasted", "wretched", "horrible"):
                words[r.randint(0, 59)] = w
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    rows += [(900, None), (901, ""), (None, "alphaa betab"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id bigint, toxic int")
    found = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found)
    held = [x for x in found if x.held_out and x.doc_id is not None and x.doc_id < 500]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held) and len(held) > 90
    right = [x.predicted == (x.doc_id % 5 == 0) for x in held]
    assert sum(right) / len(right) > 0.95
    assert score_toxicity(empty, fit_toxicity(empty, labels)).count() == 0
    none = fit_toxicity(docs, labels.limit(0))
    assert {x.score for x in score_toxicity(docs, none).collect()} == {0.0}
    assert len(toxicity.savings(b"", toxicity.compressor(b"abc"), toxicity.compressor(b"abc"))) == 1


def test_toxicity_sample(spark):
    """Bounded by texts and bytes, long texts included, one text per id, whatever the labels repeat."""
    rows = [(k, "word " * (1 + k % 7)) for k in range(200)] + [(300, "long " * 10_000), (7, "another text"), (8, "word " * 2)]
    marks = [(k, k % 3 == 0) for k in range(200)] * 2 + [(300, True), (9, True), (None, True), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, None if t is None else int(t)) for i, t in marks], "doc_id bigint, toxic int")
    held = {k for k in range(301) if zlib.crc32(str(k).encode()) % 4 == 2}
    drawn, share = toxicity.draw_sample(docs, labels, 1_000, 1_000, 1 << 20)
    wanted = {(k, int(k % 3 == 0)) for k in range(200) if k not in held} | ({(300, 1)} - {(k, 1) for k in held})
    assert sorted(drawn) == sorted(wanted) and share == sum(y for _, y in wanted) / len(wanted)
    few, _ = toxicity.draw_sample(docs, labels, 5, 4, 1 << 20)
    assert few == [d for d in drawn if d[1]][:5] + [d for d in drawn if not d[1]][:4]
    tight, _ = toxicity.draw_sample(docs, labels, 1_000, 1_000, 400)
    text = dict(rows[:201])
    for y in (0, 1):
        assert 0 < sum(len(text[i]) for i, own in tight if own == y) <= 200
    assert toxicity.draw_sample(docs, labels.limit(0), 5, 5, 100) == ([], None)


def test_savings_and_features_by_hand():
    plain, toxic = toxicity.compressor(b"common words here"), toxicity.compressor(b"dreadful insult common words here")
    text = b"Common words here a dreadful insult then common words here"
    words = text.lower().split()
    wanted = []
    for i in range(0, len(words), toxicity.WINDOW):
        w = b" " + b" ".join(words[i : i + toxicity.WINDOW]) + b" "
        wanted.append(len(plain.compress(w)) - len(toxic.compress(w)))
    saved = toxicity.savings(text, plain, toxic)
    assert saved.tolist() == wanted and max(wanted) > 2
    found = toxicity.features(saved)
    top = sorted(wanted, reverse=True)[:3]
    counts = [sum(v >= s for v in wanted) for s in toxicity.STEPS]
    right = [top[0], sum(top) / 3, sum(wanted) / len(wanted), *np.log1p(counts), *(c / len(wanted) for c in counts), np.log(len(wanted))]
    assert np.allclose(found, right)
