"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled texts: one on ordinary words, and
one on the words that set toxic texts apart, put in front of the ordinary one. A window
of a few words is compressed with either. Where the ordinary dictionary does as well, the
lengths are equal; a window is the shorter under the toxic dictionary the more of it comes
from toxic text. The savings of a text's windows, counted at several thresholds, are
turned into a probability by a logistic fit on texts the dictionaries have not seen.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bounds of the labelled sample: texts of each class, chosen by a hash of the id, and their
#: bytes together. Texts of any length take part; one that no longer fits is passed over.
TOXIC_TEXTS, ORDINARY_TEXTS, SAMPLE_BYTES = 3_000, 5_000, 64 << 20
#: Ordinary texts, first ones in the sample's order, that the ordinary dictionary is trained on.
DICTIONARY_TEXTS = 2_000
WINDOW, LEVEL = 3, 6
ORDINARY_SIZE, TOXIC_SIZE = 8_192, 4_096
STEPS = (2, 4, 6)
#: A word start counts as characteristic from this many texts (and this share of the toxic
#: ones), standard deviations and times the share of ordinary texts on; its length is bounded.
LEAST_TEXTS, LEAST_SHARE, LEAST_Z, LEAST_RATIO, SHORTEST, LONGEST = 4, 0.03, 4.0, 6.0, 4, 14
_MARKS = b".,!?;:\"'()[]#$%&*|"


def _starts(text: bytes) -> set[bytes]:
    words = set(text.lower().translate(None, _MARKS).split())
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def characteristic(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> set[bytes]:
    """Word starts that toxic texts hold clearly more often."""
    seen = Counter()
    for text in toxic:
        seen.update(_starts(text))
    known = {w for w, n in seen.items() if n >= max(LEAST_TEXTS, LEAST_SHARE * len(toxic))}
    other = Counter()
    for text in ordinary:
        other.update(_starts(text) & known)
    n1, n0, out = len(toxic), len(ordinary), set()
    for w in known:
        p = (seen[w] + other[w]) / (n1 + n0)
        spread = (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5
        a, b = seen[w] / n1, other[w] / n0
        if spread and (a - b) / spread >= LEAST_Z and a >= LEAST_RATIO * b:
            out.add(w)
    return out


def _dictionary(words: list[bytes], size: int) -> bytes:
    order = random.Random(0)
    order.shuffle(words)
    samples = [b" " + b" ".join(words[i : i + 12]) + b" " for i in range(0, len(words), 12)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their words themselves
        return b" ".join(dict.fromkeys(words))[:size]


def train_dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes], most: int = DICTIONARY_TEXTS) -> tuple[bytes, bytes]:
    """Contents (ordinary, toxic in front of ordinary)."""
    starts = characteristic(toxic, ordinary)
    cuts = range(SHORTEST, LONGEST + 1)
    telling = [w for t in toxic for w in t.lower().translate(None, _MARKS).split() if any(w[:k] in starts for k in cuts)]
    common = _dictionary([w for t in ordinary[:most] for w in t.lower().split()], ORDINARY_SIZE)
    return common, (_dictionary(telling, TOXIC_SIZE) if telling else b"") + common


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False)


def savings(text: bytes, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of the text."""
    words = text.lower().split()
    windows = [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words)), WINDOW)]
    a, b = plain.compress, toxic.compress
    return np.array([len(a(w)) - len(b(w)) for w in windows], np.int64)


def features(saved: np.ndarray) -> list[float]:
    top = np.sort(saved)[::-1][:3]
    counts = [(saved >= s).sum() for s in STEPS]
    return [top[0], top.mean(), saved.mean(), *np.log1p(counts), *(c / len(saved) for c in counts), np.log(len(saved))]


@dataclass
class ToxicityModel:
    """Dictionary contents and the fitted weights; a few kilobytes."""

    plain: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float = 0.0

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        a, b = compressor(self.plain), compressor(self.toxic)
        x = np.array([features(savings(t, a, b)) for t in texts]).reshape(len(texts), -1)
        return _probability((x - self.centre) / self.scale, self.weights)


def _probability(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + z @ weights[1:], -40, 40)))


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(z), 1)), z])
    w, keep = np.zeros(x.shape[1]), np.r_[0, np.full(z.shape[1], ridge)]
    for _ in range(rounds):
        p = _probability(z, w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(keep + 1e-9), x.T @ (p - y) / len(y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    texts: Sequence[bytes], labels: Sequence[int], share: float | None = None, folds: int = 3, dictionary_texts: int = DICTIONARY_TEXTS
) -> ToxicityModel:
    """Model from labelled texts. Weights are fitted on savings under dictionaries of the
    other folds; the dictionaries kept are those of all texts. ``share``: the true share
    of label 1, when the sample holds another one."""
    y = np.array(labels, np.int64)
    prior = float(y.mean()) if len(y) else 0.0
    if min(y.sum(), (1 - y).sum()) < folds:
        return ToxicityModel(b"", b"", np.empty(0), np.empty(0), np.empty(0), prior if share is None else share)
    fold = np.zeros(len(y), np.int64)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    side = lambda mask, k: [t for t, m, v in zip(texts, mask, y) if m and v == k]
    x = None
    for f in range(folds):
        a, b = map(compressor, train_dictionaries(side(fold != f, 1), side(fold != f, 0), dictionary_texts))
        own = np.nonzero(fold == f)[0]
        rows = np.array([features(savings(texts[i], a, b)) for i in own])
        x = np.zeros((len(y), rows.shape[1])) if x is None else x
        x[own] = rows
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - centre) / scale, y)
    if share is not None and 0 < share < 1:
        weights[0] += np.log(share / (1 - share)) - np.log(prior / (1 - prior))
    every = np.ones(len(y), bool)
    plain, toxic = train_dictionaries(side(every, 1), side(every, 0), dictionary_texts)
    return ToxicityModel(plain, toxic, centre, scale, weights, prior)


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no fit may see: remainder 2 of the id's checksum by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def draw_sample(docs: DataFrame, labels: DataFrame, toxic_texts: int, ordinary_texts: int, sample_bytes: int) -> tuple[list[tuple[int, int]], float | None]:
    """([(doc_id, label)] in the order of a hash of the id, share of label 1) of the labelled
    rows that are not held out. Each class has half the bytes. Of an id with several texts
    the one with the smallest hash counts, of an id with several labels the largest."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    marks = marks.where(~is_held_out())
    shares = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).alias("_n"), F.xxhash64(text).alias("_h")).join(marks, "doc_id")
    sizes = sizes.groupBy("doc_id").agg(F.max("_y").alias("_y"), F.min_by("_n", "_h").alias("_n"))
    out = []
    for y, most in ((1, toxic_texts), (0, ordinary_texts)):
        room = sample_bytes // 2
        for r in sizes.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():  # ids and sizes only
            if r["_n"] <= room:
                room -= r["_n"]
                out.append((r["doc_id"], y))
    total = sum(shares.values())
    return out, shares.get(1, 0) / total if total else None


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, toxic_texts: int = TOXIC_TEXTS, ordinary_texts: int = ORDINARY_TEXTS, sample_bytes: int = SAMPLE_BYTES,
    dictionary_texts: int = DICTIONARY_TEXTS,
) -> ToxicityModel:
    """Model from a sample of the labelled rows that are not held out, bounded by the number
    of texts of each class and by their bytes together."""
    drawn, share = draw_sample(docs, labels, toxic_texts, ordinary_texts, sample_bytes)
    if not drawn:
        return fit([], [], share)
    # at most toxic_texts + ordinary_texts ids
    ids = docs.sparkSession.createDataFrame([(i, y, k) for k, (i, y) in enumerate(drawn)], "doc_id long, _y int, _k int")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("_t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("_k").agg(F.first("_y").alias("_y"), F.min_by("_t", "_h").alias("_t"))
    sample = sorted((r["_k"], bytes(r["_t"]), r["_y"]) for r in one.collect())
    return fit([r[1] for r in sample], [r[2] for r in sample], share, dictionary_texts=dictionary_texts)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    Whole texts are scored; a null text counts as empty. The score depends on the text
    alone, so repeated rows agree. Without labels of both classes every score is the
    share of label 1. Other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                scores = model.score([t.as_py() or b"" for t in batch.column(2)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("binary"))
    rows = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
