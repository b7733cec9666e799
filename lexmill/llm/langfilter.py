"""Language ID by bit-sliced Bloom filters over n-grams.

One Bloom filter per language, all with the same slots and hashes, stored slot by slot: a
slot is a bit mask with one bit for each language. The and of the slots of an n-gram is the
mask of all languages that hold it, found with a few look-ups whatever their number. The bits of a
text's masks are counted per language. A filter that is filled to a share f answers yes to a
strange n-gram with probability f^k, so of h hits among n n-grams (h - n f^k) / (1 - f^k) are
expected to be real; the language with most real hits is the prediction.

N-grams are pieces of three and of four bytes of the normalised text: lower case, every run
without letters one space, a space at both ends. A language's filter holds the n-grams that
occur in a least share of its training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lexmill.session import materialize

SIZES = (3, 4)
HASHES = 3
#: Training texts of a language: their number is near this bound (a share of all, by hash).
TEXTS = 4_000
#: An n-gram belongs to a language from this share of its training texts on (and this many).
LEAST_SHARE, LEAST_TEXTS = 0.005, 2
#: Slots per n-gram of the fullest language, and the most slots (2^24 slots of 64 languages
#: are 128 MB); beyond, filters fill up and the correction for false positives grows.
SPARE, MOST_SLOTS = 8, 1 << 24
#: Bytes of normalised text looked up at once; it bounds memory only.
PIECE = 1 << 19

_BREAKS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FOREIGN = regex.compile(r"[^\p{L}\p{M}]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def normalise(text: str) -> bytes:
    """Lower-cased letters with single spaces between and around; b'' without a letter."""
    low = text.lower()
    words = low.encode().translate(_BREAKS).split() if low.isascii() else _FOREIGN.sub(" ", low).encode().split()
    if not words or not any(map(str.isalpha, low)):
        return b""
    return b" " + b" ".join(words) + b" "


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The n-gram at every place as one number, its size in the top byte."""
    n = max(0, len(data) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def slots_of(found: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of n-grams in a table of 2^bits, one array per hash."""
    out = []
    for k in range(HASHES):
        mixed = (found ^ (found >> np.uint64(15))) * _FACTORS[k]
        out.append(((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[3] >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class LanguageFilters:
    """Languages with most training texts first, slots x mask bytes, and the false-positive rates."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.masks).bit_length() - 1

    def languages_with(self, found: np.ndarray) -> np.ndarray:
        """Masks (n-grams x words) of the languages that hold each n-gram."""
        one, *rest = slots_of(found, self.bits)
        out = self.masks[one]
        for at in rest:
            out &= self.masks[at]
        return out

    def hits(self, text: bytes) -> tuple[np.ndarray, int]:
        """(hits per language, n-grams) of a normalised text, read in pieces."""
        data = np.frombuffer(text, np.uint8)
        total, n = np.zeros(len(self.languages), np.int64), 0
        for size in SIZES:
            for low in range(0, max(1, len(data) - size + 1), PIECE):
                found = grams(data[low : low + PIECE + size - 1], size)
                n += len(found)
                total += self._popcounts(self.languages_with(found), np.array([0, len(found)]))[0]
        return total, n

    def _popcounts(self, masks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Set bits per language in masks[bounds[i]:bounds[i + 1]], for every i."""
        out = np.empty((len(bounds) - 1, len(self.languages)), np.int64)
        for k in range(len(self.languages)):
            bit = (masks[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)
            upto = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            out[:, k] = np.diff(upto[bounds])
        return out

    def count(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages hits, n-grams per text); short texts share their look-ups."""
        hits, n = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        group: list[int] = []

        def together() -> None:
            sizes = np.array([len(texts[i]) for i in group])
            data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            ends = np.cumsum(sizes)
            for size in SIZES:
                found = grams(data, size)
                inside = np.ones(len(found), bool)
                for back in range(1, size):  # pieces over the end of a text are none
                    at = ends[:-1] - back
                    inside[at[(at >= 0) & (at < len(found))]] = False
                own = np.maximum(sizes - size + 1, 0)
                bounds = np.concatenate([[0], np.cumsum(own)])
                hits[group] += self._popcounts(self.languages_with(found[inside]), bounds)
                n[group] += own

        held = 0
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                hits[i], n[i] = self.hits(text)
            elif text:
                if group and held + len(text) > PIECE:
                    together()
                    group, held = [], 0
                group.append(i)
                held += len(text)
        if group:
            together()
        return hits, n

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) per text. The score is the best language's part of the real hits
        of the best two. A text without letters, n-grams or
        learned languages is 'und' with score 0."""
        plain = [normalise(t) if t else b"" for t in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        hits, n = self.count(plain)
        real = np.clip((hits - n[:, None] * self.wrong) / (1 - self.wrong), 0, None)
        best = real.argmax(1)
        top = real[np.arange(len(best)), best]
        real[np.arange(len(best)), best] = -1
        second = np.clip(real.max(1), 0, None)
        for i, text in enumerate(plain):
            if text:
                names[i] = self.languages[best[i]]
                scores[i] = top[i] / (top[i] + second[i]) if top[i] > 0 else 1 / len(self.languages)
        return names, scores


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no fit may see: remainder 2 of the id's checksum by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def build_filters(held: DataFrame, languages: Sequence[str]) -> LanguageFilters:
    """Filters from rows (k, gram): language number and n-gram. The slots are filled by a
    grouping on the executors; only filled slots, at most MOST_SLOTS, reach the driver."""
    most = held.groupBy("k").count().agg(F.max("count")).first()[0] if languages else None
    if not most:
        return LanguageFilters([], np.zeros((2, 1), np.uint8), np.zeros(0))
    bits = max(10, min(SPARE * most, MOST_SLOTS) - 1).bit_length()
    bits = min(bits, MOST_SLOTS.bit_length() - 1)

    def place(batches):
        for batch in batches:
            found = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(slots_of(found, bits))
            k = np.tile(batch.column(0).to_numpy(zero_copy_only=False), HASHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array((k // 8).astype(np.int64)), pa.array(np.left_shift(1, k % 8).astype(np.int64))], names=["slot", "word", "bit"]
            )

    placed = held.select("k", "gram").mapInArrow(place, "slot bigint, word bigint, bit bigint")
    filled = placed.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks = np.zeros((1 << bits, (len(languages) + 7) // 8), np.uint8)
    masks[filled.column("slot").to_numpy(), filled.column("word").to_numpy()] = filled.column("mask").to_numpy()
    share = np.array([((masks[:, k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
    return LanguageFilters(list(languages), masks, np.minimum(share**HASHES, 0.99))


def fit_languages(docs: DataFrame, texts: int = TEXTS, least_share: float = LEAST_SHARE, least_texts: int = LEAST_TEXTS) -> LanguageFilters:
    """Filters of all languages of ``docs`` (doc_id, text, lang).

    Training rows have a language and are not held out. Of a language with more than
    ``texts`` of them about so many are taken, whole, by a hash of id and length; their
    n-grams are counted on the executors.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    found = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]  # one row per language
    sizes = sorted(found, key=lambda x: (-x[1], x[0]))
    if not sizes:
        return LanguageFilters([], np.zeros((2, 1), np.uint8), np.zeros(0))
    number = F.create_map(*(F.lit(x) for k, (lang, _) in enumerate(sizes) for x in (lang, k)))
    limits = F.array(*(F.lit(min(1.0, texts / n)) for _, n in sizes))
    draw = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.withColumn("k", F.element_at(number, F.col("lang"))).where(draw < F.get(limits, F.col("k")))

    def count(batches):
        held: dict[int, Counter] = {}
        read: Counter = Counter()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                read[k] += 1
                data = np.frombuffer(normalise(text.as_py()), np.uint8)
                own = np.unique(np.concatenate([grams(data, s) for s in SIZES])).view(np.int64)
                held.setdefault(k, Counter()).update(own.tolist())
            if sum(map(len, held.values())) > 1 << 20:
                yield from send(held, read)
                held, read = {}, Counter()
        yield from send(held, read)

    def send(held, read):
        for k, c in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c) + 1, k), pa.int32()), pa.array([0, *c.keys()], pa.int64()), pa.array([read[k], *c.values()], pa.int64())],
                names=["k", "gram", "n"],
            )

    # the number of texts of a language travels as the n-gram 0
    counts = rows.select("k", "text").mapInArrow(count, "k int, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    read = {r["k"]: r["n"] for r in counts.where("gram = 0").collect()}  # one row per language
    least = F.array(*(F.lit(float(max(least_texts, least_share * read.get(k, 0)))) for k in range(len(sizes))))
    held = counts.where((F.col("gram") != 0) & (F.col("n") >= F.get(least, F.col("k"))))
    return build_filters(held, [lang for lang, _ in sizes])


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Whole texts are read. A null text, or one without a letter, is 'und' with score 0, and
    so is every text when no language was learned. The prediction depends on the text alone,
    so repeated rows agree; ties go to the language with more training texts. Other columns
    are ignored.
    """

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 1_000):
                batch = whole.slice(low, 1_000)
                names, scores = filters.predict(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
