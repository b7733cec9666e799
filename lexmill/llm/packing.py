"""Packing of tokenized documents into fixed-length sequences.

Documents are dealt into random groups of about ``group_bytes`` of text by a hash; each
group is packed by itself, so tasks stay small whatever the corpus. Where documents come in a
training order, it is cut into ranges, the random draws are made inside a range, and the
sequences are numbered range by range. A document's whole
stretches of ``capacity`` tokens are sequences of their own. The rests are packed
first-fit decreasing: a tournament tree over the bins' free capacities finds the leftmost
bin with room in logarithmic time. What first fit leaves open is closed by cutting: the
last bins are dissolved and poured into the gaps of the others, and the remainder of the
group goes into sequences whose lengths are powers of two, which need no padding. Copies of
a document keep out of each other's bins as long as another one has room.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.functions.ordered import range_bucket

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Pieces whose ids a worker remembers (the first that come, so the frequent ones are
#: among them); only speed and memory depend on it.
REMEMBERED = 800_000

# A tokenizer's normalizers and pattern, and how it splits lower-case Latin-1 text.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Latin-1 characters for which Python's classes differ from the tokenizer's.
_ODD = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])


def _splits_as_known(settings: dict) -> bool:
    normalizer, splitter = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = splitter.get("pretokenizers") or [{}]
    return (
        [n.get("type") for n in normalizer.get("normalizers", [])] == NORMALIZERS
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": PATTERN}
        and not steps[1].get("add_prefix_space")
    )


class PieceIds(dict):
    """Little-endian 32-bit ids of the pieces a lower-casing byte-level tokenizer splits
    text into; the model sees each remembered piece once. Texts outside the Latin-1 range,
    or with characters or marks of special meaning, take the tokenizer's whole way, and so
    does every text of a tokenizer with another normalizer or pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.known = _splits_as_known(json.load(file))
        # byte-level models spell bytes outside the printable ranges with letters from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.spelling = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelling))]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        try:
            plain = text.encode("latin-1") if self.known else None
        except UnicodeEncodeError:
            plain = None
        if plain is None or b"<|" in plain or len(plain.translate(None, _ODD)) != len(plain):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))


_ENCODERS: dict[str, PieceIds] = {}


def encoder(path: str) -> PieceIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceIds(path)
    return _ENCODERS[path]


class CapacityTree:
    """Tournament tree: each node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int, low: int = 0) -> int | None:
        """Leftmost bin from ``low`` on with room for ``size``, or None."""
        node = low + self.leaves
        while self.free[node] < size:
            # up past the right children and one step to the right, where all bins lie behind
            while node & 1:
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.free[2 * node] >= size else 2 * node + 1
        return node - self.leaves

    def take(self, at: int, size: int) -> None:
        node = at + self.leaves
        self.free[node] -= size
        while node > 1:
            node //= 2
            self.free[node] = max(self.free[2 * node], self.free[2 * node + 1])


def first_fit_decreasing(sizes: list[int], capacity: int, names: list | None = None) -> list[list[int]]:
    """Bins of item numbers. Items of equal name do not share a bin."""
    tree = CapacityTree(max(1, len(sizes)), capacity)
    bins: list[list[int]] = []
    held: list[set] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.place(sizes[item])
        while names is not None and at < len(bins) and names[item] in held[at]:
            at = tree.place(sizes[item], at + 1)  # an empty bin is left for every item
        tree.take(at, sizes[item])
        if at == len(bins):
            bins.append([])
            held.append(set())
        bins[at].append(item)
        if names is not None:
            held[at].add(names[item])
    return bins


def pack_lengths(lengths: list[int], capacity: int, names: list | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). Every sequence but those with a power
    of two of tokens is full, and each token lies in one piece. Copies, documents of equal
    name, are kept apart while another piece can take their place."""
    names = list(range(len(lengths))) if names is None else names
    sequences, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        sequences += [[(doc, start, capacity)] for start in range(0, whole, capacity)]
        if n > whole:
            rests.append((doc, whole, n - whole))
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], capacity, [names[r[0]] for r in rests])]
    full, last = divmod(sum(r[2] for r in rests), capacity)
    pool = deque(piece for b in bins[full:] for piece in b)
    sizes = [capacity] * full + [1 << k for k in reversed(range(last.bit_length())) if last >> k & 1]
    for at, size in enumerate(sizes):
        pieces = bins[at] if at < full else []
        gap = size - sum(p[2] for p in pieces)
        inside = {names[p[0]]: p[0] for p in pieces}
        while gap:
            for _ in range(len(pool)):  # mostly the first piece fits
                if inside.get(names[pool[0][0]], pool[0][0]) == pool[0][0]:
                    break
                pool.rotate(-1)
            doc, start, n = pool.popleft()
            taken = min(gap, n)
            pieces.append((doc, start, taken))
            inside[names[doc]] = doc
            if n > taken:
                pool.appendleft((doc, start + taken, n - taken))
            gap -= taken
        sequences.append(pieces)
    return sequences


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    group_bytes: int = 2 << 20,
    seed: int = 0,
    apart: Sequence[str] = (),
    order: Sequence[str] = (),
    ranges: int = 1_024,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. The
    group of a row depends on id, text and the columns ``apart``, the order inside a group on
    id and text, so reruns agree. ``apart`` tells repeated rows from each other, so that they
    are dealt to different groups; equal rows that it does not tell apart meet in one.
    ``order``: columns of the training order. It is cut into at most ``ranges`` ranges of
    several groups each; a sequence holds documents of one range, and sequence ids ascend
    with the ranges. Repeated rows are packed as often as they come. Other columns are ignored.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    tail = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        rows = sorted(
            zip(table.column("doc_id").to_pylist(), (t or "" for t in table.column("text").to_pylist())),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )
        pieces = encoder(tokenizer)
        ids = [pieces.encode(r[1]) + tail for r in rows]
        sequences = pack_lengths([len(x) // 4 for x in ids], capacity, rows)
        out = []
        for k, pieces in enumerate(sequences):
            offset = 0
            for doc, start, n in pieces:
                crc = zlib.crc32(memoryview(ids[doc])[4 * start : 4 * (start + n)])
                out.append((rows[doc][0], start, n, crc, len(ids[doc]) // 4, (group << 32) + k, offset))
                offset += n
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out))})

    draw = F.xxhash64(F.lit(seed), "doc_id", "text", *apart, *order)
    if order:
        count = min(ranges, max(1, groups // 4))
        each = -(-groups // count)
        keys = docs.select("doc_id", "text", *apart, *order).withColumn("_place", F.struct(*order))
        ranged = range_bucket(keys, ["_place"], count) if count > 1 else keys.withColumn("_range", F.lit(0))
        group = F.col("_range").cast("long") * each + F.pmod(draw, F.lit(each))
        dealt = ranged.select("doc_id", "text", group.alias("_group"))
    else:
        dealt = docs.select("doc_id", "text", F.pmod(draw, F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInArrow(run, SCHEMA)
