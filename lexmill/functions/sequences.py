"""Fixed-length arrays for models, as array expressions inside the row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed ids of the special tokens in the usual transformer vocabularies.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 100, 101, 102


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_front(seq, maxlen: int) -> Column:
    """The last ``maxlen`` ids, zeros on the left."""
    s = _col(seq)
    kept = F.slice(s, F.greatest(F.size(s) - maxlen, F.lit(0)) + 1, F.lit(maxlen))
    zeros = F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(maxlen) - F.size(s), F.lit(0)))
    return F.concat(zeros, kept)


def _fill(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), n)


def _encoded(real: Column, types: Column, max_len: int) -> Column:
    """Struct of the three vectors, zero-padded on the right."""
    n = F.size(real)
    rest = F.lit(max_len) - n
    return F.struct(
        F.concat(real, _fill(rest, PAD_ID)).alias("input_ids"),
        F.concat(_fill(n, 1), _fill(rest, 0)).alias("attention_mask"),
        F.concat(types, _fill(rest, 0)).alias("token_type_ids"),
    )


def encode_ids(ids, max_len: int = 128, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """[CLS] ids [SEP], ids cut to ``max_len - 2``; all zeros when ``ids`` is null."""
    s = F.slice(F.coalesce(_col(ids), F.array().cast("array<int>")), 1, max_len - 2)
    real = F.concat(F.array(F.lit(cls_id)), s, F.array(F.lit(sep_id)))
    empty = F.array().cast("array<int>")
    real = F.when(_col(ids).isNull(), empty).otherwise(real)
    return _encoded(real, _fill(F.size(real), 0), max_len)


def pair_lengths(la: Column, lb: Column, room: int) -> tuple[Column, Column]:
    """How many ids of each side stay when tokens are removed one by one from the
    longer side, from the second side on a tie."""
    excess = F.greatest(la + lb - room, F.lit(0))
    from_longer = F.least(excess, F.abs(la - lb))
    shared = excess - from_longer
    keep_a = la - F.when(la > lb, from_longer).otherwise(0) - F.floor(shared / 2)
    keep_b = lb - F.when(lb > la, from_longer).otherwise(0) - F.ceil(shared / 2)
    return keep_a.cast("int"), keep_b.cast("int")


def encode_pair_ids(a, b, max_len: int = 128, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """[CLS] a [SEP] b [SEP]; type 0 for the first part, 1 for the second."""
    ca, cb = _col(a), _col(b)
    na, nb = pair_lengths(F.size(ca), F.size(cb), max_len - 3)
    cls, sep = F.array(F.lit(cls_id)), F.array(F.lit(sep_id))
    real = F.concat(cls, F.slice(ca, F.lit(1), na), sep, F.slice(cb, F.lit(1), nb), sep)
    return _encoded(real, F.concat(_fill(na + 2, 0), _fill(nb + 1, 1)), max_len)
