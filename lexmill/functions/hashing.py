"""Repeatable pseudo-random numbers from keys.

A row's number depends on its key and a salt only, never on partitioning, so
splits, samples and shuffles repeat after retries and on other clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shuffle_key(key, seed="") -> Column:
    """32 hex digits, uniform over keys; sorting by them shuffles rows."""
    text = _col(key).cast("string")
    return F.md5(F.concat(F.lit(f"{seed}:"), text) if seed != "" else text)


def hash_bucket(key, buckets: int = 100, salt="") -> Column:
    """Bucket 0..buckets-1 of a key, portable across SQL engines that have md5."""
    digits = F.substring(shuffle_key(key, salt), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % F.lit(buckets)


def fast_bucket(*keys, buckets: int = 100) -> Column:
    """Same purpose with Spark's own 64-bit hash: cheaper, not portable."""
    return F.pmod(F.xxhash64(*[_col(k) for k in keys]), F.lit(buckets))
