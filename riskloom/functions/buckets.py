"""Stable hash buckets for splitting and sampling by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def sha_bucket(value: Column, modulo: int = BUCKETS) -> Column:
    """First 32 bits of the SHA-256 of the value's text, modulo ``modulo``; null hashes as ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    head = F.substring(F.sha2(text, 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % modulo


def murmur_bucket(value: Column, modulo: int = BUCKETS) -> Column:
    """Spark's own hash, folded to 0..modulo-1.

    ``pmod`` rather than ``%``: the hash is negative for half of all keys, and a
    negative remainder would put every one of them on the same side of a split.
    """
    return F.pmod(F.hash(value), F.lit(modulo))
