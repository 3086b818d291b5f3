"""Chances that a key and a seed fix: the same at any size and partitioning, and in any system that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column, seed: int = 0) -> Column:
    """The hexadecimal MD5 of `key:seed`, a random order of the keys."""
    return F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))))


def chance(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1, 1 excluded: the digest's first 32 bits."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
