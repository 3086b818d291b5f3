"""Rows of a key in one task, for tasks that take them as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def together(df: DataFrame, *keys: str, order: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df with all rows of a key in one task, sorted by the keys and then by `order`; in as many parts as Spark has, or in `parts`.

    Spark leaves out a `repartition` by the keys of the join or aggregate before it, and may then read that one's shuffle where it
    lies, or in parts, as `mapInArrow` asks for no distribution. Nothing else is dealt by this hash, so that this shuffle stays.
    """
    by = F.xxhash64(*keys)
    return (df.repartition(by) if parts is None else df.repartition(parts, by)).sortWithinPartitions(*keys, *order)
