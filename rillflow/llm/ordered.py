"""Ascending-id order over many tasks: bounded id ranges, each sorted by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, ranges: int, *order: str) -> DataFrame:
    """`df` with all rows of a `bucket` in one task, sorted by bucket and `order`."""
    return df.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", *order)
