"""Bouts in batches, for code outside Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row


def batches(rows: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Lists of ``size`` rows, the last one maybe shorter; one partition at a time is on the driver. The size is checked at once."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError("a batch has one row at least")
    return _batches(rows, size)


def _batches(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    each = rows.toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(each, size)):
        yield batch
