"""Row numbers, prefix sums and last values, global or by key, without gathering all rows, or all of a key, in one task.

Rows are range-partitioned in the order asked for. Windows run inside the partitions,
and what a partition needs to know of those before it comes from one small row per
partition, so a key with a third of all rows is as many tasks as any other third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutworks.runtime import staged


def with_sequence(df: DataFrame, order: list[Column | str], name: str = "seq") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the total order of ``order``.

    Rows are range-partitioned and sorted; each partition counts its own, and the
    offsets come from one small row per partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = staged(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    # as many rows as partitions: bounded by the cluster, not by the data
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_row_at")).drop("_part", "_row_at", "_before")


def running_sums(df: DataFrame, order: list[Column | str], columns: list[str]) -> DataFrame:
    """``df`` with the columns replaced by their sums up to the row, and ``k``: 1, 2, ... in the order.

    Sums run inside range partitions; the partitions' totals are added by a row per partition. ``_part`` stays.
    """
    local = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = local.select(*[c for c in df.columns if c not in columns], "_part", *[F.sum(c).over(inside).alias(c) for c in columns], F.count("*").over(inside).alias("k"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("k"))
    before = totals.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in [*columns, "k"]])
    out = sums.join(F.broadcast(before), "_part")
    return out.select(*[c for c in df.columns if c not in columns], *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in [*columns, "k"]], "_part")


def _ranges(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, stored by ranges of keys and order, with ``_part`` and ``_key``; and for each partition its last key and the first one.

    Only the first key of a partition can have rows in partitions before it.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    local = staged(ranged.withColumn("_key", F.struct(*keys)), "key-ranges")
    return local, local.groupBy("_part").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))


def segmented_sums(df: DataFrame, keys: list[str], order: list[str], columns: list[str], current: bool = True, part: bool = False) -> DataFrame:
    """``df`` with the columns replaced by their sums over the key's rows up to the row, or up to the one before it.

    ``order`` must be total within a key. Nulls count as nothing, and a key's first row has the sum 0 before it.
    With ``part`` the number of the range partition stays as ``_part``.
    """
    local, ends = _ranges(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    sums = local.select(*[c for c in df.columns if c not in columns], "_part", "_key", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in columns])
    # one row per partition from here on
    last = local.join(F.broadcast(ends.select("_part", "_last")), "_part").where(F.col("_key") == F.col("_last"))
    totals = last.groupBy("_part", "_last").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_earlier(sums, ends, totals.select("_part", "_last", *[F.sum(f"_{c}").over(so_far).alias(f"_{c}") for c in columns]), columns, lambda own, before: own + F.coalesce(before, F.lit(0)), part)


def carried_forward(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with the column's nulls replaced by the last value that the key has before the row; null where there is none."""
    local, ends = _ranges(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = local.select(*[c for c in df.columns if c != column], "_part", "_key", F.last(column, ignorenulls=True).over(inside).alias(column))
    last = local.join(F.broadcast(ends.select("_part", "_last")), "_part").where(F.col("_key") == F.col("_last"))
    place = F.when(F.col(column).isNotNull(), F.struct(*order))
    known = last.groupBy("_part", "_last").agg(F.max_by(column, place).alias(f"_{column}"))
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_earlier(filled, ends, known.select("_part", "_last", F.last(f"_{column}", ignorenulls=True).over(so_far).alias(f"_{column}")), [column], lambda own, before: F.coalesce(own, before))


def _with_earlier(rows: DataFrame, ends: DataFrame, upto: DataFrame, columns: list[str], combine, part: bool = False) -> DataFrame:
    """``rows`` combined with what the partitions before have for the first key of each; ``upto`` has it for their last keys."""
    by_part = Window.orderBy("_part")
    shifted = ends.join(upto, ["_part", "_last"]).select("_part", "_first", F.lag("_last").over(by_part).alias("_before"), *[F.lag(f"_{c}").over(by_part).alias(f"_{c}") for c in columns])
    earlier = shifted.where(F.col("_first") == F.col("_before")).select("_part", F.col("_first").alias("_key"), *[f"_{c}" for c in columns])
    out = rows.join(F.broadcast(earlier), ["_part", "_key"], "left")
    names = [c for c in rows.columns if c not in (*columns, *(["_key"] if part else ["_part", "_key"]))]
    return out.select(*names, *[combine(F.col(c), F.col(f"_{c}")).alias(c) for c in columns])
