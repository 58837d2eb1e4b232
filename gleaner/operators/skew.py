"""Joins and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.session import durable

ROWS_PER_SLICE = 1_000_000
MAX_BROADCAST_ROWS = 100_000


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which NULL keys meet NULL keys, so that no row is lost for its key."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def join_leaders(
    rows: DataFrame,
    leaders: DataFrame,
    keys: list[str],
    size_col: str,
    spread: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join rows to one leader row per key; keys larger than ``rows_per_slice`` are sliced over many tasks.

    ``leaders`` is unique on ``keys`` and knows each group's size in ``size_col``. There are at most rows /
    ``rows_per_slice`` hot keys; their list is broadcast up to MAX_BROADCAST_ROWS (counted) and joined beyond that. Rows of
    a hot key get a slice number from a hash of the ``spread`` columns and its leader is repeated once per slice; all
    other keys have slice 0. NULL is a key like others. The leaders are cut once, since both their hot part and the whole
    are read.
    """
    leaders = durable(leaders)
    hot = leaders.filter(F.col(size_col) > rows_per_slice).select(
        *keys, F.ceil(F.col(size_col) / rows_per_slice).cast("int").alias("n_slices")
    )
    hot = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_ROWS else hot
    slice_of = F.when(F.col("n_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("n_slices")).cast("int"))
    sliced_rows = join_same(rows, hot, keys, "left").withColumn("slice", slice_of).drop("n_slices")
    sliced_leaders = (
        join_same(leaders, hot, keys, "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_slices"), F.lit(1)) - 1)))
        .drop("n_slices")
    )
    return join_same(sliced_rows, sliced_leaders, [*keys, "slice"]).drop("slice")


def number_rows(df: DataFrame, by: list[str], order: list[str | Column], number_col: str = "number") -> DataFrame:
    """``row_number() over (partition by by order by order)`` without a task per group.

    Rows are range-partitioned and sorted once, cut durably, and numbered by their position in the partition plus the
    offset of earlier partitions. The offset table has at most one row per partition and group border.
    Also adds ``<number_col>_total``, the size of the group.
    """
    keys: list[str | Column] = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = durable(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
        )
    )
    counts = durable(cut.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        *by,
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias(f"{number_col}_total"),
    )
    # One row per partition and group border; broadcast only after counting them.
    offsets = F.broadcast(offsets) if counts.count() <= MAX_BROADCAST_ROWS else offsets
    joined = join_same(cut, offsets, ["_part", *by])
    return joined.withColumn(number_col, F.col("_before") + F.col("_pos") - F.col("_first") + 1).drop(
        "_part", "_pos", "_first", "_before"
    )
