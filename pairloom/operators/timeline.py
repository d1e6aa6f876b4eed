"""Ordered operations per key that stay parallel when one key holds much of the table.

A window partitioned by the key alone would put a hot key into one task. Here the
rows are first cut into range-sorted blocks (``range_blocks``); the window runs inside
each (block, key), and what a block must know of the rows before it - at most one key
per block continues from an earlier one - is carried over in a table that has no more
rows than there are blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.ranking import range_blocks



def _local_window(keys: Sequence[str]):
    return W.partitionBy("_block", *keys).orderBy("_slot")


def border_groups(blocks: DataFrame, keys: Sequence[str], *ends: Column) -> DataFrame:
    """Groups (block, key) that touch the start or the end of their block, with ``ends`` aggregated.

    Only these can belong to a key that spans blocks: at most two per block. ``_starts``
    marks the one at the start.
    """
    groups = blocks.groupBy("_block", *keys).agg(
        *ends, F.min("_slot").alias("_from"), F.max("_slot").alias("_to")
    )
    edges = blocks.groupBy("_block").agg(F.min("_slot").alias("_low"), F.max("_slot").alias("_high"))
    # One row per block on the broadcast side.
    return (
        groups.join(F.broadcast(edges), "_block")
        .filter((F.col("_from") == F.col("_low")) | (F.col("_to") == F.col("_high")))
        .withColumn("_starts", F.col("_from") == F.col("_low"))
        .drop("_from", "_to", "_low", "_high")
    )


def _carried(blocks: DataFrame, keys: Sequence[str], end: Column, combine) -> DataFrame:
    """Per block, the state its first key brings along; ``combine`` folds the earlier ends."""
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return (
        border_groups(blocks, keys, end.alias("_end"))
        .withColumn("_carry", combine(F.col("_end")).over(earlier))
        .filter(F.col("_starts") & F.col("_carry").isNotNull())
        .select("_block", *keys, "_carry")
    )


def _with_carry(blocks: DataFrame, keys: Sequence[str], end: Column, combine, local: Column) -> DataFrame:
    carried = _carried(blocks, keys, end, combine)
    renamed = carried.withColumnsRenamed({c: f"_c_{c}" for c in ("_block", *keys)})
    # A null key is a key like others.
    same = F.col("_block") == F.col("_c__block")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    # At most one row per block.
    return blocks.withColumn("_local", local).join(F.broadcast(renamed), same, "left")


def _tidy(df: DataFrame, columns: Sequence[str], result: Column, name: str) -> DataFrame:
    return df.select(*columns, result.alias(name))


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Latest non-null ``value`` of the key at or before each row."""
    blocks = range_blocks(df, [*keys, *order])
    upto = _local_window(keys).rowsBetween(W.unboundedPreceding, 0)
    end = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_slot")))
    joined = _with_carry(
        blocks, keys, end, lambda c: F.last(c, ignorenulls=True), F.last(value, ignorenulls=True).over(upto)
    )
    return _tidy(joined, df.columns, F.coalesce("_local", "_carry"), name)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, name: str, default: Column
) -> DataFrame:
    """``value`` (a column, or an expression over the row) of the row before in the key's order; ``default`` for the first row.

    ``value`` must not be null.
    """
    blocks = range_blocks(df, [*keys, *order])
    value = F.col(value) if isinstance(value, str) else value
    end = F.max_by(value, F.col("_slot"))
    joined = _with_carry(
        blocks, keys, end, lambda c: F.last(c, ignorenulls=True), F.lag(value).over(_local_window(keys))
    )
    return _tidy(joined, df.columns, F.coalesce(F.col("_local"), F.col("_carry"), default), name)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including each row."""
    blocks = range_blocks(df, [*keys, *order])
    upto = _local_window(keys).rowsBetween(W.unboundedPreceding, 0)
    joined = _with_carry(blocks, keys, F.sum(value), F.sum, F.sum(value).over(upto))
    return _tidy(joined, df.columns, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)), name)
