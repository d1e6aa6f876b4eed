"""Order statistics and exact positions that never sort everything in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.session import parallelism, write_once

# monotonically_increasing_id keeps the partition number above bit 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort ``df`` globally into contiguous blocks and number the rows.

    Adds ``_slot`` (increasing in the given order) and ``_block`` (the partition
    it fell into). Blocks are cut by sampled ranges of the whole sort key, so one
    hot leading key spreads over many of them. The result is written once because
    several branches must agree on the block of each row.
    """
    blocks = parallelism(df.sparkSession)
    ordered = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    slotted = write_once(ordered.withColumn("_slot", F.monotonically_increasing_id()), "blocks")
    return slotted.withColumn("_block", F.shiftright("_slot", _ROW_BITS))


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the exact zero-based position of each row in the given order."""
    blocks = range_blocks(df, order)
    sizes = blocks.groupBy("_block").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # One row per block: never more than the shuffle partition count.
    return blocks.join(F.broadcast(offsets), "_block").select(
        *df.columns, (F.col("_before") + F.col("_slot").bitwiseAND(_ROW_MASK)).alias(name)
    )


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of a key, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


@dataclass(frozen=True)
class SplitCuts:
    """Largest hash of the train and of the validation part, and the exact sizes."""

    train: str
    val: str
    sizes: dict[str, int]


def split_cuts(df: DataFrame, key: str, seed: int, train_ratio: float, val_ratio: float) -> SplitCuts:
    """Find the hash values where a split of exact sizes must cut.

    Hashes are counted by their first four digits, then the two groups that hold a
    cut are counted by eight, and so on. Each pass is a grouped count of at most
    65,536 rows per cut, whatever the size of the table; no row is sorted.
    """
    hashes = df.select(hash_order(F.col(key), seed).alias("h"))
    counts = _digit_counts(hashes, [""], 4)
    total = sum(counts.values())
    n_train, n_val = int(total * train_ratio), int(total * val_ratio)
    wanted = {"train": n_train, "val": n_train + n_val}
    found = {side: ("", rank) for side, rank in wanted.items() if rank > 0}
    digits = 4
    while True:
        for side, (prefix, rank) in found.items():
            found[side] = _descend(counts, prefix, rank)
        open_prefixes = sorted({prefix for prefix, _ in found.values() if counts[prefix] > 1})
        if digits == 32 or not open_prefixes:
            break
        digits += 4
        done = {p: 1 for p, _ in found.values() if p not in open_prefixes}
        counts = {**_digit_counts(hashes, open_prefixes, digits), **done}
    # A prefix that belongs to a single row stands for it: pad it to compare above that hash.
    upper = {side: prefix + "g" if len(prefix) < 32 else prefix for side, (prefix, _) in found.items()}
    sizes = {"train": n_train, "val": n_val, "test": total - n_train - n_val}
    return SplitCuts(upper.get("train", ""), upper.get("val", ""), sizes)


def _digit_counts(hashes: DataFrame, prefixes: list[str], digits: int) -> dict[str, int]:
    """Rows per hash prefix of ``digits`` digits, below the given prefixes."""
    kept = hashes if prefixes == [""] else hashes.filter(
        F.substring("h", 1, digits - 4).isin(prefixes)
    )
    rows = kept.groupBy(F.substring("h", 1, digits).alias("p")).count().collect()
    return {row["p"]: row["count"] for row in rows}


def _descend(counts: dict[str, int], prefix: str, rank: int) -> tuple[str, int]:
    """Group below ``prefix`` that holds the row of this rank, and its rank in there."""
    if prefix in counts and counts[prefix] == 1 and prefix:
        return prefix, 1
    for group in sorted(p for p in counts if p.startswith(prefix)):
        if rank <= counts[group]:
            return group, rank
        rank -= counts[group]
    raise ValueError("rank beyond the number of rows")


def assign_split(df: DataFrame, key: str, cuts: SplitCuts, seed: int) -> DataFrame:
    """Add ``split`` by comparing each row's hash with the cuts: no shuffle."""
    h = hash_order(F.col(key), seed)
    return df.withColumn(
        "split", F.when(h <= cuts.train, "train").when(h <= cuts.val, "val").otherwise("test")
    )
