"""Reproducible shuffle into shards by a Feistel permutation of the row numbers.

Every row gets its number in a fixed global order. A Feistel network over
``a * b >= rows`` points permutes the numbers; a point beyond the rows walks on along its
cycle until it is one. Shard and slot are remainder and quotient of the permuted number,
so they can be computed for any row number without looking at another row, shard sizes
differ by one at most, and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.columns import carried, restored
from pairloom.operators.ranking import with_position

ROUNDS = 8
WALK = 64


def _sides(rows: int) -> tuple[int, int]:
    """``a * b >= rows`` with less than ``a`` points to spare."""
    a = max(1, isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def _mixed(side: Column, seed: int, turn: Column | int, modulus: int) -> Column:
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.pmod(F.xxhash64(side, F.lit(seed).cast("long"), turn.cast("int")), F.lit(modulus).cast("long"))


def _permuted_once(point: Column, a: int, b: int, seed: int) -> Column:
    """The network as one expression, for the few points that walk on."""
    start = F.struct(F.floor(point / F.lit(b)).cast("long").alias("l"), F.pmod(point, F.lit(b)).cast("long").alias("r"))

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(left + _mixed(right, seed, i, a), F.lit(a).cast("long"))).otherwise(left).alias("l"),
            F.when(even, right).otherwise(F.pmod(right + _mixed(left, seed, i, b), F.lit(b).cast("long"))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def with_permuted(df: DataFrame, number: str, rows: int, seed: int, name: str) -> DataFrame:
    """Add ``name``: the permuted ``number``, where the numbers are 0 to ``rows - 1``.

    The network is staged as projections, two columns a round. A walk ends after as many
    steps as there are points to spare at most; more than 64 steps would need a chance
    below 1e-70, and raise an error instead of a wrong place.
    """
    a, b = _sides(rows)
    staged = df.withColumns(
        {"_l": (F.col(number) / F.lit(b)).cast("long"), "_r": F.pmod(F.col(number), F.lit(b)).cast("long")}
    )
    for i in range(ROUNDS):
        if i % 2 == 0:
            staged = staged.withColumn("_l", F.pmod(F.col("_l") + _mixed(F.col("_r"), seed, i, a), F.lit(a).cast("long")))
        else:
            staged = staged.withColumn("_r", F.pmod(F.col("_r") + _mixed(F.col("_l"), seed, i, b), F.lit(b).cast("long")))
    staged = staged.withColumn("_point", F.col("_l") * F.lit(b) + F.col("_r"))
    spare = a * b - rows
    if spare <= 0:
        return staged.withColumn(name, F.col("_point")).drop("_l", "_r", "_point")
    inside = F.lit(rows).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(spare, WALK))),
        F.col("_point"),
        lambda point, _: F.when(point < inside, point).otherwise(_permuted_once(point, a, b, seed)),
    )
    staged = staged.withColumn("_end", F.when(F.col("_point") < inside, F.col("_point")).otherwise(walked))
    end = F.when(F.col("_end") < inside, F.col("_end")).otherwise(F.raise_error(F.lit("walk too long")).cast("long"))
    return staged.withColumn(name, end).drop("_l", "_r", "_point", "_end")


def feistel_shards(df: DataFrame, order: Sequence[str], shards: int, seed: int = 0) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long, from 0).

    ``order`` fixes the row numbers, nulls first. Rows equal in all of it are
    interchangeable to the operator: name as many columns as tell rows apart. Repeated rows
    get places of their own. An empty table gives an empty result. Columns called ``shard``
    or ``slot`` are replaced. Reruns over the same rows agree, however they are partitioned.
    """
    rows = df.count()
    keys = {f"_k{i}": F.col(c) for i, c in enumerate(order)}
    numbered = with_position(carried(df, **keys), list(keys), "_number")
    placed = with_permuted(numbered, "_number", rows, seed, "_place")
    return restored(
        placed,
        df.columns,
        shard=F.pmod(F.col("_place"), F.lit(shards)).cast("int"),
        slot=F.floor(F.col("_place") / F.lit(shards)).cast("long"),
    )
