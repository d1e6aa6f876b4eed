"""Exact order statistics of groups, spread over range-sorted blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.operators.timeline import running_sum


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value of each group; repeated values shrink before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Values at exact zero-based ranks: one row (keys, n, name, value) per wanted rank.

    ``ranks`` maps a name to an expression over ``n``, the rows of the group. Equal values are
    counted first; the counts are summed in order over range-sorted blocks, so that a
    group with very many distinct values is worked on by many tasks. Nulls do not count;
    NaN is larger than all numbers.
    """
    keys = list(keys)
    histogram = value_histogram(df, keys, value)
    upto = running_sum(histogram.withColumn("_all", F.lit(0)), ["_all", *keys], [value], "_n", "_upto")
    sizes = histogram.groupBy(*keys).agg(F.sum("_n").alias("n")) if keys else histogram.agg(F.sum("_n").alias("n"))
    renamed = sizes.withColumnsRenamed({c: f"_t_{c}" for c in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_t_{key}"))
    # One row per group.
    sized = upto.join(renamed, same) if keys else upto.crossJoin(F.broadcast(renamed))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("_upto") - F.col("_n")) & (w["rank"] < F.col("_upto")))
    return sized.select(*keys, "n", value, F.inline(inside)).select(*keys, "n", "name", value)


def floor_index_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Element ``int(n * p)`` of the sorted values, one column per point."""
    ranks = {name: F.floor(F.col("n") * F.lit(p)) for name, p in points.items()}
    rows = ranked_values(df, keys, value, ranks)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in points]
    )


def interpolated_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Value at rank ``(n - 1) * p``, linear between neighbours, two decimals."""
    ranks = {}
    for name, p in points.items():
        at = (F.col("n") - 1) * F.lit(p)
        ranks[f"{name}:low"] = F.floor(at)
        ranks[f"{name}:high"] = F.ceil(at)
    rows = ranked_values(df, keys, value, ranks)

    def pick(label: str) -> Column:
        return F.max(F.when(F.col("name") == label, F.col(value)))

    picked = rows.groupBy(*keys).agg(
        F.max("n").alias("_n"),
        *[pick(f"{name}:{side}").alias(f"_{name}_{side}") for name in points for side in ("low", "high")],
    )
    columns = []
    for name, p in points.items():
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        between = low * (F.ceil(at) - at) + high * (at - F.floor(at))
        columns.append(round_half_up(F.when(F.floor(at) == F.ceil(at), low).otherwise(between), 2).alias(name))
    return picked.select(*keys, *columns)
