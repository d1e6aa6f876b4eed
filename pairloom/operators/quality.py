"""Constraint checks that a table's declaration asks for: counts of offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_and_key_report(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows, rows with a null key part, and rows beyond the first of each key."""
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.lit(name).alias("table_name"), F.lit(", ".join(keys)).alias("key_columns"),
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(~has_null, F.col("n") - 1)), F.lit(0)).alias("repeated_keys"),
    )


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows per value that the domain does not allow; null passes, as in a CHECK."""
    return (
        df.filter(~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("bad_value"))
        .agg(F.count("*").alias("bad_rows"))
    )


def outside_ranges(df: DataFrame, checks: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Offending rows of each check ``name: (column, low, high)``: one scan of the table for all of them."""
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.count(column).alias("checked_rows"),
            F.count_if(~F.col(column).between(low, high)).alias("bad_rows"),
            (F.min(column) + 0.0).alias("min_value"),
            (F.max(column) + 0.0).alias("max_value"),
        )
        for name, (column, low, high) in checks.items()
    ]
    return df.agg(F.array(*rows).alias("checks")).select(F.inline("checks"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """Child rows whose key has no parent row; a null key is no orphan.

    Child keys are counted first, so a key that holds a third of the child meets the
    parent as one row.
    """
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.agg(
        F.lit(relation).alias("relation"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
        F.count("*").alias("orphan_keys"),
    )
