"""Length, validity and catalogue profiles of prepared pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.functions.screening import bare_text, is_well_formed, referenced_tables
from pairloom.operators.percentiles import floor_index_percentiles
from pairloom.operators.screen import with_well_formed

# The percentile points of the length report.
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def length_distribution(df: DataFrame, tokens: str, max_len: int = 2048) -> DataFrame:
    return df.agg(
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
        round_half_up(F.avg(tokens), 1).alias("mean_tokens"),
        F.count_if(F.col(tokens) > max_len).alias("exceeding_max_len"),
    )


def length_percentiles(df: DataFrame, tokens: str) -> DataFrame:
    return floor_index_percentiles(df, [], tokens, PERCENTILES)


def validity_report(df: DataFrame, sql: str) -> DataFrame:
    """Total, valid, invalid and valid share in percent (0 for an empty table)."""
    counted = with_well_formed(df.select(sql), sql, "_ok").agg(
        F.count("*").alias("total_records"), F.count_if("_ok").alias("valid_sql")
    )
    share = F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(
        round_half_up(F.col("valid_sql") * 100 / F.col("total_records"), 2)
    )
    return counted.select(
        "total_records", "valid_sql", (F.col("total_records") - F.col("valid_sql")).alias("invalid_sql"),
        share.alias("validity_percentage"),
    )


def unique_tables(df: DataFrame, sql: str) -> DataFrame:
    """Distinct tables referenced by the well-formed texts."""
    bared = df.select(sql).withColumn("_bare", bare_text(F.col(sql)))
    tables = F.when(is_well_formed(F.col(sql), F.col("_bare")), referenced_tables(F.col("_bare")))
    return bared.select(F.explode(tables).alias("table_name")).distinct()


def catalog_listing(df: DataFrame, dataset: str, domain: str) -> DataFrame:
    """Pairs and sorted distinct domains of each dataset.

    Counted per (dataset, domain) first, so the list only ever holds distinct domains.
    """
    named = F.coalesce(F.col(domain), F.lit("unknown"))
    parts = df.groupBy(F.col(dataset).alias("dataset_name"), named.alias("domain")).agg(F.count("*").alias("n"))
    return parts.groupBy("dataset_name").agg(
        F.sum("n").alias("total_pairs"), F.array_join(F.array_sort(F.collect_list("domain")), ",").alias("domains")
    )
