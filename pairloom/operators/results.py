"""Comparison of captured result sets, gold against generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip

NUMERIC_TEXT = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def normalize_value(value: Column) -> Column:
    """Canonical text of a captured cell: null stays null, numbers get four decimals.

    Numbers are decimals, so 1, 1.0 and 1.00001 agree and long integers keep all digits;
    what does not fit a decimal falls back to a double.
    """
    text = strip(value)
    as_decimal = text.try_cast("decimal(38,4)")
    as_text = F.coalesce(as_decimal.cast("string"), text.try_cast("double").cast("string"))
    return F.when(text.rlike(NUMERIC_TEXT), as_text).otherwise(text)


def normalize_cells(values: Column) -> Column:
    return F.transform(values, normalize_value)


def compare_results(rows: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """One row per case: do both sides hold the same rows?

    ``rows`` has (case_id, side, pos, ordered, values). ``cases`` (case_id, ordered) lists the cases; one whose
    results are both empty has no rows, and matches. Both sides are counted against
    each other per (position when order matters, normalised row): equal sequences and
    equal bags both mean that every count is zero. One aggregation, no join, and a
    case with very many rows spreads over its distinct rows.
    """
    sign = F.when(F.col("side") == "gold", 1).otherwise(-1)
    balance = (
        rows.select(
            "case_id", "ordered", F.when(F.col("ordered"), F.col("pos")).alias("at"),
            normalize_cells(F.col("values")).alias("row"), sign.alias("sign"),
        )
        .groupBy("case_id", "ordered", "at", "row")
        .agg(F.sum("sign").alias("surplus"), F.count("*").alias("n"))
    )
    compared = balance.groupBy("case_id", "ordered").agg(
        (F.max(F.abs("surplus")) == 0).alias("rows_match"),
        F.sum(F.abs("surplus")).alias("differing_rows"),
        F.sum("n").alias("rows_compared"),
    )
    if cases is None:
        return compared
    none = F.lit(0).cast("long")
    return cases.select("case_id", "ordered").join(compared.drop("ordered"), "case_id", "left").select(
        "case_id", "ordered", F.coalesce("rows_match", F.lit(True)).alias("rows_match"),
        F.coalesce("differing_rows", none).alias("differing_rows"), F.coalesce("rows_compared", none).alias("rows_compared"),
    )


def digests(rows: DataFrame) -> DataFrame:
    """``bag`` and ``list`` of each ``text_id``: equal where ``compare_results`` finds the rows equal, without and with positions.

    ``rows`` has (text_id, pos, values). A digest adds up the SHA-256 of all rows, spread to 256 bits in eight exact sums of whole
    numbers, so rows are read once and summed where they lie. A text without rows has no digest.
    """
    # A length before each cell: no two rows read the same.
    cell = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    placed = rows.select("text_id", "pos", F.transform("values", lambda v: cell(normalize_value(v))).alias("cells"))
    # The texts are built behind a generator, lest each sum builds them again.
    hashed = placed.select("text_id", "pos", F.explode(F.array(F.sha2(F.array_join("cells", ""), 256))).alias("row")).select(
        "text_id", "row", F.sha2(F.concat_ws(" ", "pos", "row"), 256).alias("place")
    )

    def summed(name: str) -> Column:
        pieces = []
        for at in range(4):
            bits = F.xxhash64(F.lit(at), name)
            pieces += [F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))]
        return F.concat_ws(" ", F.count("*").cast("string"), *[F.sum(p).cast("string") for p in pieces])

    return hashed.groupBy("text_id").agg(summed("row").alias("bag"), summed("place").alias("list"))


def asks_for_order(gold_sql: Column) -> Column:
    """Does the gold text order its result? Then positions count in the comparison."""
    return F.lower(gold_sql).contains("order by")
