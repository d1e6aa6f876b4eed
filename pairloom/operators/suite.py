"""Run a suite of query texts and capture what each returns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.clauses import outcome
from pairloom.operators.ranking import with_position
from pairloom.operators.results import asks_for_order, compare_results
from pairloom.operators.screen import judge
from pairloom.session import write_once

CAPTURED_ROWS = 50

# Error conditions of the SQL front end and the type each one counts as.
ERROR_TYPES = {
    "PARSE_SYNTAX_ERROR": "SyntaxError",
    "TABLE_OR_VIEW_NOT_FOUND": "TableNotFound",
    "UNRESOLVED_COLUMN": "ColumnNotFound",
}

_SIDE_NAMES = ("gold", "generated")
_STATUS = "name string, executed boolean, columns string, error_type string"


def screen_texts(spark: SparkSession, texts: Mapping[str, str], tables: list[str], columns: list[str]) -> dict[str, bool]:
    """Which texts of the suite may run. The result has one row per text of the suite."""
    known_tables = F.array(*[F.lit(t) for t in tables])
    known_columns = F.array(*[F.lit(c) for c in columns])
    frame = spark.createDataFrame(list(texts.items()), "name string, text string")
    rows = judge(frame, "text", known_tables, known_columns).select("name", "allowed").collect()
    return {row["name"]: row["allowed"] for row in rows}


# What Spark raises for a text; a failed job may come as the plain Java error.
FAILURES = (PySparkException, Py4JJavaError)


def failure_type(error: Exception) -> str:
    """Type of what Spark reports about a text."""
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    return ERROR_TYPES.get(condition.split(".")[0], "ExecutionError")


def _run(spark: SparkSession, text: str, allowed: bool) -> tuple[DataFrame | None, str | None]:
    """The written result of a text, or why there is none.

    The text runs by itself, once: an error while it runs is an error of this text. What is not
    known to be allowed is not even parsed, since parsing runs commands.
    """
    if not allowed:
        return None, "SafetyViolation"
    try:
        df = spark.sql(text)
        # Names may repeat in a result, but not in a written table.
        return write_once(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), "captured"), None
    except FAILURES as error:  # analysis, parse and run-time errors
        return None, failure_type(error)


def _columns(spark: SparkSession, text: str) -> str:
    return ",".join(spark.sql(text).columns)


def capture_status(spark: SparkSession, texts: Mapping[str, str], allowed: Mapping[str, bool]) -> DataFrame:
    """One row per text: executed, columns, full row count, error type."""
    parts = []
    for name, text in texts.items():
        df, error = _run(spark, text, allowed.get(name, False))
        if df is None:
            failed = spark.createDataFrame([(name, False, "", error)], _STATUS)
            parts.append(failed.withColumn("row_count", F.lit(0).cast("long")))
        else:
            parts.append(
                df.agg(
                    F.lit(name).alias("name"), F.lit(True).alias("executed"),
                    F.lit(_columns(spark, text)).alias("columns"),
                    F.lit(None).cast("string").alias("error_type"), F.count("*").alias("row_count"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def capture_rows(spark: SparkSession, texts: Mapping[str, str], allowed: Mapping[str, bool]) -> DataFrame:
    """The first 50 rows of each text that runs, as a JSON array of its values."""
    parts = [spark.createDataFrame([], "name string, cells string")]
    for name, text in texts.items():
        if not allowed.get(name, False):
            continue
        try:
            df = spark.sql(text)
            placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).limit(CAPTURED_ROWS)
            cells = F.to_json(F.array(*[F.col(c).cast("string") for c in placed.columns]))
            # Fifty rows at most, run now so that an error stays with its text.
            parts.append(write_once(placed.select(F.lit(name).alias("name"), cells.alias("cells")), "captured"))
        except FAILURES:
            continue
    return reduce(DataFrame.unionByName, parts)


def _result_rows(spark: SparkSession, text: str, allowed: bool) -> tuple[DataFrame | None, str | None]:
    """(``pos``, ``values``) of a text's result in its order, or the type of its error."""
    if not allowed:
        return None, "SafetyViolation"
    try:
        df = spark.sql(text)
        cells = F.array(*[F.col(f"c{i}").cast("string") for i in range(len(df.columns))])
        placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(
            F.monotonically_increasing_id().alias("at"), cells.alias("values")
        )
        return with_position(write_once(placed, "result"), ["at"], "pos").select("pos", "values"), None
    except FAILURES as error:
        return None, failure_type(error)


def live_outcomes(
    spark: SparkSession, cases: Mapping[str, tuple[str, str]], tables: list[str], columns: list[str]
) -> DataFrame:
    """Run gold and generated text of each case, compare what they return, and give the verdict.

    (``case_id``, ``outcome``), null for a right answer. Both texts are screened first. Positions
    count where the gold text asks for an order; two empty results match. Texts are looped over on the
    driver, their rows stay in Spark.
    """
    texts = {f"{side} {case}": text for case, pair in cases.items() for side, text in zip(_SIDE_NAMES, pair)}
    allowed = screen_texts(spark, texts, tables, columns)
    given, captured = [], []
    for case, (gold, generated) in cases.items():
        errors = []
        for side, text in zip(_SIDE_NAMES, (gold, generated)):
            rows, error = _result_rows(spark, text, allowed.get(f"{side} {case}", False))
            errors.append(error)
            if rows is not None:
                captured.append(rows.select(F.lit(case).alias("case_id"), F.lit(side).alias("side"), "pos", "values"))
        given.append((case, gold, generated.strip() != "", *errors))
    ddl = "case_id string, gold_sql string, generated boolean, gold_error string, actual_error string"
    known = spark.createDataFrame(given, ddl).withColumn("ordered", asks_for_order(F.col("gold_sql")))
    nothing = spark.createDataFrame([], "case_id string, side string, pos long, values array<string>")
    rows = reduce(DataFrame.unionByName, captured, nothing).join(F.broadcast(known.select("case_id", "ordered")), "case_id")
    matches = compare_results(rows, known).select("case_id", "rows_match")
    # The type of an error that Spark reports is known already.
    verdict = F.when(~F.col("generated"), F.lit("GenerationFailed")).otherwise(
        F.coalesce("actual_error", outcome(F.col("generated"), F.lit(None).cast("string"), F.col("gold_error"), F.col("rows_match")))
    )
    return known.join(matches, "case_id").select("case_id", verdict.alias("outcome"))


def suite_status(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("queries"), F.count_if("executed").alias("executed_queries"),
        F.count_if(~F.col("executed")).alias("failed_queries"), F.bool_and("executed").alias("all_passed"),
        F.sum("row_count").alias("total_rows"),
    )
