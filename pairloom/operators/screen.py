"""Screening of a table of SQL texts: one scan, no shuffle.

The steps are separate projections on purpose. Each cleaned text, name list and so
on becomes a column that the later rules read, instead of an expression repeated
inside every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import clauses as C
from pairloom.functions import screening as S
from pairloom.functions.screening import _if, _words
from pairloom.functions.text import drop_comments, first_statement, mask_literals, strip, strip_fences


def keep_where(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """``columns`` of the rows that pass.

    A filter would be pushed below the projections that compute the condition, where the
    optimizer repeats their text patterns once per use. An array of one row or none is
    generated where it stands.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def with_bare(df: DataFrame, sql: str) -> DataFrame:
    """Add ``_clean`` (no fences) and ``_bare`` (lower case, literals empty)."""
    cleaned = df.withColumn("_clean", strip_fences(F.coalesce(F.col(sql), F.lit(""))))
    return cleaned.withColumn("_bare", S.bare_text(F.col("_clean")))


def with_names(df: DataFrame, sql: str) -> DataFrame:
    """Add the tables, WITH names and columns that the text mentions."""
    named = with_bare(df, sql).withColumns(
        {"_tables": S.referenced_tables(F.col("_bare")), "_ctes": S.cte_names(F.col("_bare"))}
    )
    return named.withColumn("_columns", S.referenced_columns(F.col("_bare"), F.col("_tables"), F.col("_ctes")))


def with_normalized(df: DataFrame, sql: str, name: str) -> DataFrame:
    """Add the comparable form of a text column."""
    lowered = df.withColumn("_lower", F.lower(drop_comments(strip_fences(F.coalesce(F.col(sql), F.lit(""))))))
    masked = lowered.withColumn("_lower", mask_literals(F.col("_lower")))
    return masked.withColumn(name, C.normalize_masked(F.col("_lower"))).drop("_lower")


def with_well_formed(df: DataFrame, sql: str, name: str) -> DataFrame:
    """Add a flag: does the text look like SQL that parses?"""
    bared = df.withColumn("_bare", S.bare_text(F.col(sql)))
    return bared.withColumn(name, S.is_well_formed(F.col(sql), F.col("_bare"))).drop("_bare")


def with_extracted(df: DataFrame, output: str, name: str) -> DataFrame:
    """Add the SQL found in a model's answer."""
    return df.withColumn("_body", S.fenced_or_whole(F.col(output))).withColumn(
        name, S.from_select(F.col("_body"))
    ).drop("_body")


def judge(df: DataFrame, sql: str, tables: Column, columns: Column, db: Column | str = "target") -> DataFrame:
    """Add ``allowed``, ``reason`` and ``violations`` for each text.

    Allowed is a single statement that reads: a SELECT, or WITH queries and a SELECT.
    ``tables`` and ``columns`` are arrays of the names the schema knows: literals for
    one schema, or columns joined in by database. Null: there is no schema to check against; nor
    are columns checked against a schema without any.
    """
    db = F.lit(db) if isinstance(db, str) else F.coalesce(db, F.lit("target"))
    none = F.array().cast("array<string>")
    facts = with_names(df, sql).withColumns(
        {
            "_count": S.statement_count(F.col("_bare")),
            "_operations": S.mutating_operations(S.first_bare(F.col("_bare"))),
            "_missing": F.when(tables.isNotNull(), S.unknown_tables(F.col("_tables"), F.col("_ctes"), tables)).otherwise(none),
            "_strange": F.when(F.size(F.coalesce(columns, none)) > 0, S.unknown_columns(F.col("_columns"), columns)).otherwise(none),
            "_formed": S.is_well_formed(F.col("_clean"), F.col("_bare")),
        }
    )
    count, operations, missing, strange = (F.col(c) for c in ("_count", "_operations", "_missing", "_strange"))
    label = "Prohibited AST operation detected: "
    found = F.concat(
        _if(
            count > 1,
            F.concat(
                F.lit("Multiple SQL statements detected ("), count.cast("string"),
                F.lit(" statements). Multi-statement stacked execution is prohibited."),
            ),
        ),
        F.when(
            F.size(operations) > 0,
            F.split(F.concat(F.lit(label), F.array_join(operations, "\n" + label)), "\n"),
        ).otherwise(F.array().cast("array<string>")),
        _if(~S.has_read_only_root(F.col("_bare")), F.lit(S.NOT_READ_ONLY_VIOLATION)),
        _if(S.has_pragma(F.col("_clean")), F.lit(S.PRAGMA_VIOLATION)),
        _if(S.has_attach(F.col("_clean")), F.lit(S.ATTACH_VIOLATION)),
        _if(
            F.size(missing) > 0,
            F.concat(
                F.lit("Referenced table(s) '"), F.array_join(missing, "', '"),
                F.lit("' do not exist in database schema '"), db, F.lit("'."),
            ),
        ),
        _if(
            F.size(strange) > 3,
            F.concat(
                F.lit("Referenced multiple unrecognized columns: "), F.array_join(F.slice(strange, 1, 3), ", ")
            ),
        ),
    )
    violations = (
        F.when(F.col("_clean") == "", _words([S.EMPTY_VIOLATION]))
        .when(count == 0, _words([S.NO_STATEMENT_VIOLATION]))
        .when(~F.col("_formed"), _words([S.PARSE_VIOLATION]))
        .otherwise(found)
    )
    listed = facts.withColumn("violations", violations)
    n = F.size("violations")
    reason = (
        F.when(F.col("_clean") == "", S.EMPTY_REASON)
        .when(count == 0, S.NO_STATEMENT_REASON)
        .when(~F.col("_formed"), S.PARSE_REASON)
        .when(n == 0, S.PASSED)
        .otherwise(F.concat(F.lit("SQL execution blocked due to "), n.cast("string"), F.lit(" safety violation(s)")))
    )
    return listed.select(*df.columns, (n == 0).alias("allowed"), reason.alias("reason"), "violations")


def validate(df: DataFrame, output: str) -> DataFrame:
    """Add valid flag, cleaned SQL, referenced tables and error of a model's answer."""
    extracted = with_extracted(df, output, "_sql").withColumn("_sql", first_statement(F.col("_sql")))
    bared = extracted.withColumn("_bare", S.bare_text(F.col("_sql")))
    flagged = bared.withColumn("valid", S.is_well_formed(F.col("_sql"), F.col("_bare")))
    valid = F.col("valid")
    return flagged.select(
        *df.columns,
        "valid",
        F.when(valid, F.col("_sql")).otherwise(strip(F.col(output))).alias("formatted_sql"),
        F.when(valid, S.referenced_tables(F.col("_bare")))
        .otherwise(F.array().cast("array<string>"))
        .alias("tables_referenced"),
        F.when(~valid, F.lit(S.NO_SQL_ERROR)).alias("syntax_error"),
    )


def with_shape(df: DataFrame, normalized: str, name: str, needed: Column | None = None) -> DataFrame:
    """Add joins, tables and well-formed flag of a normalised text, as ``<name>_joins`` and so on.

    Rows for which ``needed`` does not hold get nulls, without any pattern work.
    """
    text, bare = F.col(f"{name}_text"), F.col(f"{name}_bare")
    return (
        df.withColumn(f"{name}_text", F.col(normalized) if needed is None else F.when(needed, F.col(normalized)))
        .withColumn(f"{name}_bare", S.bare_text(text))
        .withColumns(
            {
                f"{name}_ok": S.is_well_formed(text, bare),
                f"{name}_joins": C.join_clauses(text),
                f"{name}_tables": F.array_sort(S.referenced_tables(bare)),
                f"{name}_ctes": S.cte_names(bare),
            }
        )
    )


def with_clauses(df: DataFrame, name: str, needed: Column | None = None) -> DataFrame:
    """Add columns, functions and clause texts to a frame that went through ``with_shape``."""
    text, bare = F.col(f"{name}_text"), F.col(f"{name}_bare")
    if needed is not None:
        text, bare = F.when(needed, text), F.when(needed, bare)
    placed = df.withColumns({f"{name}_text": text, f"{name}_bare": bare})
    text, bare = F.col(f"{name}_text"), F.col(f"{name}_bare")
    return placed.withColumns(
        {
            f"{name}_columns": S.referenced_columns(bare, F.col(f"{name}_tables"), F.col(f"{name}_ctes")),
            f"{name}_functions": C.function_names(bare),
            f"{name}_where_text": C.clause_text(text, C.WHERE_CLAUSE),
            f"{name}_group_text": C.clause_text(text, C.GROUP_CLAUSE),
            f"{name}_order_text": C.clause_text(text, C.ORDER_CLAUSE),
            f"{name}_limit_text": C.clause_text(text, C.LIMIT_CLAUSE),
        }
    )
