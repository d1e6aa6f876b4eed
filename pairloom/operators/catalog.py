"""Schemas by database, and texts screened against the schema of their own database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import screening as S
from pairloom.operators.screen import judge


def schema_dimension(schemas: DataFrame, db_id: str, ddl: str) -> DataFrame:
    """One row per database: ``db_id``, ``known_tables``, ``known_columns``, both sorted.

    A database may have any number of DDL rows; names are made distinct before they are gathered,
    so that a row is as long as its schema. Rows without an id or a DDL are left out.
    """
    given = schemas.filter(F.col(db_id).isNotNull() & F.col(ddl).isNotNull()).select(F.col(db_id).alias("db_id"), F.col(ddl).alias("ddl"))

    def labelled(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    both = F.concat(labelled("table", S.ddl_tables(F.col("ddl"))), labelled("column", S.ddl_columns(F.col("ddl"))))
    # A database without any name is known too.
    names = given.select("db_id", F.explode_outer(both).alias("n")).select("db_id", "n.*").distinct()
    return names.groupBy("db_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))).alias(f"known_{kind}s") for kind in ("table", "column")]
    )


def with_schema(texts: DataFrame, db_id: str, dimension: DataFrame) -> DataFrame:
    """Add ``known_tables`` and ``known_columns`` of each text's database, null where it has no schema.

    The schemas are broadcast: joined by database, all texts of one database would be screened in one task.
    """
    named = dimension.withColumnRenamed("db_id", "_db")
    return texts.join(F.broadcast(named), F.col(db_id) == F.col("_db"), "left").drop("_db")


def judge_by_database(texts: DataFrame, sql: str, db_id: str, dimension: DataFrame) -> DataFrame:
    """Add ``allowed``, ``reason`` and ``violations``: a name is known where the text's own database has it.

    Texts of a database without a schema are screened for everything but names.
    """
    placed = with_schema(texts, db_id, dimension)
    judged = judge(placed, sql, F.col("known_tables"), F.col("known_columns"), F.col(db_id))
    return judged.drop("known_tables", "known_columns")
