"""Exports of bounded files with a manifest that is written last.

An export is a folder: ``files/version=<n>/split=<name>`` holds JSON lines, at most so many rows a file, and
``manifest/version=<n>`` lists the files with their rows and bytes. A reader opens what the newest manifest
lists: while an export is written, or after it failed half way, that is the one before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_FILE = 500_000

_MANIFEST = "split string, file string, n_rows long, n_bytes long, version int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of the newest export: ``split``, ``file``, ``n_rows``, ``n_bytes``, ``version``; none before the first."""
    try:
        listed = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    newest = listed.agg(F.max("version")).first()[0]
    return listed.filter((F.col("version") == F.lit(newest)) & F.col("file").isNotNull())


def _last_version(spark: SparkSession, path: str) -> int:
    try:
        last = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return -1 if last is None else last


def write_files(records: DataFrame, folder: str, rows_per_file: int) -> None:
    """JSON lines by ``split``. A file that a failed attempt left is replaced."""
    writer = records.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("split").json(folder)


def export(records: DataFrame, path: str, rows_per_file: int = ROWS_A_FILE) -> int:
    """Write records (with a column ``split``) as the next version; returns its number.

    Every task writes files of its own, so a split that holds most rows is spread over as many files as
    there are tasks, or more.
    """
    spark = records.sparkSession
    version = _last_version(spark, path) + 1
    folder = f"{path}/files/version={version}"
    write_files(records, folder, rows_per_file)
    lines = spark.read.schema("value string, split string").text(folder)
    listed = lines.groupBy("split", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes")
    )
    if records.isEmpty():
        listed = spark.createDataFrame([(None, None, 0, 0)], "split string, file string, n_rows long, n_bytes long")
    # One row per file.
    listed.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")
    return version


def read_export(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The records of the newest export, with their split."""
    files = [row["file"] for row in manifest(spark, path).select("file").collect()]
    if not files:
        return spark.createDataFrame([], f"{ddl}, split string")
    base = f"{path}/files"
    reader = spark.read.schema(f"{ddl}, version int, split string").option("basePath", base)
    return reader.json(files).drop("version")
