"""Files of question/SQL pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.prepare import PAIR_SCHEMA


def scan_pairs(spark: SparkSession, path: str, json_array: bool = False) -> DataFrame:
    """Pairs in JSON files; keys that are absent become null.

    One record or one array of records per line, which splits into tasks; with ``json_array`` each file is one
    array over any number of lines, read by one task. What does not parse fails instead of
    giving rows of nulls.
    """
    reader = spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").option("multiLine", json_array)
    return reader.json(path)
