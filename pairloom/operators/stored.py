"""Tables that grow by commits: bucketed, copied on write, with a manifest per commit.

A table is a folder. ``data/commit=<id>/bucket=<n>`` holds rows and is never changed; ``log/version=<n>`` says for
each bucket which commits hold its rows now, and is written last. A reader takes the newest manifest, so
it sees all of a commit or nothing of it. A commit has an id of the caller's: the same again - a job that was
repeated after it had written - changes nothing. One writer at a time.

An upsert reads and rewrites only the buckets that its keys fall into; an append reads nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pairloom.operators.runs import latest
from pairloom.session import write_once

BUCKETS = 16

_LOG = "bucket int, commit string, run string, version int"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a table: ``version`` and ``run``."""
    return _log(spark, path).select("version", "run").distinct()


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, list[int]]]:
    """Version and, by commit, the buckets whose rows it holds: at most a row per bucket and commit still in use."""
    log = _log(spark, path)
    last = version if version is not None else log.agg(F.max("version")).first()[0]
    held: dict[str, list[int]] = {}
    if last is None:
        return -1, held
    for row in log.filter((F.col("version") == last) & F.col("bucket").isNotNull()).collect():
        held.setdefault(row["commit"], []).append(row["bucket"])
    return last, held


def _rows(spark: SparkSession, path: str, schema: StructType, held: dict[str, list[int]]) -> DataFrame:
    """Rows of the given buckets, as partitions: files of others are not opened."""
    if not held:
        return spark.createDataFrame([], schema)
    placed = StructType([*schema.fields, StructField("commit", StringType()), StructField("bucket", IntegerType())])
    wanted: list[Column] = [(F.col("commit") == c) & F.col("bucket").isin(sorted(b)) for c, b in held.items()]
    stored = spark.read.schema(placed).parquet(f"{path}/data")
    return stored.filter(reduce(Column.__or__, wanted)).select(*schema.names)


def read(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The table as of its newest commit, or of an earlier version; empty before the first."""
    return _rows(spark, path, schema, _manifest(spark, path, version)[1])


def _done(spark: SparkSession, path: str, run: str) -> bool:
    return not _log(spark, path).filter(F.col("run") == run).isEmpty()


def _publish(spark: SparkSession, path: str, version: int, run: str, held: dict[str, list[int]]) -> None:
    rows = [(b, c, run) for c, buckets in held.items() for b in buckets] or [(None, None, run)]
    frame = spark.createDataFrame(rows, "bucket int, commit string, run string")
    frame.coalesce(1).write.mode("error").parquet(f"{path}/log/version={version}")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def append(rows: DataFrame, path: str, run: str, keys: Sequence[str] = (), buckets: int = BUCKETS) -> bool:
    """Add rows. False, and nothing done, if the run is in the table already."""
    spark = rows.sparkSession
    if _done(spark, path, run):
        return False
    version, held = _manifest(spark, path)
    placed = rows.withColumn("bucket", _bucket(keys, buckets) if keys else F.lit(0))
    touched = _written(placed, path, run)
    _publish(spark, path, version + 1, run, {**held, **({run: touched} if touched else {})})
    return True


def _written(placed: DataFrame, path: str, run: str) -> list[int]:
    """Write the rows of a commit - again, if a job died before its manifest - and name their buckets."""
    spark, folder = placed.sparkSession, f"{path}/data/commit={run}"
    # One file a bucket.
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    fields = [StructField(f.name, f.dataType) for f in placed.schema if f.name != "bucket"]
    stored = spark.read.schema(StructType([*fields, StructField("bucket", IntegerType())])).parquet(folder)
    return sorted(r["bucket"] for r in stored.select("bucket").distinct().collect())


def upsert(rows: DataFrame, path: str, run: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> bool:
    """Put rows by key, the newest by ``order`` wins; of equal ones that of the later commit.

    Only buckets with a changed key are rewritten. False, and nothing done, if the run is in the table already.
    """
    spark = rows.sparkSession
    if _done(spark, path, run):
        return False
    version, held = _manifest(spark, path)
    names = rows.columns
    incoming = latest(rows, list(keys), list(order)).withColumn("bucket", _bucket(keys, buckets))
    incoming = write_once(incoming, "incoming")
    touched = {r["bucket"] for r in incoming.select("bucket").distinct().collect()}
    old = {c: [b for b in own if b in touched] for c, own in held.items()}
    kept = {c: [b for b in own if b not in touched] for c, own in held.items()}
    before = _rows(spark, path, rows.schema, {c: b for c, b in old.items() if b})
    both = before.withColumn("_new", F.lit(0)).unionByName(incoming.select(*names, F.lit(1).alias("_new")))
    merged = latest(both, list(keys), [*order, "_new"]).select(*names).withColumn("bucket", _bucket(keys, buckets))
    written = _written(merged, path, run)
    _publish(spark, path, version + 1, run, {c: b for c, b in {**kept, run: written}.items() if b})
    return True
