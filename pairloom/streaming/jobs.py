"""Structured Streaming jobs over files that arrive in a folder.

Every job takes what is there (``availableNow``), in batches of a bounded number of files, and stops. A job
lives in a folder of its own below the shared one: its checkpoint, and tables with one folder a batch. Run
again with the same folder it goes on where it stopped; a batch that is repeated after a failure
overwrites its own rows only, so that every row counts once. Results never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from pairloom.functions.numbers import round_half_up
from pairloom.operators.screen import judge
from pairloom.operators.telemetry import micros
from pairloom.session import scratch_path

FILES_A_BATCH = 100


def read_stream(spark: SparkSession, folder: str, file: str, schema, files: int = FILES_A_BATCH) -> DataFrame:
    """Stream over the Parquet files of a folder whose names match ``file``, at most ``files`` of them a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


@dataclass(frozen=True)
class Job:
    """The folder of a streaming job; by default a new one."""

    spark: SparkSession
    folder: str

    @classmethod
    def at(cls, stream: DataFrame, folder: str | None, label: str) -> Job:
        return cls(stream.sparkSession, folder or scratch_path(stream.sparkSession, label))

    def run(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
        """Hand every open batch to ``sink``, with its number."""
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/state")
        running = writer.trigger(availableNow=True).foreachBatch(sink).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()

    def put(self, table: str, batch: DataFrame, number: int) -> None:
        """The rows of one batch; the same batch again replaces them."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={number}")

    def table(self, name: str, schema: StructType) -> DataFrame:
        """All batches of a table, with the column ``batch``; no rows before the first batch."""
        schema = StructType([*schema.fields, StructField("batch", LongType())])
        reader = self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.folder}/{name}")
        except Exception as error:
            if getattr(error, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def append_to_table(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run the stream into a table and read it."""
    job = Job.at(stream, folder, label)
    job.run(stream, lambda batch, number: job.put("rows", batch, number))
    return job.table("rows", stream.schema).drop("batch")


def complete_to_table(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run an aggregate in complete mode and read the result of its last batch, of this run or an earlier one."""
    job = Job.at(stream, folder, label)
    job.run(stream, lambda batch, number: job.put("results", batch, number), "complete")
    results = job.table("results", stream.schema)
    last = results.agg(F.max("batch")).first()[0]
    return results.filter(F.col("batch") == F.lit(last)).drop("batch")


def running_counters(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Total, successful and failed requests per kind, updated with every batch."""
    counted = events.groupBy("endpoint").agg(
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("failed")).alias("successful_requests"),
        F.count_if("failed").alias("failed_requests"),
    )
    return complete_to_table(counted, "counters", folder)


@dataclass(frozen=True)
class Windows:
    """Closed windows, and the rows that came after their window was closed."""

    closed: DataFrame
    late: DataFrame


def tumbling_rates(
    events: DataFrame, width: str = "1 hour", delay: str = "1 hour", folder: str | None = None
) -> Windows:
    """Requests and mean latency per closed time window; late rows go to a table of their own.

    Before a batch, the watermark is the newest time of all earlier batches less ``delay``. A row is late when its
    window ended by then. Each batch adds partial sums of its windows and its own newest time, so that
    the state of the job is its tables. Windows are closed when the watermark after the last batch passes their end.
    Rows without a time are late.
    """
    job = Job.at(events, folder, "windows")
    at = F.col("ts").cast("timestamp")
    delayed = F.expr(f"INTERVAL {delay}")
    marks = "newest timestamp"
    sums = "start timestamp, end timestamp, requests long, total_ms decimal(28,4)"
    late_schema = events.schema

    def mark(before: int | None) -> DataFrame:
        """One row: the watermark from the batches before this one, null at first."""
        known = job.table("marks", StructType.fromDDL(marks))
        earlier = known if before is None else known.filter(F.col("batch") < before)
        return earlier.agg((F.max("newest") - delayed).alias("mark"))

    def sink(batch: DataFrame, number: int) -> None:
        watermark = mark(number).first()["mark"]
        # Spark's window drops rows without a time.
        timed, timeless = batch.filter(at.isNotNull()), batch.filter(at.isNull())
        placed = timed.withColumn("_window", F.window(at, width))
        placed = placed.withColumn("_late", F.lit(False) if watermark is None else F.col("_window.end") <= F.lit(watermark)).persist()
        try:
            job.put("late", placed.filter("_late").select(*batch.columns).unionByName(timeless), number)
            on_time = placed.filter("NOT _late").groupBy("_window").agg(
                F.count("*").alias("requests"), F.sum(F.col("latency_ms").cast("decimal(18,4)")).alias("total_ms")
            )
            job.put("sums", on_time.select("_window.start", "_window.end", "requests", F.col("total_ms").cast("decimal(28,4)")), number)
            job.put("marks", placed.agg(F.max(at).alias("newest")), number)
        finally:
            placed.unpersist()

    job.run(events, sink)
    summed = job.table("sums", StructType.fromDDL(sums)).groupBy("start", "end").agg(
        F.sum("requests").alias("requests"), F.sum("total_ms").alias("total_ms")
    )
    # One row on the broadcast side.
    closed = summed.join(F.broadcast(mark(None)), F.col("end") <= F.col("mark")).select(
        F.col("start").cast("timestamp_ntz").alias("window_start"), "requests",
        round_half_up(F.col("total_ms").cast("double") / F.col("requests"), 2).alias("mean_latency_ms"),
    )
    return Windows(closed, job.table("late", late_schema).drop("batch"))


def sliding_client_rates(
    events: DataFrame, width: str, slide: str, limit: int, delay: str = "1 hour", folder: str | None = None
) -> DataFrame:
    """Closed sliding windows in which a client sent more than ``limit`` requests; no others are written."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    counted = timed.groupBy(F.window("at", width, slide), "client").agg(F.count("*").alias("requests"))
    closed = append_to_table(counted.filter(F.col("requests") > limit), "client-windows", folder)
    return closed.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "client", "requests")


_ARRIVALS = "request_id long, client long, in_window long"


def _arrived(width: int, slack: int):
    """Counts of one client's new requests from those it still remembers, all times in microseconds."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames)).sort_values(["at", "request_id"])
        kept = np.array(state.get[0] if state.exists else [], np.int64)
        at = new["at"].to_numpy(np.int64)
        remembered = np.searchsorted(kept, at, "right") - np.searchsorted(kept, at - width, "right")
        among_new = np.arange(1, len(at) + 1) - np.searchsorted(at, at - width, "right")
        both = np.sort(np.concatenate([kept, at]))
        both = both[both > both[-1] - width - slack]
        state.update((both.tolist(),))
        # Nothing is asked of this client's state once its last request has left every open window.
        state.setTimeoutTimestamp(max(int(both[-1] + width + slack) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": new["request_id"], "client": key[0], "in_window": remembered + among_new})

    return count


def exact_client_rates(
    events: DataFrame, seconds: int, limit: int, delay_seconds: int = 3600, folder: str | None = None
) -> DataFrame:
    """For each request, as it arrives, the client's requests in the last ``seconds`` up to and including it.

    A client's state is the times of the requests that can still count, dropped by an event-time timer. Each
    request is counted against what has arrived by its batch, in the order of times and ids inside the batch: exact,
    like the same over a table, where batches arrive in order of time. A request may be up to
    ``delay_seconds`` late; later ones, and those without a time, are not counted.
    """
    at = F.col("ts").cast("timestamp")
    timed = events.withColumn("_at", at).withWatermark("_at", f"{delay_seconds} seconds")
    known = timed.filter(F.col("_at").isNotNull()).select("client", "request_id", micros(F.col("ts")).alias("at"), "_at")
    counted = known.groupBy("client").applyInPandasWithState(
        _arrived(seconds * 1_000_000, delay_seconds * 1_000_000),
        _ARRIVALS, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return append_to_table(counted.withColumn("limited", F.col("in_window") > limit), "client-rates", folder)


def screened_split(
    texts: DataFrame, key: str, sql: str, tables, columns, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Screen texts as they arrive; accepted and rejected rows go to two tables.

    Each batch is screened once and written to both, under its number.
    """
    job = Job.at(texts, folder, "screened")
    judged = judge(texts.select(key, sql), sql, tables, columns)
    shown = [key, sql, "reason", "violations"]
    schema = judged.select(*shown).schema

    def sink(batch: DataFrame, number: int) -> None:
        once = batch.persist()
        try:
            job.put("accepted", once.filter("allowed").select(*shown), number)
            job.put("rejected", once.filter("NOT allowed").select(*shown), number)
        finally:
            once.unpersist()

    job.run(judged, sink)
    return tuple(job.table(name, schema).drop("batch") for name in ("accepted", "rejected"))
