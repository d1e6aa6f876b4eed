"""Packing documents into training sequences by deficit round-robin over sources.

Each source is a queue. In every round a source is granted its share of a window, and its
head packets leave while they fit into what it was granted and has not used; the rest, its
deficit, is kept for the next round. A packet that ends at token ``e`` of its queue
therefore leaves in round ``ceil(e / grant) - 1``, whatever happened to other queues. This
gives each packet its round without running the rounds one after the other: deficits carry
over windows and partitions by arithmetic. The packets, in order of round and source, form one stream,
which is cut into full windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.tokens import word_encoder
from pairloom.operators.timeline import running_sum
from pairloom.session import scratch_path

WINDOW = 2048
# Long documents enter their queue in parts, so that none fills windows alone.
PACKET = 512


def _encoded(tokenizer: str, end_id: int):
    """Ids of each row, its number in the task, and its source's tokens before it in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part, row = TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        queued: dict[str | None, int] = {}
        for batch in batches:
            ids, tokens, before = [], [], []
            texts = (coded for part in encoder.encode_array(batch.column("text")) for coded in part)
            for coded, source in zip(texts, batch.column("source").to_pylist()):
                coded += end
                ids.append(coded)
                tokens.append(len(coded) // encoder.width)
                before.append(queued.get(source, 0))
                queued[source] = before[-1] + tokens[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("source"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(row, row + n)),
                    pa.array(tokens, pa.int64()),
                    pa.array(before, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["id", "source", "part", "row", "tokens", "before", "ids"],
            )
            row += n

    return encode


def _grants(encoded: DataFrame, weights: Mapping[str | None, float] | None, window: int) -> DataFrame:
    """Per input partition and source: tokens queued in partitions before, and the source's grant a round."""
    lanes = encoded.groupBy("part", "source").agg(F.sum("tokens").alias("tokens"))
    queue = W.partitionBy("source")
    before = queue.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    share: Column = F.sum("tokens").over(queue)
    if weights is not None:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    placed = lanes.select(
        F.col("part").alias("lane_part"),
        F.col("source").alias("lane_source"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("lane_before"),
        share.cast("double").alias("share"),
    )
    total = encoded.agg(F.sum("tokens")).first()[0] if weights is None else sum(weights.values())
    return placed.withColumn("grant", F.lit(float(window)) * F.col("share") / F.lit(float(total or 1)))


def _pieces(width: int):
    dtype = np.dtype(f"<u{width}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, source, ids, pieces in zip(*(batch.column(n).to_pylist() for n in ("id", "source", "ids", "pieces"))):
                values = np.frombuffer(ids, dtype).astype("<u4")
                merged: list[list[int]] = []
                for p in sorted(pieces, key=lambda p: p["start"]):
                    last = merged[-1] if merged else None
                    if last and last[2] == p["sequence_id"] and last[3] + last[1] == p["offset"]:
                        last[1] += p["length"]
                    else:
                        merged.append([p["start"], p["length"], p["sequence_id"], p["offset"]])
                for start, length, sequence, offset in merged:
                    out.append((id_, source, start, length, values[start : start + length].tobytes(), len(values), sequence, offset))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return cut


def pack_mixture(
    df: DataFrame,
    doc_id: str,
    text: str,
    source: str,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    packet: int = PACKET,
    weights: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens, mixed by source.

    Target proportions are the given weights by source, or each source's share of all
    tokens. In every stretch of windows a source's tokens stay within one packet of its
    share as long as its queue lasts; when a queue runs dry the others keep their proportions. Sources
    without a weight come after all others. Each document is its ids and ``end_id``; each id lies in exactly one piece. All
    sequences are full but the last, which is as long as what is left.

    One row per piece: ``doc_id`` (under its own name), ``source``, ``start`` and ``length`` in the document,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.
    A null text is empty and leaves its end id; null sources form one queue; null or
    repeated document ids are kept as rows of their own; other columns are not used. An
    empty table gives an empty result. Queues follow the order in which rows are read.
    """
    spark = df.sparkSession
    width = word_encoder(tokenizer).width
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    path = scratch_path(spark, "packing")
    ddl = "id bigint, source string, part int, row bigint, tokens bigint, before bigint, ids binary"
    docs.mapInArrow(_encoded(tokenizer, end_id), ddl).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(ddl).parquet(path)

    same_lane = (F.col("part") == F.col("lane_part")) & F.col("source").eqNullSafe(F.col("lane_source"))
    queued = encoded.select("part", "row", "source", "tokens", "before").join(_grants(encoded, weights, window), same_lane)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(packet).cast("long")))
    packets = queued.select("part", "row", "source", "tokens", "grant", (F.col("lane_before") + F.col("before")).alias("queue"), start.alias("start"))
    packets = packets.withColumn("length", F.least(F.lit(packet).cast("long"), F.col("tokens") - F.col("start")))
    end = F.col("queue") + F.col("start") + F.col("length")
    # A source that is granted nothing waits until all others are done.
    turn = F.when(F.col("grant") > 0, F.floor((end - 1) / F.col("grant")).cast("long")).otherwise(F.lit((1 << 63) - 1))
    packets = packets.select("part", "row", "start", "length", "source", turn.alias("round"), end.alias("end"), F.lit(0).alias("stream"))
    placed = running_sum(packets, ["stream"], ["round", "source", "end"], "length", "upto")
    first = F.col("upto") - F.col("length")
    spans = placed.select(
        "part", "row", "start", first.alias("from"), "upto",
        F.explode(F.sequence(F.floor(first / window), F.floor((F.col("upto") - 1) / window))).alias("sequence_id"),
    )
    low = F.greatest(F.col("from"), F.col("sequence_id") * window)
    high = F.least(F.col("upto"), (F.col("sequence_id") + 1) * window)
    piece = F.struct(
        (F.col("start") + low - F.col("from")).alias("start"),
        (high - low).alias("length"),
        "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"),
    )
    cuts = spans.groupBy("part", "row").agg(F.collect_list(piece).alias("pieces"))
    out = "id bigint, source string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    joined = encoded.select("part", "row", "id", "source", "ids").join(cuts, ["part", "row"])
    return joined.select("id", "source", "ids", "pieces").mapInArrow(_pieces(width), out).withColumnRenamed("id", doc_id)
