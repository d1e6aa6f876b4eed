"""Token files: ids of all documents in order, open to access at any token.

A folder of Parquet files whose rows are segments. A segment holds whole documents, about
65,536 tokens, as directly addressable codes (``dac``) in uncompressed binary columns, and
where it stands. Written by Spark's committed writer, so a lost executor costs its tasks
and leaves no half file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm import dac
from pairloom.llm.tokens import word_encoder
from pairloom.session import parallelism

SEGMENT_TOKENS = 1 << 16
_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first", pa.int64()),
        ("tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("levels", pa.list_(_LEVEL)),
    ]
)
SEGMENT_DDL = (
    "part int, segment int, first bigint, tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "levels array<struct<chunks: binary, more: binary, ranks: binary>>"
)


def _segments(tokenizer: str, end_id: int, segment_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        segment = first = held = 0
        ids: list[bytes] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), encoder.dtype)
            levels = [level._asdict() for level in dac.encode(values)]
            row = [[part], [segment], [first], [held], [docs], [sizes], [levels]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, _SEGMENT)], schema=_SEGMENT
            )

        for batch in batches:
            texts = (coded for part in encoder.encode_array(batch.column(1)) for coded in part)
            for doc, coded in zip(batch.column(0).to_pylist(), texts):
                coded += end
                ids.append(coded)
                docs.append(doc)
                sizes.append(len(coded) // encoder.width)
                held += sizes[-1]
                if held >= segment_tokens:
                    yield flush()
                    segment, first, held = segment + 1, first + held, 0
                    ids, docs, sizes = [], [], []
        if docs:
            yield flush()

    return write


def write_token_files(
    df: DataFrame,
    doc_id: str,
    text: str,
    tokenizer: str,
    end_id: int,
    path: str,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending ``doc_id`` order.

    Null ids come first, rows with one id are ordered by a hash of their text; a null text is empty and
    leaves its end id. An empty table writes a folder without segments.
    """
    # The hash breaks ties: range bounds are sampled on the driver, where whole texts would weigh.
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = docs.repartitionByRange(parallelism(df.sparkSession), "doc", "tie").sortWithinPartitions("doc", "tie")
    segments = ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), SEGMENT_DDL)
    segments.write.option("compression", "none").parquet(path)


def _segment_table(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the tokens of all segments before."""
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_base"))
    # One row per part, as many as the writer had shuffle partitions.
    return segments.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def _levels(column: pa.Array) -> Iterator[list[dac.Level]]:
    for levels in column.to_pylist():
        yield [dac.Level(level["chunks"], level["more"], level["ranks"]) for level in levels]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, docs, sizes = (batch.column(n).to_pylist() for n in ("start", "doc_ids", "doc_tokens"))
        for start, own, counts, levels in zip(starts, docs, sizes, _levels(batch.column("levels"))):
            values = dac.decode(levels).astype("<u4")
            ends = np.cumsum(np.array(counts, np.int64))
            begins = ends - np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int64()),
                    pa.array(begins + start, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([values[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (tokens before it), ``n_tokens``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    segments = _segment_table(spark, path).select("start", "doc_ids", "doc_tokens", "levels")
    return segments.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, wanted = batch.column("start").to_pylist(), batch.column("wanted").to_pylist()
        for start, positions, levels in zip(starts, wanted, _levels(batch.column("levels"))):
            found = dac.access(levels, np.array(positions, np.int64) - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(positions, pa.int64()), pa.array(found.astype(np.int64))], names=["position", "token"]
            )


def tokens_at(positions: DataFrame, position: str, path: str) -> DataFrame:
    """``position`` and ``token`` for each distinct position that the files have.

    Positions meet segments over a grid of 65,536 tokens; only the segments that hold one are
    opened, and in them only the bytes of the wanted tokens are read.
    """
    segments = _segment_table(positions.sparkSession, path)
    cells = segments.select(
        "part", "segment", "start", "tokens",
        F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("start") + F.col("tokens") - 1) / SEGMENT_TOKENS))).alias("cell"),
    )
    asked = positions.select(F.col(position).cast("long").alias("at")).distinct()
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("tokens"))
    wanted = (
        asked.withColumn("cell", F.floor(F.col("at") / SEGMENT_TOKENS))
        .join(cells, "cell")
        .filter(inside)
        .groupBy("part", "segment")
        .agg(F.collect_list("at").alias("wanted"))
    )
    opened = segments.join(wanted, ["part", "segment"]).select("start", "wanted", "levels")
    return opened.mapInArrow(_picked, "position bigint, token bigint")
