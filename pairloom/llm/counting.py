"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.columns import byte_count, carried, restored
from pairloom.llm.tokens import count_tokens, strings, tokenizer_digest
from pairloom.session import scratch_path

CACHE_DDL = "digest binary, tokenizer string, n_tokens bigint"
# Characters that are handed to the library at once.
BATCH_CHARS = 4_000_000


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeated digests of one task; what it remembers is a digest a row."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _counted(tokenizer: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_seen(batches):
            counts: list[int] = []
            texts, held = [], 0
            for text in strings(batch.column("text")):
                texts.append(text)
                held += len(text)
                if held > BATCH_CHARS:
                    counts += count_tokens(tokenizer, texts)
                    texts, held = [], 0
            counts += count_tokens(tokenizer, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return count


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row per digest.

    An append that was done twice, as after a lost driver, leaves equal rows; they count once.
    """
    stored = spark.read.schema(CACHE_DDL).parquet(cache).filter(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def digest_cached_counts(
    df: DataFrame, text: str, tokenizer: str, cache: str | None = None, over: int = 4096
) -> DataFrame:
    """All rows and columns of ``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The content digest is the sha-256 of the text; null is normalised to the empty text,
    and nothing else, since any other change could change the count. The digest of the
    tokenizer covers its file and its library's version. Counts stored in ``cache`` (a Parquet
    folder; by default a new one in the shared folder) under both digests are used; of
    the other texts each distinct one is encoded once, and its count appended. Repeated
    texts are dropped inside each input partition before they are shuffled, so a text that
    is a third of all rows arrives once per partition. Empty texts count 0; an empty table
    gives an empty result. Input columns with an added name are replaced.
    """
    spark = df.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "token-counts")
    # An append of nothing makes sure that the folder can be read.
    spark.createDataFrame([], CACHE_DDL).write.mode("append").parquet(cache)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    texts = df.select(digest.alias("digest"), content.alias("text"))
    missing = (
        texts.mapInArrow(_first_seen, "digest binary, text string")
        .repartition("digest")
        .join(read_cache(spark, cache, version), "digest", "left_anti")
    )
    counted = missing.mapInArrow(_counted(tokenizer), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    rows = carried(df, digest=digest, _bytes=byte_count(F.col(text)))
    joined = rows.join(read_cache(spark, cache, version), "digest")
    return restored(
        joined, df.columns, n_bytes=F.col("_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > over
    )
