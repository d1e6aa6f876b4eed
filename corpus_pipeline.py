"""From raw documents to packed training sequences, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents. Results are written between
stages, so that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.columns import word_count
from pairloom.llm.jaccard import jaccard_groups
from pairloom.llm.mixing import mix_to_targets
from pairloom.llm.packing import pack_mixture
from pairloom.llm.toxicity import toxicity_scores
from pairloom.session import write_once

TOKENIZER, END_ID = "byte_bpe_50k.json", 1
# Row number inside the stage of near duplicates.
ROW = "row_of_near_duplicates"

# A network, a similarity join and arithmetic over the whole corpus: no SQL text.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector does not call toxic; texts without words stay."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity_scores(docs, labels).filter(F.col("predicted") == 0).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts share 80 % of their five-word shingles, the one with the smallest id, null last.

    Rows are told apart by a number of their own, not by their id: rows that share an id and have different
    texts all stay, and of copies without an id one stays. Of rows with one id in one group the first in the
    order of the written rows stays. Texts without words stay all.
    """
    rows = write_once(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_groups(rows, ROW, "text", width=5, percent=80)
    placed = groups.join(rows.select(ROW, "doc_id"), ROW)
    best = F.min_by(ROW, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW)))
    kept = placed.groupBy("component_id").agg(best.alias("kept")).select(F.col("kept").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_to_targets(sized, "source", "size", "doc_id", seed=7)
    copies = mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows of 2048 tokens, in each of which sources have their share."""
    return pack_mixture(docs, "doc_id", "text", "source", TOKENIZER, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
