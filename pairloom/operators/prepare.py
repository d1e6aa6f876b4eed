"""Preparation of question/SQL pairs: layouts, cleaning, dedup, split, expansion, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.functions import prompts as P
from pairloom.functions.text import clean_sql, collapse, strip
from pairloom.operators.export import ROWS_A_FILE, export
from pairloom.operators.ranking import assign_split, split_cuts, with_position
from pairloom.operators.timeline import previous_value
from pairloom.session import scratch_path, write_once

PAIR_SCHEMA = (
    "id string, instruction string, input string, output string, schema string, db_id string, difficulty string"
)


def pair_turns(turns: DataFrame) -> DataFrame:
    """A user turn and the assistant turn that comes next, as (conv_id, turn, instruction, output).

    Rows of a conversation are ordered by turn, role and text; turn numbers may have gaps,
    and repeated rows stay rows. An assistant row whose row before is a user's makes a pair
    with the number of the user's turn. The order is taken over range-sorted blocks, since
    a conversation may be huge.
    """
    spoken = turns.select("conv_id", "turn", "role", "text")
    # Only a user's row is looked back at; the texts of others do not travel.
    said = F.struct("role", "turn", F.when(F.col("role") == "user", F.col("text")).alias("text"))
    nobody = F.lit(None).cast("struct<role:string,turn:bigint,text:string>")
    placed = previous_value(spoken, ["conv_id"], ["turn", "role", "text"], said, "before", nobody)
    replied = (F.col("role") == "assistant") & (F.col("before.role") == "user")
    return placed.filter(replied & F.col("before.text").isNotNull() & F.col("text").isNotNull()).select(
        "conv_id", F.col("before.turn").alias("turn"), F.col("before.text").alias("instruction"), F.col("text").alias("output")
    )


def normalize_flat(raw: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Layout (question, query, db_id): ids are the source name and the row number."""
    return with_position(raw, order).select(
        _numbered(source),
        F.col("question").alias("instruction"),
        F.concat(F.lit("Database: "), F.col("db_id"), F.lit(".")).alias("input"),
        F.col("query").alias("output"),
        "db_id",
        F.lit("").alias("schema"),
    )


def normalize_nested(raw: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Layout (question, sql.human_readable, table.id, table.header)."""
    return with_position(raw, order).select(
        _numbered(source),
        F.col("question").alias("instruction"),
        F.concat(F.lit("Table ID: "), F.col("table.id"), F.lit(".")).alias("input"),
        F.col("sql.human_readable").alias("output"),
        F.col("table.id").alias("db_id"),
        F.array_join("table.header", ", ").alias("schema"),
    )


def _numbered(source: str) -> Column:
    return F.concat(F.lit(f"{source}-"), (F.col("position") + 1).cast("string")).alias("id")


def replicate(pairs: DataFrame, times: int = 10) -> DataFrame:
    """Each row ``times`` times, with the copy number in the id."""
    copies = pairs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("id", F.concat("id", F.lit("-exp-"), F.col("_k").cast("string"))).drop("_k")


def trim_and_drop_blank(pairs: DataFrame) -> DataFrame:
    """Strip question and answer; drop rows where either is blank."""
    stripped = pairs.withColumns({"instruction": strip(F.col("instruction")), "output": strip(F.col("output"))})
    return stripped.filter((F.col("instruction") != "") & (F.col("output") != ""))


def clean(pairs: DataFrame) -> DataFrame:
    """Trim, drop blanks, and take fences and final semicolons off the SQL."""
    return trim_and_drop_blank(pairs).withColumn("output", clean_sql(F.col("output")))


def dedup_key(question: Column, sql: Column) -> Column:
    """Digest of the lower-case question and the whitespace-collapsed lower-case SQL.

    The length of the question is part of the text, so the two cannot run into each other.
    """
    lowered = F.lower(question)
    return F.sha2(F.concat_ws("\x00", F.length(lowered).cast("string"), lowered, collapse(F.lower(sql))), 256)


def deduplicate(pairs: DataFrame, order: list[str]) -> DataFrame:
    """First row, in the given order, of each group of equal pairs.

    ``min_by`` keeps one row per key before the shuffle, so a pair repeated through a
    third of the table costs one row per task.
    """
    keyed = pairs.withColumn("_key", dedup_key(F.col("instruction"), F.col("output")))
    first = F.min_by(F.struct(*pairs.columns), F.struct(*order))
    return keyed.groupBy("_key").agg(first.alias("_row")).select("_row.*")


def dedup_report(pairs: DataFrame) -> DataFrame:
    """Rows read, rows kept, rows removed (blank or repeated), in one pass."""
    question, sql = strip(F.col("instruction")), strip(F.col("output"))
    kept = (question != "") & (sql != "")
    keyed = pairs.select(F.when(kept, dedup_key(question, clean_sql(sql))).alias("_key"))
    groups = keyed.groupBy("_key").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count("_key").alias("unique_pairs")).select(
        "original", "unique_pairs", (F.col("original") - F.col("unique_pairs")).alias("removed")
    )


def split(
    pairs: DataFrame, key: str = "id", seed: int = 42, train_ratio: float = 0.8, val_ratio: float = 0.1
) -> DataFrame:
    """Add ``split``: reproducible, with exactly int(n*train) and int(n*val) rows. ``key`` must be unique."""
    return assign_split(pairs, key, split_cuts(pairs, key, seed, train_ratio, val_ratio), seed)


def format_pairs(pairs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the prompt record in the named format."""
    columns = [F.col(c) for c in ("instruction", "output", "schema", "db_id")]
    return pairs.select(*keep, *P.render(name, *columns))


def cycle(items: DataFrame, order: list[str], n_items: int, n_requests: int) -> DataFrame:
    """Item ``i % n_items`` for every request number below ``n_requests``."""
    numbers = items.sparkSession.range(n_requests).select(
        F.col("id").alias("request_no"), (F.col("id") % n_items).alias("position")
    )
    return numbers.join(with_position(items, order), "position")


def expand_epochs(items: DataFrame, order: list[str], n_items: int, epochs: int) -> DataFrame:
    """Training steps: every item once per epoch, numbered from 1, with the fractional epoch."""
    placed = with_position(items, order).withColumn(
        "epoch_index", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    )
    done = (F.col("position") + 1) / F.lit(n_items)
    return placed.select(
        *items.columns,
        F.col("epoch_index").cast("long").alias("epoch_index"),
        (F.col("epoch_index") * F.lit(n_items) + F.col("position") + 1).cast("long").alias("step"),
        round_half_up(F.col("epoch_index") + done, 2).alias("epoch"),
        F.lit(max(epochs * n_items, epochs * 5)).cast("long").alias("total_steps"),
    )


def export_jsonl(split_pairs: DataFrame, name: str, path: str, rows_per_file: int = ROWS_A_FILE) -> int:
    """Write prompt records as JSON lines of bounded files, one folder per split, and their manifest."""
    return export(format_pairs(split_pairs, name, ["split"]), path, rows_per_file)


def prepare(pairs: DataFrame, order: list[str], name: str, key: str = "id") -> tuple[DataFrame, str]:
    """Clean, dedup, split and export; returns the written pairs and the export folder.

    The cleaned pairs are written once: the hash counts of the split, the export and the
    report all read them back instead of repeating the dedup shuffle.
    """
    cleaned = write_once(deduplicate(clean(pairs), order), "pairs")
    placed = split(cleaned, key)
    path = scratch_path(pairs.sparkSession, f"export-{name}")
    export_jsonl(placed, name, path)
    return placed, path
