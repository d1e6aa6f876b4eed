"""Preparation and profiling of pairs (D, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.functions import prompts as P
from pairloom.functions.text import clean_sql, estimated_tokens, word_tokens
from pairloom.operators import prepare, profile
from pairloom.operators.export import read_export
from pairloom.operators.screen import with_well_formed
from pairloom.plans import sqltext as Q
from pairloom.plans.registry import query
from pairloom.session import scratch_path, write_once
from pairloom.sources import views
from pairloom.sources.pairs import scan_pairs
from pairloom.sources.tables import Tables

PAIR_ORDER = ["conv_id", "turn"]
EPOCHS = 3
# Pairs in one JSON file of an array.
ARRAY_ROWS = 1000

_PAIRS = views.with_views("pairs")
_SQL_PAIRS = views.with_views("sql_pairs")


def raw_answers(t: Tables) -> DataFrame:
    """Question and generated SQL under the names of a pair."""
    return views.sql_pairs(t).selectExpr("case_id", "question AS instruction", "generated_sql AS output")


_ANSWERS = f"{_SQL_PAIRS}, answers AS (SELECT case_id, question AS instruction, generated_sql AS output FROM sql_pairs)"
_TRIMMED = f"""{_ANSWERS}, trimmed AS (SELECT case_id, {Q.strip('instruction')} AS instruction, {Q.strip('output')} AS output
  FROM answers WHERE {Q.strip('instruction')} <> '' AND {Q.strip('output')} <> '')"""
_CLEANED = f"""{_TRIMMED}, cleaned AS (SELECT case_id, instruction, {Q.clean_sql('output')} AS output FROM trimmed)"""
_FIRST = f"""{_CLEANED}, kept AS (SELECT case_id, instruction, output FROM (SELECT *, row_number() OVER (
  PARTITION BY lower(instruction), {Q.collapse('lower(output)')} ORDER BY case_id) AS rn FROM cleaned) r WHERE rn = 1)"""


@query(
    "d01_scan_json",
    f"""{_PAIRS} SELECT id, instruction, input, output, schema, db_id, CAST(NULL AS VARCHAR) AS difficulty FROM pairs""",
)
def scan_json(t: Tables) -> DataFrame:
    """Read JSON of pairs with a fixed schema; keys that are absent become null.

    The pairs are written first, every other one as a line, the rest in files of one pretty-printed array each.
    """
    lines, arrays = scratch_path(t.spark, "json-lines"), scratch_path(t.spark, "json-arrays")
    # Numbered as they lie and written once, so that both layouts agree on the numbers; these do not depend on any key.
    pairs = write_once(views.pairs(t).withColumn("number", F.monotonically_increasing_id()), "numbered")
    record = F.struct("id", "instruction", "input", "output", "schema", "db_id")
    pairs.filter("number % 2 = 0").select(F.to_json(record).alias("value")).write.text(lines)
    # One row per file, which one task reads: of ARRAY_ROWS pairs at most, so that the table's size makes more files, not larger ones.
    numbered = F.expr(f"number div {2 * ARRAY_ROWS}").alias("file")
    whole = pairs.filter("number % 2 = 1").select(numbered, F.to_json(record, {"pretty": "true"}).alias("text"))
    files = whole.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("text"), ",\n"), F.lit("\n]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(arrays)
    array_rows = scan_pairs(t.spark, arrays, json_array=True)
    return scan_pairs(t.spark, lines).unionByName(array_rows)


@query(
    "d02_source_layouts",
    f"""{_PAIRS}, numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM pairs)
  SELECT 'flat-' || i AS id, instruction, 'Database: ' || db_id || '.' AS input, output, db_id, '' AS schema FROM numbered
  UNION ALL SELECT 'nested-' || i, instruction, 'Table ID: ' || 't-' || conv_id || '.', output, 't-' || conv_id,
  'id, turn ' || turn || ', text' FROM numbered""",
)
def source_layouts(t: Tables) -> DataFrame:
    """Two raw layouts mapped to one pair schema, with ids from the row number."""
    pairs = views.pairs(t)
    flat = pairs.selectExpr(*PAIR_ORDER, "instruction AS question", "output AS query", "db_id")
    nested = pairs.selectExpr(
        *PAIR_ORDER,
        "instruction AS question",
        "named_struct('human_readable', output) AS sql",
        "named_struct('id', 't-' || conv_id, 'header', array('id', 'turn ' || turn, 'text')) AS table",
    )
    return prepare.normalize_flat(flat, "flat", PAIR_ORDER).unionByName(
        prepare.normalize_nested(nested, "nested", PAIR_ORDER)
    )


@query("d03_turn_pairs", f"{_PAIRS} SELECT conv_id, turn, instruction, output FROM pairs")
def turn_pairs(t: Tables) -> DataFrame:
    """User turns with the assistant turn that follows."""
    return prepare.pair_turns(t.conversations)


@query(
    "d04_replicate",
    f"""{_PAIRS} SELECT id || '-exp-' || k AS id, db_id, instruction FROM pairs, range(10) r(k)""",
)
def replicate(t: Tables) -> DataFrame:
    """Ten numbered copies of each pair."""
    return prepare.replicate(views.pairs(t).select("id", "db_id", "instruction"))


@query("d05_trim_drop_blank", f"{_TRIMMED} SELECT * FROM trimmed")
def trim_drop_blank(t: Tables) -> DataFrame:
    """Stripped pairs without blank ones."""
    return prepare.trim_and_drop_blank(raw_answers(t))


@query("d06_strip_fences", f"{_ANSWERS} SELECT case_id, {Q.clean_sql('output')} AS output FROM answers")
def strip_fences(t: Tables) -> DataFrame:
    """SQL without code fences and final semicolons."""
    return raw_answers(t).select("case_id", clean_sql(F.col("output")).alias("output"))


@query("d07_dedup", f"{_FIRST} SELECT * FROM kept")
def dedup(t: Tables) -> DataFrame:
    """First of each group of equal pairs, in case order."""
    return prepare.deduplicate(prepare.clean(raw_answers(t)), ["case_id"])


@query(
    "d07_dedup_documents",
    f"""SELECT doc_id, source, length(text) AS n_chars FROM (SELECT *, row_number() OVER (
  PARTITION BY lower(source), {Q.collapse('lower(text)')} ORDER BY doc_id) AS rn FROM documents) r WHERE rn = 1""",
)
def dedup_documents(t: Tables) -> DataFrame:
    """The same rule on long texts: source as question, text as answer.

    Only the id travels with the digest of the text.
    """
    keyed = t.documents.select(
        "doc_id", "source", F.length("text").cast("long").alias("n_chars"),
        prepare.dedup_key(F.col("source"), F.col("text")).alias("_key"),
    )
    first = F.min_by(F.struct("doc_id", "source", "n_chars"), "doc_id")
    return keyed.groupBy("_key").agg(first.alias("_row")).select("_row.*")


@query(
    "d08_dedup_report",
    f"""{_FIRST} SELECT (SELECT count(*) FROM answers) AS original, (SELECT count(*) FROM kept) AS unique_pairs,
  (SELECT count(*) FROM answers) - (SELECT count(*) FROM kept) AS removed""",
)
def dedup_report(t: Tables) -> DataFrame:
    """Rows read, kept and removed."""
    return prepare.dedup_report(raw_answers(t))


_SPLIT_CASE = """CASE WHEN rn <= floor(n * 0.8) THEN 'train'
  WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END"""


@query(
    "d09_split",
    f"""{_PAIRS} SELECT id, {_SPLIT_CASE} AS split FROM (SELECT id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5('42|' || id), id) AS rn FROM pairs) r""",
)
def split(t: Tables) -> DataFrame:
    """Reproducible split of exact sizes.

    The ids are written once, so that counting hash prefixes does not repeat the pairing.
    """
    return prepare.split(write_once(views.pairs(t).select("id"), "ids"))


def _context(q: str = "schema", d: str = "db_id") -> str:
    return (
        f"CASE WHEN coalesce({q}, '') <> '' THEN chr(10) || 'Database Schema DDL:' || chr(10) || {q} || chr(10) ELSE '' END"
        f" || CASE WHEN coalesce({d}, '') <> '' THEN chr(10) || 'Target Database: ' || {d} || chr(10) ELSE '' END"
    )


def _chr(text: str) -> str:
    return " || chr(10) || ".join(Q.lit(part) for part in text.split("\n"))


@query(
    "d10_format_alpaca",
    f"""{_PAIRS} SELECT id, {_chr(chr(10).join(["### Instruction:",
    "Translate the natural language question into a valid SQLite query."]))} || {_context()} || chr(10) || 'Question: '
  || instruction || {_chr(chr(10) * 2 + "### Response:" + chr(10))} AS prompt, output AS completion FROM pairs""",
)
def format_alpaca(t: Tables) -> DataFrame:
    """Prompt and completion with instruction and response headings."""
    return prepare.format_pairs(views.pairs(t), "alpaca", ["id"])


@query(
    "d11_format_chatml",
    f"""{_PAIRS} SELECT id, i AS pos, CASE i WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE 'assistant' END AS role,
  CASE i WHEN 0 THEN 'You are an expert SQL assistant. Translate natural language questions to SQL.'
         WHEN 1 THEN {_context()} || 'Question: ' || instruction ELSE output END AS content
  FROM pairs, range(3) r(i)""",
)
def format_chatml(t: Tables) -> DataFrame:
    """Messages with roles, one row per message."""
    records = prepare.format_pairs(views.pairs(t), "chatml", ["id"])
    return records.select("id", F.posexplode("messages").alias("pos", "message")).select(
        "id", F.col("pos").cast("long").alias("pos"), "message.role", "message.content"
    )


@query(
    "d12_format_llama3",
    f"""{_PAIRS} SELECT id, '<|start_header_id|>system<|end_header_id|>' || chr(10)
  || 'You are an expert SQL assistant.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || {_context()}
  || 'Question: ' || instruction || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) AS prompt,
  output || '<|eot_id|>' AS completion FROM pairs""",
)
def format_llama3(t: Tables) -> DataFrame:
    """Prompt with header tokens."""
    return prepare.format_pairs(views.pairs(t), "llama3", ["id"])


@query(
    "d13_format_gemma",
    f"""{_PAIRS} SELECT id, '<start_of_turn>user' || chr(10) || 'Translate natural language to SQL.' || {_context()}
  || chr(10) || 'Question: ' || instruction || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt,
  output || '<end_of_turn>' AS completion FROM pairs""",
)
def format_gemma(t: Tables) -> DataFrame:
    """Prompt with turn tokens; also the answer to an unknown format name."""
    return prepare.format_pairs(views.pairs(t), "some other name", ["id"])


@query(
    "d14_catalog_listing",
    """SELECT source AS dataset_name, count(*) AS total_pairs, array_to_string(list_sort(list_distinct(
  list(coalesce(lang, 'unknown')))), ',') AS domains FROM documents GROUP BY source""",
)
def catalog_listing(t: Tables) -> DataFrame:
    """Pairs and distinct domains per dataset."""
    return profile.catalog_listing(t.documents, "source", "lang")


@query("d15_head_sample", f"{_PAIRS} SELECT id, instruction FROM pairs ORDER BY conv_id, turn LIMIT 5")
def head_sample(t: Tables) -> DataFrame:
    """The first five pairs."""
    return views.pairs(t).orderBy(*PAIR_ORDER).limit(5).select("id", "instruction")


@query(
    "d16_cyclic_sample",
    f"""{_PAIRS}, numbered AS (SELECT id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position,
  count(*) OVER () AS n FROM pairs)
  SELECT position + k * n AS request_no, position, id FROM numbered, range(3) r(k) WHERE position + k * n < 2 * n + 7""",
)
def cyclic_sample(t: Tables) -> DataFrame:
    """Pairs taken round robin until there are 2n + 7 requests."""
    items = views.pairs(t).select(*PAIR_ORDER, "id")
    n = items.count()
    return prepare.cycle(items, PAIR_ORDER, n, 2 * n + 7).select("request_no", "position", "id")


@query(
    "d17_epochs",
    f"""{_PAIRS}, numbered AS (SELECT id, row_number() OVER (ORDER BY conv_id, turn) AS i, count(*) OVER () AS n FROM pairs)
  SELECT id, e AS epoch_index, e * n + i AS step, {Q.rnd(f'e + i / CAST(n AS DOUBLE)', 2)} AS epoch,
  CAST(greatest({EPOCHS} * n, {EPOCHS} * 5) AS BIGINT) AS total_steps FROM numbered, range({EPOCHS}) r(e)""",
)
def epochs(t: Tables) -> DataFrame:
    """Training steps of three epochs."""
    items = views.pairs(t).select(*PAIR_ORDER, "id")
    expanded = prepare.expand_epochs(items, PAIR_ORDER, items.count(), EPOCHS)
    return expanded.drop(*PAIR_ORDER)


@query(
    "d18_model_prompts",
    f"""{_PAIRS} SELECT id, 'You are a production text-to-SQL engine. Translate the following user request '
  || 'into a precise SQLite query.' || chr(10)
  || CASE WHEN coalesce(schema, '') <> '' THEN 'Database Schema DDL:' || chr(10) || schema || chr(10) ELSE '' END
  || CASE WHEN coalesce(input, '') <> '' THEN 'Input: ' || input || chr(10) ELSE '' END
  || 'User Question: ' || instruction || chr(10) || 'SQLite Query: ' || output AS training_prompt,
  'You are a production text-to-SQL engine. Translate the following user request into a precise SQLite query.'
  || CASE WHEN coalesce(schema, '') <> '' THEN chr(10) || 'Database Schema DDL:' || chr(10) || schema || chr(10) ELSE '' END
  || chr(10) || 'User Question: ' || instruction || chr(10) || 'SQLite Query:' AS inference_prompt FROM pairs""",
)
def model_prompts(t: Tables) -> DataFrame:
    """Texts for training and for inference."""
    question, sql, schema, extra = (F.col(c) for c in ("instruction", "output", "schema", "input"))
    return views.pairs(t).select(
        "id",
        P.training_prompt(question, sql, schema, extra).alias("training_prompt"),
        P.inference_prompt(question, schema).alias("inference_prompt"),
    )


@query(
    "d19_jsonl_export",
    f"""{_PAIRS} SELECT {_SPLIT_CASE} AS split, output || '<|eot_id|>' AS completion FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5('42|' || id), id) AS rn FROM pairs) r""",
)
def jsonl_export(t: Tables) -> DataFrame:
    """JSON lines per split, read back."""
    path = scratch_path(t.spark, "jsonl")
    prepare.export_jsonl(prepare.split(write_once(views.pairs(t), "pairs")), "llama3", path)
    return read_export(t.spark, path, "prompt string, completion string").select("split", "completion")


@query(
    "d20_end_to_end_prepare",
    f"""{_FIRST}, placed AS (SELECT output, {_SPLIT_CASE} AS split FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5('42|' || case_id), case_id) AS rn FROM kept) r)
  SELECT split, count(*) AS exported, count(*) FILTER ({Q.well_formed('output')}) AS valid_sql,
  {Q.rnd(f"count(*) FILTER ({Q.well_formed('output')}) * 100 / CAST(count(*) AS DOUBLE)", 2)} AS validity_percentage
  FROM placed GROUP BY split""",
)
def end_to_end_prepare(t: Tables) -> DataFrame:
    """Clean, dedup, split, export; split sizes counted in the export, validity in the pairs."""
    raw = raw_answers(t).withColumns({"schema": F.lit(None).cast("string"), "db_id": F.lit(None).cast("string")})
    placed, path = prepare.prepare(raw, ["case_id"], "gemma", key="case_id")
    exported = (
        read_export(t.spark, path, "prompt string, completion string")
        .groupBy("split").agg(F.count("*").alias("exported"))
    )
    flagged = with_well_formed(placed.select("split", "output"), "output", "ok")
    valid = flagged.groupBy("split").agg(F.count_if("ok").alias("valid_sql"))
    share = round_half_up(F.col("valid_sql") * 100 / F.col("exported"), 2)
    return exported.join(valid, "split").withColumn("validity_percentage", share)


def _tokens(x: str) -> str:
    return f"CAST(greatest(1, floor(length({x}) / 4.0)) AS BIGINT)"


@query(
    "p01_token_estimate",
    f"{_PAIRS} SELECT id, {_tokens('instruction')} AS prompt_tokens, {_tokens('output')} AS completion_tokens FROM pairs",
)
def token_estimate(t: Tables) -> DataFrame:
    """Characters over four, at least one."""
    return views.pairs(t).select(
        "id", estimated_tokens(F.col("instruction")).alias("prompt_tokens"),
        estimated_tokens(F.col("output")).alias("completion_tokens"),
    )


def _document_tokens(t: Tables) -> DataFrame:
    return t.documents.select(estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "p02_length_distribution",
    f"""SELECT min(k) AS min_tokens, max(k) AS max_tokens, {Q.rnd('avg(k)', 1)} AS mean_tokens,
  count(*) FILTER (k > 2048) AS exceeding_max_len FROM (SELECT {_tokens('text')} AS k FROM documents) d""",
)
def length_distribution(t: Tables) -> DataFrame:
    """Shortest, longest, mean, and how many are too long."""
    return profile.length_distribution(_document_tokens(t), "tokens")


@query(
    "p03_floor_percentiles",
    f"""SELECT max(k) FILTER (i = floor(n * 0.5)) AS p50, max(k) FILTER (i = floor(n * 0.95)) AS p95,
  max(k) FILTER (i = floor(n * 0.99)) AS p99 FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i,
  count(*) OVER () AS n FROM (SELECT {_tokens('text')} AS k FROM documents) d) r""",
)
def floor_percentiles(t: Tables) -> DataFrame:
    """Element int(n * p) of the sorted lengths."""
    return profile.length_percentiles(_document_tokens(t), "tokens")


@query(
    "p04_validity_report",
    f"""{_CLEANED} SELECT count(*) AS total_records, count(*) FILTER (ok) AS valid_sql, count(*) FILTER (NOT ok) AS invalid_sql,
  {Q.rnd('count(*) FILTER (ok) * 100 / CAST(count(*) AS DOUBLE)', 2)} AS validity_percentage
  FROM (SELECT {Q.well_formed('output')} AS ok FROM cleaned) c""",
)
def validity_report(t: Tables) -> DataFrame:
    """How many texts are well formed."""
    return profile.validity_report(prepare.clean(raw_answers(t)), "output")


@query(
    "p05_unique_tables",
    f"""{_CLEANED} SELECT DISTINCT unnest({Q.tables('output')}) AS table_name FROM cleaned WHERE {Q.well_formed('output')}""",
)
def unique_tables(t: Tables) -> DataFrame:
    """Tables that any well-formed text references."""
    return profile.unique_tables(prepare.clean(raw_answers(t)), "output")


@query(
    "p06_word_tokens",
    f"""{_PAIRS} SELECT id, 2 * len({Q.words('instruction')}) AS prompt_tokens,
  2 * len({Q.words('output')}) AS completion_tokens FROM pairs""",
)
def word_token_estimate(t: Tables) -> DataFrame:
    """Two tokens per word."""
    return views.pairs(t).select(
        "id", word_tokens(F.col("instruction")).alias("prompt_tokens"),
        word_tokens(F.col("output")).alias("completion_tokens"),
    )
