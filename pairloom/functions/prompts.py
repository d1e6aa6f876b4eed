"""Prompt texts built from a pair (instruction, output, schema, db_id, input)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt formats a pair can be rendered in; the last is the default.
FORMATS = ["alpaca", "chatml", "llama3", "gemma"]


def _optional(value: Column, before: str, after: str) -> Column:
    """``before + value + after``, or nothing for a missing or empty value."""
    return F.when(
        F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after))
    ).otherwise(F.lit(""))


def context(schema: Column, db_id: Column) -> Column:
    return F.concat(
        _optional(schema, "\nDatabase Schema DDL:\n", "\n"), _optional(db_id, "\nTarget Database: ", "\n")
    )


def alpaca_prompt(question: Column, schema: Column, db_id: Column) -> Column:
    return F.concat(
        F.lit("### Instruction:\nTranslate the natural language question into a valid SQLite query."),
        context(schema, db_id), F.lit("\nQuestion: "), question, F.lit("\n\n### Response:\n"),
    )


def llama3_prompt(question: Column, schema: Column, db_id: Column) -> Column:
    return F.concat(
        F.lit(
            "<|start_header_id|>system<|end_header_id|>\nYou are an expert SQL assistant.<|eot_id|>"
            "<|start_header_id|>user<|end_header_id|>\n"
        ),
        context(schema, db_id), F.lit("Question: "), question,
        F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"),
    )


def gemma_prompt(question: Column, schema: Column, db_id: Column) -> Column:
    return F.concat(
        F.lit("<start_of_turn>user\nTranslate natural language to SQL."), context(schema, db_id),
        F.lit("\nQuestion: "), question, F.lit("<end_of_turn>\n<start_of_turn>model\n"),
    )


def chatml_messages(question: Column, sql: Column, schema: Column, db_id: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = "You are an expert SQL assistant. Translate natural language questions to SQL."
    return F.array(
        message("system", F.lit(system)),
        message("user", F.concat(context(schema, db_id), F.lit("Question: "), question)),
        message("assistant", sql),
    )


def render(name: str, question: Column, sql: Column, schema: Column, db_id: Column) -> list[Column]:
    """Columns of one export format; an unknown name falls back to the default."""
    if name == "chatml":
        return [chatml_messages(question, sql, schema, db_id).alias("messages")]
    if name == "alpaca":
        prompt, completion = alpaca_prompt(question, schema, db_id), sql
    elif name == "llama3":
        prompt, completion = llama3_prompt(question, schema, db_id), F.concat(sql, F.lit("<|eot_id|>"))
    else:
        prompt, completion = gemma_prompt(question, schema, db_id), F.concat(sql, F.lit("<end_of_turn>"))
    return [prompt.alias("prompt"), completion.alias("completion")]


def training_prompt(question: Column, sql: Column, schema: Column, extra: Column) -> Column:
    """Supervised training text: request, optional schema and input, and the answer."""
    return F.concat(
        F.lit(
            "You are a production text-to-SQL engine. Translate the following user request "
            "into a precise SQLite query.\n"
        ),
        _optional(schema, "Database Schema DDL:\n", "\n"), _optional(extra, "Input: ", "\n"),
        F.lit("User Question: "), F.coalesce(question, F.lit("")),
        F.lit("\nSQLite Query: "), F.coalesce(sql, F.lit("")),
    )


def inference_prompt(question: Column, schema: Column) -> Column:
    """The same request without the answer."""
    return F.concat(
        F.lit(
            "You are a production text-to-SQL engine. Translate the following user request "
            "into a precise SQLite query."
        ),
        _optional(schema, "\nDatabase Schema DDL:\n", "\n"),
        F.lit("\nUser Question: "), question, F.lit("\nSQLite Query:"),
    )
