"""Clause features of a SQL text, exact match, and the cause of a wrong answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.functions.screening import _all
from pairloom.functions.text import collapse, strip

JOIN_WORD = r"\b(?:(?:natural|left|right|full|inner|cross|outer) )*join\b"
CLAUSE_TAIL = r"(?m)\b(?:where|group by|having|order by|limit|union|intersect|except)\b.*$"
WHERE_CLAUSE = r"\bwhere\b(.*?)(?:\b(?:group by|having|order by|limit|union|intersect|except)\b|\z)"
GROUP_CLAUSE = r"\bgroup by\b(.*?)(?:\b(?:having|order by|limit|union|intersect|except)\b|\z)"
ORDER_CLAUSE = r"\border by\b(.*?)(?:\b(?:limit|union|intersect|except)\b|\z)"
LIMIT_CLAUSE = r"\blimit\b(.*)\z"

# Words that may stand before a bracket without being a function.
BEFORE_BRACKET = [
    "all", "and", "any", "as", "between", "by", "case", "else", "except", "exists", "from", "having", "in",
    "intersect", "join", "like", "limit", "not", "on", "or", "over", "select", "some", "then", "union", "using",
    "values", "when", "where", "with",
]

# Labels of a wrong answer, first difference wins.
SYNTAX_ERROR = "syntax error"
MISSING_JOIN = "missing JOIN"
INCORRECT_JOIN = "incorrect JOIN"
WRONG_TABLE = "wrong table"
WRONG_COLUMN = "wrong column"
INCORRECT_AGGREGATION = "incorrect aggregation"
INCORRECT_WHERE = "incorrect WHERE/filter"
INCORRECT_GROUP_BY = "incorrect GROUP BY"
INCORRECT_ORDER_BY = "incorrect ORDER BY"
INCORRECT_LIMIT = "incorrect LIMIT"
EXECUTION_ERROR = "execution error"
WRONG_RESULT = "wrong result set"
FAILURE_CATEGORIES = [
    SYNTAX_ERROR, MISSING_JOIN, INCORRECT_JOIN, WRONG_TABLE, WRONG_COLUMN, INCORRECT_AGGREGATION,
    INCORRECT_WHERE, INCORRECT_GROUP_BY, INCORRECT_ORDER_BY, INCORRECT_LIMIT, EXECUTION_ERROR, WRONG_RESULT,
]


def normalize_masked(masked: Column) -> Column:
    """Comparable form of a lower-case text whose literals are masked.

    One blank between words, none around punctuation, no final semicolon.
    """
    text = F.regexp_replace(collapse(masked), r"[; ]+\z", "")
    return F.regexp_replace(text, r" ?([(),=<>]) ?", "$1")


def join_clauses(normalized: Column) -> Column:
    """Text of each joined table with its condition, in order."""
    lines = F.regexp_replace(F.regexp_replace(normalized, JOIN_WORD, "\n"), CLAUSE_TAIL, "")
    joins = F.slice(F.split(strip(F.regexp_replace(lines, r" *\n *", "\n")), "\n"), 2, 2**30)
    return F.when(F.instr(normalized, "join") > 0, joins).otherwise(F.array().cast("array<string>"))


def function_names(bare: Column) -> Column:
    """Names before a bracket, sorted, repeated as often as they are used."""
    named = _all(bare, r"\b([a-z_]\w*)\(")
    return F.array_sort(F.filter(named, lambda name: ~name.isin(BEFORE_BRACKET)))


def clause_text(normalized: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(normalized, pattern, 1))


def error_type(message: Column) -> Column:
    """Type of an execution error, from its message."""
    text = F.lower(message)
    return (
        F.when(text.contains("syntax"), "SyntaxError")
        .when(text.contains("no such table"), "TableNotFound")
        .when(text.contains("no such column"), "ColumnNotFound")
        .when(message.isNotNull(), "ExecutionError")
    )


def outcome(generated: Column, actual_error: Column, gold_error: Column, rows_match: Column) -> Column:
    """Execution verdict of one case; null means the results agree."""
    return (
        F.when(~generated, "GenerationFailed")
        .when(actual_error.isNotNull(), error_type(actual_error))
        .when(gold_error.isNotNull(), "GroundTruthExecutionError")
        .when(~rows_match, "ResultMismatch")
    )


def error_cause(message: Column) -> Column:
    """Cause of a wrong answer that a runtime error tells; null without one."""
    error = F.lower(message)
    return (
        F.when(error.contains("syntax") | error.contains("near"), SYNTAX_ERROR)
        .when(error.contains("no such table"), WRONG_TABLE)
        .when(error.contains("no such column"), WRONG_COLUMN)
        .when(error != "", EXECUTION_ERROR)
    )


def failure_cause(generated_sql: Column, actual_error: Column, gold: str, own: str) -> Column:
    """Cause of a wrong answer: runtime error first, then the first clause that differs.

    ``gold`` and ``own`` are the prefixes of the columns with the clause features.
    """
    told = error_cause(actual_error)

    def differ(feature: str) -> Column:
        return F.col(f"{gold}_{feature}") != F.col(f"{own}_{feature}")

    return (
        F.when(F.coalesce(strip(generated_sql), F.lit("")) == "", SYNTAX_ERROR)
        .when(told.isNotNull(), told)
        .when(~F.col(f"{gold}_ok") | ~F.col(f"{own}_ok"), SYNTAX_ERROR)
        .when((F.size(f"{gold}_joins") > 0) & (F.size(f"{own}_joins") == 0), MISSING_JOIN)
        .when(differ("joins"), INCORRECT_JOIN)
        .when(differ("tables"), WRONG_TABLE)
        .when(differ("columns"), WRONG_COLUMN)
        .when(differ("functions"), INCORRECT_AGGREGATION)
        .when(differ("where_text"), INCORRECT_WHERE)
        .when(differ("group_text"), INCORRECT_GROUP_BY)
        .when(differ("order_text"), INCORRECT_ORDER_BY)
        .when(differ("limit_text"), INCORRECT_LIMIT)
        .otherwise(WRONG_RESULT)
    )


def repeated_words(tokens: Column) -> Column:
    """Words that occur more than once; ``tokens`` is a sorted array column."""
    again = F.filter(tokens, lambda token, i: (i > 0) & (token == F.get(tokens, i - 1)))
    return F.array_distinct(again)


def unigram_bleu(ref: Column, cand: Column, repeated: Column) -> Column:
    """Clipped unigram precision of two word arrays with brevity penalty, four decimals.

    A word that the candidate has once matches once if the reference has it; only the
    ``repeated`` words of the candidate need counting. All three should be columns.
    """

    def count(tokens: Column, token: Column) -> Column:
        return F.size(tokens) - F.size(F.array_remove(tokens, token))

    matches = F.aggregate(
        F.array_intersect(repeated, ref),
        F.size(F.array_intersect(cand, ref)),
        lambda total, token: total + F.least(count(cand, token), count(ref, token)) - 1,
    )
    precision = matches / F.size(cand)
    penalty = F.when(F.size(cand) < F.size(ref), F.exp(1 - F.size(ref) / F.size(cand))).otherwise(F.lit(1.0))
    return F.when((F.size(ref) == 0) | (F.size(cand) == 0), F.lit(0.0)).otherwise(
        round_half_up(precision * penalty, 4)
    )
