"""Screening of SQL and prompt text, as column expressions.

Every rule looks at one row only, so a whole table is screened in one scan
without a shuffle. Rules are textual: literals are emptied first, then
keywords, tables and columns are found by pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import blank_literals, drop_all, drop_comments, strip

# Words that make a statement destructive.
DESTRUCTIVE_WORDS = [
    "DROP", "DELETE", "TRUNCATE", "ALTER", "UPDATE", "INSERT", "REPLACE", "GRANT",
    "REVOKE", "EXEC", "EXECUTE", "PRAGMA", "ATTACH", "DETACH", "VACUUM",
]

# Statement words reported as a mutating operation, in report order.
MUTATING_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER"]

# Statement words that count as an opaque command.
COMMAND_WORDS = ["VACUUM", "REINDEX", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL", "EXPLAIN"]

# Patterns of a prompt that tries to override instructions.
INJECTION_PATTERNS = [
    r"ignore\s+all\s+previous\s+instructions",
    r"override\s+system\s+prompt",
    r"drop\s+table",
    r"delete\s+from",
    r"truncate\s+table",
]

# Tables that always exist.
SYSTEM_TABLES = ["sqlite_master", "sqlite_sequence"]

# Control characters removed from prompts (tab, line feed and return stay).
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

PROMPT_LIMIT = 2048

# The messages of a verdict.
PASSED = "SQL query passed all safety and schema validation checks"
EMPTY_REASON = "Empty SQL query provided"
EMPTY_VIOLATION = "Empty SQL string"
NO_STATEMENT_REASON = "No valid SQL statements found"
NO_STATEMENT_VIOLATION = "Invalid SQL statement structure"
PARSE_REASON = "Failed to parse SQL AST"
PARSE_VIOLATION = "SQL Syntax Parsing Error"
NOT_READ_ONLY_VIOLATION = "Only a single read-only SELECT statement may run."
PRAGMA_VIOLATION = "PRAGMA statement execution is prohibited for safety."
ATTACH_VIOLATION = "ATTACH/DETACH database command is prohibited."
NO_SQL_ERROR = "Unable to extract or parse valid SQL AST statement from model generation output"

# Names shorter than this, or starting so, are not reported as unknown columns.
SHORTEST_COLUMN, ALIAS_LETTER = 3, "t"

# Words that are never a column name.
RESERVED_WORDS = [
    "all", "and", "any", "as", "asc", "between", "by", "case", "cast", "collate", "cross", "desc",
    "distinct", "else", "end", "escape", "except", "exists", "false", "from", "full", "glob", "group",
    "having", "in", "inner", "intersect", "interval", "into", "is", "join", "left", "like", "limit",
    "natural", "not", "null", "offset", "on", "or", "order", "outer", "over", "partition", "recursive",
    "right", "select", "set", "some", "then", "true", "union", "using", "values", "when", "where", "with",
]

# Patterns over lower-case text whose literals are empty.
FROM_LIST = (
    r"\bfrom\s+((?:\w+\.)?[a-z_]\w*(?:\s+(?:as\s+)?[a-z_]\w*)?"
    r"(?:\s*,\s*(?:\w+\.)?[a-z_]\w*(?:\s+(?:as\s+)?[a-z_]\w*)?)*)"
)
JOIN_TABLE = r"\bjoin\s+(?:\w+\.)?([a-z_]\w*)"
CTE_NAME = r"(?:\bwith|,)\s*(?:recursive\s+)?([a-z_]\w*)\s+as\s*\("
TABLE_ALIAS = r"\b(?:from|join)\s+(?:\w+\.)?[a-z_]\w*\s+(?:as\s+)?([a-z_]\w*)"
# How tables and columns are found in DDL text.
DDL_TABLE = r"create\s+table\s+([a-zA-Z0-9_]+)"
DDL_COLUMN = r"([a-zA-Z0-9_]+)\s+(?:int|text|decimal|date|timestamp|boolean|varchar)"

# Statement patterns read text with a semicolon before each statement.
STATEMENT_START = (
    r";[\s(]*(?:select|with|values|insert|update|delete|drop|create|alter|pragma|attach|detach|truncate"
    r"|vacuum|reindex|grant|revoke|exec|execute|call|explain|replace|merge)\b"
)
STATEMENT_WORD = r";[\s(]*([A-Z]+)"
BEHIND_WITH = r";\s*WITH\b[^;]*\)\s*(INSERT|UPDATE|DELETE)\b"
# FROM that names no table: inside these functions, and in a comparison.
FUNCTION_FROM = r"(\b(?:extract|trim|substring|overlay|position)\s*\([^()]*?)\bfrom\b|\bdistinct\s+from\b"
NOT_COLUMN = r"\bas\s+[a-z_]\w*|\b[a-z_]\w*\s*[.(]"
# Fixed value: the first fenced block of an answer.
FENCED = r"(?is)```(?:sql)?\s*(.*?)\s*```"
SELECT_WORD = r"(?i)\b(?:select|with)\b"
HOLLOW_CLAUSE = (
    r"\bselect\s+from\b"
    r"|\b(?:from|where|by|having|limit)\s*(?:;|\z|\b(?:from|where|group|having|order|limit)\b)"
)
READ_ONLY_ROOT = r"(?i)\A[\s(;]*(?:select|with)\b"
# What follows the last WITH query of a statement when that is not a SELECT.
WRITE_BEHIND_WITH = r"(?i)\A[\s(;]*with\b[^;]*\)\s*(?:insert|update|delete|merge|replace|truncate|drop|create|alter)\b"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _if(condition: Column, message: Column) -> Column:
    """Array of the message, or an empty one."""
    return F.when(condition, F.array(message)).otherwise(_nothing())


def bare_text(clean: Column) -> Column:
    """Lower-case text with empty literals, without comments and quotes around names: what the patterns look at."""
    return F.regexp_replace(blank_literals(F.lower(clean)), FUNCTION_FROM, "$1,")


def statement_count(bare: Column) -> Column:
    return F.regexp_count(bare, F.lit(r"[^;\s][^;]*")).cast("long")


def destructive_words(text: Column) -> Column:
    """Destructive words in the text, sorted."""
    return F.array_sort(F.array_intersect(_all(F.upper(text), r"\b[A-Z_]+\b", 0), _words(DESTRUCTIVE_WORDS)))


def has_read_only_root(bare: Column) -> Column:
    """Is the first statement a SELECT, or a WITH that ends in one?"""
    return bare.rlike(READ_ONLY_ROOT) & ~bare.rlike(WRITE_BEHIND_WITH)


def fenced_or_whole(output: Column) -> Column:
    """Inside of the first fenced block, else the whole text."""
    text = strip(output)
    return F.when(text.rlike(FENCED), strip(F.regexp_extract(text, FENCED, 1))).otherwise(text)


def from_select(body: Column) -> Column:
    """Text from the first SELECT or WITH on, if there is one."""
    return F.when(body.rlike(SELECT_WORD), strip(F.regexp_extract(body, f"(?s){SELECT_WORD}.*", 0))).otherwise(body)


def referenced_tables(bare: Column) -> Column:
    """Distinct names after FROM (comma lists too) and JOIN."""
    listed = F.concat(F.lit(","), F.array_join(_all(bare, FROM_LIST), ","))
    return F.array_distinct(F.concat(_all(listed, r",\s*(?:\w+\.)?([a-z_]\w*)"), _all(bare, JOIN_TABLE)))


def cte_names(bare: Column) -> Column:
    return F.array_distinct(_all(bare, CTE_NAME))


def unknown_tables(tables: Column, ctes: Column, known: Column) -> Column:
    """Referenced tables that are neither known, nor defined by WITH, nor system tables; sorted."""
    return F.array_sort(F.array_except(tables, F.concat(known, ctes, _words(SYSTEM_TABLES))))


def referenced_columns(bare: Column, tables: Column, ctes: Column) -> Column:
    """Distinct names used as a column, sorted."""
    names = _all(F.regexp_replace(bare, NOT_COLUMN, " "), r"\b[a-z_]\w*", 0)
    open_words = F.filter(names, lambda name: ~name.isin(RESERVED_WORDS))
    return F.array_sort(F.array_except(open_words, F.concat(tables, ctes, _all(bare, TABLE_ALIAS))))


def unknown_columns(columns: Column, known: Column) -> Column:
    """Column names that are not known, but for short ones and those that look like a table alias."""
    odd = F.filter(columns, lambda c: (F.length(c) >= SHORTEST_COLUMN) & ~F.startswith(c, F.lit(ALIAS_LETTER)))
    return F.array_except(odd, known)


def ddl_tables(ddl: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(F.lower(ddl), DDL_TABLE)))


def ddl_columns(ddl: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(F.lower(ddl), DDL_COLUMN)))


def has_pragma(clean: Column) -> Column:
    return F.lower(clean).contains("pragma")


def has_attach(clean: Column) -> Column:
    return F.lower(clean).contains("attach ") | F.lower(clean).contains("detach ")


def first_bare(bare: Column) -> Column:
    """First statement of a bare text."""
    return F.regexp_extract(bare, r"\A[\s;]*([^;]*)", 1)


def mutating_operations(bare: Column) -> Column:
    """Labels of mutating statements in report order; COMMAND stands for opaque ones."""
    text = F.concat(F.lit(";"), F.upper(bare))
    found = F.concat(_all(text, STATEMENT_WORD), _all(text, BEHIND_WITH))
    return F.concat(
        F.array_intersect(_words(MUTATING_WORDS), found),
        _if(F.arrays_overlap(found, _words(COMMAND_WORDS)), F.lit("COMMAND")),
    )


def is_well_formed(clean: Column, bare: Column) -> Column:
    """Textual stand-in for a parse.

    Every statement starts with a statement word, no clause is empty, brackets and quotes match.
    """
    started = F.regexp_count(F.concat(F.lit(";"), bare), F.lit(STATEMENT_START))
    balanced = F.length(drop_all(bare, "(")) == F.length(drop_all(bare, ")"))
    written = drop_comments(clean)
    quotes = F.length(written) - F.length(drop_all(written, "'"))
    # One comparison: what is written twice behind an AND is looked for twice.
    return (
        (started == F.greatest(statement_count(bare), F.lit(1))) & ~bare.rlike(HOLLOW_CLAUSE) & balanced & (quotes % 2 == 0)
    )


def prompt_too_long(prompt: Column, limit: int = PROMPT_LIMIT) -> Column:
    return F.length(prompt) > limit


def injection_pattern(prompt: Column) -> Column:
    """First injection pattern found in the prompt, or null."""
    lowered = F.lower(prompt)
    found = F.lit(None).cast("string")
    for pattern in reversed(INJECTION_PATTERNS):
        found = F.when(lowered.rlike(pattern), F.lit(pattern)).otherwise(found)
    return found


def clean_prompt(prompt: Column) -> Column:
    return strip(F.regexp_replace(prompt, CONTROL_CHARACTERS, ""))
