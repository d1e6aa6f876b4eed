"""Pieces of SQL text for the checking engine, one per text expression."""

from __future__ import annotations

from pairloom.functions import clauses as C
from pairloom.functions import screening as S
from pairloom.functions.text import WHITESPACE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def rnd(x: str, digits: int) -> str:
    """Round half up on the decimal form of a double."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def money(x: str) -> str:
    """Sum of two-decimal amounts without rounding drift."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"


def average(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18, 4))) AS DOUBLE) / count({x}))"


_WS = lit(WHITESPACE)
_WS_RUN = lit(f"[{WHITESPACE}]+")


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, {_WS_RUN}, ' ', 'g')"


def words(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({strip(x)}, {_WS_RUN}) END"


def fences(x: str) -> str:
    opened = f"regexp_replace(regexp_replace({strip(x)}, '\\A```sql', ''), '\\A```', '')"
    return strip(f"regexp_replace({opened}, '```\\z', '')")


def clean_sql(x: str) -> str:
    return f"rtrim({fences(x)}, ';')"


def literals(x: str, replace: str) -> str:
    """``replace`` is an expression over the inside ``p`` of a literal."""
    return (
        f"array_to_string(list_transform(string_split({x}, ''''), "
        f"lambda p, i: CASE WHEN i % 2 = 0 THEN {replace} ELSE p END), '''')"
    )


def mask(x: str) -> str:
    return literals(x, "md5(lower(p))")


def blank(x: str) -> str:
    return f"translate({literals(x, lit(''))}, '\"`[]', '')"


def statements(x: str) -> str:
    hidden = literals(x, "translate(p, ';', chr(1))")
    parts = f"list_transform(string_split({hidden}, ';'), lambda s: {strip('translate(s, chr(1), chr(59))')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def minus(left: str, right: str) -> str:
    return f"list_filter(list_distinct({left}), lambda e: NOT list_contains({right}, e))"


def tables(x: str) -> str:
    text = blank(f"lower({x})")
    listed = f"flatten(list_transform(regexp_extract_all({text}, {lit(S.FROM_LIST)}, 1), lambda l: string_split(l, ',')))"
    names = f"list_transform({listed}, lambda l: regexp_extract(l, '\\A\\s*(?:\\w+\\.)?(\\w+)', 1))"
    return f"list_sort(list_distinct(list_concat({names}, regexp_extract_all({text}, {lit(S.JOIN_TABLE)}, 1))))"


def ctes(x: str) -> str:
    return f"list_distinct(regexp_extract_all({blank(f'lower({x})')}, {lit(S.CTE_NAME)}, 1))"


def unknown_tables(x: str, known) -> str:
    allowed = f"list_concat({array(list(known) + S.SYSTEM_TABLES)}, {ctes(x)})"
    return f"list_sort({minus(tables(x), allowed)})"


def columns(x: str) -> str:
    text = blank(f"lower({x})")
    aliases = f"list_concat(list_concat(regexp_extract_all({text}, {lit(S.TABLE_ALIAS)}, 1), {tables(x)}), {ctes(x)})"
    bare = f"regexp_replace({text}, '\\bas\\s+[a-z_]\\w*', ' ', 'g')"
    bare = f"regexp_replace({bare}, '\\b[a-z_]\\w*\\.', '', 'g')"
    bare = f"regexp_replace({bare}, '\\b[a-z_]\\w*\\s*\\(', '(', 'g')"
    names = f"regexp_extract_all({bare}, '\\b[a-z_]\\w*\\b')"
    return f"list_sort({minus(names, f'list_concat({array(S.RESERVED_WORDS)}, {aliases})')})"


def unknown_columns(x: str, known) -> str:
    return (
        f"list_sort(list_filter({minus(columns(x), array(known))}, "
        "lambda c: length(c) > 2 AND NOT starts_with(c, 't')))"
    )


def well_formed(x: str) -> str:
    bare = f"lower({blank(x)})"
    return (
        f"(len(regexp_extract_all(';' || {bare}, {lit(S.STATEMENT_START)})) > 0 "
        f"AND len(regexp_extract_all(';' || {bare}, {lit(S.STATEMENT_START)})) = len({statements(bare)}) "
        f"AND NOT regexp_matches({bare}, {lit(S.HOLLOW_CLAUSE)}) "
        f"AND length(replace({bare}, '(', '')) = length(replace({bare}, ')', '')) "
        f"AND (length({x}) - length(replace({x}, '''', ''))) % 2 = 0)"
    )


def extract(x: str) -> str:
    """SQL in an answer; ``x`` is a column name."""
    fenced = lit(r"(?is)```(?:sql)?\s*(.*?)\s*```")
    body = (
        f"CASE WHEN regexp_matches({strip(x)}, {fenced}) THEN {strip(f'regexp_extract({strip(x)}, {fenced}, 1)')} "
        f"ELSE {strip(x)} END"
    )
    started = strip(f"regexp_extract({body}, '(?is)\\b(?:select|with)\\b.*')")
    return f"CASE WHEN {started} <> '' THEN {started} ELSE {body} END"


def first_statement(x: str) -> str:
    return f"coalesce({statements(x)}[1], '')"


def mutations(parts: str) -> str:
    """``parts`` is a list of statements."""
    leading = f"list_transform({parts}, lambda s: upper(regexp_extract(s, '\\A[\\s(]*([A-Za-z]+)', 1)))"
    behind = (
        f"flatten(list_transform({parts}, lambda s: CASE WHEN starts_with(lower(s), 'with') THEN "
        f"regexp_extract_all(upper({blank('s')}), '\\)\\s*(INSERT|UPDATE|DELETE)\\b', 1) ELSE []::VARCHAR[] END))"
    )
    found = f"list_concat({leading}, {behind})"
    return (
        f"list_concat(list_filter({array(S.MUTATING_WORDS)}, lambda w: list_contains({found}, w)), "
        f"CASE WHEN list_has_any({found}, {array(S.COMMAND_WORDS)}) THEN ['COMMAND'] ELSE []::VARCHAR[] END)"
    )


def normalize(x: str) -> str:
    text = collapse(mask(f"lower({fences(f'coalesce({x}, {lit(str())})')})"))
    text = f"regexp_replace({text}, '[; ]+\\z', '')"
    return f"regexp_replace({text}, ' ?([(),=<>]) ?', '\\1', 'g')"


def joins(n: str) -> str:
    tail = lit(C.CLAUSE_TAIL.replace("(?m)", "").replace("$", r"\z"))
    return (
        f"list_transform(regexp_split_to_array({n}, {lit(C.JOIN_WORD)})[2:], "
        f"lambda j: {strip(f'regexp_replace(j, {tail}, {lit(str())})')})"
    )


def functions(n: str) -> str:
    return (
        f"list_sort(list_filter(regexp_extract_all({blank(n)}, '\\b([a-z_]\\w*)\\(', 1), "
        f"lambda f: NOT list_contains({array(C.BEFORE_BRACKET)}, f)))"
    )


def clause(n: str, pattern: str) -> str:
    return strip(f"regexp_extract({n}, {lit(pattern)}, 1)")


def feature_columns(n: str, suffix: str = "") -> str:
    return f"""{joins(n)} AS joins{suffix}, {tables(n)} AS tables{suffix}, {columns(n)} AS columns{suffix},
  {functions(n)} AS functions{suffix}, {clause(n, C.WHERE_CLAUSE)} AS where_text{suffix},
  {clause(n, C.GROUP_CLAUSE)} AS group_text{suffix}, {clause(n, C.ORDER_CLAUSE)} AS order_text{suffix},
  {clause(n, C.LIMIT_CLAUSE)} AS limit_text{suffix}"""
