"""Screening of SQL and prompt texts (S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import screening as S
from pairloom.functions import text
from pairloom.operators import catalog, screen
from pairloom.plans import sqltext as Q
from pairloom.plans.registry import query
from pairloom.sources import views
from pairloom.sources.tables import COLUMN_NAMES, TABLE_DDL, TABLE_NAMES, Tables

_WITH = views.with_views("sql_pairs")


def known(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _texts(t: Tables) -> DataFrame:
    return views.sql_pairs(t).select("case_id", "generated_sql")


def _bare(t: Tables) -> DataFrame:
    return screen.with_bare(_texts(t), "generated_sql")


def _names(t: Tables) -> DataFrame:
    return screen.with_names(_texts(t), "generated_sql")


def _select(columns: str, where: str = "") -> str:
    return f"{_WITH} SELECT case_id, {columns} FROM sql_pairs {where}"


def _joined(expression: str) -> str:
    return f"array_to_string({expression}, ',')"


@query("s01_extract_sql", _select(f"{Q.extract('generated_sql')} AS sql_text"))
def extract_sql(t: Tables) -> DataFrame:
    """SQL out of a model's answer."""
    return screen.with_extracted(_texts(t), "generated_sql", "sql_text").drop("generated_sql")


@query("s02_first_statement", _select(f"{Q.first_statement(Q.extract('generated_sql'))} AS statement"))
def first_statement(t: Tables) -> DataFrame:
    """Text before the first semicolon outside literals."""
    extracted = screen.with_extracted(_texts(t), "generated_sql", "sql_text")
    return extracted.select("case_id", text.first_statement(F.col("sql_text")).alias("statement"))


@query(
    "s03_empty_check",
    _select(
        f"{Q.lit(S.EMPTY_REASON)} AS reason", f"WHERE {Q.fences('generated_sql')} = ''"
    ),
)
def empty_check(t: Tables) -> DataFrame:
    """Blank texts, which are blocked."""
    return screen.keep_where(
        _bare(t), F.col("_clean") == "", "case_id", F.lit(S.EMPTY_REASON).alias("reason")
    )


@query(
    "s04_stacked_statements",
    _select(
        f"CAST(len({Q.statements(Q.fences('generated_sql'))}) AS BIGINT) AS n_statements",
        f"WHERE len({Q.statements(Q.fences('generated_sql'))}) > 1",
    ),
)
def stacked_statements(t: Tables) -> DataFrame:
    """Texts with more than one statement."""
    counted = _bare(t).withColumn("n_statements", S.statement_count(F.col("_bare")))
    return screen.keep_where(counted, F.col("n_statements") > 1, "case_id", "n_statements")


_FOUND = f"regexp_extract_all(upper({Q.blank('generated_sql')}), '\\b[A-Z_]+\\b')"
_FOUND_ANYWHERE = "regexp_extract_all(upper(generated_sql), '\\b[A-Z_]+\\b')"
_BAD = Q.array(S.DESTRUCTIVE_WORDS)


@query(
    "s05_destructive_words",
    _select(
        f"""array_to_string(list_sort(list_intersect(list_distinct({_FOUND}), {_BAD})), ', ') AS found,
  array_to_string(list_sort(list_intersect(list_distinct({_FOUND_ANYWHERE}), {_BAD})), ', ') AS found_anywhere""",
        f"WHERE list_has_any({_FOUND_ANYWHERE}, {_BAD})",
    ),
)
def destructive_words(t: Tables) -> DataFrame:
    """Destructive words of each text, outside literals and anywhere."""
    anywhere = _bare(t).withColumn("_anywhere", S.destructive_words(F.col("generated_sql")))
    return screen.keep_where(
        anywhere, F.size("_anywhere") > 0, "case_id",
        F.array_join(S.destructive_words(F.col("_bare")), ", ").alias("found"),
        F.array_join("_anywhere", ", ").alias("found_anywhere"),
    )


# The root rule on its own terms: the first word of the text, and what stands behind the last bracket of a WITH.
_FIRST_WORD = f"lower(regexp_extract({Q.fences('generated_sql')}, '[A-Za-z]+'))"
_READS = f"""({_FIRST_WORD} = 'select' OR ({_FIRST_WORD} = 'with'
  AND lower(regexp_extract({Q.fences('generated_sql')}, '(?s)\\)\\s+([A-Za-z]+)\\s+[^()]*(?:\\([^)]*\\)[^()]*)*\\z', 1))
  NOT IN ('insert', 'update', 'delete', 'merge', 'replace', 'truncate', 'drop', 'create', 'alter')))"""


@query(
    "s06_read_only_root",
    _select(f"{_READS} AS read_only"),
)
def read_only_root(t: Tables) -> DataFrame:
    """Does the text start with SELECT or WITH?"""
    return _bare(t).select("case_id", S.has_read_only_root(F.col("_bare")).alias("read_only"))


@query("s07_referenced_tables", _select(f"{_joined(Q.tables('generated_sql'))} AS tables_referenced"))
def referenced_tables(t: Tables) -> DataFrame:
    """Tables after FROM and JOIN."""
    found = F.array_join(F.array_sort(S.referenced_tables(F.col("_bare"))), ",")
    return _bare(t).select("case_id", found.alias("tables_referenced"))


@query(
    "s08_unknown_tables",
    f"""SELECT * FROM ({_select(f"{_joined(Q.unknown_tables('generated_sql', TABLE_NAMES))} AS unknown_tables")}) u
  WHERE unknown_tables <> ''""",
)
def unknown_tables(t: Tables) -> DataFrame:
    """Referenced tables that the catalogue lacks; WITH names count as known."""
    missing = S.unknown_tables(F.col("_tables"), F.col("_ctes"), known(TABLE_NAMES))
    found = _names(t).withColumn("names", missing)
    return screen.keep_where(
        found, F.size("names") > 0, "case_id", F.array_join("names", ",").alias("unknown_tables")
    )


@query(
    "s09_unknown_columns",
    f"""SELECT case_id, CAST(len(names) AS BIGINT) AS n_unknown, array_to_string(names[1:3], ', ') AS first_three FROM
  ({_select(f"{Q.unknown_columns('generated_sql', COLUMN_NAMES)} AS names")}) u WHERE len(names) > 3""",
)
def unknown_columns(t: Tables) -> DataFrame:
    """Texts with more than three column names that the catalogue lacks."""
    strange = S.unknown_columns(F.col("_columns"), known(COLUMN_NAMES))
    found = _names(t).withColumn("names", strange)
    return screen.keep_where(
        found, F.size("names") > 3, "case_id", F.size("names").cast("long").alias("n_unknown"),
        F.array_join(F.slice("names", 1, 3), ", ").alias("first_three"),
    )


_PAIRS = views.with_views("pairs")


@query(
    "s10_ddl_catalog",
    f"""{_PAIRS}, found AS (SELECT db_id, list_concat(
      list_transform(list_distinct(regexp_extract_all(lower(schema), {Q.lit(S.DDL_TABLE)}, 1)), lambda n: 'table ' || n),
      list_transform(list_distinct(regexp_extract_all(lower(schema), {Q.lit(S.DDL_COLUMN)}, 1)), lambda n: 'column ' || n)
    ) AS names FROM pairs WHERE schema IS NOT NULL)
  SELECT coalesce(db_id, 'unknown') AS db_id, name, count(*) AS n_pairs
  FROM (SELECT db_id, unnest(names) AS name FROM found) f GROUP BY 1, 2""",
)
def ddl_catalog(t: Tables) -> DataFrame:
    """Table and column names in the DDL of the pairs, per database."""

    def labelled(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit(f"{kind} "), n))

    ddl = F.col("schema")
    names = F.concat(labelled("table", S.ddl_tables(ddl)), labelled("column", S.ddl_columns(ddl)))
    return (
        views.pairs(t)
        .filter(ddl.isNotNull())
        .select(F.coalesce("db_id", F.lit("unknown")).alias("db_id"), F.explode(names).alias("name"))
        .groupBy("db_id", "name")
        .agg(F.count("*").alias("n_pairs"))
    )


@query(
    "s11_pragma_attach",
    _select(
        """contains(lower(generated_sql), 'pragma') AS has_pragma,
  contains(lower(generated_sql), 'attach ') OR contains(lower(generated_sql), 'detach ') AS has_attach""",
        """WHERE contains(lower(generated_sql), 'pragma') OR contains(lower(generated_sql), 'attach ')
  OR contains(lower(generated_sql), 'detach ')""",
    ),
)
def pragma_attach(t: Tables) -> DataFrame:
    """Texts with PRAGMA, ATTACH or DETACH."""
    clean = F.col("_clean")
    found = _bare(t).withColumns({"has_pragma": S.has_pragma(clean), "has_attach": S.has_attach(clean)})
    either = F.col("has_pragma") | F.col("has_attach")
    return screen.keep_where(found, either, "case_id", "has_pragma", "has_attach")


_PARTS = Q.statements(Q.fences("generated_sql"))


@query(
    "s12_mutating_operations",
    f"""SELECT * FROM ({_select(f"{_joined(Q.mutations(_PARTS))} AS operations, "
                               f"{_joined(Q.mutations(f'{_PARTS}[1:1]'))} AS first_operations")}) m
  WHERE operations <> ''""",
)
def mutating_operations(t: Tables) -> DataFrame:
    """Mutating operations anywhere in the text, and in its first statement."""
    found = _bare(t).select(
        "case_id",
        S.mutating_operations(F.col("_bare")).alias("all_found"),
        S.mutating_operations(S.first_bare(F.col("_bare"))).alias("first_found"),
    )
    return screen.keep_where(
        found, F.size("all_found") > 0, "case_id", F.array_join("all_found", ",").alias("operations"),
        F.array_join("first_found", ",").alias("first_operations"),
    )


_VERDICT_SQL = f"""{_WITH}, parts AS (SELECT case_id, {Q.fences('generated_sql')} AS f, {_PARTS} AS parts,
    {_READS} AS reads FROM sql_pairs),
  facts AS (SELECT case_id, f, parts, reads, len(parts) AS n, {Q.mutations('parts[1:1]')} AS ops,
    {Q.unknown_tables('f', TABLE_NAMES)} AS missing, {Q.unknown_columns('f', COLUMN_NAMES)} AS strange,
    NOT {Q.well_formed('f')} AS broken FROM parts),
  listed AS (SELECT case_id, f, n, broken, list_filter(list_concat(list_concat(
    [CASE WHEN n > 1 THEN 'Multiple SQL statements detected (' || n
      || ' statements). Multi-statement stacked execution is prohibited.' END],
    list_transform(ops, lambda o: 'Prohibited AST operation detected: ' || o)),
    [CASE WHEN NOT reads THEN 'Only a single read-only SELECT statement may run.' END,
     CASE WHEN contains(lower(f), 'pragma') THEN {Q.lit(S.PRAGMA_VIOLATION)} END,
     CASE WHEN contains(lower(f), 'attach ') OR contains(lower(f), 'detach ') THEN {Q.lit(S.ATTACH_VIOLATION)} END,
     CASE WHEN len(missing) > 0 THEN 'Referenced table(s) '
       || array_to_string(list_transform(missing, lambda m: '''' || m || ''''), ', ')
       || ' do not exist in database schema ''target''.' END,
     CASE WHEN len(strange) > 3 THEN 'Referenced multiple unrecognized columns: '
       || array_to_string(strange[1:3], ', ') END]), lambda v: v IS NOT NULL) AS v FROM facts),
  final AS (SELECT case_id, CASE WHEN f = '' THEN {Q.lit(S.EMPTY_REASON)} WHEN n = 0 THEN {Q.lit(S.NO_STATEMENT_REASON)}
    WHEN broken THEN {Q.lit(S.PARSE_REASON)} WHEN len(v) = 0 THEN {Q.lit(S.PASSED)}
    ELSE 'SQL execution blocked due to ' || len(v) || ' safety violation(s)' END AS reason,
    CASE WHEN f = '' THEN [{Q.lit(S.EMPTY_VIOLATION)}] WHEN n = 0 THEN [{Q.lit(S.NO_STATEMENT_VIOLATION)}]
    WHEN broken THEN [{Q.lit(S.PARSE_VIOLATION)}] ELSE v END AS v FROM listed)
"""


@query(
    "s13_verdict",
    f"""{_VERDICT_SQL} SELECT case_id, len(v) = 0 AS allowed, reason, array_to_string(v, ' | ') AS violations FROM final""",
)
def verdict(t: Tables) -> DataFrame:
    """Allowed or blocked, with the reason and every violation."""
    judged = screen.judge(_texts(t), "generated_sql", known(TABLE_NAMES), known(COLUMN_NAMES))
    return judged.select("case_id", "allowed", "reason", F.array_join("violations", " | ").alias("violations"))


def _by_database(expression) -> str:
    """An expression over the names of the text's own database, in SQL; no names where it has no schema."""
    cases = []
    for db, tables in views.DATABASES.items():
        columns = sorted({c.split()[0] for t in tables for c in TABLE_DDL[t].split(", ")})
        cases.append(f"WHEN '{db}' THEN {expression(tables, columns)}")
    return f"CASE db_id {' '.join(cases)} ELSE CAST([] AS VARCHAR[]) END"


_DATABASE_SQL = (
    _VERDICT_SQL.replace("parts AS (SELECT case_id,", f"parts AS (SELECT case_id, {views.DB_ID.replace('o_orderkey', 'case_id')} AS db_id,")
    .replace("facts AS (SELECT case_id,", "facts AS (SELECT case_id, db_id,")
    .replace("listed AS (SELECT case_id,", "listed AS (SELECT case_id, db_id, missing, strange,")
    .replace("final AS (SELECT case_id,", "final AS (SELECT case_id, db_id, missing, strange,")
    .replace(Q.unknown_tables("f", TABLE_NAMES), _by_database(lambda tables, _: Q.unknown_tables("f", tables)))
    .replace(Q.unknown_columns("f", COLUMN_NAMES), _by_database(lambda _, columns: Q.unknown_columns("f", columns)))
    .replace("database schema ''target''.'", "database schema ''' || db_id || '''.'")
)


def _dimension(t: Tables) -> DataFrame:
    return catalog.schema_dimension(views.schemas(t), "db_id", "ddl")


@query(
    "s13_verdict_by_database",
    f"""{_DATABASE_SQL} SELECT case_id, db_id, len(v) = 0 AS allowed, reason, array_to_string(v, ' | ') AS violations FROM final""",
)
def verdict_by_database(t: Tables) -> DataFrame:
    """The verdict with names looked up in the schema of the text's own database."""
    judged = catalog.judge_by_database(views.database_texts(t), "generated_sql", "db_id", _dimension(t))
    return judged.select("case_id", "db_id", "allowed", "reason", F.array_join("violations", " | ").alias("violations"))


@query(
    "s08_unknown_tables_by_database",
    f"{_DATABASE_SQL} SELECT case_id, db_id, array_to_string(missing, ',') AS unknown_tables FROM final WHERE len(missing) > 0",
)
def unknown_tables_by_database(t: Tables) -> DataFrame:
    """Referenced tables that the text's own database lacks."""
    named = screen.with_names(catalog.with_schema(views.database_texts(t), "db_id", _dimension(t)), "generated_sql")
    found = named.withColumn("names", S.unknown_tables(F.col("_tables"), F.col("_ctes"), F.col("known_tables")))
    return screen.keep_where(found, F.size("names") > 0, "case_id", "db_id", F.array_join("names", ",").alias("unknown_tables"))


@query(
    "s09_unknown_columns_by_database",
    f"""{_DATABASE_SQL} SELECT case_id, db_id, CAST(len(strange) AS BIGINT) AS n_unknown, array_to_string(strange[1:3], ', ') AS first_three
  FROM final WHERE len(strange) > 3""",
)
def unknown_columns_by_database(t: Tables) -> DataFrame:
    """Texts with more than three column names that their own database lacks."""
    named = screen.with_names(catalog.with_schema(views.database_texts(t), "db_id", _dimension(t)), "generated_sql")
    found = named.withColumn("names", S.unknown_columns(F.col("_columns"), F.col("known_columns")))
    return screen.keep_where(
        found, F.size("names") > 3, "case_id", "db_id", F.size("names").cast("long").alias("n_unknown"),
        F.array_join(F.slice("names", 1, 3), ", ").alias("first_three"),
    )


@query(
    "s14_validation_row",
    f"""SELECT case_id, valid, CASE WHEN valid THEN s ELSE raw END AS formatted_sql,
  CASE WHEN valid THEN array_to_string({Q.tables('s')}, ',') ELSE '' END AS tables_referenced,
  CASE WHEN NOT valid THEN {Q.lit(S.NO_SQL_ERROR)} END AS syntax_error FROM
  (SELECT case_id, raw, s, {Q.well_formed('s')} AS valid FROM
   ({_select(f"{Q.strip('generated_sql')} AS raw, {Q.first_statement(Q.extract('generated_sql'))} AS s")}) a) b""",
)
def validation_row(t: Tables) -> DataFrame:
    """Valid flag, cleaned sql(), tables and error of each text."""
    return screen.validate(_texts(t), "generated_sql").select(
        "case_id", "valid", "formatted_sql",
        F.array_join(F.array_sort("tables_referenced"), ",").alias("tables_referenced"), "syntax_error",
    )


@query(
    "s15_prompt_length",
    f"SELECT doc_id, length(text) AS prompt_length FROM documents WHERE length(text) > {S.PROMPT_LIMIT}",
)
def prompt_length(t: Tables) -> DataFrame:
    """Prompts beyond the length limit."""
    text = F.col("text")
    return t.documents.filter(S.prompt_too_long(text)).select(
        "doc_id", F.length(text).cast("long").alias("prompt_length")
    )


_PROMPTS = views.with_views("prompts")


@query(
    "s16_prompt_injection",
    f"""SELECT * FROM ({_PROMPTS} SELECT doc_id, CASE
  {' '.join(f"WHEN regexp_matches(lower(prompt), {Q.lit(p)}) THEN {Q.lit(p)}" for p in S.INJECTION_PATTERNS)}
  END AS pattern FROM prompts) p WHERE pattern IS NOT NULL""",
)
def prompt_injection(t: Tables) -> DataFrame:
    """First injection pattern of each prompt that has one."""
    found = views.prompts(t).withColumn("pattern", S.injection_pattern(F.col("prompt")))
    return screen.keep_where(found, F.col("pattern").isNotNull(), "doc_id", "pattern")


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


@query(
    "s17_clean_prompt",
    f"""{_PROMPTS} SELECT doc_id, md5({Q.strip(f"regexp_replace(prompt, '{_CONTROL}', '', 'g')")}) AS cleaned_md5,
  length(prompt) - length({Q.strip(f"regexp_replace(prompt, '{_CONTROL}', '', 'g')")}) AS removed FROM prompts""",
)
def clean_prompt(t: Tables) -> DataFrame:
    """Prompts without control characters and outer whitespace, as a digest and the count removed."""
    cleaned = views.prompts(t).select("doc_id", "prompt", S.clean_prompt(F.col("prompt")).alias("cleaned"))
    return cleaned.select(
        "doc_id", F.md5("cleaned").alias("cleaned_md5"),
        (F.length("prompt") - F.length("cleaned")).cast("long").alias("removed"),
    )


@query(
    "s18_audit_rows",
    f"""{views.with_views('requests')} SELECT request_id, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  || '","event":"api_request","request_id":' || request_id || ',"client":' || client || ',"model":"' || model
  || '","failed":' || CASE WHEN failed THEN 'true' ELSE 'false' END || '}}' AS audit FROM requests""",
)
def audit_rows(t: Tables) -> DataFrame:
    """One JSON text per request."""
    return views.requests(t).select(
        "request_id",
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                F.lit("api_request").alias("event"), "request_id", "client", "model", "failed",
            )
        ).alias("audit"),
    )


