"""Running very many SQL texts as few jobs.

Texts that differ in literals only are one template. The literals are lifted out, the texts are
grouped by what is left, and each template runs once, joined laterally with the table of its
parameters: Catalyst turns that into joins and groupings over the parameters, so a thousand
questions about one customer each are one grouped scan. A template is screened, and parsed, once. What fails
while parameters are applied is found by halving the table of parameters.

Cases keep template and literals in place of their texts: what only asks how a text is built - the SQL in an answer,
the comparison of two texts - is worked out once for texts that differ in literals only (``put_back``).
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions.clauses import outcome
from pairloom.functions.screening import fenced_or_whole
from pairloom.functions.text import strip, strip_fences
from pairloom.operators.results import asks_for_order, digests
from pairloom.operators.screen import judge, validate
from pairloom.operators.suite import FAILURES, failure_type
from pairloom.session import parallelism, scratch_path, write_once

# Strings, and numbers that a value is compared with. Ordinals and limits stay in the template. No place is tried where
# neither can begin, and nothing is tried twice.
_STRING = r"[^']*+'(?:'[^']*+')*+"
_LITERAL = rf"['=<>](?:(?<='){_STRING}|(?<=[=<>])\s{{0,3}}\d+(?:\.\d+)?(?![\w.]))"
# What marks a lifted text, whole and decimal number.
_MARKS = {"\x01": "string", "\x02": "bigint", "\x03": "double"}
# Texts with comments, quoted names, typed literals or marks of their own run as they are; so do those with words
# that are screened inside literals too. The first pattern is for literals, the second for the marked text around them.
_AS_IT_IS_AROUND = r"""--|/\*|["`\\]|(?i:\b(?:date|timestamp|interval|as)\s*['\x01])"""
_AS_IT_IS = f"{_AS_IT_IS_AROUND}|(?i:pragma|attach|detach)"
# Templates whose literals may not stand for any other: a quote is left open, or stands before the first SELECT (what
# is cut off there may hold half a literal), an odd character, or a number that was not lifted for the blanks before it.
_ODD = r"(?is)'|[^\x01-\x03\t\n\r -~]|[=<>]\s{4,}\d|\A(?![^\x01]*\b(?:select|with)\b)[^\x01]*\x01"

# Templates that run at the same time.
AT_A_TIME = 6

_RESULT = "text_id long, pos int, values array<string>"


def _marked(texts: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``template`` and ``params`` of each text by itself, and ``told``: nothing in its literals asks to run it as it is."""
    literals, template, params, told = (F.col(f"{prefix}{name}") for name in ("literals", "template", "params", "told"))
    none = F.array().cast("array<string>")
    # Without a doubled or open quote, every other piece between quotes is a literal.
    halves = F.length(text) - F.length(F.replace(F.col(text), F.lit("'")))
    simple = (halves % 2 == 0) & ~F.contains(F.col(text), F.lit("''"))
    outside = F.array_join(F.filter(F.split(text, "'"), lambda _, i: i % 2 == 0), "\x01")
    marked = F.when(halves == 0, F.col(text)).when(simple, outside).otherwise(F.regexp_replace(text, f"'{_STRING}", "\x01"))
    numbers = F.regexp_replace(marked, r"([=<>]\s{0,3}+)\d++(?![\w.])", "$1\x02")
    decimals = F.regexp_replace(marked, r"([=<>]\s{0,3}+)\d+\.\d+(?![\w.])", "$1\x03")
    both = F.regexp_replace(decimals, r"([=<>]\s{0,3}+)\d++(?![\w.])", "$1\x02")

    def value(literal: Column) -> Column:
        inner = F.replace(F.substr(literal, F.lit(2), F.length(literal) - 2), F.lit("''"), F.lit("'"))
        return F.when(F.startswith(literal, F.lit("'")), inner).otherwise(F.ltrim(literal, F.lit("=<> \t\n\x0b\f\r")))

    found = texts.withColumn(f"{prefix}literals", F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0)))
    listed = found.withColumn(f"{prefix}listed", F.array_join(literals, "\n"))
    listing, marks = F.col(f"{prefix}listed"), [~F.contains(F.col(text), F.lit(mark)) for mark in _MARKS]
    judged = listed.withColumn(f"{prefix}told", ~listing.rlike(_AS_IT_IS) & marks[0] & marks[1] & marks[2])
    return judged.withColumns(
        {
            f"{prefix}template": F.when(~told, F.col(text)).when(F.contains(listing, F.lit(".")), both).otherwise(numbers),
            f"{prefix}params": F.when(told, F.transform(literals, value)).otherwise(none),
        }
    ).drop(f"{prefix}literals", f"{prefix}listed")


def lifted(texts: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add ``template`` and ``params``: the text with its literals marked, and these in order."""
    told, template, params = (F.col(f"{prefix}{name}") for name in ("told", "template", "params"))
    plain = told & ~template.rlike(_AS_IT_IS_AROUND)
    marked = _marked(texts, text, prefix).withColumn(f"{prefix}told", plain)
    return marked.withColumns(
        {
            f"{prefix}template": F.when(told, template).otherwise(F.col(text)),
            f"{prefix}params": F.when(told, params).otherwise(F.array().cast("array<string>")),
        }
    ).drop(f"{prefix}told")


def put_back(template: Column, literals: Column, regular: Column) -> Column:
    """The text of a template: with its literals or, where it is regular, with one of the literal's number for each."""
    pieces = F.split(template, "[\x01-\x03]")

    def put(mark: Column, at: Column) -> Column:
        literal = F.get(literals, at)
        written = (
            F.when((mark == "\x01") & regular, F.concat(F.lit("'v"), literal, F.lit("'")))
            .when(mark == "\x01", F.concat(F.lit("'"), F.replace(literal, F.lit("'"), F.lit("''")), F.lit("'")))
            .when((mark == "\x03") & regular, F.concat(literal, F.lit(".5")))
            .otherwise(literal)
        )
        return F.concat(written, F.get(pieces, at + 1))

    marks = F.regexp_extract_all(template, F.lit("([\x01-\x03])"), F.lit(1))
    filled = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(marks, put), ""))
    return F.when(F.size(literals) > 0, filled).otherwise(template)


def _written(mark: str, literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'" if _MARKS[mark] == "string" else literal


@dataclass
class _Template:
    nr: int
    text: str
    instance: str = ""
    allowed: bool = False
    error: str | None = None
    # Parameters that have one value in all texts.
    fixed: dict[int, str] = field(default_factory=dict)

    def kinds(self) -> list[str]:
        return [_MARKS[c] for c in self.text if c in _MARKS]

    def instance_of(self, literals: list[str]) -> str:
        """The text with these literals."""
        if not literals:
            return self.text
        own = iter(literals)
        return re.sub("[\x01-\x03]", lambda mark: _written(mark[0], next(own)), self.text)

    def body(self) -> str:
        """The text with columns of the parameter table, or fixed literals, for its marks."""
        parts = iter(range(len(self.kinds())))

        def put(mark: re.Match) -> str:
            at = next(parts)
            if at not in self.fixed:
                return f"p.v{at}"
            return _written(mark[0], self.fixed[at])

        return re.sub("[\x01-\x03]", put, self.text)


def _numbers(spark: SparkSession, templates: DataFrame) -> tuple[list[_Template], DataFrame]:
    """The templates of a column, numbered, and as a table (``known``, ``nr``). There is a row, and later a job, for each."""
    names = sorted(r[0] for r in templates.distinct().collect())
    found = [_Template(nr, name) for nr, name in enumerate(names)]
    return found, spark.createDataFrame([(t.text, t.nr) for t in found], "known string, nr int")


def _screen(found: list[_Template], numbered: DataFrame, tables: list[str], columns: list[str]) -> None:
    """Screen an instance of each template of (``nr``, ``params``), and find the parameters that are the same in all."""
    for row in numbered.groupBy("nr").agg(F.min("params").alias("least")).collect():
        found[row["nr"]].instance = found[row["nr"]].instance_of(row["least"])
    groups = numbered.sparkSession.createDataFrame([(t.nr, t.instance) for t in found], "nr int, instance string")
    known = [F.array(*[F.lit(n) for n in names]) for names in (tables, columns)]
    judged = judge(groups, "instance", *known)
    message = F.concat(F.lit("SQL Safety Violation: "), "reason", F.lit(" ("), F.array_join("violations", "; "), F.lit(")"))
    for row in judged.select("nr", "allowed", F.when(~F.col("allowed"), message).alias("error")).collect():
        found[row["nr"]].allowed, found[row["nr"]].error = row["allowed"], row["error"]
    places = numbered.select("nr", F.posexplode("params").alias("at", "value")).groupBy("nr", "at")
    ends = places.agg(F.min("value").alias("low"), F.max("value").alias("high")).filter(F.col("low") == F.col("high"))
    for row in ends.collect():
        found[row["nr"]].fixed[row["at"]] = row["low"]


def _message(error: Exception) -> str:
    kind = failure_type(error)
    condition = (error.getCondition() or "unknown") if isinstance(error, PySparkException) else "job failed"
    return {
        "SyntaxError": "SQL Syntax Error: ",
        "TableNotFound": "Execution Error: no such table: ",
        "ColumnNotFound": "Execution Error: no such column: ",
    }.get(kind, "Execution Error: ") + condition


@dataclass
class Executed:
    """Rows of the texts that ran (``text_id``, ``pos``, ``values``), and all texts (``text_id``, ``nr``, ``params``) with their ``error``."""

    rows: DataFrame
    texts: DataFrame
    jobs: int

    @property
    def errors(self) -> DataFrame:
        """``text_id`` and ``error`` of the texts that did not run."""
        return self.texts.filter(F.col("error").isNotNull()).select("text_id", "error")


def run_texts(texts: DataFrame, tables: list[str], columns: list[str]) -> Executed:
    """Run every text of (``text_id``, ``text``) whose template may run.

    Positions count in the order of the text's own result where it asks for one, else in the order of the values.
    """
    cut = write_once(lifted(texts, "text").select("text_id", "template", "params"), "lifted")
    found, numbers = _numbers(texts.sparkSession, cut.select("template"))
    numbered = cut.join(numbers, F.col("template") == F.col("known")).select("text_id", "nr", "params")
    return _run_numbered(numbered, found, tables, columns)


def _run_numbered(numbered: DataFrame, templates: list[_Template], tables: list[str], columns: list[str]) -> Executed:
    """Run the texts of (``text_id``, ``nr``, ``params``), by the numbers of their templates."""
    spark = numbered.sparkSession
    path = scratch_path(spark, "templates")
    numbered.write.partitionBy("nr").parquet(path)
    stored = spark.read.schema("text_id long, params array<string>, nr int").parquet(path) if templates else numbered
    _screen(templates, stored, tables, columns)

    paths: list[str] = []
    failed: list[tuple[int, int | None, str]] = [(t.nr, None, t.error) for t in templates if not t.allowed]

    def run(template: _Template) -> int:
        try:
            width = len(spark.sql(template.instance).columns)
        except FAILURES as error:
            failed.append((template.nr, None, _message(error)))
            return 0
        return _run(stored.filter(F.col("nr") == template.nr), template, width, paths, failed)

    # Most templates are small jobs: several at a time keep the cluster busy.
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        jobs = sum(pool.map(run, [t for t in templates if t.allowed]))
    whole = {nr: message for nr, text_id, message in failed if text_id is None}
    single = [(text_id, message) for _, text_id, message in failed if text_id is not None]
    by_template = spark.createDataFrame(list(whole.items()), "failed_nr int, failure string")
    by_text = spark.createDataFrame(single, "failed_id long, own_failure string")
    texts = stored.join(F.broadcast(by_template), F.col("nr") == F.col("failed_nr"), "left").join(
        by_text, F.col("text_id") == F.col("failed_id"), "left"
    ).select("text_id", "nr", "params", F.coalesce("failure", "own_failure").alias("error"))
    rows = spark.read.schema(_RESULT).parquet(*paths) if paths else spark.createDataFrame([], _RESULT)
    return Executed(rows, texts, jobs)


def _run(params: DataFrame, template: _Template, width: int, paths: list[str], failed: list) -> int:
    """Run a template over its parameters; where that fails, over each half. Returns the number of jobs."""
    path = scratch_path(params.sparkSession, "results")
    try:
        _applied(params, template, width).write.parquet(path)
        paths.append(path)
        return 1
    except FAILURES as error:
        ends = params.agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).first()
        if ends["low"] == ends["high"]:
            failed.append((template.nr, ends["low"], _message(error)))
            return 1
        middle = (ends["low"] + ends["high"]) // 2
        halves = (params.filter(F.col("text_id") <= middle), params.filter(F.col("text_id") > middle))
        return 1 + sum(_run(half, template, width, paths, failed) for half in halves)


def _applied(params: DataFrame, template: _Template, width: int) -> DataFrame:
    spark = params.sparkSession
    values = [
        F.col("params")[at].cast(kind).alias(f"v{at}") for at, kind in enumerate(template.kinds()) if at not in template.fixed
    ]
    view = f"params_{uuid.uuid4().hex}"
    params.select("text_id", *values).createOrReplaceTempView(view)
    names = [f"c{i}" for i in range(width)]
    cells = f"array({', '.join(f'CAST(q.{n} AS STRING)' for n in names)})"
    body = template.body().strip().rstrip(";")
    ordered = re.search(r"(?is)\border\s+by\b(?!.*\blimit\b)", body)
    if ordered:
        # A limit that cuts nothing: the rows of a parameter are then numbered, and kept, in order.
        body += " LIMIT 2147483647"
    source = f"({body}) AS q({', '.join(names)})"
    try:
        if re.search(r"(?i)\border\s+by\b", body):
            return spark.sql(
                f"SELECT p.text_id, posexplode(r.all_rows) AS (pos, values) FROM {view} p, "
                f"LATERAL (SELECT collect_list({cells}) AS all_rows FROM {source}) r"
            )
        rows = spark.sql(f"SELECT p.text_id, r.values FROM {view} p, LATERAL (SELECT {cells} AS values FROM {source}) r")
        place = F.row_number().over(W.partitionBy("text_id").orderBy("values"))
        return rows.select("text_id", (place - 1).alias("pos"), "values")
    finally:
        spark.catalog.dropTempView(view)


def _checked(cases: DataFrame, output: str) -> DataFrame:
    """Cases with the SQL found in the model's output (``formatted_sql``), written once."""
    checked = validate(cases, output).drop("valid", "tables_referenced", "syntax_error")
    return write_once(checked.withColumn("_blank", F.trim(F.col(output)) == ""), "cases")


def _distinct(both: DataFrame) -> DataFrame:
    """Each text that is not blank, once, with a number."""
    distinct = both.filter(F.col("text").isNotNull() & (F.trim("text") != "")).distinct()
    return write_once(distinct.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def failed_cases(cases: DataFrame, output: str, tables: list[str], columns: list[str]) -> DataFrame:
    """The cases whose SQL in ``output`` does not run, with ``actual_error``: what ``execute_cases`` finds, without gold and results."""
    checked = _checked(cases, output)
    texts = _distinct(checked.select(F.col("formatted_sql").alias("text")))
    failed = texts.join(run_texts(texts, tables, columns).errors, "text_id").select("text", F.col("error").alias("actual_error"))
    return checked.join(failed, F.col("formatted_sql") == F.col("text")).select(*cases.columns, "actual_error")


def lift_cases(cases: DataFrame, gold: str, output: str, *keep: str, compare: bool = True) -> DataFrame:
    """Columns ``keep`` of the cases, with template and literals of both texts in place of the texts.

    ``_gold_`` and ``_own_`` stand before ``template``, ``params`` and ``regular``: patterns over the text see the same
    whatever its literals are. With ``compare``, ``_first`` has for each literal of both the place of the first that is the
    same. Of an answer that is one fenced block the inside is lifted, and ``_whole`` is what runs if that is no SQL.
    """
    answer = F.coalesce(F.col(output), F.lit(""))
    fenced = cases.withColumns({"_gold_text": F.coalesce(F.col(gold), F.lit("")), "_fenced": F.contains(answer, F.lit("```"))}).withColumn(
        "_inside", F.when(F.col("_fenced"), strip_fences(answer))
    )
    # The same inside for whoever drops fences and whoever looks for a block.
    block = (F.col("_inside") != "") & ~F.contains(F.col("_inside"), F.lit("`")) & (fenced_or_whole(answer) == F.col("_inside"))
    told = fenced.withColumn("_block", F.when(F.col("_fenced"), block).otherwise(F.lit(False))).withColumns(
        {"_own_text": F.when(F.col("_block"), F.col("_inside")).otherwise(answer), "_whole": F.when(F.col("_block"), strip(answer))}
    )
    flags = told.withColumns({"_ordered": asks_for_order(F.col(gold)), "_blank": F.trim(F.col(output)) == ""})
    marked = _marked(_marked(flags, "_gold_text", "_gold_"), "_own_text", "_own_")
    for side in ("gold", "own"):
        marked = marked.withColumn(f"_{side}_plain", F.octet_length(f"_{side}_text") == F.length(f"_{side}_text"))
    # Case does not count where texts are compared.
    lowered = marked.withColumn("_lowered", F.split(F.lower(F.array_join(F.concat("_gold_params", "_own_params"), "\x01")), "\x01"))
    first = F.transform("_lowered", lambda v: F.array_position("_lowered", v).cast("string"))
    names = [f"_{side}_{name}" for side in ("gold", "own") for name in ("template", "params", "told", "plain")]
    firsts = [first.alias("_first")] if compare else []
    written = write_once(lowered.select(*keep, "_ordered", "_blank", "_whole", *names, *firsts), "cases")
    # What asks for a look at the text around the literals is asked once a template.
    sides = [written.select(F.col(f"_{s}_template").alias("template"), F.col(f"_{s}_told").alias("told")) for s in ("gold", "own")]
    template, told = F.col("template"), F.col("told")
    kinds = sides[0].union(sides[1]).distinct().withColumn("lifts", told & ~template.rlike(_AS_IT_IS_AROUND))
    kinds = write_once(kinds.withColumn("fits", F.col("lifts") & ~template.rlike(_ODD)), "kinds")
    for side in ("gold", "own"):
        named = kinds.select(*[F.col(c).alias(f"_{side}_kind_{c}") for c in kinds.columns])
        same = (F.col(f"_{side}_template") == F.col(f"_{side}_kind_template")) & (F.col(f"_{side}_told") == F.col(f"_{side}_kind_told"))
        written = written.join(named, same)
    for side in ("gold", "own"):
        template, params, lifts = F.col(f"_{side}_template"), F.col(f"_{side}_params"), F.col(f"_{side}_kind_lifts")
        whole, none = put_back(template, params, F.lit(False)), F.array().cast("array<string>")
        written = written.withColumns(
            {
                f"_{side}_template": F.when(lifts, template).otherwise(whole),
                f"_{side}_params": F.when(lifts, params).otherwise(none),
                f"_{side}_regular": F.col(f"_{side}_kind_fits") & F.col(f"_{side}_plain"),
            }
        )
    names = [f"_{side}_{name}" for side in ("gold", "own") for name in ("template", "params", "regular")]
    return written.select(*keep, "_ordered", "_blank", "_whole", *names, *(["_first"] if compare else []))


def _answers(cases: DataFrame) -> DataFrame:
    """The SQL in the answers of lifted cases, looked for once a template: ``ran_template`` and ``ran_params``.

    Of a regular text ``places`` says which of its own literals these are, unless they are all of them in order.
    """
    texts = cases.select("_own_template", "_own_regular", _own_literals().alias("_own_literals")).distinct()
    # Few bytes, but much work a row.
    texts, names = texts.repartition(parallelism(cases.sparkSession)), texts.columns
    # Any literals will do for a regular text: their numbers, by which they are found again.
    marks = F.length(F.regexp_replace("_own_template", "[^\x01-\x03]", ""))
    numbers = F.slice(F.transform(F.sequence(F.lit(0), marks), lambda n: n.cast("string")), F.lit(2), marks)
    literals = F.when(F.col("_own_regular"), numbers).otherwise(F.col("_own_literals"))
    found = texts.withColumn("_given", literals).withColumn("_text", put_back(F.col("_own_template"), F.col("_given"), F.col("_own_regular")))
    cut = lifted(validate(found.drop("_given"), "_text"), "formatted_sql", "ran_").withColumn("given", numbers.cast("array<int>"))
    places = F.transform("ran_params", lambda p: F.regexp_extract(p, "([0-9]+)", 1).cast("int"))
    moved = F.when(F.col("_own_regular") & (places != F.col("given")), places)
    return write_once(cut.select(*names, "valid", "ran_template", "ran_params", moved.alias("places")), "answers")


def _own_literals() -> Column:
    """What tells answers of one template apart: nothing where they are regular."""
    return F.when(F.col("_own_regular"), F.array().cast("array<string>")).otherwise(F.col("_own_params"))


def answered(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lifted cases with the SQL of the answer in place of the answer, and every ``template`` to run."""
    answers, names = _answers(cases), ["_own_template", "_own_regular", "_own_literals"]
    keyed = cases.withColumn("_own_literals", _own_literals())
    # A block without SQL runs as the whole answer.
    whole, none = F.col("_whole").isNotNull() & ~F.col("valid"), F.array().cast("array<string>")
    picked = F.transform("places", lambda n: F.get("_own_params", n - 1))
    own = F.when(F.col("places").isNotNull(), picked).when(F.col("_own_regular"), F.col("_own_params")).otherwise(F.col("ran_params"))
    placed = keyed.join(answers, names).withColumns(
        {
            "_own_template": F.when(whole, F.col("_whole")).otherwise(F.col("ran_template")),
            "_own_params": F.when(whole, none).otherwise(own),
        }
    )
    unread = keyed.filter(F.col("_whole").isNotNull()).join(answers, names).filter(whole).select("_whole")
    return placed, cases.select("_gold_template").union(answers.select("ran_template")).union(unread).toDF("template")


def execute_cases(cases: DataFrame, gold: str, output: str, tables: list[str], columns: list[str]) -> DataFrame:
    """Add ``generated``, ``gold_error``, ``actual_error`` and ``rows_match`` by running both texts of each case."""
    return execute_lifted(lift_cases(cases, gold, output, *cases.columns, compare=False), cases.columns, tables, columns)


def execute_lifted(cases: DataFrame, keep: list[str], tables: list[str], columns: list[str]) -> DataFrame:
    """Columns ``keep`` of lifted cases and what running both texts gave.

    SQL is taken out of the model's output first. Both texts are screened; a text that may not run has
    the violation as its error. Each distinct text - a template and its literals - runs once, and its result is read once, into
    digests that are compared: a result that very many texts are compared with costs no more than any other.
    """
    placed, found = answered(cases)
    templates, numbers = _numbers(cases.sparkSession, found.filter(F.trim("template") != ""))
    for name in ("gold", "own"):
        number = numbers.select(F.col("known").alias(f"_{name}_known"), F.col("nr").alias(f"_{name}_nr"))
        placed = placed.join(number, F.col(f"_{name}_template") == F.col(f"_{name}_known"), "left")
    placed = write_once(placed.select(*keep, "_ordered", "_blank", "_gold_nr", "_gold_params", "_own_nr", "_own_params"), "numbered")
    both = [placed.select(F.col(f"_{name}_nr").alias("nr"), F.col(f"_{name}_params").alias("params")) for name in ("gold", "own")]
    distinct = both[0].union(both[1]).filter(F.col("nr").isNotNull()).distinct()
    done = _run_numbered(distinct.withColumn("text_id", F.monotonically_increasing_id()), templates, tables, columns)
    # Digests of the kinds that a comparison asks for.
    asked = {bool(r["_ordered"]) for r in placed.select("_ordered").distinct().collect()}
    wanted = [name for name, ordered in (("bag", False), ("list", True)) if ordered in asked]
    known = done.texts.join(digests(done.rows).select("text_id", *wanted), "text_id", "left")
    known = write_once(known.withColumn("place", F.xxhash64("nr", "params")), "known")

    joined = placed
    for name in ("gold", "own"):
        result = known.select(*[F.col(c).alias(f"{name}_known_{c}") for c in known.columns])
        # The hash comes first: it decides nearly every comparison.
        same = (
            (F.xxhash64(f"_{name}_nr", f"_{name}_params") == F.col(f"{name}_known_place")) & (F.col(f"_{name}_nr") == F.col(f"{name}_known_nr"))
            & (F.col(f"_{name}_params") == F.col(f"{name}_known_params"))
        )
        joined = joined.join(result, same, "left")
    gold_error, own_error = F.col("gold_known_error"), F.col("own_known_error")
    ran = gold_error.isNull() & own_error.isNull() & F.col("gold_known_text_id").isNotNull() & F.col("own_known_text_id").isNotNull()
    match = F.lit(None).cast("boolean")
    for name in wanted:
        equal = F.col(f"gold_known_{name}").eqNullSafe(F.col(f"own_known_{name}"))
        match = F.when(F.coalesce("_ordered", F.lit(False)) == F.lit(name == "list"), equal).otherwise(match)
    return joined.select(
        *keep,
        (~F.coalesce("_blank", F.lit(True))).alias("generated"),
        gold_error.alias("gold_error"),
        own_error.alias("actual_error"),
        F.when(ran, match).otherwise(F.lit(False)).alias("rows_match"),
    )


def verdict() -> Column:
    """Execution verdict over the columns that ``execute_cases`` adds."""
    return outcome(F.col("generated"), F.col("actual_error"), F.col("gold_error"), F.col("rows_match"))
