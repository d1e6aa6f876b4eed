"""Scores of generated SQL against gold SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.clauses import FAILURE_CATEGORIES, error_cause, failure_cause, outcome, repeated_words, unigram_bleu
from pairloom.functions.numbers import round_half_up
from pairloom.functions.text import strip, words
from pairloom.operators import stored
from pairloom.operators.percentiles import interpolated_percentiles
from pairloom.operators.screen import with_clauses, with_normalized, with_shape
from pairloom.operators.templates import put_back
from pairloom.session import parallelism, write_once

# The latency percentiles of a run.
LATENCY_POINTS = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}


def clause_features(df: DataFrame, sql: str) -> DataFrame:
    """Clause features of a SQL text column, as flat columns."""
    parsed = with_clauses(with_shape(with_normalized(df, sql, "_n"), "_n", "_f"), "_f")
    names = ("joins", "tables", "columns", "functions", "where_text", "group_text", "order_text", "limit_text")
    return parsed.select(*df.columns, *[F.col(f"_f_{n}").alias(n) for n in names])


def compare_texts(df: DataFrame, gold: str, generated: str) -> DataFrame:
    """Add both normalised texts (``_gold``, ``_own``)."""
    return with_normalized(with_normalized(df, gold, "_gold"), generated, "_own")


def parse_texts(df: DataFrame, needed: Column | None = None) -> DataFrame:
    """Add the features of both normalised texts, as far as they are needed.

    Joins and tables come first. The other clauses are only looked at where these agree
    and the texts still differ; elsewhere the cause of failure is already known.
    """
    shaped = with_shape(with_shape(df, "_gold", "_g", needed), "_own", "_o", needed)
    undecided = (
        F.col("_g_ok") & F.col("_o_ok") & (F.col("_gold") != F.col("_own"))
        & (F.col("_g_joins") == F.col("_o_joins")) & (F.col("_g_tables") == F.col("_o_tables"))
    )
    marked = shaped.withColumn("_undecided", undecided)
    return with_clauses(with_clauses(marked, "_g", F.col("_undecided")), "_o", F.col("_undecided"))


def failure_category(error: Column) -> Column:
    """Cause of a wrong answer, over a frame that went through ``parse_texts``."""
    return failure_cause(F.col("generated_sql"), error, "_g", "_o")


def compare_lifted(cases: DataFrame, causes: bool) -> DataFrame:
    """Add ``em`` to lifted cases and, with ``causes``, ``text_cause``: why the answer would be wrong by its text.

    Both follow from which literals are the same, not from the literals: pairs of texts that agree in that are compared once.
    """
    regular = F.col("_gold_regular") & F.col("_own_regular")
    # For each literal the place of the first that is the same.
    told = F.when(regular, F.col("_first")).otherwise(F.concat("_gold_params", "_own_params"))
    split = F.size("_gold_params")
    keyed = cases.withColumns(
        {
            "_regular": regular,
            "_gold_literals": F.slice(told, F.lit(1), split),
            "_own_literals": F.slice(told, split + 1, F.size("_own_params")),
        }
    )
    names = ["_gold_template", "_own_template", "_regular", "_gold_literals", "_own_literals"]
    texts = [put_back(F.col(f"_{s}_template"), F.col(f"_{s}_literals"), F.col("_regular")) for s in ("gold", "own")]
    # Few bytes, but much work a row.
    distinct = keyed.select(*names).distinct().repartition(parallelism(cases.sparkSession))
    pairs = distinct.select(*names, texts[0].alias("gold_sql"), texts[1].alias("generated_sql"))
    compared = compare_texts(pairs, "gold_sql", "generated_sql")
    found = [(F.col("_gold") == F.col("_own")).alias("em")]
    if causes:
        compared = parse_texts(compared)
        found += [failure_category(F.lit(None).cast("string")).alias("text_cause"), (strip(F.col("generated_sql")) == "").alias("_empty")]
    results = write_once(compared.select(*names, *found), "compared")
    return keyed.join(results, names).select(*cases.columns, *[c for c in results.columns if c not in names])


def score_cases(cases: DataFrame) -> DataFrame:
    """Per case and model: exact match, execution verdict, success flag, failure category.

    Cases bring ``em`` and ``text_cause`` from ``compare_lifted``, or their texts. Row-wise projections only: the texts
    are normalised once, everything else is derived from the normalised texts.
    """
    verdict = outcome(
        F.col("generated"), F.col("actual_error"), F.col("gold_error"), F.col("rows_match")
    )
    placed = cases.withColumn("_verdict", verdict)
    verdict = F.col("_verdict")
    if "em" in cases.columns:
        scored, em = placed, F.col("em")
        category = F.lit(None).cast("string")
        if "text_cause" in cases.columns:
            # What running the answer gave decides before its text does, but for an empty one.
            caused = F.coalesce(error_cause(F.col("actual_error")), "text_cause")
            category = F.when(F.col("_empty"), F.col("text_cause")).otherwise(caused)
    else:
        em = F.col("_gold") == F.col("_own")
        compared = compare_texts(placed, "gold_sql", "generated_sql")
        # A right answer has no category, and a runtime error decides it without the clauses.
        scored = parse_texts(compared, verdict.isNotNull() & F.col("actual_error").isNull())
        category = failure_category(F.col("actual_error"))
    return scored.select(
        "case_id", "model",
        em.alias("em"),
        verdict.isNull().alias("ex"),
        (F.col("generated") & F.col("actual_error").isNull()).alias("ok"),
        verdict.alias("error_type"),
        F.when(verdict.isNotNull(), category).alias("failure_category"),
        "latency_ms",
    )


def _rate(flag: Column) -> Column:
    return round_half_up(F.count_if(flag) / F.count("*"), 4)


def accuracy(items: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-match, execution, success and fail rates."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("total_samples"),
        _rate(F.col("em")).alias("exact_match_acc"),
        _rate(F.col("ex")).alias("exec_acc"),
        _rate(F.col("ok")).alias("success_rate"),
        _rate(~F.col("ok")).alias("fail_rate"),
    )


def average(value: str) -> Column:
    """Mean of a two-decimal amount: summed as decimals, so the order of rows cannot matter."""
    return F.sum(F.col(value).cast("decimal(18,4)")).cast("double") / F.count(value)


def latency_stats(items: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Average and P50/P95/P99 latency, two decimals."""
    means = items.groupBy(*keys).agg(round_half_up(average(value), 2).alias("avg_latency_ms"))
    return means.join(interpolated_percentiles(items, keys, value, LATENCY_POINTS), keys)


def _category_counts() -> Column:
    """Count of every failure category, as an array of (failure_category, failures)."""
    label = F.col("failure_category")
    return F.array(
        *[
            F.struct(F.lit(c).alias("failure_category"), F.count_if(label == c).alias("failures"))
            for c in FAILURE_CATEGORIES
        ]
    )


def failure_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Failures per category and their share of all failures in percent.

    The dozen categories are counted side by side in one aggregate.
    """
    counted = items.groupBy(*keys).agg(_category_counts().alias("_counts"), F.count("failure_category").alias("_all"))
    listed = counted.select(*keys, "_all", F.inline("_counts")).filter(F.col("failures") > 0)
    return listed.withColumn("share_pct", round_half_up(F.col("failures") * 100 / F.col("_all"), 1)).drop("_all")


def run_row(items: DataFrame) -> DataFrame:
    """One row for a benchmark run: every rate and latency of both sides, and failure counts."""
    rates = accuracy(items, ["model"]).join(latency_stats(items, ["model"]), "model")
    failures = items.groupBy("model").agg(
        F.map_from_entries(F.filter(_category_counts(), lambda e: e["failures"] > 0)).alias("failure_counts")
    )
    per_model = rates.join(failures, "model")
    measures = [c for c in rates.columns if c not in ("model", "total_samples")]
    return per_model.agg(
        F.max("total_samples").alias("total_samples"),
        *[
            F.max(F.when(F.col("model") == side, F.col(m))).alias(f"{side}_{m}")
            for side in ("base", "tuned")
            for m in measures
        ],
        F.any_value(F.when(F.col("model") == "tuned", F.col("failure_counts")), True).alias("failure_counts"),
    )


def lift(items: DataFrame) -> DataFrame:
    """Gain of the tuned side: accuracy points and latency reduction in percent."""

    def side(name: str, flag: str) -> Column:
        return F.count_if((F.col("model") == name) & F.col(flag))

    def latency(name: str) -> Column:
        cents = F.col("latency_ms").cast("decimal(18,4)")
        return F.sum(F.when(F.col("model") == name, cents)).cast("double")

    n = F.count_if(F.col("model") == "base")
    return items.agg(
        round_half_up((side("tuned", "em") - side("base", "em")) * 100 / n, 1).alias("exact_match_lift"),
        round_half_up((side("tuned", "ex") - side("base", "ex")) * 100 / n, 1).alias("execution_acc_lift"),
        round_half_up((1 - latency("tuned") / latency("base")) * 100, 1).alias("latency_reduction_pct"),
    )


def side_by_side(items: DataFrame) -> DataFrame:
    """Detail rows with both model sides in one row per case (grouped, not joined)."""

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == side, F.col(column))).alias(f"{side}_{column}")

    return items.groupBy("case_id").agg(
        *[of(side, c) for side in ("base", "tuned") for c in ("em", "ex", "latency_ms", "error_type")],
        F.max(F.when(F.col("model") == "tuned", F.col("failure_category"))).alias("failure_category"),
    )


def bleu_scores(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Add ``bleu``; both texts are split into words once."""
    split = df.withColumns(
        {"_ref": words(F.lower(F.col(reference))), "_cand": F.sort_array(words(F.lower(F.col(candidate))))}
    ).withColumn("_repeated", repeated_words(F.col("_cand")))
    score = unigram_bleu(F.col("_ref"), F.col("_cand"), F.col("_repeated"))
    return split.withColumn("bleu", score).drop("_ref", "_cand", "_repeated")


def append_history(run: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append a run row to the history table, once however often it is tried, and return the whole history."""
    stored.append(run, path, run_id)
    return stored.read(run.sparkSession, path, run.schema)
