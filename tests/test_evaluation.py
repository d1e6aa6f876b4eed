import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, results, suite
from pairloom.operators.percentiles import interpolated_percentiles

JOINED = (
    "SELECT singer_id, name FROM singer JOIN concert ON singer.id = concert.id "
    "WHERE age > 25 ORDER BY age DESC LIMIT 5;"
)
SINGLE = "SELECT singer_id, name FROM singer WHERE age > 25 ORDER BY age DESC LIMIT 5;"
GROUPED = "SELECT name, SUM(age) FROM singer WHERE country = 'x order by y' GROUP BY name"

FAILURES = [
    (JOINED, SINGLE, "missing JOIN"),
    (JOINED, JOINED.replace("concert.id", "concert.cid"), "incorrect JOIN"),
    (SINGLE, JOINED, "incorrect JOIN"),
    (SINGLE, SINGLE.replace("FROM singer", "FROM wrong_table"), "wrong table"),
    (SINGLE, "SELECT wrong_col FROM singer WHERE age > 25 ORDER BY age DESC LIMIT 5;", "wrong column"),
    (GROUPED, GROUPED.replace("SUM", "AVG"), "incorrect aggregation"),
    (SINGLE, SINGLE.replace("> 25", "> 50"), "incorrect WHERE/filter"),
    (GROUPED, GROUPED.replace("x order", "z order"), "incorrect WHERE/filter"),
    (GROUPED, GROUPED.replace("BY name", "BY name, country"), "incorrect GROUP BY"),
    (SINGLE, SINGLE.replace("age DESC", "age ASC"), "incorrect ORDER BY"),
    (SINGLE, SINGLE.replace("LIMIT 5", "LIMIT 100"), "incorrect LIMIT"),
    (SINGLE, "SELECT FROM WHERE ;;;", "syntax error"),
    (SINGLE, "  ", "syntax error"),
    (SINGLE, SINGLE.replace("singer_id, name", "name, singer_id"), "wrong result set"),
]


def test_failure_labels(spark):
    frame = spark.createDataFrame(
        [(i, g, o) for i, (g, o, _) in enumerate(FAILURES)], "i int, gold_sql string, generated_sql string"
    )
    parsed = evaluate.parse_texts(evaluate.compare_texts(frame, "gold_sql", "generated_sql"))
    rows = parsed.select("i", evaluate.failure_category(F.lit(None).cast("string")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: label for i, (_, _, label) in enumerate(FAILURES)}


def test_exact_match(spark):
    gold = "SELECT singer_id, name FROM singer WHERE age > 25 ORDER BY age DESC;"
    same = [
        "   select singer_id, name  from  singer  where  age > 25  order by age desc  ",
        "```sql\nSELECT singer_id,name FROM singer WHERE age>25 ORDER BY age DESC\n```",
    ]
    other = [gold.replace("25", "30"), "", gold.replace("singer_id, name", "name")]
    frame = spark.createDataFrame([(gold, s) for s in same + other], "g string, o string")
    rows = evaluate.compare_texts(frame, "g", "o").select((F.col("_gold") == F.col("_own")).alias("em")).collect()
    assert [r["em"] for r in rows] == [True] * 2 + [False] * 3


def test_outcomes(spark):
    rows = [
        (1, False, None, None, True, "GenerationFailed"),
        (2, True, "SQL Syntax Error: near x", "boom", True, "SyntaxError"),
        (3, True, "no such table: t", None, True, "TableNotFound"),
        (4, True, "No such column: c", None, True, "ColumnNotFound"),
        (5, True, "blocked", None, True, "ExecutionError"),
        (6, True, None, "no such column: salary", True, "GroundTruthExecutionError"),
        (7, True, None, None, False, "ResultMismatch"),
        (8, True, None, None, True, None),
    ]
    cases = spark.createDataFrame(
        [(i, "m", SINGLE, SINGLE, gold, err, gen, match, 1.0) for i, gen, err, gold, match, _ in rows],
        "case_id long, model string, gold_sql string, generated_sql string, gold_error string, "
        "actual_error string, generated boolean, rows_match boolean, latency_ms double",
    )
    scored = {r["case_id"]: r for r in evaluate.score_cases(cases).collect()}
    for i, gen, err, _, _, want in rows:
        assert scored[i]["error_type"] == want and scored[i]["ex"] == (want is None)
        assert scored[i]["ok"] == (gen and err is None)
    assert scored[3]["failure_category"] == "wrong table" and scored[5]["failure_category"] == "execution error"
    assert scored[7]["failure_category"] == "wrong result set" and scored[8]["failure_category"] is None


def _compare(spark, gold, generated, ordered, **options):
    rows = [(1, side, pos, ordered, values) for side, table in (("gold", gold), ("generated", generated))
            for pos, values in enumerate(table)]
    frame = spark.createDataFrame(rows, "case_id long, side string, pos long, ordered boolean, values array<string>")
    return results.compare_results(frame, **options).first()["rows_match"]


def test_result_comparison(spark):
    a, b, n = ["1", " x "], ["2.00004", "y"], [None, "z"]
    assert _compare(spark, [a, b, n], [["1.0", "x"], ["2", "y"], [None, "z"]], True)
    assert not _compare(spark, [a, b], [b, a], True)
    assert _compare(spark, [a, b, a], [b, a, a], False)
    assert not _compare(spark, [a, b, a], [b, a, b], False)
    assert not _compare(spark, [a], [a, a], False)
    assert not _compare(spark, [n], [["", "z"]], False)
    assert _compare(spark, [["9007199254740993"]], [["9007199254740993.0"]], False)
    assert not _compare(spark, [["9007199254740993"]], [["9007199254740992"]], False)
    assert not _compare(spark, [["1_000"]], [["1000"]], False)
    assert not _compare(spark, [[str(i)] for i in range(60)], [[str(i)] for i in range(50)], True)


def test_two_empty_results_match(spark):
    rows = spark.createDataFrame([(1, "gold", 0, False, ["a"])], "case_id long, side string, pos long, ordered boolean, values array<string>")
    cases = spark.createDataFrame([(1, False), (2, True)], "case_id long, ordered boolean")
    got = {r["case_id"]: (r["rows_match"], r["rows_compared"]) for r in results.compare_results(rows, cases).collect()}
    assert got == {1: (False, 1), 2: (True, 0)}


def test_gold_text_asks_for_order(spark):
    frame = spark.createDataFrame([("SELECT a FROM t ORDER BY a",), ("SELECT a FROM t",)], "g string")
    assert [r[0] for r in frame.select(results.asks_for_order(frame["g"])).collect()] == [True, False]


def test_percentiles_of_close_values_and_nan(spark):
    frame = spark.range(200_000).selectExpr("'m' model", "100 + id / 1e6 AS v").unionByName(
        spark.createDataFrame([("m", float("nan")), ("m", None), (None, 1.0), (None, 3.0)], "model string, v double")
    )
    got = {r["model"]: (r["a"], r["z"]) for r in interpolated_percentiles(frame, ["model"], "v", {"a": 0.5, "z": 1.0}).collect()}
    assert got["m"][0] == 100.1 and got["m"][1] != got["m"][1]
    assert got[None] == (2.0, 3.0)


@pytest.mark.parametrize(
    "values,want",
    [
        ([10.0, 20.0, 30.0, 40.0, 50.0], (30.0, 48.0, 49.6)),
        ([10.0 * i for i in range(1, 11)], (55.0, 95.5, 99.1)),
        ([7.0], (7.0, 7.0, 7.0)),
        ([5.0] * 1000 + [1.0, 9.0], (5.0, 5.0, 5.0)),
        ([-3.0, -2.0, 0.0, 1.5], (-1.0, 1.28, 1.46)),
    ],
)
def test_percentiles(spark, values, want):
    frame = spark.createDataFrame([("m", v) for v in values], "model string, v double")
    got = interpolated_percentiles(frame, ["model"], "v", {"a": 0.5, "b": 0.95, "c": 0.99}).first()
    assert (got["a"], got["b"], got["c"]) == want


def test_words_of_plain_and_other_texts(spark):
    """Words are Python's, and texts of single-byte characters are not translated character by character."""
    from pairloom.functions.text import WHITESPACE, words

    texts = [None, "", " ", "a", " a  b ", "SELECT x\tFROM\n\r y\x0b;", "\x1c\x1d\x1e\x1f a\x1cb\x1f", "a\x00b \x7f c", "é b\xa0c", "\u3000", "日本 語\u2003x"]
    texts += [f"{c}a{c}{c}b{c}" for c in WHITESPACE] + [f"é{c}{c}b{c}" for c in WHITESPACE]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    split = frame.select("id", words(F.col("text")).alias("words"))
    got = {r["id"]: r["words"] for r in split.collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else t.split() for t in texts]
    assert "octet_length" in split._jdf.queryExecution().optimizedPlan().toString()


def test_bleu(spark):
    pairs = [
        ("SELECT a FROM t", "select a from t", 1.0),
        ("select a a b", "select a a a", 0.75),
        ("a b c d", "a b", round(math.exp(1 - 4 / 2), 4)),
        ("a b", "", 0.0),
        ("", "a", 0.0),
        ("x y", "p q r", 0.0),
        ("a a a b b", "a a b b b c", round(4 / 6, 4)),
    ]
    frame = spark.createDataFrame([(r, c) for r, c, _ in pairs], "r string, c string")
    assert [row["bleu"] for row in evaluate.bleu_scores(frame, "r", "c").collect()] == [w for _, _, w in pairs]


def test_rates_and_shares(spark):
    items = spark.createDataFrame(
        [(i, "tuned", i % 2 == 0, i % 4 == 0, i != 3, "wrong table" if i % 4 else None, 10.0 * i) for i in range(8)],
        "case_id long, model string, em boolean, ex boolean, ok boolean, failure_category string, latency_ms double",
    )
    row = evaluate.accuracy(items, ["model"]).first()
    assert (row["exact_match_acc"], row["exec_acc"], row["success_rate"], row["fail_rate"]) == (0.5, 0.25, 0.875, 0.125)
    share = evaluate.failure_counts(items, ["model"]).collect()
    assert [(r["failure_category"], r["failures"], r["share_pct"]) for r in share] == [("wrong table", 6, 100.0)]


def test_suite(spark):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").createOrReplaceTempView("people")
    texts = {
        "rows": "SELECT id FROM people ORDER BY id",
        "none": "SELECT id FROM people WHERE name = 'q'",
        "column": "SELECT nope FROM people",
        "table": "SELECT 1 FROM nowhere",
        "syntax": "SELECT id FRM people WHERE (",
        "drop": "DROP TABLE people",
    }
    allowed = suite.screen_texts(spark, texts, ["people"], ["id", "name"])
    assert allowed["rows"] and not allowed["drop"] and not allowed["table"]
    status = suite.capture_status(spark, texts, {**allowed, "table": True, "syntax": True})
    got = {r["name"]: (r["executed"], r["row_count"], r["error_type"]) for r in status.collect()}
    assert got == {
        "rows": (True, 2, None), "none": (True, 0, None), "column": (False, 0, "ColumnNotFound"),
        "table": (False, 0, "TableNotFound"), "syntax": (False, 0, "SyntaxError"),
        "drop": (False, 0, "SafetyViolation"),
    }
    summary = suite.suite_status(status).first()
    assert (summary["queries"], summary["failed_queries"], summary["all_passed"]) == (6, 4, False)


def test_lift_and_accuracy_ask_for_no_failure_category(spark, monkeypatch, capsys):
    from pairloom.plans import evaluation

    rows = [(1, "base", "SELECT 1", "SELECT 2", True, None, None, False, 10.0), (1, "tuned", "SELECT 1", "select 1", True, None, None, True, 5.0)]
    ddl = (
        "case_id int, model string, gold_sql string, generated_sql string, generated boolean, gold_error string, "
        "actual_error string, rows_match boolean, latency_ms double"
    )
    monkeypatch.setattr(evaluation, "executed", lambda t: spark.createDataFrame(rows, ddl).repartition(2))
    lift, rates = evaluation.lift(None), evaluation.accuracy(None)
    assert lift.collect() == [(100.0, 100.0, 50.0)]
    assert sorted(rates.collect()) == [("base", 1, 0.0, 0.0, 1.0, 0.0), ("tuned", 1, 1.0, 1.0, 1.0, 0.0)]
    for df in (lift, rates):
        df.explain(True)
        plan = capsys.readouterr().out.split("Optimized Logical Plan")[1]
        assert "rows_match" in plan and "missing JOIN" not in plan and "Parquet" not in plan
