"""Texts run by template, against running each by itself."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import templates
from pairloom.operators.results import compare_results, digests

TABLES, COLUMNS = ["people", "visits"], ["id", "name", "age", "city", "person_id", "day", "amount"]


@pytest.fixture(scope="module")
def views(spark):
    people = [(i, f"n{i % 7}" if i % 5 else "o'neil", 20 + i % 30, "rome" if i % 3 else None) for i in range(60)]
    spark.createDataFrame(people, "id int, name string, age int, city string").createOrReplaceTempView("people")
    visits = [(i % 60, i % 11, float(i % 13)) for i in range(400)]
    spark.createDataFrame(visits, "person_id int, day int, amount double").createOrReplaceTempView("visits")


def lifted(spark, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return [(r["template"], r["params"]) for r in templates.lifted(frame, "text").collect()]


def test_only_compared_literals_are_lifted(spark):
    texts = [
        "SELECT a1 FROM t WHERE b = 5 AND c <> 'x''y' AND d >= 1.5 ORDER BY 1 LIMIT 10",
        "SELECT a FROM t WHERE n IN ('p', 'q') AND k BETWEEN 1 AND 2",
        "SELECT a FROM t WHERE b = 5 -- note",
        "SELECT a FROM t WHERE note = 'about pragma'",
        "SELECT a FROM t WHERE day = DATE '2026-01-01' AND b = 5",
        'SELECT "a" FROM t WHERE b = 5',
    ]
    got = lifted(spark, *texts)
    assert got[0] == ("SELECT a1 FROM t WHERE b = \x02 AND c <> \x01 AND d >= \x03 ORDER BY 1 LIMIT 10", ["5", "x'y", "1.5"])
    assert got[1] == ("SELECT a FROM t WHERE n IN (\x01, \x01) AND k BETWEEN 1 AND 2", ["p", "q"])
    # These run as they are.
    assert all(params == [] and template == text for (template, params), text in zip(got[2:], texts[2:]))


def run(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    done = templates.run_texts(frame, TABLES, COLUMNS)
    rows = {}
    for r in done.rows.orderBy("text_id", "pos").collect():
        rows.setdefault(r["text_id"], []).append(tuple(r["values"]))
    return rows, {r["text_id"]: r["error"] for r in done.errors.collect()}, done.jobs


def plainly(spark, text):
    df = spark.sql(text)
    return [tuple(None if v is None else str(v) for v in r) for r in df.select(*[F.col(c).cast("string") for c in df.columns]).collect()]


def test_many_texts_are_few_jobs_with_the_same_rows(spark, views):
    texts = [f"SELECT name, age FROM people WHERE age > {a} AND name <> 'n{a % 7}' ORDER BY age DESC, id LIMIT 4" for a in range(15, 55)]
    texts += [f"SELECT COUNT(*) AS n FROM visits WHERE person_id = {p}" for p in range(0, 70, 3)]
    texts += [f"SELECT p.city, SUM(v.amount) AS total FROM people AS p JOIN visits AS v ON p.id = v.person_id "
              f"WHERE v.day = {d} GROUP BY p.city HAVING SUM(v.amount) > 3" for d in range(13)]  # fmt: skip
    texts += [f"SELECT id FROM people WHERE name = '{n}'" for n in ("n1", "o''neil", "nobody")]
    texts += [f"WITH old AS (SELECT id, age FROM people WHERE age >= {a}) SELECT id FROM old ORDER BY age, id" for a in (20, 45, 99)]
    rows, errors, jobs = run(spark, texts)
    assert errors == {} and jobs == 5
    for i, text in enumerate(texts):
        want = plainly(spark, text)
        got = rows.get(i, [])
        assert got == want if "ORDER BY" in text else sorted(got, key=str) == sorted(want, key=str), text


def test_errors_stay_with_their_texts(spark, views):
    texts = [f"SELECT id FROM people WHERE age = 100 / (id - {k}) AND id = {k}" for k in range(6)]
    texts += ["SELECT nothing FROM people WHERE id = 1", "SELECT id FROM people WHERE", "DROP TABLE people", "SELECT id FROM strangers"]
    # A cast that fails for one parameter only.
    texts += [f"SELECT CAST('{v}' AS INT) AS v FROM people WHERE id = 3" for v in ("1", "2", "x", "4")]
    rows, errors, jobs = run(spark, texts)
    assert set(range(6)) | {6, 7, 8, 9, 12} == set(errors)
    assert errors[6].startswith("Execution Error: no such column") and errors[12].startswith("Execution Error: CAST_INVALID_INPUT")
    assert errors[8].startswith("SQL Safety Violation: ") and errors[9].startswith("SQL Safety Violation: ")
    assert [rows[i] for i in (10, 11, 13)] == [[("1",)], [("2",)], [("4",)]]


def test_cases(spark, views):
    list_, bag = "SELECT name FROM people WHERE age > 40 ORDER BY id", "SELECT name FROM people WHERE age > 40"
    cases = {
        "same": (list_, f"```sql\n{list_};\n```", None),
        "other order": (list_, list_ + " DESC", "ResultMismatch"),
        "bag": (bag, list_ + " DESC", None),
        "both empty": ("SELECT id FROM people WHERE id = 999", "SELECT person_id FROM visits WHERE amount > 999", None),
        "one empty": (bag, "SELECT name FROM people WHERE age > 999", "ResultMismatch"),
        "blank": (bag, "  ", "GenerationFailed"), "null": (bag, None, "GenerationFailed"),
        "blocked": (bag, "DELETE FROM people", "ExecutionError"),
        "column": (bag, "SELECT surname FROM people", "ColumnNotFound"),
        "gold": ("SELECT surname FROM people", bag, "GroundTruthExecutionError"),
        "chatter": (bag, f"Here you are: {bag}; Anything else?", None),
    }
    frame = spark.createDataFrame([(k, g, o) for k, (g, o, _) in cases.items()], "k string, gold string, answer string")
    done = templates.execute_cases(frame, "gold", "answer", TABLES, COLUMNS)
    got = {r["k"]: r["o"] for r in done.select("k", templates.verdict().alias("o")).collect()}
    assert got == {k: o for k, (_, _, o) in cases.items()}


def test_no_cases(spark, views):
    frame = spark.createDataFrame([], "k string, gold string, answer string")
    assert templates.execute_cases(frame, "gold", "answer", TABLES, COLUMNS).count() == 0


def test_digests_agree_with_the_comparison_of_rows(spark):
    results = {
        0: [["1", "a"], ["2", None]], 1: [["2.0", None], [" 1.00001 ", "a"]], 2: [["1", "a"], ["2", ""]], 3: [["1", "a"], ["2", None], ["2", None]],
        4: [["1a"], ["2"]], 5: [["1", "a"], ["2.00", None]], 6: [["12", "a"], ["1", "2a"]], 7: [["1", "2a"], ["12", "a"]], 8: [["1"], ["a"]], 9: [],
    }
    rows = [(i, at, values) for i, some in results.items() for at, values in enumerate(some)]
    found = {r["text_id"]: (r["bag"], r["list"]) for r in digests(spark.createDataFrame(rows, templates._RESULT)).collect()}
    cases = [(f"{a} {b} {o}", o, a, b) for a in results for b in results for o in (False, True)]
    sides = [(case, name, o, at, v) for case, o, a, b in cases for name, i in (("gold", a), ("generated", b)) for at, v in enumerate(results[i])]
    frame = spark.createDataFrame(sides, "case_id string, side string, ordered boolean, pos int, values array<string>")
    listed = spark.createDataFrame([c[:2] for c in cases], "case_id string, ordered boolean")
    want = {r["case_id"]: r["rows_match"] for r in compare_results(frame, listed).collect()}
    none = (None, None)
    assert want == {case: found.get(a, none)[o] == found.get(b, none)[o] for case, o, a, b in cases}
    assert want["0 1 False"] and not want["0 1 True"] and want["0 5 True"] and not want["0 3 False"]


def test_a_shared_result_is_not_read_once_a_case(spark, views, capsys):
    cases = [(i, f"SELECT id FROM people WHERE id = {i}", "SELECT person_id FROM visits") for i in range(3)]
    frame = spark.createDataFrame(cases, "k int, gold string, answer string")
    done = templates.execute_cases(frame, "gold", "answer", TABLES, COLUMNS)
    done.explain(True)
    assert "values" not in capsys.readouterr().out
    assert {r["rows_match"] for r in done.collect()} == {False}


def test_failed_cases_run_the_answers_only(spark, views, monkeypatch):
    asked = []
    run_texts = templates.run_texts

    def noted(texts, *known):
        asked.extend(r["text"] for r in texts.collect())
        return run_texts(texts, *known)

    gold = "SELECT name FROM people WHERE id = 1"
    outputs = [gold, "  ", None, "DROP TABLE people", "SELECT surname FROM people", "SELECT id FROM people WHERE", "Look: SELECT 1 / (id - id) AS n FROM people;"]
    cases = [(k, "SELECT city FROM people", o) for k, o in enumerate(outputs + outputs[4:])]
    frame = spark.createDataFrame(cases, "k int, gold string, answer string")
    both = templates.execute_cases(frame, "gold", "answer", TABLES, COLUMNS).filter(F.col("actual_error").isNotNull())
    monkeypatch.setattr(templates, "run_texts", noted)
    failed = templates.failed_cases(frame.drop("gold"), "answer", TABLES, COLUMNS)
    assert sorted(failed.select("k", "actual_error").collect()) == sorted(both.select("k", "actual_error").collect())
    assert failed.count() == 7 and "SELECT city FROM people" not in asked
