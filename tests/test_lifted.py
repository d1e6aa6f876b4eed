"""Cases with template and literals in place of their texts, against the texts themselves."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, templates
from pairloom.operators.screen import validate

GOLD = [
    "SELECT a, COUNT(b) AS n FROM t WHERE k = 5 AND c = 'x' GROUP BY a ORDER BY n DESC LIMIT 5",
    "SELECT a FROM t WHERE k = 5 OR k = 7", "SELECT a FROM t WHERE k = 5 OR k >= 5.50",
    "SELECT a FROM t AS t1 JOIN u AS u2 ON t1.id = u2.id WHERE c IN ('F', 'O') AND d = 'o''neil' AND e = ''",
    "SELECT a FROM t WHERE c = 'order by x; -- y'", "SELECT a FROM t WHERE c = 'É' AND k = 5", "SELECT a FROM t", "", None,
]
OWN = [
    "  select a  FROM t WHERE k  =  5 or k = 7 ;;", "SELECT a FROM t WHERE k = 7 OR k = 5", "SELECT a FROM t WHERE k = 7 OR k = 7",
    "SELECT a FROM t WHERE k =     5 OR k = 7", "SELECT a FROM t WHERE k = 1 OR k =     7", "SELECT a FROM t WHERE k =\xa05 OR k = 7",
    "SELECT a FROM t WHERE k = 5 /* '1' */ OR k = 7", "SELECT a FROM t WHERE k = 5 OR k = 7 -- it's 5", 'SELECT "a" FROM t WHERE k = 5 OR k = 7',
    "SELECT a FROM t WHERE k = 5 OR k >= 5.5", "SELECT a FROM t WHERE k = 5 OR k >= 5.50", "SELECT a FROM t WHERE k = 5 OR k >= '5.50'",
    "SELECT a, COUNT(b) AS n FROM t WHERE k = 5 AND c = 'X' GROUP BY a ORDER BY n DESC LIMIT 5",
    "SELECT a, COUNT(b) AS n FROM t WHERE k = 5 AND c = 'y' GROUP BY a ORDER BY n DESC LIMIT 5",
    "SELECT a, SUM(b) AS n FROM t WHERE k = 5 AND c = 'x' GROUP BY a ORDER BY n DESC LIMIT 5",
    "SELECT a, COUNT(b) AS n FROM t WHERE k = 5 AND c = 'x' GROUP BY a, n ORDER BY n DESC LIMIT 50",
    "SELECT a FROM t AS t1 JOIN u AS u2 ON t1.id = u2.id WHERE c IN ('f', 'O') AND d = 'o''neil' AND e = ''",
    "SELECT a FROM t AS t1 JOIN u AS u2 ON t1.id = 5 WHERE c IN ('F', 'F') AND d = 'o''neil' AND e = ''",
    "SELECT a FROM t AS t1 JOIN u AS u2 ON t1.id = u2.id WHERE c IN ('F', 'O') AND d = 'o' AND e = 'neil'",
    "SELECT a FROM t WHERE c = 'order by x; -- y'", "SELECT a FROM t WHERE c = 'order by x; - y' AND k = 5", "SELECT a FROM t WHERE c = 'é' AND k = 5",
    "SELECT a FROM t WHERE c = 'É' AND k = 6", "SELECT a FROM t WHERE c = 'open AND k = 5", "SELECT a FROM t WHERE c = DATE '2026-01-01' AND k = 5",
    "```sql\nSELECT a FROM t WHERE k = 5 OR k = 7\n```", "```\nSELECT a FROM t WHERE k = 5 OR k = 7;\n```", "```sql\nno query = 5\n```", "``````", "```\n \n```",
    "Here: ```sql\nSELECT a FROM t WHERE k = 5\n``` or ```SELECT 1```", "```sql\nSELECT a FROM t WHERE c = '```' AND k = 5\n```",
    "I can't tell k = 5; SELECT a FROM t WHERE k = 5 AND c = 'x'; it's done", "can't SELECT a FROM t WHERE c = 'x' OR k = 'y'",
    "With k = 9 in mind: SELECT a FROM t WHERE k = 5 OR k = 7; Let me know = 3", "x = 4 'p' SELECT a FROM t WHERE k = 4 AND c = 'p'",
    "SELECT a FROM t WHERE k = 5 OR k = 7; ATTACH DATABASE x AS y", "PRAGMA x = 5", "SELECT a FROM t WHERE c = 'attach x' AND k = 5",
    "DROP TABLE t WHERE k = 5", "DROP TABLE t WHERE c = 'x'", "SELECT a FROM t WHERE c = '\x01' AND k = 5", "SELECT a FROM t WHERE \x02 = 5", "SELECT FROM WHERE ;;;",
    "WITH r AS (SELECT a FROM t WHERE k = 5) SELECT a FROM r WHERE a <> 'pragma'", "SELECT a FROM t WHERE k=5OR k=7", "SELECT 5 = k, 5 FROM t LIMIT 5",
    "", "  ", "\n", None,
]


@pytest.fixture(scope="module")
def cases(spark):
    pairs = [(g, o) for g in GOLD + OWN[:12] for o in OWN + GOLD[:4]]
    return spark.createDataFrame([(k, *pair) for k, pair in enumerate(pairs)], "k int, gold_sql string, generated_sql string").repartition(8)


def by_case(df):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.collect()}


def test_texts_are_put_back(spark, cases):
    texts = cases.select(F.col("generated_sql").alias("text")).filter("text IS NOT NULL").distinct()
    cut = templates.lifted(texts, "text")
    back = cut.select("text", templates.put_back(F.col("template"), F.col("params"), F.lit(False)).alias("back"))
    assert all(r["text"] == r["back"] for r in back.collect())


def test_answers_are_those_found_text_by_text(cases):
    lifted = templates.lift_cases(cases, "gold_sql", "generated_sql", "k", "generated_sql")
    placed, found = templates.answered(lifted)
    ran = templates.put_back(F.col("_own_template"), F.col("_own_params"), F.lit(False))
    told = F.when(F.col("generated_sql").isNotNull(), ran)
    want = by_case(validate(cases, "generated_sql").select("k", "formatted_sql"))
    assert by_case(placed.select("k", told)) == want
    # The very templates and literals of these texts, so that equal texts run once.
    texts = validate(cases.filter("generated_sql IS NOT NULL"), "generated_sql").select("k", "formatted_sql")
    direct = by_case(templates.lifted(texts, "formatted_sql").select("k", "template", "params"))
    assert by_case(placed.filter("generated_sql IS NOT NULL").select("k", "_own_template", "_own_params")) == direct
    assert {r["template"] for r in found.collect()} >= {template for template, _ in direct.values()}


def test_pairs_compare_like_their_texts(cases):
    direct = evaluate.parse_texts(evaluate.compare_texts(cases, "gold_sql", "generated_sql"))
    cause = evaluate.failure_category(F.lit(None).cast("string"))
    want = by_case(direct.select("k", F.col("_gold") == F.col("_own"), cause))
    lifted = templates.lift_cases(cases, "gold_sql", "generated_sql", "k")
    assert by_case(evaluate.compare_lifted(lifted, True).select("k", "em", "text_cause")) == want
    assert len({em for em, _ in want.values()}) == 2 and len({c for _, c in want.values()}) >= 9
    assert evaluate.compare_lifted(lifted, False).columns == [*lifted.columns, "em"]


def test_texts_that_differ_in_literals_are_looked_at_once(spark, monkeypatch):
    rows = [
        (i, f"SELECT a FROM t WHERE k = {i} AND c = 'v{i % 9}' LIMIT 5", f"SELECT b FROM t WHERE k = {i + i % 2} AND c = 'v{i % 9}'; PRAGMA x")
        for i in range(200)
    ]
    cases = spark.createDataFrame(rows, "k int, gold_sql string, generated_sql string")
    seen = []

    def noted(module, name):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *more: (seen.append((name, df.count())), plain(df, *more))[1])

    noted(templates, "validate")
    noted(evaluate, "compare_texts")
    lifted = templates.lift_cases(cases, "gold_sql", "generated_sql", "k")
    evaluate.compare_lifted(lifted, True).collect()
    templates.answered(lifted)[0].collect()
    # An even and an odd number: two ways in which the literals of a pair are the same.
    assert dict(seen) == {"compare_texts": 2, "validate": 1}


def test_scores_with_and_without_texts(spark):
    rows = [
        (1, "m", "SELECT a FROM t", "  ", False, None, "boom", False, 1.0), (2, "m", "SELECT a FROM t", "SELECT b FROM t", True, None, None, False, 1.0),
        (3, "m", "SELECT a FROM t", "SELECT a FROM u", True, None, "no such table: u", False, 1.0), (4, "m", "SELECT a FROM t", "SELECT a FROM t", True, None, None, True, 1.0),
        (5, "m", "SELECT a FROM t", "SELECT a FROM t LIMIT 3", True, "no such column", None, False, 1.0), (6, "m", "SELECT 1", "SELECT 2", True, None, "Execution Error: x", False, 1.0),
        (7, "m", "SELECT a FROM t", "\n", True, None, "Execution Error: x", False, 1.0),
    ]
    ddl = (
        "case_id int, model string, gold_sql string, generated_sql string, generated boolean, gold_error string, "
        "actual_error string, rows_match boolean, latency_ms double"
    )
    cases = spark.createDataFrame(rows, ddl)
    rest = [c for c in cases.columns if not c.endswith("_sql")]
    lifted = evaluate.compare_lifted(templates.lift_cases(cases, "gold_sql", "generated_sql", *rest), True)
    assert sorted(evaluate.score_cases(lifted).collect()) == sorted(evaluate.score_cases(cases).collect())
