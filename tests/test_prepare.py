import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows_of
from pairloom.functions import prompts, text
from pairloom.operators import export
from pairloom.operators.export import read_export
from pairloom.operators import prepare, profile
from pairloom.operators.percentiles import floor_index_percentiles
from pairloom.operators.ranking import with_position
from pairloom.plans import preparation
from pairloom.plans.all_queries import ORACLES, QUERIES
from pairloom.session import scratch_path
from pairloom.sources.pairs import scan_pairs


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, instruction string, output string")


def test_clean(spark):
    rows = [
        (1, "  Q ", "```sql\nSELECT 1;;\n```"), (2, " \t", "SELECT 1"), (3, "q", " ; "), (4, "q", " \n "),
        (5, "q", "```\nSELECT 'a;b';"),
    ]
    got = {r["id"]: (r["instruction"], r["output"]) for r in prepare.clean(pairs(spark, rows)).collect()}
    assert got == {1: ("Q", "SELECT 1"), 3: ("q", ""), 5: ("q", "SELECT 'a;b'")}


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(i, "Count ROWS" if i % 2 else "count rows", "SELECT  1" if i % 3 else "select 1") for i in range(300, 0, -1)]
    rows += [(1000 + i, f"q{i}", "SELECT 1") for i in range(50)] + [(2000, "qa", "b"), (2001, "q", "ab")]
    once = prepare.deduplicate(pairs(spark, rows), ["id"])
    assert once.filter("id < 1000").select("id").collect() == [(1,)]
    assert once.count() == 53 and prepare.deduplicate(once, ["id"]).count() == 53
    report = prepare.dedup_report(pairs(spark, rows + [(3000, " ", "x")])).first()
    assert tuple(report) == (353, 53, 300)


def test_split_sizes(spark):
    for n in (0, 1, 9, 10, 1003):
        frame = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"))
        sizes = {r["split"]: r["n"] for r in prepare.split(frame).groupBy("split").agg(F.count("*").alias("n")).collect()}
        train, val = int(n * 0.8), int(n * 0.1)
        want = {"train": train, "val": val, "test": n - train - val}
        assert sizes == {k: v for k, v in want.items() if v}


def test_split_is_reproducible_and_seeded(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("id"))

    def train(seed, parts):
        return {r["id"] for r in prepare.split(frame.repartition(parts), seed=seed).filter("split = 'train'").collect()}

    assert train(42, 3) == train(42, 7) != train(43, 3)


def test_positions(spark):
    keys = [(1, i) for i in range(400)] + [(k, 0) for k in range(2, 60)]
    shuffled = random.Random(5).sample(keys, len(keys))
    frame = spark.createDataFrame(shuffled, "a int, b int").repartition(5)
    got = sorted((r["position"], r["a"], r["b"]) for r in with_position(frame, ["a", "b"]).collect())
    assert got == [(i, a, b) for i, (a, b) in enumerate(sorted(keys))]


def test_turn_pairs_with_copies(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2")]
    turns += [(2, 0, "user", "x"), (2, 1, "assistant", "y")] * 200
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    # Of the repeated turns, the last user row is followed by the first reply.
    assert sorted(map(tuple, prepare.pair_turns(frame).collect())) == [(1, 1, "u1", "a1"), (2, 0, "x", "y")]


def test_turn_pairs_over_gaps_and_repeats(spark):
    turns = [(1, 1, "user", "u1"), (1, 3, "assistant", "a3"), (1, 4, "user", "u4"), (1, 4, "assistant", "a4"), (1, 9, "assistant", "a9")]
    turns += [(2, 1, "user", "first"), (2, 1, "user", "second"), (2, 2, "assistant", "r1"), (2, 2, "assistant", "r2")]
    turns += [(3, 1, "user", "asks"), (3, 2, "system", "between"), (3, 3, "assistant", "late")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, prepare.pair_turns(frame).collect()))
    # In turn 4 of conversation 1 the roles sort the assistant first.
    assert got == [(1, 1, "u1", "a3"), (1, 4, "u4", "a9"), (2, 1, "second", "r1")]


def test_cycle_and_epochs(spark):
    items = spark.createDataFrame([("c",), ("a",), ("b",)], "id string")
    got = sorted((r["request_no"], r["id"]) for r in prepare.cycle(items, ["id"], 3, 7).collect())
    assert got == [(i, "abc"[i % 3]) for i in range(7)]
    steps = sorted((r["step"], r["id"], r["epoch"], r["total_steps"]) for r in prepare.expand_epochs(items, ["id"], 3, 2).collect())
    assert steps[0] == (1, "a", 0.33, 10) and steps[-1] == (6, "c", 2.0, 10) and len(steps) == 6


def test_formats(spark):
    row = spark.createDataFrame([("Q?", "SELECT 1", "DDL", None)], "q string, s string, d string, b string")
    c = [F.col(x) for x in ("q", "s", "d", "b")]
    alpaca = row.select(*prompts.render("alpaca", *c)).first()
    assert alpaca["prompt"].startswith("### Instruction:\nTranslate") and alpaca["completion"] == "SELECT 1"
    assert "\nDatabase Schema DDL:\nDDL\n\nQuestion: Q?\n\n### Response:\n" in alpaca["prompt"]
    chat = row.select(*prompts.render("chatml", *c)).first()["messages"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant"]
    assert chat[1]["content"] == "\nDatabase Schema DDL:\nDDL\nQuestion: Q?"
    assert row.select(*prompts.render("llama3", *c)).first()["completion"] == "SELECT 1<|eot_id|>"
    unknown = row.select(*prompts.render("nope", *c)).first()
    assert unknown["prompt"].startswith("<start_of_turn>user\n") and unknown["completion"] == "SELECT 1<end_of_turn>"


def test_json_array_file_and_jsonl(spark, tmp_path):
    records = [{"id": "s-1", "instruction": "a", "output": "b"}, {"id": "s-2", "db_id": "x", "instruction": "c"}]
    (tmp_path / "pairs.json").write_text(json.dumps(records, indent=2))
    read = scan_pairs(spark, str(tmp_path / "pairs.json"), json_array=True)
    want = [("s-1", None, "b"), ("s-2", "x", None)]
    assert sorted((r["id"], r["db_id"], r["output"]) for r in read.collect()) == want
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        scan_pairs(spark, str(tmp_path / "pairs.json")).collect()
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, records)))
    assert sorted((r["id"], r["db_id"], r["output"]) for r in scan_pairs(spark, str(tmp_path / "pairs.jsonl")).collect()) == want
    path = scratch_path(spark, "test-export")
    rows = spark.range(20).selectExpr("cast(id as string) id", "'q' instruction", "'SELECT 1' output", "'' schema", "'' db_id")
    prepare.export_jsonl(prepare.split(rows), "llama3", path)
    back = read_export(spark, path, "prompt string, completion string").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in back} == {"train": 16, "val": 2, "test": 2}


def test_json_scan_keeps_every_conversation(spark, tmp_path, monkeypatch):
    """Null and negative ids, and one conversation with most rows: all pairs, in array files of bounded length."""
    monkeypatch.setattr(preparation, "ARRAY_ROWS", 50, raising=False)
    paths = {}
    monkeypatch.setattr(preparation, "scratch_path", lambda spark, label: paths.setdefault(label, str(tmp_path / label)))
    turns = [(7, i) for i in range(1500)] + [(c, i) for c in (None, -1, -2, -3, 0, 1) for i in range(10)]
    rows = [(c, 2 * i + k, role, f'"{role}"\n {c} {i}') for c, i in turns for k, role in enumerate(("user", "assistant"))]
    ddl = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "conversations.parquet"))
    df = QUERIES["d01_scan_json"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = db.execute(ORACLES["d01_scan_json"])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert len(want[1]) == 1560 and rows_of(df.columns, df.collect()) == want
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "json-arrays").glob("**/part-*")]
    assert max(sizes) <= 50 and 700 <= sum(sizes) <= 860


def test_json_scan_of_no_pairs(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["d01_scan_json"](spark, str(tmp_path)).count() == 0


def test_layouts(spark):
    flat = spark.createDataFrame([("q1", "s1", "d"), ("q0", "s0", "d")], "question string, query string, db_id string")
    got = sorted(map(tuple, prepare.normalize_flat(flat, "spider", ["question"]).select("id", "instruction", "input").collect()))
    assert got == [("spider-1", "q0", "Database: d."), ("spider-2", "q1", "Database: d.")]


def test_token_estimates(spark):
    frame = spark.createDataFrame([("",), ("abc",), ("abcdefgh",), ("a b\tc",)], "t string")
    got = frame.select(text.estimated_tokens(F.col("t")), text.word_tokens(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 2), (2, 2), (1, 6)]


def test_floor_percentiles(spark):
    frame = spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v int")
    assert tuple(floor_index_percentiles(frame, [], "v", {"a": 0.5, "b": 0.95}).first()) == (3, 4)


def test_profile_of_nothing(spark):
    report = profile.validity_report(spark.createDataFrame([], "output string"), "output").first()
    assert (report["total_records"], report["validity_percentage"]) == (0, 0.0)


def test_a_reader_never_sees_half_an_export(spark, tmp_path, monkeypatch):
    path, ddl = str(tmp_path / "export"), "prompt string"

    def records(n, text):
        return spark.range(n).repartition(4).selectExpr(f"'{text}' AS prompt", "if(id % 10 = 0, 'test', 'train') AS split")

    def seen():
        rows = read_export(spark, path, ddl).groupBy("prompt", "split").count().collect()
        return {(r["prompt"], r["split"]): r["count"] for r in rows}

    assert seen() == {}
    assert export.export(records(1000, "a"), path, rows_per_file=40) == 0
    assert seen() == {("a", "train"): 900, ("a", "test"): 100}
    listed = export.manifest(spark, path).collect()
    # A split with most rows is many files, each of bounded length; the manifest counts them.
    assert max(r["n_rows"] for r in listed) <= 40 and sum(r["n_rows"] for r in listed) == 1000
    assert sum(r["split"] == "train" for r in listed) >= 23 and all(r["n_bytes"] > 0 for r in listed)
    # An export that dies before its manifest is not seen, and the next one replaces its files.
    export.write_files(records(50, "half"), f"{path}/files/version=1", 40)
    assert seen() == {("a", "train"): 900, ("a", "test"): 100}
    assert export.export(records(20, "b"), path) == 1
    assert seen() == {("b", "train"): 18, ("b", "test"): 2}
    assert export.export(records(0, "c"), path) == 2 and seen() == {}
