"""Stored tables: what a commit touches, repeats, and what a reader sees."""

import glob
import os

import pytest

from pairloom.operators import stored

DDL = "id long, ts long, v string"


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "table")


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def rows_of(spark, table, version=None):
    return sorted(map(tuple, stored.read(spark, table, frame(spark, []).schema, version).collect()), key=str)


def test_upsert_rewrites_only_touched_buckets(spark, table):
    assert rows_of(spark, table) == []
    first = [(i, 1, f"a{i}") for i in range(200)]
    assert stored.upsert(frame(spark, first), table, "one", ["id"], ["ts"], buckets=16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table}/data/commit=one/*/*.parquet")}
    assert len({os.path.dirname(f) for f in before}) == 16
    # A newer, an older and a new record of three keys; the newest of several for one key.
    change = [(3, 2, "b3"), (3, 5, "c3"), (4, 0, "old"), (900, 1, "new"), (5, 1, "tie")]
    assert stored.upsert(frame(spark, change), table, "two", ["id"], ["ts"], buckets=16)
    want = {i: (i, 1, f"a{i}") for i in range(200)} | {3: (3, 5, "c3"), 900: (900, 1, "new"), 5: (5, 1, "tie")}
    assert rows_of(spark, table) == sorted(want.values(), key=str)
    assert {f: os.stat(f).st_mtime_ns for f in before} == before
    assert 1 <= len(glob.glob(f"{table}/data/commit=two/bucket=*")) <= 4
    # The version before is still there.
    assert rows_of(spark, table, 0) == sorted(first, key=str)


def test_a_repeated_commit_changes_nothing(spark, table):
    assert stored.upsert(frame(spark, [(1, 1, "a")]), table, "one", ["id"], ["ts"])
    assert stored.upsert(frame(spark, [(1, 2, "b")]), table, "two", ["id"], ["ts"])
    assert not stored.upsert(frame(spark, [(1, 9, "never")]), table, "one", ["id"], ["ts"])
    assert rows_of(spark, table) == [(1, 2, "b")]
    assert sorted(map(tuple, stored.versions(spark, table).collect())) == [(0, "one"), (1, "two")]


def test_append_counts_a_run_once(spark, table):
    assert stored.append(frame(spark, [(1, 1, "a"), (1, 1, "a")]), table, "run-1")
    assert stored.append(frame(spark, [(1, 1, "a")]), table, "run-2")
    assert not stored.append(frame(spark, [(1, 1, "a")]), table, "run-2")
    assert stored.append(frame(spark, []), table, "nothing") and not stored.append(frame(spark, []), table, "nothing")
    assert rows_of(spark, table) == [(1, 1, "a")] * 3


def test_rows_without_a_manifest_are_not_seen(spark, table):
    """A job that dies between its rows and its manifest, then runs again."""
    stored.append(frame(spark, [(1, 1, "a")]), table, "one")
    stored._written(frame(spark, [(2, 1, "half")]).selectExpr("*", "0 AS bucket"), table, "two")
    assert rows_of(spark, table) == [(1, 1, "a")]
    assert stored.append(frame(spark, [(2, 1, "whole"), (3, 1, "whole")]), table, "two")
    assert rows_of(spark, table) == [(1, 1, "a"), (2, 1, "whole"), (3, 1, "whole")]


def test_null_keys_and_columns_of_the_layout(spark, table):
    rows = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), (1, None, None)], DDL)
    stored.upsert(rows, table, "one", ["id"], ["ts"])
    assert rows_of(spark, table) == sorted([(1, None, None), (None, 2, "y")], key=str)
