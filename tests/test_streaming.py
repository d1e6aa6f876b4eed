"""Streams in several micro-batches, stopped and started again, against the same over a table."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairloom.operators import telemetry
from pairloom.streaming import jobs

SCHEMA = "request_id long, client long, ts timestamp_ntz, latency_ms double, failed boolean, endpoint string"
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.timestamp("us"), pa.float64(), pa.bool_(), pa.string()]
START = dt.datetime(2026, 1, 1)


def make_requests(n, seed=4, minutes=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rng.randrange(minutes * 60))
        # One client sends more than half of everything.
        client = 1 if rng.random() < 0.6 else rng.choice([2, 3, 4, None])
        rows.append((i, client, at, float(rng.randrange(1, 500)) / 4, rng.random() < 0.2, rng.choice(["a", "b"])))
    return sorted(rows, key=lambda r: (r[2], r[0]))


class Feed:
    """A folder that files are put into one by one."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.rows, self.files = spark, str(folder), [], 0

    def put(self, rows):
        self.rows += rows
        path = f"{self.folder}/part-{self.files:03d}.parquet"
        self.files += 1
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES), path)
        # Files are taken in the order of their times.
        os.utime(path, (1_700_000_000 + self.files * 10,) * 2)

    def stream(self):
        return jobs.read_stream(self.spark, self.folder, "*.parquet", self.batch().schema, files=1)

    def batch(self):
        return self.spark.createDataFrame(self.rows, SCHEMA)


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return Feed(spark, folder)


def forget_last_commit(folder):
    """As if the job had died after its sink, before it noted the batch as done."""
    commits = sorted((f for f in os.listdir(f"{folder}/state/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        path = f"{folder}/state/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    return int(commits[-1])


def test_exact_client_rates_equal_the_table(spark, feed, tmp_path):
    rows = make_requests(900)
    for at in range(0, 900, 180):
        feed.put(rows[at : at + 180])
    got = jobs.exact_client_rates(feed.stream(), 3600, 9, folder=str(tmp_path / "job")).collect()
    want = telemetry.sliding_rate(feed.batch(), 3600, 9).collect()
    assert len(got) == 900
    assert {r["request_id"]: (r["in_window"], r["limited"]) for r in got} == {
        r["request_id"]: (r["in_window"], r["limited"]) for r in want
    }


def test_exact_client_rates_go_on_after_a_stop(spark, feed, tmp_path):
    folder, rows = str(tmp_path / "job"), make_requests(400, seed=8)
    feed.put(rows[:150])
    feed.put(rows[150:260])
    jobs.exact_client_rates(feed.stream(), 7200, 9, folder=folder).count()
    assert forget_last_commit(folder) >= 1
    feed.put(rows[260:])
    got = jobs.exact_client_rates(feed.stream(), 7200, 9, folder=folder).collect()
    want = telemetry.sliding_rate(feed.batch(), 7200, 9).collect()
    assert sorted((r["request_id"], r["in_window"]) for r in got) == sorted((r["request_id"], r["in_window"]) for r in want)


def test_counters_go_on_after_a_stop(spark, feed, tmp_path):
    folder, rows = str(tmp_path / "job"), make_requests(300)

    def counts():
        return sorted(map(tuple, jobs.running_counters(feed.stream(), folder).collect()))

    def want():
        by = feed.batch().groupBy("endpoint").agg(
            F.count("*"), F.count_if(~F.col("failed")), F.count_if("failed")
        )
        return sorted(map(tuple, by.collect()))

    feed.put(rows[:100])
    feed.put(rows[100:200])
    assert counts() == want()
    assert forget_last_commit(folder) == 1
    # The batch is repeated and counts once; nothing new changes nothing.
    assert counts() == want() and counts() == want()
    feed.put(rows[200:])
    assert counts() == want()


def test_screening_goes_on_after_a_stop(spark, tmp_path):
    folder, source = str(tmp_path / "job"), tmp_path / "in"
    source.mkdir()
    texts = [(i, "SELECT a FROM t" if i % 3 else "DROP TABLE t") for i in range(90)]
    names = F.array(F.lit("t")), F.array(F.lit("a"))

    def put(rows, nr):
        spark.createDataFrame(rows, "id long, sql string").toPandas().to_parquet(source / f"{nr}.parquet", index=False)
        os.utime(source / f"{nr}.parquet", (1_700_000_000 + nr * 10,) * 2)

    def screen():
        stream = jobs.read_stream(spark, str(source), "*.parquet", "id long, sql string", files=1)
        return [sorted(r["id"] for r in side.collect()) for side in jobs.screened_split(stream, "id", "sql", *names, folder=folder)]

    put(texts[:30], 0)
    put(texts[30:60], 1)
    assert screen() == [[i for i in range(60) if i % 3], [i for i in range(60) if not i % 3]]
    assert forget_last_commit(folder) == 1
    put(texts[60:], 2)
    assert screen() == [[i for i in range(90) if i % 3], [i for i in range(90) if not i % 3]]


def test_late_rows_are_kept_aside(spark, feed, tmp_path):
    folder, rows = str(tmp_path / "job"), make_requests(600, seed=6)
    first, second, third = rows[:200], rows[200:400], rows[400:]
    late = first[::9]
    feed.put([r for r in first if r not in late])
    feed.put(second)
    feed.put(third[:100] + late + [(9999, 1, None, 1.0, False, "a")])
    feed.put(third[100:])
    windows = jobs.tumbling_rates(feed.stream(), folder=folder)
    # The watermark before the third batch is the newest time of the first two less an hour.
    mark = max(r[2] for r in second) - dt.timedelta(hours=1)

    def hour(at):
        return at.replace(minute=0, second=0, microsecond=0)

    too_late = {r[0] for r in late if hour(r[2]) + dt.timedelta(hours=1) <= mark} | {9999}
    assert {r["request_id"] for r in windows.late.collect()} == too_late and len(too_late) > 5
    on_time = [r for r in rows if r[0] not in too_late]
    end = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = {}
    for r in on_time:
        want.setdefault(hour(r[2]), []).append(r[3])
    want = {h: (len(v), round(sum(v) / len(v) + 1e-9, 2)) for h, v in want.items() if h + dt.timedelta(hours=1) <= end}
    closed = {r["window_start"]: (r["requests"], r["mean_latency_ms"]) for r in windows.closed.collect()}
    assert {h: n for h, (n, _) in closed.items()} == {h: n for h, (n, _) in want.items()}
    assert all(abs(closed[h][1] - mean) < 0.011 for h, (_, mean) in want.items())
    # On-time and late rows are all rows; a repeated batch changes neither.
    summed = spark.read.parquet(f"{folder}/sums").agg(F.sum("requests")).first()[0]
    assert summed + len(too_late) == 601
    forget_last_commit(folder)
    again = jobs.tumbling_rates(feed.stream(), folder=folder)
    assert {r["request_id"] for r in again.late.collect()} == too_late
    assert spark.read.parquet(f"{folder}/sums").agg(F.sum("requests")).first()[0] == summed
