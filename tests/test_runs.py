import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import replay, runs, telemetry, timeline
from pairloom.operators.runs import INITIAL_STATE

def step(state, checkpoint):
    """State (active, last different) after a deploy, or after a rollback (None)."""
    active, previous = state
    if checkpoint is None:
        return previous, active
    return state if checkpoint == active else (checkpoint, active)


@pytest.mark.parametrize("fan_bits", [2, 6])
def test_stretches_compose(spark, monkeypatch, fan_bits):
    """Many short logs, each folded over a tree of its own shape."""
    monkeypatch.setattr(replay, "_FAN_BITS", fan_bits)
    rng = random.Random(fan_bits)
    rows = []
    for service in [None, *range(60)]:
        for at in range(rng.randrange(1, 40)):
            # Single deploys between rollbacks leave one slot open for long.
            kind = rng.random() < 0.5 if (service or 0) % 2 else at % 2 == 0
            checkpoint = rng.choice(["base-model", "a", "b", "c", "d"]) if kind else None
            rows.append((len(rows), service, at, "deploy" if kind else "rollback", checkpoint))
            if rng.random() < 0.1:
                rows.append((len(rows), service, at, None, None))
    log = spark.createDataFrame(rows, "event_id long, service long, ts long, action string, checkpoint_id string")
    got = {
        r["event_id"]: tuple(r)[-4:]
        for r in replay.scan(log.repartition(5), "service", ["ts", "event_id"], ("base-model", "base-model")).collect()
    }
    want, states = {}, {}
    for event_id, service, _, action, checkpoint in rows:
        state = states.get(service, ("base-model", "base-model"))
        states[service] = state if action is None else step(state, checkpoint)
        want[event_id] = (*state, *states[service])
    assert got == want


def test_scan_of_nothing(spark):
    log = spark.createDataFrame([], "event_id long, service long, ts long, action string, checkpoint_id string")
    assert replay.scan(log, "service", ["ts", "event_id"], ("x", "x")).count() == 0


def brute_replay(rows):
    states, out = {}, {}
    for event_id, service, ts, action, checkpoint in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        states[service] = step(states.get(service, INITIAL_STATE), checkpoint if action == "deploy" else None)
        out[event_id] = states[service]
    return out


@pytest.fixture(scope="module")
def log_rows():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        service = 7 if rng.random() < 0.6 else rng.randrange(40)
        # The hot service alternates, so that its state is never fixed for long.
        action = ("deploy", "rollback")[i % 2] if service == 7 else rng.choice(["deploy", "rollback"])
        rows.append((i, service, i // 2, action, f"c{rng.randrange(4)}" if action == "deploy" else None))
    return rows


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(f"c{i}",) for i in range(4)], "checkpoint_id string")


@pytest.fixture(scope="module")
def log(spark, log_rows):
    schema = "event_id long, service long, ts long, action string, checkpoint_id string"
    return spark.createDataFrame(random.Random(1).sample(log_rows, len(log_rows)), schema).repartition(4)


def test_replay_with_hot_service(log, log_rows, known):
    got = {r["event_id"]: (r["active_checkpoint"], r["last_different"]) for r in runs.replay(log, known).collect()}
    assert got == brute_replay(log_rows)


def test_replay_twice_toggles():
    state = INITIAL_STATE
    for event in ["A", "B", "B", None, None]:
        state = step(state, event)
    assert state == ("B", "A")


def test_previous_and_forward_fill(log, log_rows, known):
    want, state = {}, {}
    for event_id, service, _, action, checkpoint in sorted(log_rows, key=lambda r: (r[1], r[2], r[0])):
        before = state.get(service, INITIAL_STATE)
        want[event_id] = before[0]
        state[service] = step(before, checkpoint if action == "deploy" else None)
    got = {r["event_id"]: r["previous_checkpoint_id"] for r in runs.previous_checkpoints(log, known).collect()}
    assert got == want
    active = {r["service"]: r["active_checkpoint"] for r in runs.active_checkpoints(log, known).collect()}
    assert active == {service: current for service, (current, _) in state.items()}
    statuses = {(r["service"], r["checkpoint_id"]) for r in runs.checkpoint_status(log, known).collect() if r["status"] == "ACTIVE"}
    assert statuses == set(active.items())
    filled = timeline.fill_forward(log, ["service"], ["ts", "event_id"], "checkpoint_id", "seen").collect()
    want, last = {}, {}
    for event_id, service, _, _, checkpoint in sorted(log_rows, key=lambda r: (r[1], r[2], r[0])):
        last[service] = checkpoint or last.get(service)
        want[event_id] = last[service]
    assert {r["event_id"]: r["seen"] for r in filled} == want


def test_rollback_target_and_deletable(spark):
    rows = [(1, 0, 1, "deploy", "a"), (2, 0, 2, "deploy", "gone"), (3, 0, 3, "deploy", "b"), (4, 1, 1, "deploy", "base-model")]
    log = spark.createDataFrame(rows, "event_id long, service long, ts long, action string, checkpoint_id string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("base-model",)], "checkpoint_id string")
    got = {r["service"]: r["rollback_target"] for r in runs.rollback_targets(log, known).collect()}
    assert got == {0: "a", 1: None}
    assert {r[0] for r in runs.deletable_checkpoints(known, log).collect()} == {"a", "c"}


def test_unregistered_checkpoints_are_refused(spark):
    rows = [(1, 0, 1, "deploy", "a"), (2, 0, 2, "deploy", "gone"), (3, 0, 3, "rollback", None), (4, 1, 1, "deploy", "gone"), (5, 0, 4, "deploy", None)]
    log = spark.createDataFrame(rows, "event_id long, service long, ts long, action string, checkpoint_id string")
    known = spark.createDataFrame([("a",), (None,)], "checkpoint_id string")
    events = {r["event_id"]: (r["checkpoint_id"], r["previous_checkpoint_id"]) for r in runs.resolved(log, known).collect()}
    assert events == {1: ("a", "base-model"), 3: ("base-model", "a")}
    requests = spark.createDataFrame([(9, 2, 0), (8, 5, 0), (7, 5, 1)], "request_id long, ts long, service long")
    served = {r["request_id"]: r["serving_checkpoint"] for r in runs.active_at(requests, log, known).collect()}
    assert served == {9: "a", 8: "base-model", 7: "base-model"}


def test_rollback_makes_its_target_active(spark):
    rows = [(1, 0, 1, "deploy", "a"), (2, 0, 2, "deploy", "b"), (3, 0, 3, "rollback", None)]
    log = spark.createDataFrame(rows, "event_id long, service long, ts long, action string, checkpoint_id string")
    known = spark.createDataFrame([("a",), ("b",)], "checkpoint_id string")
    assert [tuple(r) for r in runs.active_checkpoints(log, known).collect()] == [(0, "a")]
    assert {r[0] for r in runs.deletable_checkpoints(known, log).collect()} == {"b"}
    # The rollback replaced b, so the next one would go there again.
    assert [r["rollback_target"] for r in runs.rollback_targets(log, known).collect()] == ["b"]
    requests = spark.createDataFrame([(9, 2, 0, "active"), (8, 5, 0, "active"), (7, 0, 0, "base")], "request_id long, ts long, service long, requested string")
    served = {r["request_id"]: r["serving_checkpoint"] for r in runs.active_at(requests, log, known).collect()}
    assert served == {9: "b", 8: "a", 7: "base-model"}
    assert {r["request_id"]: r["selected"] for r in runs.select_model(requests, log, known).collect()} == {9: "a", 8: "a", 7: "base-model"}


def test_compare_experiments(spark):
    rows = [("base", 0.42, 0.58, 125.0, 115.0, 160.0, 3.10), ("tuned", 0.90, 0.96, 38.5, 32.0, 48.0, 0.389)]
    frame = spark.createDataFrame(
        rows, "experiment_id string, exact_match_acc double, execution_acc double, avg_latency_ms double, "
        "p50_latency_ms double, p95_latency_ms double, final_val_loss double",
    )
    row = runs.compare_experiments(frame, "base", "tuned").first()
    assert (row["diff_exact_match_acc"], row["diff_execution_acc"], row["diff_p95_latency_ms"]) == (0.48, 0.38, -112.0)
    assert runs.compare_experiments(frame, "base", "missing").count() == 0


def test_upsert_and_feedback(spark):
    frame = spark.createDataFrame([(1, i, f"v{i}") for i in range(500)] + [(2, 3, "x")], "id long, ts long, v string")
    assert sorted(map(tuple, runs.latest(frame, ["id"], ["ts"]).collect())) == [(1, 499, "v499"), (2, 3, "x")]
    notes = spark.createDataFrame([(i, "thumbs_up" if i % 2 else "meh") for i in range(200)] + [(999, None)], "id long, rating string")
    newest = [r["id"] for r in runs.latest_feedback(notes).collect()]
    assert len(newest) == 50 and newest[0] == 199 and all(i % 2 for i in newest)


def test_smoothed_loss_with_gaps(spark):
    frame = spark.createDataFrame([(1, 5, 10.0), (1, 10, 20.0), (1, 15, 30.0)], "job long, step long, loss double")
    got = {r["step"]: round(r["ema"], 6) for r in telemetry.smoothed_loss(frame).collect()}
    assert got == {5: 10.0, 10: 13.0, 15: 18.1}


def test_smoothed_loss(spark):
    frame = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "job long, step long, loss double")
    got = {r["step"]: round(r["ema"], 6) for r in telemetry.smoothed_loss(frame).collect()}
    assert got == {1: 10.0, 2: 13.0, 3: 18.1}
    rng = random.Random(2)
    losses = [rng.uniform(0, 5) for _ in range(1500)]
    long_job = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(losses)], "job long, step long, loss double")
    ema, want = None, {}
    for i, x in enumerate(losses):
        ema = x if ema is None else ema * 0.7 + x * 0.3
        want[i + 1] = ema
    for r in telemetry.smoothed_loss(long_job).collect():
        assert abs(r["ema"] - want[r["step"]]) < 1e-12


def test_sliding_rate_with_hot_client(spark):
    rng = random.Random(9)
    rows = [(i, 1 if rng.random() < 0.7 else rng.randrange(2, 9), 1_700_000_000 + rng.randrange(600)) for i in range(1200)]
    frame = spark.createDataFrame(rows, "request_id long, client long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["request_id"]: r["in_window"] for r in telemetry.sliding_rate(frame, 60, 20).collect()}
    for i, client, s in rng.sample(rows, 300):
        earlier = [r for r in rows if r[1] == client and s - 60 < r[2] and (r[2], r[0]) <= (s, i)]
        assert got[i] == len(earlier)


def test_local_time(spark):
    frame = spark.createDataFrame([("19:29:57",), ("2026-08-12 23:45:00",), ("soon",)], "t string")
    shown = frame.select(telemetry.local_time(F.col("t"), "+05:30", F.lit("2026-08-12").cast("date"))).collect()
    assert [r[0] for r in shown] == ["12:59:57 AM", "5:15:00 AM", "soon"]


def test_rolling_latency(spark):
    frame = spark.createDataFrame([(i, i, 10.0 * i) for i in range(1, 6)], "request_id long, ts long, latency_ms double")
    row = telemetry.rolling_latency(frame).first()
    assert (row["avg_latency_ms"], row["p50_latency_ms"], row["p95_latency_ms"]) == (30.0, 30.0, 48.0)
