"""Run tables: experiments, the checkpoint registry, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.operators.replay import scan
from pairloom.session import write_once

# The checkpoint that always exists, and the ratings a user may give.
BASE_CHECKPOINT = "base-model"
RATINGS = ["thumbs_up", "thumbs_down"]

# What a service runs, and would go back to, before its first deploy.
INITIAL_STATE = (BASE_CHECKPOINT, BASE_CHECKPOINT)

# Compared metrics and the decimals of their differences.
COMPARED_METRICS = {
    "exact_match_acc": 4,
    "execution_acc": 4,
    "avg_latency_ms": 2,
    "p50_latency_ms": 2,
    "p95_latency_ms": 2,
    "final_val_loss": 4,
}


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by key, last write wins; one candidate per key and task reaches the shuffle."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def compare_experiments(experiments: DataFrame, first: int | str, second: int | str) -> DataFrame:
    """Differences second - first of each metric; no row unless both exist."""
    both = experiments.filter(F.col("experiment_id").isin(first, second))

    def of(which, metric: str) -> Column:
        return F.max(F.when(F.col("experiment_id") == which, F.col(metric)))

    differences = both.agg(
        F.count_if(F.col("experiment_id") == first).alias("_n1"),
        F.count_if(F.col("experiment_id") == second).alias("_n2"),
        *[
            round_half_up(of(second, metric) - of(first, metric), digits).alias(f"diff_{metric}")
            for metric, digits in COMPARED_METRICS.items()
        ],
    )
    return differences.filter((F.col("_n1") > 0) & (F.col("_n2") > 0)).select(
        F.lit(first).alias("exp1"), F.lit(second).alias("exp2"), *[f"diff_{m}" for m in COMPARED_METRICS]
    )


def deploys(log: DataFrame) -> DataFrame:
    return log.filter(F.col("action") == "deploy")


def accepted(log: DataFrame, registered: DataFrame) -> DataFrame:
    """The log without deploys of checkpoints that are not registered: they are refused and change nothing."""
    known = _known(registered, "known_id")
    marked = log.join(known, F.col("checkpoint_id") == F.col("known_id"), "left")
    kept = F.col("known_id").isNotNull() | F.coalesce(F.col("action") != "deploy", F.lit(True))
    return marked.filter(kept).select(*log.columns)


def _known(registered: DataFrame, name: str) -> DataFrame:
    """Ids that may be deployed: the registered ones and the base checkpoint."""
    ids = registered.select(F.col("checkpoint_id").alias(name))
    return ids.union(ids.sparkSession.range(1).select(F.lit(BASE_CHECKPOINT))).distinct()


def resolved(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Every accepted deploy and every rollback with the checkpoint it made active and the one it replaced.

    One row per event: (event_id, service, ts, action, checkpoint_id, previous_checkpoint_id, last_different).
    """
    events = accepted(log, registered).select("event_id", "service", "ts", "action", "checkpoint_id")
    return scan(events, "service", ["ts", "event_id"], INITIAL_STATE).select(
        "event_id", "service", "ts", "action", F.col("active_after").alias("checkpoint_id"),
        F.col("active_before").alias("previous_checkpoint_id"), F.col("other_after").alias("last_different"),
    )


def active_checkpoints(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Checkpoint that each service runs after its last deploy or rollback."""
    newest = F.max_by("checkpoint_id", F.struct("ts", "event_id"))
    return resolved(log, registered).groupBy("service").agg(newest.alias("active_checkpoint"))


def previous_checkpoints(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Each deploy or rollback with the checkpoint it replaced."""
    return resolved(log, registered).drop("last_different")


def checkpoint_status(log: DataFrame, registered: DataFrame) -> DataFrame:
    """ACTIVE for the checkpoint a service runs, READY for its others; one aggregate per service and checkpoint."""
    last = F.max(F.struct("ts", "event_id")).alias("last")
    used = write_once(resolved(log, registered).groupBy("service", "checkpoint_id").agg(last), "used")
    newest = used.groupBy("service").agg(F.max("last").alias("newest"))
    return used.join(newest, "service").select(
        "service", "checkpoint_id", F.when(F.col("last") == F.col("newest"), "ACTIVE").otherwise("READY").alias("status")
    )


def rollback_targets(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Where a rollback of each service would go.

    The newest replaced checkpoint that differs from the active one and is registered,
    else the base checkpoint, or null when that is the active one. The log is reduced to one
    row per service and pair of replacing and replaced checkpoint before anything is joined.
    """
    last = F.max(F.struct("ts", "event_id")).alias("last")
    reduced = resolved(log, registered).groupBy("service", "checkpoint_id", "previous_checkpoint_id").agg(last)
    reduced = write_once(reduced, "replaced")
    active = reduced.groupBy("service").agg(F.max_by("checkpoint_id", "last").alias("active_checkpoint"))
    candidates = (
        reduced.join(active, "service")
        .filter(F.col("previous_checkpoint_id") != F.col("active_checkpoint"))
        .join(_known(registered, "previous_checkpoint_id"), "previous_checkpoint_id", "left_semi")
        .groupBy("service")
        .agg(F.max_by("previous_checkpoint_id", "last").alias("candidate"))
    )
    fallback = F.when(F.col("active_checkpoint") != BASE_CHECKPOINT, F.lit(BASE_CHECKPOINT))
    return active.join(candidates, "service", "left").select(
        "service", "active_checkpoint", F.coalesce("candidate", fallback).alias("rollback_target")
    )


def replay(log: DataFrame, registered: DataFrame) -> DataFrame:
    """Active checkpoint after every event of the deploy/rollback log, per service."""
    return resolved(log, registered).select(
        "event_id", "service", "action", F.col("checkpoint_id").alias("active_checkpoint"), "last_different"
    )


def deletable_checkpoints(registered: DataFrame, log: DataFrame) -> DataFrame:
    """Registered checkpoints that are neither the base one nor active in any service."""
    active = active_checkpoints(log, registered).select(F.col("active_checkpoint").alias("checkpoint_id")).distinct()
    return (
        registered.select("checkpoint_id").distinct()
        .filter(F.col("checkpoint_id") != BASE_CHECKPOINT)
        .join(active, "checkpoint_id", "left_anti")
    )


def check_ratings(feedback: DataFrame) -> DataFrame:
    """Mark each row as accepted or rejected by its rating."""
    valid = F.coalesce(F.col("rating").isin(RATINGS), F.lit(False))
    return feedback.withColumn("accepted", valid)


def latest_feedback(feedback: DataFrame, n: int = 50) -> DataFrame:
    accepted = check_ratings(feedback).filter("accepted").drop("accepted")
    return accepted.orderBy(F.col("id").desc()).limit(n)


def active_at(requests: DataFrame, log: DataFrame, registered: DataFrame) -> DataFrame:
    """Checkpoint that served each request: what the service's last deploy or rollback at or before it made active.

    Requests run through the replay as events that change nothing: one sort for both.
    """
    nothing = F.lit(None).cast("string")
    probes = requests.select(
        "service", "ts", F.lit(1).alias("_kind"), F.col("request_id").alias("_id"), nothing.alias("action"), nothing.alias("checkpoint_id")
    )
    changes = accepted(log, registered).select(
        "service", "ts", F.lit(0).alias("_kind"), F.col("event_id").alias("_id"), "action", "checkpoint_id"
    )
    met = scan(probes.unionByName(changes), "service", ["ts", "_kind", "_id"], INITIAL_STATE)
    return met.filter(F.col("_kind") == 1).select(
        F.col("_id").alias("request_id"), "service", F.col("active_before").alias("serving_checkpoint")
    )


def select_model(requests: DataFrame, log: DataFrame, registered: DataFrame) -> DataFrame:
    """Checkpoint for a requested version: base, active, or a known id; unknown ids get the active one.

    ``base`` and ``active`` are most requests and no ids; they join on a key of their own each,
    so that they do not meet in one task.
    """
    known = registered.select(F.col("checkpoint_id").alias("known_id")).distinct()
    named = ~F.coalesce(F.col("requested").isin("base", "active"), F.lit(True))
    key = F.when(named, F.col("requested")).otherwise(F.concat(F.lit("\0"), F.col("request_id").cast("string")))
    chosen = requests.withColumn("_key", key).join(
        active_checkpoints(log, registered), "service", "left"
    ).join(
        known, F.col("_key") == F.col("known_id"), "left"
    )
    active = F.coalesce("active_checkpoint", F.lit(BASE_CHECKPOINT))
    selected = F.when(F.col("requested") == "base", F.lit(BASE_CHECKPOINT)).otherwise(F.coalesce("known_id", active))
    return chosen.select(
        "request_id", "service", "requested", selected.alias("selected"),
        (selected != BASE_CHECKPOINT).alias("is_finetuned"),
    )
