"""Experiments, checkpoint registry and feedback (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import runs, stored
from pairloom.plans import sqltext as Q
from pairloom.plans.registry import query
from pairloom.session import scratch_path
from pairloom.sources import views
from pairloom.sources.tables import Tables

_EXPERIMENTS = f"""{views.with_views('experiments')}, newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY experiment_id ORDER BY ts DESC) AS rn FROM experiments) r WHERE rn = 1)"""
_REPLAY = """taken AS (SELECT * FROM deployments WHERE action <> 'deploy' OR checkpoint_id = 'base-model'
    OR checkpoint_id IN (SELECT checkpoint_id FROM checkpoints)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS i FROM taken),
  states AS (SELECT service, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, min(ts) AS ts, CAST('' AS VARCHAR) AS action,
      'base-model' AS active_checkpoint, 'base-model' AS last_different, 'base-model' AS replaced FROM numbered GROUP BY service
    UNION ALL SELECT n.service, n.i, n.event_id, n.ts, n.action,
      CASE WHEN n.action = 'rollback' THEN s.last_different ELSE n.checkpoint_id END,
      CASE WHEN n.action = 'rollback' OR n.checkpoint_id <> s.active_checkpoint THEN s.active_checkpoint
           ELSE s.last_different END, s.active_checkpoint
    FROM states s JOIN numbered n ON n.service = s.service AND n.i = s.i + 1)"""
_LOG = f"""{views.with_views('deployments', 'checkpoints').replace("WITH ", "WITH RECURSIVE ", 1)}, {_REPLAY},
  previous AS (SELECT event_id, service, ts, active_checkpoint AS checkpoint_id, replaced AS previous_checkpoint_id
    FROM states WHERE i > 0),
  active AS (SELECT service, arg_max(active_checkpoint, i) AS active_checkpoint FROM states WHERE i > 0 GROUP BY service)"""


def experiments(t: Tables) -> DataFrame:
    return runs.latest(views.experiments(t), ["experiment_id"], ["ts"])


@query("r01_upsert_latest", f"{_EXPERIMENTS} SELECT * FROM newest")
def upsert_latest(t: Tables) -> DataFrame:
    """Last record of each experiment."""
    return experiments(t)


@query("r01_stored_upsert", f"{_EXPERIMENTS} SELECT * FROM newest")
def stored_upsert(t: Tables) -> DataFrame:
    """The same in a stored table: records come in three commits, one of them twice."""
    path, records = scratch_path(t.spark, "experiments"), views.experiments(t)
    for part in (2, 0, 1, 0):
        stored.upsert(records.filter(F.col("ts") % 3 == part), path, f"part-{part}", ["experiment_id"], ["ts"])
    return stored.read(t.spark, path, records.schema)


@query("r02_point_lookup", f"{_EXPERIMENTS} SELECT * FROM newest WHERE experiment_id = 42")
def point_lookup(t: Tables) -> DataFrame:
    """One experiment; the filter reaches the scan below the upsert."""
    return experiments(t).filter(F.col("experiment_id") == 42)


@query(
    "r03_compare",
    f"""{_EXPERIMENTS} SELECT 3 AS exp1, 17 AS exp2, """
    + ", ".join(f"{Q.rnd(f'b.{m} - a.{m}', d)} AS diff_{m}" for m, d in runs.COMPARED_METRICS.items())
    + " FROM newest a, newest b WHERE a.experiment_id = 3 AND b.experiment_id = 17",
)
def compare(t: Tables) -> DataFrame:
    """Metric differences of two experiments."""
    return runs.compare_experiments(experiments(t), 3, 17)


@query("r04_list_experiments", f"{_EXPERIMENTS} SELECT experiment_id, ts, exact_match_acc FROM newest ORDER BY ts")
def list_experiments(t: Tables) -> DataFrame:
    """All experiments in order of time."""
    return experiments(t).select("experiment_id", "ts", "exact_match_acc").orderBy("ts")


@query("r05_active_checkpoint", f"{_LOG} SELECT * FROM active")
def active_checkpoint(t: Tables) -> DataFrame:
    """Checkpoint that each service runs."""
    return runs.active_checkpoints(views.deployments(t), views.checkpoints(t))


@query(
    "r06_previous_checkpoint",
    f"{_LOG} SELECT event_id, service, checkpoint_id, previous_checkpoint_id FROM previous",
)
def previous_checkpoint(t: Tables) -> DataFrame:
    """Each deploy or rollback with the checkpoint it replaced."""
    found = runs.previous_checkpoints(views.deployments(t), views.checkpoints(t))
    return found.select("event_id", "service", "checkpoint_id", "previous_checkpoint_id")


@query(
    "r07_checkpoint_status",
    f"""{_LOG} SELECT DISTINCT service, checkpoint_id, CASE WHEN checkpoint_id = active_checkpoint THEN 'ACTIVE'
  ELSE 'READY' END AS status FROM previous JOIN active USING (service)""",
)
def checkpoint_status(t: Tables) -> DataFrame:
    """ACTIVE or READY per service and checkpoint."""
    return runs.checkpoint_status(views.deployments(t), views.checkpoints(t))


@query(
    "r07_unified_status",
    f"{_LOG} SELECT checkpoint_id, upper(arg_max(status, ts)) AS status FROM checkpoints GROUP BY checkpoint_id",
)
def unified_status(t: Tables) -> DataFrame:
    """Last registered status of each checkpoint, in one spelling."""
    registered = runs.latest(views.checkpoints(t), ["checkpoint_id"], ["ts"])
    return registered.select("checkpoint_id", F.upper("status").alias("status"))


@query(
    "r08_rollback_target",
    f"""{_LOG}, candidates AS (SELECT service, arg_max(previous_checkpoint_id, (ts, event_id)) AS candidate
    FROM previous JOIN active USING (service) WHERE previous_checkpoint_id <> active_checkpoint
    AND previous_checkpoint_id IN (SELECT checkpoint_id FROM checkpoints UNION SELECT 'base-model') GROUP BY service)
  SELECT service, active_checkpoint, coalesce(candidate, CASE WHEN active_checkpoint <> 'base-model' THEN 'base-model' END)
    AS rollback_target FROM active LEFT JOIN candidates USING (service)""",
)
def rollback_target(t: Tables) -> DataFrame:
    """Where a rollback of each service would go."""
    return runs.rollback_targets(views.deployments(t), views.checkpoints(t))


@query(
    "r09_replay_log",
    f"{_LOG} SELECT event_id, service, action, active_checkpoint, last_different FROM states WHERE i > 0",
)
def replay_log(t: Tables) -> DataFrame:
    """Active checkpoint after every deploy and rollback."""
    return runs.replay(views.deployments(t), views.checkpoints(t))


@query(
    "r10_deletable",
    f"""{_LOG} SELECT DISTINCT checkpoint_id FROM (SELECT checkpoint_id FROM checkpoints UNION
  SELECT 'old-' || service FROM deployments WHERE action = 'deploy') c WHERE checkpoint_id <> 'base-model'
  AND checkpoint_id NOT IN (SELECT active_checkpoint FROM active)""",
)
def deletable(t: Tables) -> DataFrame:
    """Registered checkpoints that may be deleted."""
    log = views.deployments(t)
    old = runs.deploys(log).select(F.concat(F.lit("old-"), F.col("service").cast("string")).alias("checkpoint_id"))
    registered = views.checkpoints(t).select("checkpoint_id").union(old)
    return runs.deletable_checkpoints(registered, log)


@query(
    "r11_deployment_history",
    f"{_LOG} SELECT event_id, service, action, checkpoint_id FROM taken ORDER BY ts DESC, event_id DESC",
)
def deployment_history(t: Tables) -> DataFrame:
    """The log without refused deploys, newest first."""
    newest_first = runs.accepted(views.deployments(t), views.checkpoints(t)).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return newest_first.select("event_id", "service", "action", "checkpoint_id")


@query(
    "r12_feedback_validation",
    f"""{views.with_views('feedback')} SELECT rating, rating IN ('thumbs_up', 'thumbs_down') AS accepted, count(*) AS n
  FROM feedback GROUP BY ALL""",
)
def feedback_validation(t: Tables) -> DataFrame:
    """Accepted and rejected ratings."""
    return runs.check_ratings(views.feedback(t)).groupBy("rating", "accepted").agg(F.count("*").alias("n"))


@query(
    "r13_latest_feedback",
    f"""{views.with_views('feedback')} SELECT * FROM feedback WHERE rating IN ('thumbs_up', 'thumbs_down')
  ORDER BY id DESC LIMIT 50""",
)
def latest_feedback(t: Tables) -> DataFrame:
    """The fifty newest accepted entries."""
    return runs.latest_feedback(views.feedback(t))


_REQUESTS = _LOG.replace("WITH RECURSIVE ", views.with_views("requests").replace("WITH ", "WITH RECURSIVE ") + ",\n", 1)


def service_requests(t: Tables) -> DataFrame:
    version = (
        F.when(F.col("request_id") % 3 == 0, "base")
        .when(F.col("request_id") % 3 == 1, "active")
        .otherwise(F.concat(F.lit("ckpt-"), (F.col("request_id") % 7).cast("string")))
    )
    return views.requests(t).select(
        "request_id", "ts", (F.col("client") % 50).alias("service"), version.alias("requested")
    )


@query(
    "r14_active_at",
    f"""{_REQUESTS} SELECT r.request_id, r.service, coalesce(d.checkpoint_id, 'base-model') AS serving_checkpoint
  FROM (SELECT request_id, ts, client % 50 AS service FROM requests) r
  ASOF LEFT JOIN previous d ON r.service = d.service AND r.ts >= d.ts""",
)
def active_at(t: Tables) -> DataFrame:
    """Checkpoint that served each request."""
    return runs.active_at(service_requests(t), views.deployments(t), views.checkpoints(t))


@query(
    "r15_select_model",
    f"""{_REQUESTS}, asked AS (SELECT request_id, client % 50 AS service, CASE request_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'active'
    ELSE 'ckpt-' || request_id % 7 END AS requested FROM requests),
  chosen AS (SELECT request_id, service, requested, CASE WHEN requested = 'base' THEN 'base-model'
    WHEN requested IN (SELECT checkpoint_id FROM checkpoints) THEN requested ELSE coalesce(active_checkpoint, 'base-model') END AS selected
    FROM asked LEFT JOIN active USING (service))
  SELECT *, selected <> 'base-model' AS is_finetuned FROM chosen""",
)
def select_model(t: Tables) -> DataFrame:
    """Checkpoint for each requested version."""
    return runs.select_model(service_requests(t), views.deployments(t), views.checkpoints(t))
