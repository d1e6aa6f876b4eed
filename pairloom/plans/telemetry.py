"""Request telemetry and training curves, batch and streaming (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.operators import telemetry
from pairloom.plans import sqltext as Q
from pairloom.plans.registry import query
from pairloom.plans.screening import _VERDICT_SQL, known
from pairloom.sources import views
from pairloom.sources.tables import COLUMN_NAMES, TABLE_NAMES, Tables
from pairloom.streaming import jobs

_REQUESTS = views.with_views("requests")
_STEPS = views.with_views("train_steps")
_UP = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"


@query(
    "t01_counters",
    f"""{_REQUESTS} SELECT count(*) AS total_requests, count(*) FILTER (NOT failed) AS successful_requests,
  count(*) FILTER (failed) AS failed_requests FROM requests""",
)
def counters(t: Tables) -> DataFrame:
    """Total, successful and failed requests."""
    return telemetry.counters(views.requests(t))


@query(
    "t02_request_rate",
    f"""{_REQUESTS} SELECT count(*) AS total_requests, {Q.rnd(_UP, 1)} AS uptime_seconds,
  {Q.rnd(f"count(*) / CASE WHEN {_UP} > 0 THEN {_UP} ELSE 1 END", 6)} AS requests_per_sec FROM requests""",
)
def request_rate(t: Tables) -> DataFrame:
    """Requests per second of uptime."""
    return telemetry.request_rate(views.requests(t))


@query(
    "t03_rolling_latency",
    f"""{_REQUESTS} SELECT count(*) AS points, {Q.rnd(Q.average('latency_ms'), 2)} AS avg_latency_ms,
  {Q.rnd('quantile_cont(latency_ms, 0.5)', 2)} AS p50_latency_ms, {Q.rnd('quantile_cont(latency_ms, 0.95)', 2)} AS p95_latency_ms
  FROM (SELECT * FROM requests ORDER BY ts DESC, request_id DESC LIMIT 100) r""",
)
def rolling_latency(t: Tables) -> DataFrame:
    """Latency statistics of the newest hundred requests."""
    return telemetry.rolling_latency(views.requests(t))


@query(
    "t04_latest_per_side",
    f"""{_REQUESTS} SELECT arg_max(latency_ms, request_id) FILTER (model = 'base') AS latest_base_ms,
  arg_max(latency_ms, request_id) FILTER (model = 'tuned') AS latest_tuned_ms FROM requests""",
)
def latest_per_side(t: Tables) -> DataFrame:
    """Newest latency of each model side."""
    return telemetry.latest_per_side(views.requests(t))


@query(
    "t04_latency_series",
    f"""{_REQUESTS} SELECT request_id, strftime(ts, '%H:%M:%S') AS time, CASE WHEN model = 'base' THEN latency_ms END AS base_ms,
  CASE WHEN model = 'tuned' THEN latency_ms END AS tuned_ms FROM requests""",
)
def latency_series(t: Tables) -> DataFrame:
    """Latency series with one column per side."""
    return telemetry.latency_series(views.requests(t))


@query(
    "t05_load_metrics",
    f"""{_REQUESTS} SELECT model, count(*) AS total_requests, count(*) FILTER (NOT failed) AS successful_requests,
  count(*) FILTER (failed) AS failed_requests, {Q.rnd(f"count(*) / greatest({_UP}, 0.001)", 6)} AS throughput_req_sec,
  {Q.rnd(Q.average('latency_ms'), 2)} AS avg_latency_ms, {Q.rnd('quantile_cont(latency_ms, 0.5)', 2)} AS p50_latency_ms,
  {Q.rnd('quantile_cont(latency_ms, 0.95)', 2)} AS p95_latency_ms, {Q.rnd('quantile_cont(latency_ms, 0.99)', 2)} AS p99_latency_ms,
  {Q.rnd('count(*) FILTER (NOT failed) / CAST(count(*) AS DOUBLE)', 4)} AS success_rate,
  {Q.rnd('count(*) FILTER (failed) / CAST(count(*) AS DOUBLE)', 4)} AS error_rate FROM requests GROUP BY model""",
)
def load_metrics(t: Tables) -> DataFrame:
    """Throughput, latency and rates per model."""
    return telemetry.load_metrics(views.requests(t))


def _side_rate(side: str) -> str:
    up = f"(epoch_us(max(ts) FILTER (model = '{side}')) - epoch_us(min(ts) FILTER (model = '{side}'))) / 1e6"
    return f"(count(*) FILTER (model = '{side}') / greatest({up}, 0.001))"


@query(
    "t06_throughput_ratio",
    f"{_REQUESTS} SELECT {Q.rnd(f'{_side_rate('tuned')} / {_side_rate('base')}', 4)} AS speedup FROM requests",
)
def throughput_ratio(t: Tables) -> DataFrame:
    """Throughput of the tuned over the base side."""
    return telemetry.throughput_ratio(views.requests(t))


@query(
    "t07_labelled_counters",
    f"""{_REQUESTS} SELECT endpoint, CASE WHEN failed THEN 'error' ELSE 'success' END AS status, count(*) AS requests
  FROM requests GROUP BY ALL""",
)
def labelled_counters(t: Tables) -> DataFrame:
    """Requests per endpoint and status."""
    return telemetry.labelled_counters(views.requests(t))


@query(
    "t08_latency_histogram",
    f"""{_REQUESTS} SELECT model, le, count(*) FILTER (latency_ms / 1000 <= bound) AS requests FROM requests, (VALUES
  {', '.join(f"('{b}', {b})" for b in telemetry.HISTOGRAM_BOUNDS)}, ('+Inf', CAST('inf' AS DOUBLE))) b(le, bound)
  GROUP BY model, le""",
)
def latency_histogram(t: Tables) -> DataFrame:
    """Cumulative latency buckets per model."""
    return telemetry.latency_histogram(views.requests(t))


_EMA = f"""{_STEPS.replace("WITH ", "WITH RECURSIVE ", 1)}, ema AS (SELECT job, step, loss AS ema FROM train_steps
    WHERE step = 1 UNION ALL SELECT s.job, s.step, e.ema * 0.7E0 + s.loss * 0.3E0
    FROM ema e JOIN train_steps s ON s.job = e.job AND s.step = e.step + 1)"""


@query("t09_smoothed_loss", f"{_EMA} SELECT job, step, {Q.rnd('ema', 4)} AS train_loss FROM ema")
def smoothed_loss(t: Tables) -> DataFrame:
    """Exponential average of the loss of each job."""
    smoothed = telemetry.smoothed_loss(views.train_steps(t))
    return smoothed.select("job", "step", round_half_up(F.col("ema"), 4).alias("train_loss"))


@query(
    "t10_derived_metrics",
    f"""{_EMA} SELECT job, step, {Q.rnd('ema', 4)} AS train_loss, {Q.rnd('ema * 1.08E0', 4)} AS val_loss,
  {Q.rnd('exp(least(ema, 20.0E0))', 2)} AS perplexity FROM ema""",
)
def derived_metrics(t: Tables) -> DataFrame:
    """Validation loss and perplexity."""
    return telemetry.derived_metrics(views.train_steps(t))


_ELAPSED = "((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY job))) / 1e6)"


@query(
    "t11_progress",
    f"""SELECT job, step, total_steps, {Q.rnd('up', 4)} AS elapsed_seconds,
  {Q.rnd('step * 256 / CASE WHEN up > 0 THEN up ELSE 1 END', 4)} AS tokens_per_second,
  {Q.rnd('up / step * (total_steps - step)', 4)} AS eta_seconds FROM ({_STEPS} SELECT job, step, {_ELAPSED} AS up,
  max(step) OVER (PARTITION BY job) AS total_steps FROM train_steps) s""",
)
def progress(t: Tables) -> DataFrame:
    """Tokens per second and remaining time at each step."""
    return telemetry.progress(views.train_steps(t))


@query(
    "t12_sampled_log",
    f"""SELECT job, step, ts, loss FROM ({_STEPS} SELECT *, max(step) OVER (PARTITION BY job) AS m FROM train_steps) s
  WHERE step % 5 = 0 OR step = m""",
)
def sampled_log(t: Tables) -> DataFrame:
    """Every fifth step and the last one."""
    return telemetry.sampled_log(views.train_steps(t))


# A window of two days and a limit of six give some limited requests in the provided events.
WINDOW_SECONDS, WINDOW_LIMIT = 172_800, 6


@query(
    "t13_sliding_rate",
    f"""{_REQUESTS} SELECT request_id, client, in_window, in_window > {WINDOW_LIMIT} AS limited FROM (SELECT request_id, client,
  count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_SECONDS * 1_000_000 - 1} PRECEDING
  AND CURRENT ROW) AS in_window FROM requests) r""",
)
def sliding_rate(t: Tables) -> DataFrame:
    """Requests of the client in the window before each request, and the limit."""
    return telemetry.sliding_rate(views.requests(t), WINDOW_SECONDS, WINDOW_LIMIT)


@query(
    "t14_latest_points",
    f"{_REQUESTS} SELECT request_id, ts, latency_ms FROM requests ORDER BY ts DESC, request_id DESC LIMIT 30",
)
def latest_points(t: Tables) -> DataFrame:
    """The newest thirty points, oldest first."""
    return telemetry.latest_points(views.requests(t)).select("request_id", "ts", "latency_ms")


@query(
    "t15_local_time",
    f"""{_REQUESTS} SELECT request_id, CASE WHEN request_id % 10 = 9 THEN 'not a time'
  ELSE ltrim(strftime(ts + INTERVAL '5 hours 30 minutes', '%I:%M:%S %p'), '0') END AS local_time FROM requests""",
)
def local_time(t: Tables) -> DataFrame:
    """UTC texts (time of day, date and time, or neither) as local time."""
    text = (
        F.when(F.col("request_id") % 10 == 9, "not a time")
        .when(F.col("request_id") % 2 == 0, F.date_format("ts", "HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    shown = telemetry.local_time(text, "+05:30", F.to_date("ts"))
    return views.requests(t).select("request_id", shown.alias("local_time"))


def _arriving(t: Tables, name: str) -> DataFrame:
    return jobs.read_stream(t.spark, t.folder, f"{name}.parquet", getattr(t, name).schema)


def _arriving_requests(t: Tables) -> DataFrame:
    return t.spark.sql(views.VIEW_SQL["requests"], events=_arriving(t, "events"))


@query(
    "t16_streaming_counters",
    f"""{_REQUESTS} SELECT endpoint, count(*) AS total_requests, count(*) FILTER (NOT failed) AS successful_requests,
  count(*) FILTER (failed) AS failed_requests FROM requests GROUP BY endpoint""",
)
def streaming_counters(t: Tables) -> DataFrame:
    """Counters kept up to date by a stream."""
    return jobs.running_counters(_arriving_requests(t))


@query(
    "t17_streaming_windows",
    f"""{_REQUESTS} SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests,
  {Q.rnd(Q.average('latency_ms'), 2)} AS mean_latency_ms FROM requests GROUP BY 1
  HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM requests)""",
)
def streaming_windows(t: Tables) -> DataFrame:
    """Request count and mean latency of each closed hour."""
    return jobs.tumbling_rates(_arriving_requests(t)).closed


@query(
    "t18_streaming_client_rate",
    f"""{_REQUESTS}, placed AS (SELECT client, date_trunc('day', ts) - INTERVAL 1 DAY * k AS window_start
    FROM requests, range(2) r(k))
  SELECT window_start, client, count(*) AS requests FROM placed
  WHERE window_start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM requests)
  GROUP BY ALL HAVING count(*) > {WINDOW_LIMIT}""",
)
def streaming_client_rate(t: Tables) -> DataFrame:
    """Closed sliding windows in which a client sent too much."""
    return jobs.sliding_client_rates(_arriving_requests(t), "2 days", "1 day", WINDOW_LIMIT)


@query(
    "t18_exact_client_rate",
    f"""{_REQUESTS} SELECT request_id, client, in_window, in_window > {WINDOW_LIMIT} AS limited FROM (SELECT request_id, client,
  count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_SECONDS * 1_000_000 - 1} PRECEDING
  AND CURRENT ROW) AS in_window FROM requests) r""",
)
def exact_client_rate(t: Tables) -> DataFrame:
    """The sliding count and limit of each request, kept per client by a stream."""
    return jobs.exact_client_rates(_arriving_requests(t), WINDOW_SECONDS, WINDOW_LIMIT)


@query(
    "t17_late_rows",
    f"{_REQUESTS} SELECT request_id, client, ts FROM requests WHERE ts IS NULL",
)
def late_rows(t: Tables) -> DataFrame:
    """Requests that came after their hour was closed: none where all arrive in one batch, but those without a time."""
    return jobs.tumbling_rates(_arriving_requests(t)).late.select("request_id", "client", "ts")


@query(
    "t19_streaming_screen",
    f"""{_VERDICT_SQL} SELECT case_id, CASE WHEN len(v) = 0 THEN 'accepted' ELSE 'rejected' END AS output, reason FROM final""",
)
def streaming_screen(t: Tables) -> DataFrame:
    """Texts screened on arrival, into an accepted and a rejected table."""
    texts = t.spark.sql(views.VIEW_SQL["sql_pairs"], orders=_arriving(t, "orders"))
    accepted, rejected = jobs.screened_split(
        texts, "case_id", "generated_sql", known(TABLE_NAMES), known(COLUMN_NAMES)
    )
    return accepted.select("case_id", F.lit("accepted").alias("output"), "reason").union(
        rejected.select("case_id", F.lit("rejected"), "reason")
    )
