"""Request telemetry and training curves, as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.numbers import round_half_up
from pairloom.operators.evaluate import LATENCY_POINTS, average
from pairloom.operators.percentiles import interpolated_percentiles
from pairloom.operators.timeline import running_sum

# Upper bounds of the latency histogram in seconds.
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Smoothing of the training loss and the factor of the validation loss.
KEEP, NEW = 0.7, 0.3
VALIDATION_FACTOR = 1.08
LOG_EVERY = 5

# Steps per chunk of the smoothed loss. 0.7 ** 256 is below 1e-39: what reaches a chunk
# through more than one whole earlier chunk is far below double precision.
CHUNK = 256
# 0.7^(256 * 9) is zero in double precision.
CHUNKS_BACK = 9


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC time."""
    return F.unix_micros(ts.cast("timestamp"))


def counters(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("failed")).alias("successful_requests"),
        F.count_if("failed").alias("failed_requests"),
    )


def _seconds() -> Column:
    return (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6


def request_rate(requests: DataFrame) -> DataFrame:
    """Requests per second of uptime; an uptime of zero counts as one second."""
    totals = requests.agg(F.count("*").alias("total_requests"), _seconds().alias("up"))
    return totals.select(
        "total_requests",
        round_half_up(F.col("up"), 1).alias("uptime_seconds"),
        round_half_up(F.col("total_requests") / F.when(F.col("up") > 0, F.col("up")).otherwise(1.0), 6).alias(
            "requests_per_sec"
        ),
    )


def newest(requests: DataFrame, n: int) -> DataFrame:
    return requests.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(n)


def rolling_latency(requests: DataFrame, n: int = 100) -> DataFrame:
    """Average, P50 and P95 of the newest ``n`` requests."""
    # The percentile sees n values.
    points = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return newest(requests, n).agg(
        F.count("*").alias("points"), round_half_up(average("latency_ms"), 2).alias("avg_latency_ms"),
        round_half_up(points[0], 2).alias("p50_latency_ms"), round_half_up(points[1], 2).alias("p95_latency_ms"),
    )


def latest_per_side(requests: DataFrame) -> DataFrame:
    """Newest latency of the base and of the tuned model."""

    def of(side: str) -> Column:
        return F.max_by("latency_ms", F.when(F.col("model") == side, F.struct("ts", "request_id")))

    return requests.agg(of("base").alias("latest_base_ms"), of("tuned").alias("latest_tuned_ms"))


def latency_series(requests: DataFrame) -> DataFrame:
    """Latency of each request in the column of its side."""

    def of(side: str) -> Column:
        return F.when(F.col("model") == side, F.col("latency_ms")).alias(f"{side}_ms")

    return requests.select("request_id", F.date_format("ts", "HH:mm:ss").alias("time"), of("base"), of("tuned"))


def load_metrics(requests: DataFrame) -> DataFrame:
    """Totals, throughput, latency statistics and rates per model."""
    elapsed = F.greatest(_seconds(), F.lit(0.001))
    totals = requests.groupBy("model").agg(
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("failed")).alias("successful_requests"),
        F.count_if("failed").alias("failed_requests"),
        round_half_up(F.count("*") / elapsed, 6).alias("throughput_req_sec"),
        round_half_up(average("latency_ms"), 2).alias("avg_latency_ms"),
        round_half_up(F.count_if(~F.col("failed")) / F.count("*"), 4).alias("success_rate"),
        round_half_up(F.count_if("failed") / F.count("*"), 4).alias("error_rate"),
    )
    return totals.join(interpolated_percentiles(requests, ["model"], "latency_ms", LATENCY_POINTS), "model")


def throughput_ratio(requests: DataFrame) -> DataFrame:
    """Throughput of the tuned side over that of the base side."""

    def rate(side: str) -> Column:
        at = F.when(F.col("model") == side, micros(F.col("ts")))
        return F.count(at) / F.greatest((F.max(at) - F.min(at)) / 1e6, F.lit(0.001))

    return requests.agg(round_half_up(rate("tuned") / rate("base"), 4).alias("speedup"))


def labelled_counters(requests: DataFrame) -> DataFrame:
    status = F.when(F.col("failed"), "error").otherwise("success")
    return requests.groupBy("endpoint", status.alias("status")).agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame) -> DataFrame:
    """Cumulative bucket counts per model, in one aggregation over the requests."""
    seconds = F.col("latency_ms") / 1000
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.count_if(seconds <= b).alias("requests")) for b in HISTOGRAM_BOUNDS]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("requests")))
    return requests.groupBy("model").agg(F.array(*buckets).alias("_b")).select("model", F.inline("_b"))


def smoothed_loss(steps: DataFrame) -> DataFrame:
    """Exponential average of the loss: the first loss, then 0.7 of the last value plus 0.3 of the new loss.

    Rows of a job count in the order of their steps, which may start anywhere and have gaps.
    Each chunk of rows is summed with the weights 0.3 * 0.7^age in one window over (job,
    chunk), so a long job spreads over many tasks; the ends of earlier chunks come in with
    weight 0.7^(rows since), as far back as that weight is not zero in double precision.
    """
    counted = running_sum(steps.withColumn("_one", F.lit(1)), ["job"], ["step", "loss"], "_one", "_n")
    placed = counted.withColumns(
        {
            "_chunk": F.floor((F.col("_n") - 1) / CHUNK),
            "_at": (F.col("_n") - 1) % CHUNK,
            "_x": F.col("loss") * F.when(F.col("_n") == 1, 1.0).otherwise(NEW),
        }
    )
    upto = W.partitionBy("job", "_chunk").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    # Dividing by 0.7^position turns the recurrence into a plain running sum; at most 0.7^-255.
    own = F.sum(F.col("_x") / F.pow(F.lit(KEEP), F.col("_at"))).over(upto) * F.pow(F.lit(KEEP), F.col("_at"))
    summed = placed.withColumn("_own", own)
    ends = summed.groupBy("job", "_chunk").agg(F.max_by("_own", "_n").alias("_end"))
    later = ends.select("job", "_chunk", "_end", F.explode(F.sequence(F.lit(1), F.lit(CHUNKS_BACK))).alias("_back"))
    carried = later.groupBy(F.col("job").alias("_job"), (F.col("_chunk") + F.col("_back")).alias("_into")).agg(
        F.sum(F.col("_end") * F.pow(F.lit(KEEP), (F.col("_back") - 1) * CHUNK)).alias("_in")
    )
    same = F.col("job").eqNullSafe(F.col("_job")) & (F.col("_chunk") == F.col("_into"))
    ema = F.col("_own") + F.coalesce("_in", F.lit(0.0)) * F.pow(F.lit(KEEP), F.col("_at") + 1)
    return summed.join(carried, same, "left").select(*steps.columns, ema.alias("ema"))


def derived_metrics(steps: DataFrame) -> DataFrame:
    """Train loss, validation loss and perplexity from the smoothed loss."""
    return smoothed_loss(steps).select(
        "job", "step",
        round_half_up(F.col("ema"), 4).alias("train_loss"),
        round_half_up(F.col("ema") * VALIDATION_FACTOR, 4).alias("val_loss"),
        round_half_up(F.exp(F.least(F.col("ema"), F.lit(20.0))), 2).alias("perplexity"),
    )


def progress(steps: DataFrame, tokens_per_step: int = 256) -> DataFrame:
    """Elapsed seconds, tokens per second and remaining seconds at each step.

    Start and length of a job come from an aggregate, joined back on the job; the
    adaptive skewed join splits a job that is much longer than the others.
    """
    jobs = steps.groupBy("job").agg(F.min(micros(F.col("ts"))).alias("_start"), F.max("step").alias("total_steps"))
    elapsed = (micros(F.col("ts")) - F.col("_start")) / 1e6
    return steps.join(jobs, "job").withColumn("_elapsed", elapsed).select(
        "job", "step", "total_steps",
        round_half_up(F.col("_elapsed"), 4).alias("elapsed_seconds"),
        round_half_up(
            F.col("step") * tokens_per_step / F.when(F.col("_elapsed") > 0, F.col("_elapsed")).otherwise(1.0), 4
        ).alias("tokens_per_second"),
        round_half_up(F.col("_elapsed") / F.col("step") * (F.col("total_steps") - F.col("step")), 4).alias("eta_seconds"),
    )


def sampled_log(steps: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Every fifth step, and the last step of each job."""
    regular = steps.filter(F.col("step") % every == 0)
    last = steps.groupBy("job").agg(F.max_by(F.struct(*steps.columns), "step").alias("_row")).select("_row.*")
    return regular.unionByName(last.filter(F.col("step") % every != 0))


def sliding_rate(requests: DataFrame, seconds: int = 60, limit: int = 60) -> DataFrame:
    """Requests of the client in the last ``seconds`` up to and including each one.

    Every request adds one when it comes and takes one away when it leaves the window,
    so the running sum of both at an arrival is the window count. A request that leaves
    at the same instant is taken away first.
    """
    at = micros(F.col("ts"))
    arrivals = requests.select("client", at.alias("at"), F.lit(1).alias("delta"), "request_id")
    departures = arrivals.select(
        "client", (F.col("at") + seconds * 1_000_000).alias("at"), F.lit(-1).alias("delta"), "request_id"
    )
    counted = running_sum(
        arrivals.unionByName(departures), ["client"], ["at", "delta", "request_id"], "delta", "in_window"
    )
    return counted.filter(F.col("delta") == 1).select(
        "request_id", "client", "in_window", (F.col("in_window") > limit).alias("limited")
    )


def latest_points(requests: DataFrame, n: int = 30) -> DataFrame:
    """The newest points of the series, oldest first."""
    return newest(requests, n).orderBy("ts", "request_id")


def local_time(text: Column, zone: str, today: Column) -> Column:
    """UTC text as local wall-clock time: a time of day, or a date with time; else unchanged."""
    trimmed = F.trim(text)
    full = F.when(
        trimmed.rlike(r"\A[0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.concat_ws(" ", today.cast("string"), trimmed)
    ).otherwise(trimmed)
    utc = F.try_to_timestamp(full)
    return F.coalesce(F.date_format(F.from_utc_timestamp(utc, zone), "h:mm:ss a"), trimmed)
