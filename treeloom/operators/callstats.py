"""Statistics of a call log ``(event_id, model_name, success, response_time, complexity, ts)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.scans import running_sums
from treeloom.session import stage

# Thresholds.
MIN_ATTEMPTS = 5
MAX_FAILURE_RATE = 0.3
MIN_SUCCESSES_FOR_TIME = 3
SLOW_SECONDS = 45
MIN_SUCCESSES_FOR_RANK = 2
RECENT_SCORES = 20


def _timed() -> Column:
    """A success counts only with its response time."""
    return F.col("success") & F.col("response_time").isNotNull()


def statistics_columns() -> list[Column]:
    """Aggregates per model; shared by the batch and the streaming job."""
    good = _timed()
    return [
        F.count_if(good).alias("success_count"),
        F.coalesce(F.sum(F.when(good, F.col("response_time"))), F.lit(0.0)).alias("total_response_time"),
        F.max(F.when(good, F.col("ts"))).alias("last_success"),
        F.count_if(~F.col("success")).alias("failure_count"),
    ]


def with_rates(stats: DataFrame) -> DataFrame:
    """Add mean response time and failure rate."""
    attempts = F.col("success_count") + F.col("failure_count")
    return stats.withColumns(
        {
            "avg_response_time": F.when(
                F.col("success_count") > 0, F.col("total_response_time").cast("double") / F.col("success_count")
            ).otherwise(0.0),
            "failure_rate": F.when(attempts > 0, F.col("failure_count") / attempts).otherwise(0.0),
        }
    )


def model_statistics(calls: DataFrame) -> DataFrame:
    """One row per model."""
    return with_rates(calls.groupBy("model_name").agg(*statistics_columns()))


def degraded(
    stats: DataFrame,
    max_failure_rate: float = MAX_FAILURE_RATE,
    slow_seconds: float = SLOW_SECONDS,
    auto_switch: bool = True,
) -> DataFrame:
    """Flag models that fail too often or answer too slowly; off when switching is disabled."""
    attempts = F.col("success_count") + F.col("failure_count")
    failing = (attempts > MIN_ATTEMPTS) & (F.col("failure_rate") > max_failure_rate)
    slow = (F.col("success_count") >= MIN_SUCCESSES_FOR_TIME) & (F.col("avg_response_time") > slow_seconds)
    return stats.withColumn("degraded", (failing | slow) & F.lit(auto_switch))


def recent_scores(calls: DataFrame, k: int = RECENT_SCORES) -> DataFrame:
    """Complexity scores of the last ``k`` successes per model, oldest first.

    The rank filter runs on each map side first, so at most ``k`` rows per model and task move.
    """
    latest = Window.partitionBy("model_name").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        calls.filter(_timed())
        .select("model_name", "ts", "event_id", "complexity")
        .withColumn("r", F.row_number().over(latest))
        .filter(F.col("r") <= k)
        .groupBy("model_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("r"), "complexity"))), lambda s: s["complexity"])
             .alias("scores"))
    )


def running_mean(calls: DataFrame, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Mean response time of each model after every success.

    Sums are carried between slices of about ``rows_per_slice`` calls each, so a busy model or a
    burst of calls at one time is spread over many tasks.
    """
    good = calls.filter(_timed()).select("event_id", "model_name", "ts", "response_time")
    out = running_sums(
        good,
        ["model_name"],
        ["ts", "event_id"],
        {"success_count": F.lit(1).cast("long"), "total_response_time": F.col("response_time")},
        rows_per_slice,
    )
    return out.withColumn("avg_response_time", F.col("total_response_time").cast("double") / F.col("success_count"))


def best_models(routing: DataFrame, stats: DataFrame) -> DataFrame:
    """Best candidate per ``(task, subtask)`` of a routing table ``(task, subtask, rank, model)``.

    Models with enough successes come first, by mean time, then failure rate, then listed order;
    without such a model the first listed one is taken.
    """
    candidates = routing.filter("model <> ''").join(
        stats.withColumnRenamed("model_name", "model"), "model", "left"
    )
    known = F.coalesce(F.col("success_count") >= MIN_SUCCESSES_FOR_RANK, F.lit(False))
    order = Window.partitionBy("task", "subtask").orderBy(
        known.desc(),
        F.when(known, F.col("avg_response_time")),
        F.when(known, F.col("failure_rate")),
        "rank",
    )
    return (
        candidates.withColumn("r", F.row_number().over(order)).filter("r = 1").select("task", "subtask", "model")
    )


def first_listed(routing: DataFrame) -> DataFrame:
    """First candidate per task, used when switching is disabled."""
    return routing.filter("model <> ''").groupBy("task", "subtask").agg(F.min_by("model", "rank").alias("model"))


def route(
    requests: DataFrame, routing: DataFrame, stats: DataFrame, default_model: str, auto_switch: bool = True
) -> DataFrame:
    """Add the model for each request ``(task, subtask)``.

    An unknown subtask uses the task's rows with an empty subtask, an unknown task the default. Without
    switching the first listed model is taken, however complex the request: where the first one is a capable
    model, it is also the first capable one. The choices have a row per task, so requests are joined once.
    """
    chosen = best_models(routing, stats) if auto_switch else first_listed(routing)
    by_task = stage(
        chosen.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("subtask", "model"))).alias("_models"))
    )
    found = F.coalesce(F.try_element_at("_models", F.col("subtask")), F.try_element_at("_models", F.lit("")))
    return (
        requests.join(by_task, "task", "left")
        .withColumn("model", F.coalesce(found, F.lit(default_model)))
        .drop("_models")
    )
