"""Call statistics over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeloom.operators.callstats import RECENT_SCORES, statistics_columns, with_rates


def windowed_statistics(calls: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Statistics per model and window; a window is final once the watermark has passed it.

    ``ts`` must be a timestamp with time zone. Aggregates combine before the shuffle, so one busy
    model is no hot spot.
    """
    per_window = (
        calls.withWatermark("ts", late).groupBy(F.window("ts", window), "model_name").agg(*statistics_columns())
    )
    return with_rates(per_window).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*"
    ).drop("window")


_OUT = T.StructType(
    [T.StructField("model_name", T.StringType()), T.StructField("scores", T.ArrayType(T.IntegerType()))]
)
_STATE = T.StructType(
    [
        T.StructField("ts", T.ArrayType(T.LongType())),
        T.StructField("event_id", T.ArrayType(T.LongType())),
        T.StructField("complexity", T.ArrayType(T.IntegerType())),
    ]
)


def _latest(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["ts", "event_id"]).groupby("model_name", sort=False).tail(RECENT_SCORES)


def _trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _latest(batch)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = pd.DataFrame(dict(zip(("ts", "event_id", "complexity"), state.get))) if state.exists else None
    for batch in batches:
        new = batch[["ts", "event_id", "complexity"]]
        both = new if held is None else pd.concat([held, new])
        held = both.sort_values(["ts", "event_id"]).tail(RECENT_SCORES)
    state.update(tuple(held[c].tolist() for c in ("ts", "event_id", "complexity")))
    yield pd.DataFrame({"model_name": [key[0]], "scores": [held["complexity"].tolist()]})


def recent_scores(calls: DataFrame) -> DataFrame:
    """Scores of the last successes per model, updated with every batch of calls.

    Each Arrow batch keeps only its latest rows per model before the shuffle, so the state
    function never sees more than a few rows of a busy model.
    """
    good = calls.filter("success AND response_time IS NOT NULL").select(
        "model_name", F.unix_micros("ts").alias("ts"), "event_id", "complexity"
    )
    return (
        good.mapInPandas(_trim, good.schema)
        .groupBy("model_name")
        .applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    )
