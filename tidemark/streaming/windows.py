"""Windowed metrics and counter increases over streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming import WATERMARK

IDLE_SECONDS = 3_600
BUCKETS = 1_024


def metric_windows(samples: DataFrame, keys: Sequence[str], step: str = "15 seconds",
                   watermark: str = WATERMARK) -> DataFrame:
    """Count and sum per key and tumbling step."""
    return (samples.withWatermark("ts", watermark).groupBy(F.window("ts", step).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(30,6)")).alias("total"))
            .select(F.col("w.start").alias("step_start"), *keys, "n", F.col("total").cast("double").alias("total")))


def sliding_sum(deltas: DataFrame, keys: Sequence[str], width: str = "1 minute", step: str = "15 seconds",
                watermark: str = WATERMARK) -> DataFrame:
    """Increases summed over a sliding range; divide by the width for a rate."""
    return (deltas.withWatermark("ts", watermark).groupBy(F.window("ts", width, step).alias("w"), *keys)
            .agg(F.sum(F.col("delta").cast("decimal(30,6)")).alias("increase"))
            .select(F.col("w.end").alias("at"), *keys, F.col("increase").cast("double").alias("increase")))


def counter_increases(samples: DataFrame, series: str = "series", watermark: str = WATERMARK,
                      idle_seconds: int = IDLE_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Increase of each sample over the one before it, across micro-batches.

    A sample waits in the state of its series until the watermark has passed it, so samples
    that come late, but not too late, are put in their place first.  Falling values are resets;
    of several samples at one instant the largest counts.  A series that is silent for
    ``idle_seconds`` is forgotten and starts again.  Series are kept by hash in ``buckets`` rows of
    state, so a task takes many short series at once; a checkpoint holds for one number of them.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, has, last_us, last, *waiting = state.get if state.exists else ([],) * 7
        fresh = [] if state.hasTimedOut else [f[[series, "us", "value"]] for f in frames]
        new = pd.concat([pd.DataFrame({series: [], "us": [], "value": []}), *fresh])
        # Known names are distinct and come first, so they keep their numbers.
        code, every = pd.factorize(np.concatenate([np.array(names, object), new[series].to_numpy(object)]), use_na_sentinel=False)
        more = len(every) - len(names)
        has, last_us, last = (np.concatenate([np.array(old, kind), np.zeros(more, kind)])
                              for old, kind in ((has, bool), (last_us, "int64"), (last, "float64")))
        rows = pd.DataFrame({"at": np.concatenate([np.array(waiting[0], "int64"), code[len(names):]]),
                             "us": np.concatenate([np.array(waiting[1], "int64"), new["us"].to_numpy("int64")]),
                             "value": np.concatenate([np.array(waiting[2], "float64"), new["value"].to_numpy("float64")])})
        rows = rows.groupby(["at", "us"], as_index=False)["value"].max()
        passed = state.getCurrentWatermarkMs()
        at, us = rows["at"].to_numpy(), rows["us"].to_numpy()
        left = rows[us > passed * 1000]
        ready = rows[(us <= passed * 1000) & ~(has[at] & (us <= last_us[at]))]
        if len(ready):
            at, value = ready["at"].to_numpy(), ready["value"].to_numpy()
            change = at[1:] != at[:-1]
            before = np.where(np.append(True, change), np.where(has[at], last[at], np.nan), np.append(np.nan, value[:-1]))
            delta = np.where(np.isnan(before), 0.0, np.where(value >= before, value - before, value))
            end = np.append(change, True)
            has[at[end]], last_us[at[end]], last[at[end]] = True, ready["us"].to_numpy()[end], value[end]
            yield pd.DataFrame({series: every[at], "us": ready["us"], "value": value, "delta": delta})
        open_ = np.zeros(len(every), bool)
        open_[left["at"].to_numpy()] = True
        forgotten = last_us // 1000 + idle_seconds * 1000
        alive = open_ | (has & (forgotten > passed))
        if not alive.any():
            state.remove()
            return
        number = np.cumsum(alive) - 1
        state.update(([n if isinstance(n, str) else None for n in every[alive]], has[alive].tolist(), last_us[alive].tolist(), last[alive].tolist(),
                      number[left["at"].to_numpy()].tolist(), left["us"].tolist(), left["value"].tolist()))
        due = np.concatenate([left["us"].to_numpy() // 1000, forgotten[alive & ~open_]])
        state.setTimeoutTimestamp(max(int(due.min()), passed) + 1)

    bucket = F.pmod(F.xxhash64(series), F.lit(buckets)).alias("_bucket")
    return (samples.withWatermark("ts", watermark).select(bucket, series, "ts", F.unix_micros("ts").alias("us"), "value").groupBy("_bucket")
            .applyInPandasWithState(
                step, f"{series} STRING, us BIGINT, value DOUBLE, delta DOUBLE",
                "names ARRAY<STRING>, has_last ARRAY<BOOLEAN>, last_us ARRAY<BIGINT>, last_value ARRAY<DOUBLE>, "
                "waiting_at ARRAY<BIGINT>, waiting_us ARRAY<BIGINT>, waiting ARRAY<DOUBLE>", "append",
                GroupStateTimeout.EventTimeTimeout)
            .select(series, F.timestamp_micros("us").alias("ts"), F.expr("us div 1000000").alias("sec"), "value", "delta"))
