"""The request feed and alert diagnosis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import corpus, logs, traces


def request_feed(hits: DataFrame, as_of: str, hours: int = traces.FEED_HOURS, search: str = "",
                 limit: int = traces.FEED_LIMIT, service: str = "", stored_ts: str | None = None) -> DataFrame:
    """Newest requests with their steps; ``service`` keeps the traces that this service began.

    Where the table has a column of the time (``stored_ts``), the range is cut by it in the scan, before
    anything is flattened.  Only the traces among the newest ``limit`` are put together.
    """
    if stored_ts:
        hits = traces.time_range(hits, as_of, hours, stored_ts)
    if service:
        hits = hits.filter(F.col("rootServiceName") == service)
    flat = traces.flatten_traces(traces.root_span_filter(hits)).withColumn("step_id", F.lit(0))
    rows = traces.feed_search(traces.time_range(flat, as_of, hours), search)
    first = rows.groupBy("trace_id").agg(F.min("ts").alias("started"))
    newest = first.orderBy(F.col("started").desc(), "trace_id").limit(limit)
    return traces.feed_by_trace(rows.join(newest, "trace_id", "left_semi"))


def diagnose(payloads: DataFrame, log_table: DataFrame, ask: Callable[[str, float], str],
             partitions: int | None = None, look_back_hours: int = logs.LOOK_BACK_HOURS) -> DataFrame:
    """Diagnosis per firing alert of a pod: ``shown`` and, when it is long, ``attachment``."""
    firing = logs.needs_diagnosis(logs.alert_view(payloads)).withColumn("alert_key", F.struct("alert_id", "alert_no"))
    texts = logs.alert_logs(firing, log_table, alert_id="alert_key", look_back_hours=look_back_hours).select("alert_key", "log_text")
    prompts = firing.join(texts, "alert_key").select("alert_id", "alert_no", "name", "pod", logs.diagnosis_prompt(
        F.col("full_description"), F.col("log_text")).alias("prompt"))
    answers = corpus.batch_transform(prompts, ask, "prompt", temperature=0.1, partitions=partitions)
    told = answers.withColumn("diagnosis", F.coalesce("result", F.lit("Local LLM unreachable for diagnosis.")))
    return logs.overflow_split(told, "diagnosis")
