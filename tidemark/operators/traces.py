"""Trace search, the request feed, span metrics and the service graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import with_parts

# Root span names, defaults and limits of the trace feed.
ROOT_NAMES = ["chat_request", "ollama_chat"]
REASONING_SOURCES = ["web", "qdrant", "none"]
PROMPT_CHARS = 300
FEED_LIMIT = 50
FEED_HOURS = 6
UNKNOWN_MODEL = "unknown"
NO_SOURCE = "none"

# Latency bounds in milliseconds; the last bucket has no upper bound.
LATENCY_BOUNDS = [2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0]

STEPS_PER_ROW = 10_000

TRACE_SCHEMA = (
    "traceID STRING, rootSpanName STRING, startTimeUnixNano STRING, durationMs BIGINT, "
    "spanSets ARRAY<STRUCT<spans: ARRAY<STRUCT<attributes: ARRAY<STRUCT<key: STRING, "
    "value: STRUCT<stringValue: STRING, intValue: STRING>>>>>>>"
)


def time_range(df: DataFrame, as_of: str, hours: int = FEED_HOURS, ts: str = "ts") -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of``; literal bounds reach the scan."""
    end = F.to_timestamp(F.lit(as_of))
    return df.filter((F.col(ts) >= end - F.make_interval(hours=F.lit(hours))) & (F.col(ts) <= end))


def nanos_to_timestamp(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("bigint"))


def root_span_filter(traces: DataFrame) -> DataFrame:
    root = F.coalesce(F.col("rootSpanName"), F.lit(""))
    named = F.lit(False)
    for name in ROOT_NAMES:
        named = named | root.contains(name)
    return traces.filter(named & (F.size(F.coalesce("spanSets", F.array())) > 0))


def attr(attrs: Column, key: str, default: Column) -> Column:
    """Value of the first attribute with that key; empty text gives the default."""
    first = F.slice(F.filter(attrs, lambda a: a["key"] == key), 1, 1)
    # Inside the lambda the attribute is found once, however often it is read.
    values = F.transform(first, lambda a: F.coalesce(
        F.nullif(a["value"]["stringValue"], F.lit("")), F.nullif(a["value"]["intValue"], F.lit(""))))
    return F.coalesce(F.get(values, F.lit(0)), default)


def flatten_traces(traces: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Eight feed columns per trace, read from the attributes of its first span (and columns to keep)."""
    first = F.get(F.get(F.col("spanSets"), F.lit(0))["spans"], F.lit(0))["attributes"]
    attrs = F.coalesce(first, F.array())
    number = lambda key: attr(attrs, key, F.lit("0")).cast("bigint")
    return traces.select(
        nanos_to_timestamp(F.coalesce("startTimeUnixNano", F.lit("0"))).alias("ts"),
        F.coalesce("traceID", F.lit("")).alias("trace_id"),
        attr(attrs, "gen_ai.request.model", F.lit(UNKNOWN_MODEL)).alias("model"),
        number("gen_ai.usage.prompt_tokens").alias("input_tokens"),
        number("gen_ai.usage.completion_tokens").alias("output_tokens"),
        F.round(F.coalesce("durationMs", F.lit(0)).cast("double"), 1).alias("duration_ms"),
        F.left(attr(attrs, "app.user_message", F.lit("")), F.lit(PROMPT_CHARS)).alias("prompt"),
        attr(attrs, "app.context_source", F.lit(NO_SOURCE)).alias("source"), *keep,
    )


def feed_search(feed: DataFrame, text: str) -> DataFrame:
    """Keep items whose prompt holds the text, in any case; empty text keeps all."""
    return feed.filter(F.lower("prompt").contains(text.lower())) if text else feed


def newest(feed: DataFrame, limit: int = FEED_LIMIT, ts: str = "ts", key: str = "trace_id") -> DataFrame:
    """Newest first; a top-k, not a full sort."""
    return feed.orderBy(F.col(ts).desc(), key).limit(limit)


def feed_by_trace(items: DataFrame, max_steps: int = STEPS_PER_ROW) -> DataFrame:
    """One row per trace and part with its steps in time order.

    ``part_no`` is a step's position div ``max_steps``, ``n_parts`` their number; the
    time and prompt are those of the first step of the whole trace, in every part.
    """
    order = ["ts", "step_id"]
    step = F.struct(*order, "source", "model", "input_tokens", "output_tokens", "duration_ms", "prompt")
    steps = F.sort_array(F.collect_list(step))
    fields = ["source", "model", "input_tokens", "output_tokens", "duration_ms"]
    whole = items.groupBy("trace_id").agg(
        F.min(F.struct(*order, "prompt")).alias("_first"), F.ceil(F.count(F.lit(1)) / max_steps).alias("n_parts"))
    return (with_parts(items, ["trace_id"], order, max_steps)
            .groupBy("trace_id", "part_no").agg(steps.alias("_s")).join(whole, "trace_id")
            .select(F.col("_first.ts").alias("ts"), F.col("trace_id").alias("request_id"), "part_no", "n_parts",
                    F.col("_first.prompt").alias("prompt"),
                    F.transform("_s", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("steps")))


def reverse_steps(feed: DataFrame) -> DataFrame:
    """Last step first, over all parts of a trace."""
    return feed.withColumn("steps", F.reverse("steps")).withColumn("part_no", F.col("n_parts") - 1 - F.col("part_no"))


def step_categories(source: Column, model: Column, own: Sequence[str] = ()) -> dict[str, Column]:
    """Boolean per category; a step can be in two.  ``own``: names under which the chat service itself reports."""
    return {
        "embedding": source == "embed",
        "reranker": source == "rerank",
        "reasoning": source.isin([*REASONING_SOURCES, *own]),
        "coder": (source == "coder") | F.coalesce(model, F.lit("")).contains("coder"),
    }


def first_step_per_category(items: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Model of the first step of each category per trace (null when there is none)."""
    at = F.struct("ts", "step_id")
    picks = [F.min_by(F.when(flag, F.col("model")), F.when(flag, at)).alias(name)
             for name, flag in step_categories(F.col("source"), F.col("model"), own).items()]
    return items.groupBy("trace_id").agg(*picks)


def fmt_duration(ms: Column) -> Column:
    return (F.when(ms.isNull(), "—").when(ms < 1000, F.concat(F.printf(F.lit("%.0f"), ms.cast("double")), F.lit("ms")))
            .otherwise(F.concat(F.printf(F.lit("%.2f"), ms.cast("double") / 1000), F.lit("s"))))


def fmt_clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit("—"))


def span_metrics(spans: DataFrame, step: str = "15 seconds", bounds: list[float] | None = None) -> DataFrame:
    """Calls, total latency and cumulative latency buckets per service, span, status and step."""
    bounds = bounds or LATENCY_BOUNDS
    buckets = [F.count_if(F.col("duration_ms") <= b).alias(f"le_{b:g}") for b in bounds]
    return (spans.groupBy("service", "name", "status", F.window("ts", step).alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum(F.col("duration_ms").cast("decimal(18,3)")).cast("double").alias("latency_sum"), *buckets)
            .select("service", "name", "status", F.col("w.start").alias("step_start"), "calls", "latency_sum",
                    *[F.col(f"le_{b:g}") for b in bounds]))


def histogram_quantile(q: float, bounds: list[float], total: str = "calls") -> Column:
    """Quantile by linear interpolation inside the bucket that reaches it; the last bound above all."""
    rank = F.lit(q) * F.col(total)
    out = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        count = F.col(f"le_{bounds[i]:g}")
        below, low = (F.col(f"le_{bounds[i - 1]:g}"), bounds[i - 1]) if i else (F.lit(0), 0.0)
        inside = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / (count - below)
        out = F.when(count >= rank, F.when(count == below, F.lit(bounds[i])).otherwise(inside)).otherwise(out)
    return out


def service_graph(spans: DataFrame) -> DataFrame:
    """Calls, failures and latency between services: child spans against their parents.

    Children are summed per (trace, parent, service) before the join, so a parent with
    very many children is one row in it.
    """
    children = (spans.filter(F.col("parent_id").isNotNull())
                .groupBy("trace_id", F.col("parent_id").alias("span_id"), F.col("service").alias("server"))
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad"),
                     F.sum(F.col("duration_ms").cast("decimal(18,3)")).alias("latency")))
    parents = spans.select("trace_id", "span_id", F.col("service").alias("client"))
    return (children.join(parents, ["trace_id", "span_id"]).filter(F.col("client") != F.col("server"))
            .groupBy("client", "server")
            .agg(F.sum("n").alias("calls"), F.sum("bad").alias("failures"),
                 F.sum("latency").cast("double").alias("latency_sum")))
