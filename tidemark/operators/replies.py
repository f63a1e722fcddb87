"""Token streams: from raw event lines to whole replies, latencies and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sse
from tidemark.functions.text import strip
from tidemark.operators.scan import beside

PART_EVENTS = 100_000


def parse_events(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``token``, ``content``, ``prompt_tokens``, ``completion_tokens`` and ``done`` to event lines.

    Lines without the event prefix are dropped; an unreadable event has no text.
    """
    e = F.col("_e")
    return (lines.filter(F.col(raw).startswith(sse.PREFIX))
            .withColumn("done", sse.is_done(F.col(raw)))
            .withColumn("_e", F.when(~F.col("done"), sse.event(F.col(raw))))
            .select(*[c for c in lines.columns if c != raw], "done",
                    sse.delta_text(e).alias("token"), sse.delta_text(e, reasoning=False).alias("content"),
                    e["usage"]["prompt_tokens"].alias("prompt_tokens"),
                    e["usage"]["completion_tokens"].alias("completion_tokens")))


def until_done(events: DataFrame, max_events: int = PART_EVENTS) -> DataFrame:
    """Events before the first end mark of their request, with ``part_no``: the number div ``max_events``, rounded down.

    Which parts there are comes from the numbers that occur, so these may be of any size, with gaps, or below zero.
    The end is looked up per request and part, so a very long stream is spread over tasks, here and in ``reassemble``,
    which groups by the same keys.  An event without a number is before all others, in a part without a number; an end
    mark without one ends nothing.  A request without an id is one request.
    """
    numbered = events.withColumn("part_no", F.expr(f"(seq - pmod(seq, {int(max_events)})) div {int(max_events)}"))
    parts = numbered.groupBy("request_id", "part_no").agg(F.min(F.when(F.col("done"), F.col("seq"))).alias("_own"))
    ends = parts.groupBy("request_id").agg(F.min("_own").alias("_end"))
    first = F.expr(f"part_no * {int(max_events)}")
    wanted = beside(parts, ends, ["_end"], ["request_id"]).filter(
        F.col("part_no").isNull() | F.col("_end").isNull() | (first < F.col("_end")))
    met = beside(numbered, wanted, ["_end"], ["request_id", "part_no"])
    open_ = F.col("seq").isNull() | F.col("_end").isNull() | (F.col("seq") < F.col("_end"))
    return met.filter(open_ & ~(F.col("done") & F.col("seq").isNull())).drop("_end", "done")


def reassemble(events: DataFrame) -> DataFrame:
    """Reply text per request, from the events of ``until_done``; very long replies in ordered parts."""
    items = F.sort_array(F.collect_list(F.struct("seq", "token")))
    return (events.groupBy("request_id", "part_no")
            .agg(F.array_join(F.transform(items, lambda x: x["token"]), "").alias("text"),
                 F.count_if(F.col("token") != "").alias("n_tokens")))


def final_usage(events: DataFrame) -> DataFrame:
    """Usage last seen per request, also in events without choices: servers send it in such an event at the end."""
    seen = F.when(F.col("prompt_tokens").isNotNull(), F.col("seq"))
    return events.groupBy("request_id").agg(
        F.max_by("prompt_tokens", seen).alias("prompt_tokens"),
        F.max_by("completion_tokens", seen).alias("completion_tokens"))


def guard_reply(replies: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Status of the whole request on each of its parts: error when no part holds text.  A reply of one part is stripped.

    A table without these keys holds one row per reply.
    """
    text = F.coalesce("text", F.lit(""))
    if not set(keys) <= set(replies.columns):
        return replies.withColumn("text", strip(text)).withColumn("status", F.when(F.col("text") != "", "ok").otherwise("error"))
    whole = replies.groupBy(*keys).agg(
        F.max(strip(text) != "").alias("_some"), F.count(F.lit(1)).alias("_parts"))
    body = F.when(F.col("_parts") == 1, strip(text)).otherwise(text)
    return beside(replies, whole, ["_some", "_parts"], list(keys)).withColumn("text", body).withColumn(
        "status", F.when(F.col("_some"), "ok").otherwise("error")).drop("_some", "_parts")


def latency_stats(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: pieces, time to first piece, time per piece, total (seconds).

    ``requests``: (request_id, started, ended).
    """
    first = events.filter(F.col("content") != "").groupBy("request_id").agg(
        F.min("ts").alias("first"), F.count(F.lit(1)).alias("output_tokens"))
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)
    n = F.coalesce("output_tokens", F.lit(0))
    return requests.join(first, "request_id", "left").select(
        "request_id", n.cast("bigint").alias("output_tokens"),
        ttft(F.col("started"), F.col("first")).alias("ttft"),
        tpot(F.col("first"), F.col("ended"), n).alias("tpot"),
        seconds(F.col("started"), F.col("ended")).alias("total_duration"))


def ttft(start, first):
    return F.when(first.isNull(), 0.0).otherwise((F.unix_micros(first) - F.unix_micros(start)) / F.lit(1e6))


def tpot(first, end, pieces):
    return F.when(first.isNull() | (pieces == 0), 0.0).otherwise(
        (F.unix_micros(end) - F.unix_micros(first)) / F.lit(1e6) / pieces)
