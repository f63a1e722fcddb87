"""Server-sent token events of streamed replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# Line prefix and end mark of the stream format.
PREFIX = "data: "
DONE = "[DONE]"

EVENT_SCHEMA = (
    "choices ARRAY<STRUCT<delta: STRUCT<content: STRING, reasoning_content: STRING, thought: STRING>>>, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
)


def payload(raw: Column) -> Column:
    """Text after the prefix; null for other lines."""
    return F.when(raw.startswith(PREFIX), F.substr(raw, F.lit(len(PREFIX) + 1)))


def is_done(raw: Column) -> Column:
    return F.coalesce(strip(payload(raw)) == DONE, F.lit(False))


def event(raw: Column) -> Column:
    """Parsed event; null when the line is no event or no JSON."""
    return F.from_json(payload(raw), EVENT_SCHEMA)


def delta_text(parsed: Column, reasoning: bool = True) -> Column:
    """New text of an event: content, then reasoning (``thought`` where that is empty)."""
    delta = F.get(parsed["choices"], F.lit(0))["delta"]
    content = F.coalesce(delta["content"], F.lit(""))
    if not reasoning:
        return content
    thought = F.coalesce(F.nullif(delta["reasoning_content"], F.lit("")), delta["thought"], F.lit(""))
    return F.concat(content, thought)
