"""Token streams let out in ordered parts while they run, closed by silence."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.replies import parse_events
from tidemark.streaming import WATERMARK

PART_EVENTS = 1_000
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

PARTS = "request_id string, part_no bigint, text string, prompt_tokens bigint, completion_tokens bigint, ended boolean, last boolean"
# Arrays side by side: what is known of each request, and the waiting events with the place of theirs.
KNOWN = ("request_id string", "next_part bigint", "last_us bigint", "ended boolean", "prompt_tokens bigint", "completion_tokens bigint")
EVENT = ("at bigint", "seq bigint", "us bigint", "done boolean", "token string", "prompt bigint", "completion bigint")
HELD = ", ".join(f"{name} array<{kind}>" for name, kind in map(str.split, KNOWN + EVENT))
BUCKETS = 1_024


def use_state_store(spark: SparkSession) -> None:
    """State with lists and timers needs this store; it holds for the streams started afterwards."""
    spark.conf.set(*STATE_STORE)


class ReplyParts(StatefulProcessor):
    """Per bucket of requests one row of state: for each request the events of parts that are still open, and what is
    known of the ones let out.

    A part is let out when the watermark has passed an event of a later part, as what could still come for it would be
    late, or when the request has been silent for ``gap_us``.  So the state holds the events of one part and of the
    watermark's delay, however long a reply gets.  Each call to the state takes a turn between two processes, so a bucket
    makes as many calls as a single request would.
    """

    def __init__(self, part_events: int, gap_us: int):
        self.part_events, self.gap_us = part_events, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def close(self) -> None:
        pass

    def _load(self) -> dict[str, tuple[dict[int, tuple], list]]:
        if not self.held.exists():
            return {}
        columns = list(self.held.get())
        known = [(name, ({}, list(rest))) for name, *rest in zip(*columns[:len(KNOWN)], strict=True)]
        for at, *event in zip(*columns[len(KNOWN):], strict=True):
            known[at][1][0][event[0]] = tuple(event)
        return dict(known)

    def _store(self, held: dict[str, tuple[dict[int, tuple], list]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if not held:
            self.held.clear()
            return
        known = [(name, *rest) for name, (_, rest) in held.items()]
        waiting = [(at, *events[s]) for at, (events, _) in enumerate(held.values()) for s in sorted(events)]
        columns = [list(c) for c in zip(*known, strict=True)]
        columns += [list(c) for c in zip(*waiting, strict=True)] if waiting else [[] for _ in EVENT]
        self.held.update(tuple(columns))
        self.handle.registerTimer(min(self._due(events, rest) for events, rest in held.values()))

    def _due(self, events: dict[int, tuple], known: list) -> int:
        """The watermark, in milliseconds, at which something of the request is let out or forgotten."""
        first: dict[int, int] = {}
        for seq, us, *_ in events.values():
            part = seq // self.part_events
            first[part] = min(us, first.get(part, us))
        # The first part is over once the watermark passes an event of any later one.
        least = min(first, default=None)
        return -(-min([known[1] + self.gap_us, *(us for part, us in first.items() if part > least)]) // 1_000)

    def _let_out(self, name: str, events: dict[int, tuple], known: list, upto: int | None) -> list[tuple]:
        """Rows of the parts below ``upto`` (all: None); their events leave ``events``."""
        rows = []
        numbers = sorted(s for s in events if upto is None or s // self.part_events < upto)
        parts = [(part, [events.pop(s) for s in own]) for part, own in groupby(numbers, lambda s: s // self.part_events)]
        for i, (part, own) in enumerate(parts):
            known[0] = part + 1
            if known[2]:
                continue
            text = []
            for _, _, done, token, prompt, completion in own:
                if done:
                    known[2] = True
                    break
                text.append(token or "")
                if prompt is not None:
                    known[3], known[4] = prompt, completion
            last = known[2] or (upto is None and i == len(parts) - 1)
            rows.append((name, part, "".join(text), known[3], known[4], known[2], last))
        return rows

    @staticmethod
    def _frame(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [c.split()[0] for c in PARTS.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        new = []
        for part in rows:
            numbered = part[part["numbered"]]
            number = lambda c: [None if pd.isna(x) else int(x) for x in numbered[c].tolist()]
            new += zip(numbered["request_id"].tolist(), map(int, numbered["seq"].tolist()), map(int, numbered["us"].tolist()), map(bool, numbered["done"].tolist()),
                       (t if isinstance(t, str) else None for t in numbered["token"]), number("prompt_tokens"), number("completion_tokens"), strict=True)
        for name, *event in sorted(new, key=lambda e: e[2]):
            events, known = held.setdefault(name, ({}, [None, None, False, None, None]))
            if known[1] is not None and event[1] >= known[1] + self.gap_us:  # silent before: the next reply begins
                out += self._let_out(name, events, known, None)
                known[:] = [None, None, False, None, None]
            known[1] = event[1] if known[1] is None else max(known[1], event[1])
            if not known[2] and (known[0] is None or event[0] // self.part_events >= known[0]):
                events.setdefault(event[0], tuple(event))  # an event that comes again is there already
        self._store(held)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        for name, (events, known) in list(held.items()):
            if now >= known[1] + self.gap_us:
                out += self._let_out(name, events, known, None)
                del held[name]
            else:
                passed = [s // self.part_events for s, us, *_ in events.values() if us <= now]
                out += self._let_out(name, events, known, max(passed) if passed else 0)
        self._store(held)
        yield from self._frame(out)


def stream_replies(lines: DataFrame, gap: str = "5 minutes", watermark: str = WATERMARK, part_events: int = PART_EVENTS,
                   buckets: int = BUCKETS) -> DataFrame:
    """Rows of a request as its parts become final: text up to the end mark, usage seen so far, whether it has ended.

    ``part_no`` is the event number div ``part_events``.  A part without events has no row; the part with the end mark has one,
    with ``ended`` and ``last``, and nothing behind the mark counts.  Without a mark the row that is let out after a
    silence of ``gap`` is the ``last`` one, and what comes later begins anew.  Events that come twice count once, those
    later than the watermark are dropped (it begins at 1970, so an event of that very instant is late), and events without
    a number are left out.  Requests are kept by hash in ``buckets`` rows of state; a checkpoint holds for one number of
    them.  Call ``use_state_store`` before the stream starts.
    """
    gap_us = int(lines.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap})").first()[0])
    events = parse_events(lines).withWatermark("ts", watermark).select(
        F.coalesce("request_id", F.lit("")).alias("request_id"), "ts", F.col("seq").isNotNull().alias("numbered"),
        F.coalesce("seq", F.lit(0)).alias("seq"),  # no null in a bucket turns its numbers into floats
        F.unix_micros("ts").alias("us"), "done", "token", "prompt_tokens", "completion_tokens")
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(buckets)).alias("_bucket")
    return events.select(bucket, "*").groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=ReplyParts(part_events, gap_us), outputStructType=PARTS, outputMode="Append", timeMode="eventTime")
