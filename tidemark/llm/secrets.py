"""Secret scan: trigram queries over an inverted index of each block of documents, then the patterns themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BLOCK_ROWS = 512
BLOCK_BYTES = 4_000_000
MOST_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in the order of their kinds.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
# Shapes of keys that carry their own mark.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
]


# --- Boolean trigram queries -----------------------------------------------------------------

def _times(left: set[str], right: set[str]) -> set[str] | None:
    out = {a + b for a in left for b in right}
    return out if len(out) <= MOST_BRANCHES else None


class _Query:
    """Reads a pattern's parse tree: the literal strings every match must hold, as AND of ORs of trigrams."""

    def __init__(self, pattern: str):
        from re import _constants as C
        from re import _parser

        self.c, self.clauses = C, []
        self.sequence(_parser.parse(pattern, re.ASCII))

    def exact(self, op, arg) -> set[str] | None:
        """All strings (lower case) that a part can match when they are few, else None."""
        c = self.c
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN and len(arg) <= 4 and all(o is c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is c.SUBPATTERN:
            return self.joined(arg[-1])
        if op is c.BRANCH:
            parts = [self.joined(p) for p in arg[1]]
            whole = set().union(*parts) if all(p is not None for p in parts) else None
            return whole if whole is not None and len(whole) <= MOST_BRANCHES else None
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] <= 2:
            one = self.joined(arg[2])
            if one is None:
                return None
            out, power = set(), {""}
            for n in range(int(arg[1]) + 1):
                power = _times(power, one) if n else power
                if power is None:  # too many: without them the others are not all
                    return None
                if n >= arg[0]:
                    out |= power
            return out if 0 < len(out) <= MOST_BRANCHES else None
        return None

    def joined(self, parts) -> set[str] | None:
        out: set[str] | None = {""}
        for op, arg in parts:
            one = self.exact(op, arg)
            out = _times(out, one) if one is not None and out is not None else None
            if out is None:
                return None
        return out

    def add(self, strings: set[str]) -> None:
        """One of the strings is in every match; shorter than three letters, they say nothing."""
        if strings and all(len(s) >= 3 and s.isascii() for s in strings):
            self.clauses.append([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def sequence(self, parts) -> None:
        run: set[str] = {""}
        for op, arg in parts:
            one = self.exact(op, arg)
            longer = _times(run, one) if one is not None else None
            if longer is not None:
                run = longer
                continue
            self.add(run)
            run = one if one is not None else {""}
            if one is None and op is self.c.SUBPATTERN:
                self.sequence(arg[-1])
            elif one is None and op in (self.c.MAX_REPEAT, self.c.MIN_REPEAT) and arg[0] > 0:
                self.sequence(arg[2])
        self.add(run)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Every match holds, for each clause, all trigrams (lower case) of at least one of its sets; empty: no help."""
    return _Query(pattern).clauses


# --- the inverted index of a block ----------------------------------------------------------

def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Postings:
    """For each wanted trigram the rows of the block that hold it, in either case of ASCII letters."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        data = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8).astype(np.uint32)
        codes = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else np.zeros(0, np.uint32)
        is_wanted = np.zeros(1 << 24, bool)
        is_wanted[wanted] = True
        at = np.flatnonzero(is_wanted[codes])
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(codes[at].astype(np.uint64) << np.uint64(32) | np.searchsorted(ends, at, side="right").astype(np.uint64))
        self.codes, self.rows = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def of(self, trigram: str) -> np.ndarray:
        a, b = np.searchsorted(self.codes, [_code(trigram), _code(trigram) + 1])
        return self.rows[a:b]

    def candidates(self, clauses: list[list[frozenset[str]]], n: int) -> np.ndarray:
        rows = np.arange(n)
        for clause in clauses:
            either = np.zeros(0, np.int64)
            for trigrams in clause:
                held = None
                for t in trigrams:
                    own = self.of(t)
                    held = own if held is None else np.intersect1d(held, own, assume_unique=True)
                either = np.union1d(either, held)
            rows = np.intersect1d(rows, either, assume_unique=True)
        return rows


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def with_spans(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", name: str = "spans",
               block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``name``: the spans (kind, start, end; code points, end exclusive) by start, then by the rules' order.

    A task cuts its rows into blocks and keeps for each the postings of the
    trigrams that some rule asks for; a rule is tried only on the rows its query
    leaves.  A rule without trigrams that every match must hold is tried on all
    rows.  Every text is searched whole; a missing one has no spans.  A column called ``name`` is replaced.
    """
    rules = list(rules if rules is not None else BASE_RULES + MORE_RULES)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.array(sorted({_code(t) for q in queries for c in q for s in c for t in s}), np.int64)
    rest = [c for c in docs.columns if c != name]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(texts: list[str], patterns: list[re.Pattern]) -> list[list[tuple]]:
        found: list[list[tuple]] = [[] for _ in texts]
        index = Postings([t.encode() for t in texts], wanted)
        for order, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
            for row in index.candidates(query, len(texts)).tolist():
                for m in pattern.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[row].append((m.start(), order, m.end()))
        return [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(f)] for f in found]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A lone run is matched whole, so asking for its least length at once finds the same spans sooner.
        patterns = [re.compile(re.sub(r"^(\[[^\]]+\])\+$", rf"\1{{{r.least},}}", r.pattern) if not r.group else r.pattern, re.ASCII)
                    for r in rules]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                for value in batch.column(rest.index(text)).slice(at, block_rows):
                    texts.append(value.as_py() or "")
                    size += len(texts[-1])
                    if size >= block_bytes:
                        break
                piece = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(spans(texts, patterns), kind)], [*rest, name])

    return docs.select(*rest).mapInArrow(scan, StructType([*docs.select(*rest).schema.fields, StructField(name, ArrayType(SPAN))]))


def span_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: list[Rule] | None = None) -> DataFrame:
    """Every secret replaced by the mark; spans that overlap become one.  Rows without one keep their text as it is."""
    spans = F.col("_spans")
    found = with_spans(docs, rules, text, "_spans")
    # Spans come by start: a piece is what lies between the end so far and the next start.
    folded = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            F.when((s["start"] < a["at"]) & (a["at"] > 0), a["done"])
            .otherwise(F.concat(a["done"], F.substr(F.col(text), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("done"),
            s["end"].alias("at"))),
        lambda a: F.concat(a["done"], F.substr(F.col(text), a["at"].cast("int") + 1)))
    return found.withColumn(text, F.when(F.size(spans) > 0, folded).otherwise(F.col(text))).drop("_spans")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return with_spans(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))
