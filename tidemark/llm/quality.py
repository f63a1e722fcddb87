"""Quality rules: text statistics and a decision list learned by sequential covering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MOST_REPEAT_PERCENT = 50

# Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]


def text_stats(text: str | None) -> tuple[int, ...]:
    """Counts of one whole text, in the order of STATS; a missing text has none.

    Words are runs of other characters than space and the five control characters
    from tab to return, which is what splitting bytes on white space gives.
    """
    data = (text or "").encode()
    words = data.split()
    bare = b"".join(words)
    seen, repeated, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = np.zeros(len(words), bool)
        twice = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        for shift in range(3):
            hit[shift:shift + len(windows)] |= twice
        covered = int(hit.sum())
    return (len(words), len(bare.decode()), len(bare) - len(bare.translate(None, SYMBOLS)), repeated, covered, lines,
            len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(bare) - len(bare.translate(None, b"0123456789")))


def with_stats(docs: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    """Adds the struct ``name`` of counts; a column of that name is replaced."""
    rest = [c for c in docs.columns if c != name]
    place = rest.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t.as_py()) for t in batch.column(place)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, STATS)], [*rest, name])

    struct = StructType([StructField(s, LongType()) for s in STATS])
    kept = docs.select(*rest)
    return kept.mapInArrow(count, StructType([*kept.schema.fields, StructField(name, struct)]))


def base_failed(stats: str = "_stats") -> Column:
    words = F.col(f"{stats}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MOST_REPEAT_PERCENT * words)


# What the rules compare: each is a count or one count for every unit of another.
FEATURES = {
    "words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"),
}


def feature(name: str, stats: str = "_stats") -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(f"{stats}.{top}").cast("double")
    return F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{bottom}"), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.feature]
        return v >= self.bound if self.at_least else v < self.bound

    def column(self, stats: str) -> Column:
        v = feature(self.feature, stats)
        return v >= self.bound if self.at_least else v < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.bound:g}"


@dataclass
class DecisionList:
    """Rules in order; a document that one of them fits is rejected, all others are kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def column(self, stats: str = "_stats") -> Column:
        """Number of the first rule that fits, from 1; null without one: one conditional expression."""
        out = F.when(F.lit(False), F.lit(0))
        for number, rule in enumerate(self.rules, 1):
            whole = F.lit(True)
            for condition in rule:
                whole = whole & condition.column(stats)
            out = out.when(whole, F.lit(number))
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition that gains most information about bad rows, over all cuts of all features."""
    p0, n0 = int(bad[rows].sum()), int((~bad[rows]).sum())
    before = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    best = (1e-9, None)
    for name, all_values in values.items():
        v = all_values[rows]
        order = np.argsort(v, kind="stable")
        v, is_bad = v[order], bad[rows][order]
        cuts = np.flatnonzero(np.diff(v)) + 1
        if not len(cuts):
            continue
        below = np.cumsum(is_bad)[cuts - 1]
        for at_least in (True, False):
            p = p0 - below if at_least else below
            total = len(v) - cuts if at_least else cuts
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - before), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                bound = float(f"{(v[cuts[i] - 1] + v[cuts[i]]) / 2:.6g}")
                if not v[cuts[i] - 1] < bound <= v[cuts[i]]:
                    bound = float(v[cuts[i]])
                best = (float(gain[i]), Condition(name, at_least, bound))
    return best


def worth(rule: Sequence[Condition], values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """(share of good over bad results on these rows, bad ones it fits, others it fits)"""
    fits = rows.copy()
    for condition in rule:
        fits &= condition.holds(values)
    p, n = int((fits & bad).sum()), int((fits & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(values: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, least_precision: float = 0.9,
          least_support: int = 5, most_conditions: int = 4) -> DecisionList:
    """Sequential covering.

    A rule grows on two thirds of the rows not yet covered, one condition at a
    time, until it fits bad rows only; its last conditions go while that helps on
    the other third.  A rule that is not precise there, or fits too few bad rows, ends
    the list.
    """
    out = DecisionList()
    open_rows = np.ones(len(bad), bool)
    while True:
        rows, rule = open_rows & ~prune, []
        while len(rule) < most_conditions and (bad & rows).any() and (~bad & rows).any():
            _, condition = best_condition(values, bad, rows)
            if condition is None:
                break
            rule.append(condition)
            rows = rows & condition.holds(values)
        if not rule:
            return out
        test = open_rows & prune
        size = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k], values, bad, test)[0], -k))
        rule = rule[:size]
        _, p, n = worth(rule, values, bad, test)
        _, p_all, _ = worth(rule, values, bad, open_rows)
        if p == 0 or p / (p + n) < least_precision or p_all < least_support:
            return out
        out.rules.append(tuple(rule))
        fits = open_rows.copy()
        for condition in rule:
            fits &= condition.holds(values)
        open_rows &= ~fits


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The list learned from at most ``sample_rows`` labelled documents (those with the smallest hash of the id).

    0 is bad.  Labels without value or id are left out.  Documents that fail the base
    rules are left out too: the list only has to find the others.  This bound is
    the only one; every document is judged.
    """
    by_hash = F.xxhash64("doc_id")
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("_label"))
             .filter(F.col("doc_id").isNotNull() & F.col("_label").isNotNull())
             .orderBy(by_hash, "doc_id", "_label").limit(sample_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    # At most sample_rows rows of two numbers.
    labelled = with_stats(texts.join(F.broadcast(known), "doc_id"), "_text").filter(~base_failed())
    rows = (labelled.select("doc_id", (F.col("_label") == 0).alias("bad"), "_stats.*")
            .orderBy(by_hash, "doc_id", "bad", *STATS).limit(sample_rows).toPandas())
    values = {}
    for name, (top, bottom) in FEATURES.items():
        values[name] = rows[top].to_numpy(float) / (np.maximum(rows[bottom].to_numpy(float), 1) if bottom else 1.0)
    prune = np.arange(len(rows)) % 3 == 2  # rows come by hash of the id
    return learn(values, rows["bad"].to_numpy(bool), prune)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", name: str = "_stats") -> DataFrame:
    """Adds ``name`` (the counts and ``base_failed``, ``rule``, ``kept``) to every row; all texts are read whole.

    A missing or empty text has no words and so fails.  A column called ``name`` is replaced.
    """
    failed = base_failed(name)
    rule = F.when(~failed, rules.column(name))
    return with_stats(docs, text, name).withColumn(name, F.struct(
        f"{name}.*", failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", *[f"_stats.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])
