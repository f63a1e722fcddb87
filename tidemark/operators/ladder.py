"""Analysis of load-test results: result grid, pass counts, largest stable context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan

# Line shapes of the load-test log and context steps.
HEADER_PATTERN = r"^Testing (\S+) \| Context: (\d+) tokens"
SUCCESS_PATTERN = r"SUCCESS: ([0-9.]+)s \(Actual tokens: (\d+)\)"
ERROR_PATTERN = r"^\s*Error (\d+):|^\s*Exception:"
STAGES = list(range(10_000, 80_001, 10_000))
CONTEXT_STEP = 8_000


def parse_log_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes in a load-test log, each with the test header above it.

    ``lines``: keys, ``line_no``, ``line``.  Only header and outcome lines are scanned.
    """
    header = F.rlike("line", F.lit(HEADER_PATTERN))
    ok = F.rlike("line", F.lit(SUCCESS_PATTERN))
    failed = F.rlike("line", F.lit(ERROR_PATTERN))
    take = lambda pattern, n: F.regexp_extract("line", pattern, n)
    marked = lines.filter(header | ok | failed).select(
        *keys, "line_no", header.alias("is_header"),
        F.when(header, take(HEADER_PATTERN, 1)).alias("model"),
        F.when(header, take(HEADER_PATTERN, 2).cast("bigint")).alias("target"),
        F.when(ok, take(SUCCESS_PATTERN, 1).cast("double")).alias("seconds"),
        F.when(ok, take(SUCCESS_PATTERN, 2).cast("bigint")).alias("actual"))
    seen = prefix_scan(marked, keys, ["line_no"], maxes={
        "_h": F.when(F.col("is_header"), F.struct("line_no", "model", "target"))})
    return seen.filter(~F.col("is_header")).select(
        *keys, "line_no", F.col("_h.model").alias("model"), F.col("_h.target").alias("target"),
        F.round("seconds", 2).alias("seconds"), "actual",
        F.when(F.col("seconds").isNotNull(), "PASS").otherwise("FAIL").alias("status"))


def result_grid(results: DataFrame, stages: Sequence[int] = tuple(STAGES)) -> DataFrame:
    """Every model at every stage; a cell without a passing result is FAIL.

    The grid comes from exploding the stage list per model, so nothing is cross-joined.
    """
    grid = results.select("model").distinct().withColumn(
        "target", F.explode(F.array(*[F.lit(s).cast("bigint") for s in stages])))
    passed = results.filter("status = 'PASS'").groupBy("model", "target").agg(
        F.count(F.lit(1)).alias("runs"), F.min("seconds").alias("best_seconds"))
    return grid.join(passed, ["model", "target"], "left").select(
        "model", "target", F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"),
        F.round("best_seconds", 2).alias("seconds"),
        F.when(F.col("runs").isNotNull(), "PASS").otherwise("FAIL").alias("status"))


def pass_counts(grid: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return grid.groupBy(*by).agg(F.count_if(F.col("status") == "PASS").alias("passed"),
                                 F.count(F.lit(1)).alias("cells"))


def pivot_grid(grid: DataFrame, models: Sequence[str]) -> DataFrame:
    """Targets by models; the model list is given, so Spark needs no extra pass to find it."""
    return grid.groupBy("target").pivot("model", list(models)).agg(F.first("status"))


def max_stable_context(results: DataFrame, key: str = "model", size: str = "ctx", ok: str = "ok") -> DataFrame:
    """Largest size below the first failure per model (null when the first step fails)."""
    # One row per model and size from here on, however many runs there are.
    steps = results.groupBy(key, size).agg(F.min(F.col(ok).cast("int")).alias("_ok"))
    first_fail = steps.groupBy(key).agg(F.min(F.when(F.col("_ok") == 0, F.col(size))).alias("first_fail"))
    return steps.join(first_fail, key).groupBy(key).agg(
        F.max(F.when(F.col("first_fail").isNull() | (F.col(size) < F.col("first_fail")), F.col(size))).alias("max_ctx"),
        F.max("first_fail").alias("first_fail"))
