"""Token accounting and cost of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan

from tidemark.functions.text import est_tokens

# Prices in USD per million tokens.
INPUT_PRICE = 5.00
OUTPUT_PRICE = 15.00
FLAT_PRICE = 12.50


def all_calls(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Local and cloud call lists as one table with ``is_local``."""
    return (local.withColumn("is_local", F.lit(True))
            .unionByName(cloud.withColumn("is_local", F.lit(False))))


def _tokens():
    return (F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            F.count(F.lit(1)).alias("calls"))


def fill_usage(calls: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Token counts of calls whose reply brought none: estimated from the texts."""
    missing = F.coalesce("prompt_tokens", F.lit(0)) == 0
    return calls.withColumns({
        "prompt_tokens": F.when(missing, est_tokens(F.col(prompt))).otherwise(F.col("prompt_tokens")),
        "completion_tokens": F.when(missing, est_tokens(F.col(reply))).otherwise(F.col("completion_tokens"))})


def usage_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(*_tokens())


def usage_by_locality(calls: DataFrame) -> DataFrame:
    """Rows Local, Cloud and TOTAL."""
    kind = F.when(F.col("is_local"), "Local").otherwise("Cloud")
    return (calls.withColumn("kind", kind).rollup("kind").agg(*_tokens())
            .withColumn("kind", F.coalesce("kind", F.lit("TOTAL"))))


def _cost(prompt, completion):
    rate = lambda p: F.lit(p).cast("decimal(10,2)")
    million = F.lit(1_000_000).cast("decimal(10,0)")
    return ((prompt.cast("decimal(24,0)") * rate(INPUT_PRICE)
             + completion.cast("decimal(24,0)") * rate(OUTPUT_PRICE)) / million)


def cost_report(calls: DataFrame) -> DataFrame:
    """One row: cost had local calls run in the cloud, actual cloud cost, savings (4 decimals)."""
    side = lambda flag, c: F.coalesce(F.sum(F.when(F.col("is_local") == flag, F.col(c))), F.lit(0).cast("bigint"))
    sums = calls.agg(
        side(True, "prompt_tokens").alias("lp"), side(True, "completion_tokens").alias("lo"),
        side(False, "prompt_tokens").alias("cp"), side(False, "completion_tokens").alias("co"),
        F.count(F.lit(1)).alias("calls"))
    out = lambda c: F.round(c, 4).cast("double")
    return sums.select(
        "calls", out(_cost(F.col("lp"), F.col("lo"))).alias("equivalent_cost"),
        out(_cost(F.col("cp"), F.col("co"))).alias("actual_cost"),
        out(_cost(F.col("lp"), F.col("lo"))).alias("savings"))


def flat_savings(tokens):
    """Savings at one flat price per million tokens."""
    return tokens / F.lit(1_000_000) * F.lit(FLAT_PRICE)


def money(c):
    """``$1,234.5000`` style; plain digits as a report prints them are ``format_cost``."""
    return F.concat(F.lit("$"), F.format_number(c, 2))


def format_cost(c):
    return F.printf(F.lit("$%.4f"), c)


def thousands(c):
    return F.format_number(c, 0)


def token_counter(calls: DataFrame, step: str = "15 seconds") -> DataFrame:
    """Counters per model as a gateway exports them: running token totals at each step.

    Calls are summed per (model, step) first, so the running total handles one row
    per model and step, however many calls a model has.
    """
    per_step = (calls.groupBy("model", F.window("ts", step).alias("w"))
                .agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c")))
    steps = per_step.select("model", F.col("w.end").alias("ts"), "p", "c")
    before = prefix_scan(steps, ["model"], ["ts"], sums={"_p": F.col("p"), "_c": F.col("c")})
    return before.select("model", "ts", (F.col("_p") + F.col("p")).alias("input_tokens_total"), (F.col("_c") + F.col("c")).alias("output_tokens_total"))


def usage_report(calls: DataFrame, run_date: str, minutes: float) -> DataFrame:
    """Markdown usage report as ordered lines (``line_no``, ``line``)."""
    usage = usage_by_locality(calls)
    rank = F.when(F.col("kind") == "Local", 20).when(F.col("kind") == "Cloud", 21).otherwise(22)
    bold = lambda c: F.when(F.col("kind") == "TOTAL", F.concat(F.lit("**"), c, F.lit("**"))).otherwise(c)
    cells = [bold(F.col("kind"))] + [bold(thousands(F.col(c))) for c in
                                     ("prompt_tokens", "completion_tokens", "total_tokens")]
    table = usage.select(rank.alias("line_no"), F.concat(
        F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    cost = cost_report(calls)
    row = lambda label, c: F.concat(F.lit(f"| {label} | "), c, F.lit(" |"))
    lines = cost.select(F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("# Usage report").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit(f"**Run date:** {run_date}  ").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.lit(f"**Duration:** {minutes:.1f} minutes  ").alias("line")),
        F.struct(F.lit(3).alias("line_no"), F.concat(
            F.lit("**Total calls:** "), F.col("calls").cast("string"), F.lit("  ")).alias("line")),
        F.struct(F.lit(10).alias("line_no"), F.lit("| Type | Prompt Tokens | Output Tokens | Total |").alias("line")),
        F.struct(F.lit(11).alias("line_no"), F.lit("|------|--------------:|--------------:|------:|").alias("line")),
        F.struct(F.lit(30).alias("line_no"), F.lit("| Metric | Cost (USD) |").alias("line")),
        F.struct(F.lit(31).alias("line_no"), F.lit("|--------|----------:|").alias("line")),
        F.struct(F.lit(32).alias("line_no"), F.lit("| Local inference | $0.0000 |").alias("line")),
        F.struct(F.lit(33).alias("line_no"), row("Actual cloud cost", format_cost(F.col("actual_cost"))).alias("line")),
        F.struct(F.lit(34).alias("line_no"), row("Equivalent cloud cost", format_cost(F.col("equivalent_cost"))).alias("line")),
        F.struct(F.lit(35).alias("line_no"), row("**Total savings**", F.concat(
            F.lit("**"), format_cost(F.col("savings")), F.lit("**"))).alias("line")),
    )).alias("x")).select("x.line_no", "x.line")
    return lines.unionByName(table)
