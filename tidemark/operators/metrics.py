"""Label rules, counter rates and the dashboard aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits and steps of the metric pipeline.
MAX_LABEL_NAMES = 200
RATE_SECONDS = 60
STEP_SECONDS = 15
GIB = 1024 ** 3
TENANT = "anonymous"


# --- labels -----------------------------------------------------------------

def matches(labels: Column, rules: Mapping[str, tuple[str, str]]) -> Column:
    """Label matchers: ``=``, ``!=``, and the anchored ``=~``, ``!~``.  A missing label is empty text."""
    ok = F.lit(True)
    for name, (op, value) in rules.items():
        have = F.coalesce(labels[name], F.lit(""))
        anchored = F.rlike(have, F.lit(f"^(?:{value})$"))
        ok = ok & {"=": have == value, "!=": have != value, "=~": anchored, "!~": ~anchored}[op]
    return ok


@dataclass(frozen=True)
class Rule:
    """One relabelling rule; the defaults are those of the scrape configuration format."""

    target: str = ""
    sources: Sequence[str] = ()
    regex: str = "(.*)"
    replacement: str = "$1"
    separator: str = ";"
    action: str = "replace"


def relabel(df: DataFrame, rules: Sequence[Rule], labels: str = "labels") -> DataFrame:
    """Apply the rules in order to the label map: one filter and one projection, no shuffle.

    The labels that rules read or write are held as columns of one struct meanwhile.
    Empty results remove the label, as the format says.
    """
    names = list(dict.fromkeys([s for r in rules for s in r.sources] + [r.target for r in rules if r.target]))
    out = df.select("*", *[F.coalesce(F.col(labels)[n], F.lit("")).alias(f"_l{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"_l{i}") for i, n in enumerate(names)}
    for rule in rules:
        joined = F.concat_ws(rule.separator, *[at[s] for s in rule.sources]) if rule.sources else F.lit("")
        pattern = f"^(?:{rule.regex})$"
        hit = F.rlike(joined, F.lit(pattern))
        if rule.action == "keep":
            out = out.filter(hit)
        elif rule.action == "drop":
            out = out.filter(~hit)
        elif rule.action != "replace":
            raise ValueError(f"unknown action {rule.action!r}")
        else:
            value = F.regexp_replace(joined, F.lit(pattern), F.lit(rule.replacement))
            column = f"_l{names.index(rule.target)}"
            out = out.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
    written = list(dict.fromkeys(r.target for r in rules if r.action == "replace"))
    fresh = F.map_from_arrays(F.array(*[F.lit(n) for n in written]),
                              F.array(*[F.col(f"_l{names.index(n)}") for n in written]))
    kept = F.map_filter(F.col(labels), lambda k, v: ~k.isin(written))
    merged = F.map_filter(F.map_concat(kept, fresh), lambda k, v: v != "") if written else F.col(labels)
    return out.withColumn(labels, merged).select(*df.columns)


def series_admission(df: DataFrame, limit: int = MAX_LABEL_NAMES, labels: str = "labels") -> tuple[DataFrame, DataFrame]:
    """(series with at most ``limit`` label names, the rest)."""
    fits = F.coalesce(F.size(F.map_keys(labels)), F.lit(0)) <= limit
    return df.filter(fits), df.filter(~fits)


def resource_to_labels(resource: Column, labels: Column) -> Column:
    """Resource attributes become labels; a label of the same name wins."""
    return F.map_zip_with(resource, labels, lambda k, r, l: F.coalesce(l, r))


def enrich_pods(df: DataFrame, pods: DataFrame, key: str = "pod_uid") -> DataFrame:
    """Add pod attributes.  A left join: Spark broadcasts the pods only when their measured
    size is below its threshold and shuffles both sides otherwise."""
    return df.join(pods.withColumnRenamed("uid", key), key, "left")


def series_key(labels: Column) -> Column:
    """Text key of a label map that does not depend on the order of its entries."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


# --- rates ------------------------------------------------------------------

def counter_deltas(samples: DataFrame, keys: Sequence[str], bucket_seconds: int = 3600) -> DataFrame:
    """Increase per series and second, and the last value there; after a reset a sample adds its whole value.

    Every sample is compared with the one before it, also inside a second; a series has
    one sample per instant (of several the largest).  Series are cut into time buckets of
    ``bucket_seconds``.  The last sample of a bucket is repeated at the head of the next bucket
    that has samples (found on one row per bucket), so the first sample there has its predecessor.
    """
    keys = list(keys)
    rows = (samples.groupBy(*keys, F.unix_micros("ts").alias("_us")).agg(F.max("value").alias("value"))
            .withColumn("_b", F.expr(f"_us div {int(bucket_seconds) * 1_000_000}")))
    following = Window.partitionBy(*keys).orderBy("_b")
    heads = (rows.groupBy(*keys, "_b").agg(F.max("_us").alias("_us"), F.max_by("value", "_us").alias("value"))
             .withColumn("_b", F.lead("_b").over(following)).filter(F.col("_b").isNotNull()))
    columns = [*keys, "_us", "value", "_b"]
    both = (rows.select(*columns, F.lit(False).alias("_head"))
            .unionByName(heads.select(*columns, F.lit(True).alias("_head"))))
    prev = F.lag("value").over(Window.partitionBy(*keys, "_b").orderBy("_us"))
    delta = (F.when(F.col("_prev").isNull(), 0.0).when(F.col("value") < F.col("_prev"), F.col("value"))
             .otherwise(F.col("value") - F.col("_prev")))
    return (both.withColumn("_prev", prev).filter(~F.col("_head")).withColumn("_delta", delta)
            .groupBy(*keys, F.expr("_us div 1000000").alias("sec"))
            .agg(F.max_by("value", "_us").alias("value"),
                 F.sum(F.col("_delta").cast("decimal(30,6)")).cast("double").alias("delta")))


def counter_rate(samples: DataFrame, keys: Sequence[str], seconds: int = RATE_SECONDS) -> DataFrame:
    """Increase per second over (t - seconds, t] at each sample, aware of resets.

    The window is cut into buckets of 16 ranges; rows near the end of a bucket are
    repeated in the next one as context, so no window holds a whole series.
    """
    keys, width = list(keys), seconds * 16
    deltas = counter_deltas(samples, keys)
    bucket = F.expr(f"sec div {width}")
    spill = F.expr(f"(sec + {seconds - 1}) div {width}")
    copies = deltas.select("*", F.explode(F.array_distinct(F.array(bucket, spill))).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("sec").rangeBetween(-(seconds - 1), 0)
    total = F.sum(F.col("delta").cast("decimal(30,6)")).over(w)
    return (copies.withColumn("rate", total.cast("double") / F.lit(seconds))
            .filter(F.col("_b") == bucket).select(*keys, "sec", "value", "rate"))


def sum_rate(samples: DataFrame, keys: Sequence[str], by: Sequence[str] = (), seconds: int = RATE_SECONDS,
             step: int = STEP_SECONDS) -> DataFrame:
    """Summed rate of all series at each step: ``sum(rate(counter[range]))``.

    An increase counts in every step whose range covers it, so it is sent to those steps
    and added up; partial sums are made before the shuffle.  Every step with samples in its
    range has a row, with 0 where nothing grew.
    """
    return rate_from_deltas(counter_deltas(samples, keys), by, seconds, step)


def rate_from_deltas(deltas: DataFrame, by: Sequence[str] = (), seconds: int = RATE_SECONDS,
                     step: int = STEP_SECONDS) -> DataFrame:
    first = F.expr(f"(sec + {step - 1}) div {step} * {step}")
    steps = F.sequence(first, F.expr(f"(sec + {seconds - 1}) div {step} * {step}"), F.lit(step).cast("bigint"))
    return (deltas.select(*by, "delta", F.explode(steps).alias("at_sec"))
            .groupBy(*by, "at_sec")
            .agg((F.sum(F.col("delta").cast("decimal(30,6)")).cast("double") / F.lit(seconds)).alias("rate")))


def sum_gauge(samples: DataFrame, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Sum of gauges per instant, optionally scaled (bytes to GiB: ``1 / GIB``)."""
    return samples.groupBy(*by, "ts").agg(
        (F.sum(F.col("value").cast("decimal(30,6)")).cast("double") * F.lit(scale)).alias("value"))


def raw_gauge(samples: DataFrame, metric: str, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    return samples.filter((F.col("metric") == metric) & matches(F.col("labels"), rules))


def either(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows, and right rows whose instant and labels the left lacks."""
    return left.unionByName(right.join(left.select(*on), list(on), "left_anti"))


def to_gib(bytes_: Column) -> Column:
    return bytes_ / F.lit(float(GIB))


def to_ms(seconds: Column) -> Column:
    return seconds * 1000
