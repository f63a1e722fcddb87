"""Streams that keep tables up to date.

A batch that is run again after a failure replaces what it wrote before: its own ``batch_id`` folder, or its entry in
the generations of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators.facts import drop_overwritten, kind_marks, merge_facts, merge_marks
from tidemark.operators.logs import LOOK_BACK_HOURS, alert_logs, alert_view, diagnosis_prompt, needs_diagnosis
from tidemark.operators.traces import flatten_traces, root_span_filter
from tidemark.sources.generations import FAN, Generations, Parts
from tidemark.streaming import BATCH_SECONDS


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(writer: DataStreamWriter, every: str | None = BATCH_SECONDS) -> StreamingQuery:
    """Start with a processing-time trigger, or drain what is there (``every=None``)."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


# --- three signals, three stores ---------------------------------------------

def route_signals(source: DataFrame, enrich: Callable[[DataFrame], DataFrame], paths: Mapping[str, str],
                  checkpoint: str, every: str | None = BATCH_SECONDS) -> list[StreamingQuery]:
    """One query per signal: filter, enrich, write to the signal's own store by day."""
    queries = []
    for signal, path in paths.items():
        out = enrich(source.filter(F.col("signal") == signal)).withColumn("date", F.to_date("ts"))
        writer = (out.writeStream.format("parquet").partitionBy("date").outputMode("append")
                  .option("path", path).option("checkpointLocation", f"{checkpoint}/{signal}"))
        queries.append(start(writer, every))
    return queries


# --- retention ---------------------------------------------------------------

def retained(df: DataFrame, as_of: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows not older than the retention time."""
    return df.filter(F.col(ts) >= F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(hours)))


def expire(spark: SparkSession, path: str, as_of: str, hours: int = 24) -> list[str]:
    """Delete day folders that lie wholly before the retention time; returns their names."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = spark.range(1).select(F.date_format(
        F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd")).first()[0]
    gone = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/date=*")):
        name = status.getPath().getName()
        if name.split("=", 1)[1] < oldest:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


# --- feed --------------------------------------------------------------------

def newest_rows(parts: Parts) -> Parts:
    """One row per trace: the one of its latest micro-batch, of several there the one of the latest time."""
    rows = parts["rows"]
    fields = [c for c in rows.columns if c != "trace_id"]
    newest = rows.groupBy("trace_id").agg(F.max_by(F.struct(*fields), F.struct("batch_id", "ts")).alias("_r"))
    return {"rows": newest.select("trace_id", "_r.*")}


def feed_updates(traces: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> DataStreamWriter:
    """Keep the newest state of each trace; old batches are folded, a batch that is run again changes nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = flatten_traces(root_span_filter(batch)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        Generations(batch.sparkSession, path, newest_rows, fan).add(batch_id, newest_rows({"rows": rows}))

    return each_batch(traces, handle, checkpoint)


def feed_view(spark: SparkSession, path: str) -> DataFrame:
    """One row per trace: the one of its latest micro-batch."""
    return Generations(spark, path, newest_rows).read()["rows"].drop("batch_id")


# --- alerts ------------------------------------------------------------------

def alert_diagnoses(alerts: DataFrame, logs: Callable[[], DataFrame], path: str, checkpoint: str,
                    look_back_hours: int = LOOK_BACK_HOURS) -> DataStreamWriter:
    """Diagnosis input of each firing alert against the log table as it is then."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        firing = needs_diagnosis(alert_view(batch)).withColumn("alert_key", F.struct("alert_id", "alert_no"))
        texts = alert_logs(firing, logs(), alert_id="alert_key", look_back_hours=look_back_hours).select("alert_key", "log_text")
        out = firing.join(texts, "alert_key").select(
            "alert_id", "alert_no", "pod", "namespace", "log_text",
            diagnosis_prompt(F.col("full_description"), F.col("log_text")).alias("prompt"))
        write_batch(out, path, batch_id)

    return each_batch(alerts, handle, checkpoint)


# --- knowledge base ----------------------------------------------------------

def surviving_facts(parts: Parts) -> Parts:
    """Facts that no later value of another kind replaces, and per path the last number of each kind ever seen.

    These numbers only grow, so a fact that is dropped once stays dropped whatever comes later, late facts included:
    folding batches in any grouping gives what one merge of all facts gives.
    """
    marks = merge_marks(parts["marks"])
    return {"facts": drop_overwritten(parts["facts"], marks), "marks": marks}


def fact_updates(facts: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> DataStreamWriter:
    """Keep a knowledge base: a batch reads and writes its own facts, and older ones only when folders are folded."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        Generations(batch.sparkSession, path, surviving_facts, fan).add(batch_id, surviving_facts({"facts": batch, "marks": kind_marks(batch)}))

    return each_batch(facts, handle, checkpoint)


def merged_view(spark: SparkSession, path: str) -> DataFrame:
    """The merged knowledge base of all batches so far."""
    return merge_facts(Generations(spark, path, surviving_facts).read()["facts"])
