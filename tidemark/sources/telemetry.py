"""Streams of logs, metrics, spans, alerts and token events from landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql import functions as F

from tidemark.operators.logs import ALERT_SCHEMA
from tidemark.operators.metrics import TENANT
from tidemark.operators.traces import TRACE_SCHEMA, nanos_to_timestamp

LOG_SCHEMA = "ts TIMESTAMP, seq BIGINT, labels MAP<STRING, STRING>, line STRING"
METRIC_SCHEMA = "ts TIMESTAMP, metric STRING, labels MAP<STRING, STRING>, value DOUBLE"
SSE_SCHEMA = "request_id STRING, seq BIGINT, ts TIMESTAMP, raw STRING"

MAX_FILES = 1024

# Names the collector gives to the labels of a pod.
POD_LABELS = {"pod": "k8s_pod_name", "namespace": "k8s_namespace_name"}


def _json_stream(spark: SparkSession, path: str, schema: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def log_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Log lines with ``pod`` and ``namespace`` from their labels, as alerts look them up."""
    label = lambda name: F.coalesce(F.col("labels")[name], F.col("labels")[POD_LABELS[name]]).alias(name)
    return _json_stream(spark, path, LOG_SCHEMA, max_files).select("*", label("pod"), label("namespace"))


def metric_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    return _json_stream(spark, path, METRIC_SCHEMA, max_files)


def trace_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Search hits with ``ts``, the start of the trace."""
    return _json_stream(spark, path, f"rootServiceName STRING, {TRACE_SCHEMA}", max_files).withColumn("ts", nanos_to_timestamp(F.col("startTimeUnixNano")))


def alert_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Alert payloads with ``alert_id`` and ``ts``.

    A webhook sends neither, so where the landed payload has none, the id is a hash of the
    file and the payload, and the time that of the file.
    """
    landed = _json_stream(spark, path, f"alert_id BIGINT, ts TIMESTAMP, {ALERT_SCHEMA}", max_files)
    own = F.xxhash64(F.col("_metadata.file_path"), "status", F.to_json("alerts"))
    return landed.select(F.coalesce("alert_id", own).alias("alert_id"), F.coalesce("ts", "_metadata.file_modification_time").alias("ts"), "status", "alerts")


def sse_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    return _json_stream(spark, path, SSE_SCHEMA, max_files)


def tenant_sink(df: DataFrame, path: str, checkpoint: str, tenant: str = TENANT) -> DataStreamWriter:
    """Parquet by tenant and day, the layout that range filters and retention prune.

    A micro-batch overwrites its own folders only, so running it again changes nothing.
    There is no log of files beside the table: old days can simply be deleted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "date", "batch_id").parquet(path))

    rows = df.withColumn("tenant", F.lit(tenant)).withColumn("date", F.to_date("ts"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
