"""Streaming queries drained over the test tables; their results are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import metrics
from tidemark.session import scratch_folder
from tidemark.sources import telemetry
from tidemark.sources.files import folders_of
from tidemark.streaming import tables, windows
from tidemark.streaming.replies import STATE_STORE, stream_replies, use_state_store


def _stream(spark, folder: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    if folders_of(spark, folder, f"{name}.parquet"):  # a table in parts
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _events(spark, folder: str) -> DataFrame:
    return (_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.get_json_object("props", "$.k").cast("bigint")))


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is there and read its parquet output."""
    spark = df.sparkSession
    root = scratch_folder(spark, name)
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state"))
    tables.start(writer, every=None).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_metric_windows", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS step_start, event_type, n, total FROM (
  SELECT time_bucket(INTERVAL 15 SECOND, ts) AS w, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(30, 6))) AS DOUBLE) AS total
  FROM events GROUP BY 1, 2) WHERE w + INTERVAL 15 SECOND <= {CLOSED}""")
def stream_metric_windows(spark, folder):
    out = _drain(windows.metric_windows(_events(spark, folder), ["event_type"]), "metric-windows")
    return out.withColumn("step_start", F.date_format("step_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sliding_sum", f"""
SELECT strftime(w + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS at, event_type, CAST(sum(CAST(value AS DECIMAL(30, 6))) AS DOUBLE) AS increase
FROM (SELECT time_bucket(INTERVAL 15 SECOND, ts) - to_seconds(15 * i) AS w, event_type, value FROM events, range(0, 4) t(i))
WHERE w + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY w, event_type""")
def stream_sliding_sum(spark, folder):
    deltas = _events(spark, folder).withColumn("delta", F.col("value"))
    return _drain(windows.sliding_sum(deltas, ["event_type"]), "sliding-sum").withColumn(
        "at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_counter_rate", I.extend("""
SELECT at_sec, round(CAST(sum(CAST(delta AS DECIMAL(30, 6))) AS DOUBLE) / 60, 6) AS rate
FROM closed, LATERAL (SELECT unnest(range((sec + 14) // 15 * 15, (sec + 59) // 15 * 15 + 1, 15)) AS at_sec)
GROUP BY at_sec""", {"closed": """SELECT us // 1000000 AS sec, delta FROM steps_up
  WHERE us <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000"""}, "steps_up"))
def stream_counter_rate(spark, folder):
    """Samples that the watermark has passed; later ones wait for earlier ones that may still come."""
    text = lambda c: F.col(c).cast("string")
    labels = F.create_map(F.lit("model"), "event_type", F.lit("pod"), F.concat(F.lit("m-"), (F.col("k") % 3).cast("string")), F.lit("user"), text("user_id"))
    metric = F.when(F.col("k") % 2 == 0, "requests_total").otherwise("tokens_total")
    samples = _events(spark, folder).select(F.concat(metric, metrics.series_key(labels)).alias("series"), "ts", "value")
    deltas = _drain(windows.counter_increases(samples), "counter-increases")
    return metrics.rate_from_deltas(deltas).withColumn("rate", F.round("rate", 6))


@query("stream_routes", """
SELECT CASE event_type WHEN 'view' THEN 'logs' WHEN 'click' THEN 'traces' ELSE 'metrics' END AS signal, c_name AS pod, count(*) AS n
FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2""")
def stream_routes(spark, folder):
    root = scratch_folder(spark, "routes")
    pods = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("pod"))
    signal = F.when(F.col("event_type") == "view", "logs").when(F.col("event_type") == "click", "traces").otherwise("metrics")
    source = _events(spark, folder).select("ts", F.col("user_id").alias("pod_uid"), signal.alias("signal"))
    paths = {s: f"{root}/{s}" for s in ("logs", "traces", "metrics")}
    for q in tables.route_signals(source, lambda df: metrics.enrich_pods(df, pods), paths, f"{root}/state", every=None):
        q.awaitTermination()
    stores = [spark.read.parquet(p).groupBy("signal", "pod").agg(F.count(F.lit(1)).alias("n")) for p in paths.values()]
    return stores[0].unionByName(stores[1]).unionByName(stores[2])


REPLY_PART = 20

# Events are the tokens, a broken one, the usage and the end mark (n + 1 to n + 3); a part is out when the reply was silent
# for five minutes or an event of a later part (the late one, n + 4, too) is older than the watermark.
@query("stream_replies", I.sql(f"""
SELECT request_id, p AS part_no, coalesce(string_agg(token, '' ORDER BY seq) FILTER (seq < n), '') AS text,
  CASE WHEN (n + 2) // {REPLY_PART} <= p THEN any_value(turn) * 10 END AS prompt_tokens,
  CASE WHEN (n + 2) // {REPLY_PART} <= p THEN n END AS completion_tokens,
  (n + 3) // {REPLY_PART} = p AS ended, (n + 3) // {REPLY_PART} = p AS last
FROM (SELECT *, seq // {REPLY_PART} AS p, at0 + (n + 5) * 0.025 + 300 <= w AS closed,
    at0 + 0.025 * (1 + CASE WHEN (seq // {REPLY_PART} + 1) * {REPLY_PART} = n THEN n + 1 ELSE (seq // {REPLY_PART} + 1) * {REPLY_PART} END) <= w
      AND (seq // {REPLY_PART} + 1) * {REPLY_PART} <= n + 4 AS passed
  FROM (SELECT request_id, turn, n, seq, token, conv_id * 60 + turn AS at0 FROM tokens
        UNION ALL SELECT request_id, any_value(turn), n, n + unnest([1, 2, 3]), '', any_value(conv_id * 60 + turn) FROM tokens GROUP BY request_id, n),
    (SELECT max(conv_id * 60 + turn + (n + 5) * 0.025) - 600 AS w FROM tokens))
WHERE closed OR passed GROUP BY request_id, n, p""", "tokens"))
def stream_replies_query(spark, folder):
    root = scratch_folder(spark, "sse")
    I.sse_lines(spark, folder).write.parquet(root)
    lines = spark.readStream.schema("request_id STRING, seq BIGINT, ts TIMESTAMP, raw STRING").parquet(root)
    kept = spark.conf.get(STATE_STORE[0])
    use_state_store(spark)
    try:
        return _drain(stream_replies(lines, part_events=REPLY_PART), "replies")
    finally:
        spark.conf.set(STATE_STORE[0], kept)


@query("stream_facts", I.sql("SELECT seq, pos, path, kind, value FROM merged", "merged"))
def stream_facts(spark, folder):
    """Facts land in four files, one micro-batch each; the kept state equals one merge of all."""
    root = scratch_folder(spark, "facts")
    I.facts(spark, folder).repartitionByRange(4, "seq").write.parquet(f"{root}/in")
    stream = (spark.readStream.schema("seq BIGINT, pos BIGINT, path ARRAY<STRING>, kind STRING, value STRING")
              .option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    tables.start(tables.fact_updates(stream, f"{root}/kb", f"{root}/state"), every=None).awaitTermination()
    return tables.merged_view(spark, f"{root}/kb").withColumn("path", F.array_join("path", "."))


@query("stream_feed", I.sql("""
SELECT trace_id, epoch_us(max(ts)) AS us, arg_max(model, ts) AS model, arg_max(source, ts) AS source FROM feed GROUP BY trace_id""", "feed"))
def stream_feed(spark, folder):
    from tidemark.operators.traces import TRACE_SCHEMA
    root = scratch_folder(spark, "feed")
    I.traces(spark, folder).drop("event_id", "ts").write.json(f"{root}/in")
    stream = spark.readStream.schema(TRACE_SCHEMA).json(f"{root}/in")
    tables.start(tables.feed_updates(stream, f"{root}/feed", f"{root}/state"), every=None).awaitTermination()
    return tables.feed_view(spark, f"{root}/feed").select("trace_id", F.unix_micros("ts").alias("us"), "model", "source")


@query("stream_diagnoses", I.extend("SELECT alert_id, alert_no, pod, log_text FROM al", {"al": """
SELECT alert_id, alert_no, any_value(l.pod) AS pod, coalesce(string_agg(l.line, chr(10) ORDER BY l.ts, l.seq) FILTER (rn <= 50),
  'No logs found or Loki unreachable.') AS log_text
FROM (SELECT a.alert_id, a.alert_no, a.pod, g.ts, g.seq, g.line, row_number() OVER (PARTITION BY a.alert_id, a.alert_no ORDER BY g.ts DESC, g.seq DESC) AS rn
      FROM (SELECT * FROM alerts WHERE needs_diagnosis) a
      LEFT JOIN logs g ON g.pod = a.pod AND g.namespace = a.namespace AND g.ts <= a.ts AND g.ts >= a.ts - INTERVAL 1 HOUR) l
GROUP BY alert_id, alert_no"""}, "alerts", "logs"))
def stream_diagnoses(spark, folder):
    root = scratch_folder(spark, "alerts")
    I.alert_payloads(spark, folder).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    writer = tables.alert_diagnoses(stream, lambda: I.logs(spark, folder), f"{root}/out", f"{root}/state")
    tables.start(writer, every=None).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("alert_id", "alert_no", "pod", "log_text")


@query("stream_alert_logs", I.extend("SELECT alert_id, alert_no, pod, log_text FROM al", {"al": """
SELECT alert_id, alert_no, any_value(l.pod) AS pod, coalesce(string_agg(l.line, chr(10) ORDER BY l.ts, l.seq) FILTER (rn <= 50),
  'No logs found or Loki unreachable.') AS log_text
FROM (SELECT a.alert_id, a.alert_no, a.pod, g.ts, g.seq, g.line, row_number() OVER (PARTITION BY a.alert_id, a.alert_no ORDER BY g.ts DESC, g.seq DESC) AS rn
      FROM (SELECT * FROM alerts WHERE needs_diagnosis) a
      LEFT JOIN logs g ON g.pod = a.pod AND g.namespace = a.namespace AND g.ts <= a.ts AND g.ts >= a.ts - INTERVAL 24 HOUR) l
GROUP BY alert_id, alert_no"""}, "alerts", "logs"))
def stream_alert_logs(spark, folder):
    """Landed lines go through the log stream into the tenant store, landed alerts through the alert stream against it."""
    root = scratch_folder(spark, "landed")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    labels = F.create_map(F.lit("pod"), "pod", F.lit("k8s_namespace_name"), "namespace")
    I.logs(spark, folder).select("ts", "seq", labels.alias("labels"), "line").write.options(**exact).json(f"{root}/lines")
    I.alert_payloads(spark, folder).write.options(**exact).json(f"{root}/alerts")
    lines = telemetry.log_stream(spark, f"{root}/lines")
    tables.start(telemetry.tenant_sink(lines, f"{root}/store", f"{root}/a"), every=None).awaitTermination()
    store = lambda: spark.read.parquet(f"{root}/store").select("ts", "seq", "pod", "namespace", "line")
    alerts = telemetry.alert_stream(spark, f"{root}/alerts")
    tables.start(tables.alert_diagnoses(alerts, store, f"{root}/out", f"{root}/b", look_back_hours=24), every=None).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("alert_id", "alert_no", "pod", "log_text")


@query("stream_trace_store", I.sql("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM feed GROUP BY 1", "feed"))
def stream_trace_store(spark, folder):
    """Traces stored by tenant and day of their start, flattened when read."""
    from tidemark.operators.traces import flatten_traces, root_span_filter
    root = scratch_folder(spark, "spans")
    I.traces(spark, folder).drop("event_id", "ts").write.json(f"{root}/in")
    stream = telemetry.trace_stream(spark, f"{root}/in")
    tables.start(telemetry.tenant_sink(stream, f"{root}/store", f"{root}/state"), every=None).awaitTermination()
    kept = flatten_traces(root_span_filter(spark.read.parquet(f"{root}/store")), ["date"])
    return kept.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))
