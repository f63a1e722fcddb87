"""Traces, logs, alerts, metrics, token streams and load tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import ladder, logs, metrics, replies, traces
from tidemark.operators.metrics import Rule

STAMP = "yyyy-MM-dd HH:mm:ss"
D6 = lambda c: F.round(c, 6)


def _micros(c="ts"):
    return F.unix_micros(c).alias("us")


# --- traces -----------------------------------------------------------------

FEED_COLUMNS = "epoch_us(ts) AS us, trace_id, model, input_tokens, output_tokens, duration_ms, prompt, source"


def _feed(spark, folder):
    return traces.flatten_traces(traces.root_span_filter(I.traces(spark, folder)))


def _steps(spark, folder):
    """The feed with the id of each step."""
    hits = traces.root_span_filter(I.traces(spark, folder)).withColumnRenamed("event_id", "step_id")
    return traces.flatten_traces(hits, ["step_id"])


@query("flatten_traces", I.sql(f"SELECT {FEED_COLUMNS} FROM feed", "feed"))
def flatten_traces(spark, folder):
    f = _feed(spark, folder)
    return f.select(_micros(), *f.columns[1:])


@query("trace_feed", I.sql(f"""SELECT {FEED_COLUMNS} FROM feed WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR
  AND ts <= TIMESTAMP '2024-01-31 00:00:00' AND contains(lower(prompt), 'view') ORDER BY ts DESC, trace_id LIMIT 50""", "feed"))
def trace_feed(spark, folder):
    f = traces.time_range(_feed(spark, folder), "2024-01-31 00:00:00", 240)
    return traces.newest(traces.feed_search(f, "View")).select(_micros(), *f.columns[1:])


PARTED = """
SELECT *, (row_number() OVER w - 1) // 10000 AS part_no, first_value(prompt) OVER w AS first_prompt, min(ts) OVER (PARTITION BY trace_id) AS began,
  (count(*) OVER (PARTITION BY trace_id) + 9999) // 10000 AS n_parts FROM feed WINDOW w AS (PARTITION BY trace_id ORDER BY ts, step_id)"""


@query("feed_by_trace", I.extend("""
SELECT epoch_us(any_value(began)) AS us, trace_id AS request_id, part_no, any_value(n_parts) AS n_parts, any_value(first_prompt) AS prompt,
  count(*) AS n_steps, string_agg(source || '/' || model || '/' || input_tokens || '/' || output_tokens, ',' ORDER BY ts, step_id) AS steps
FROM parted GROUP BY trace_id, part_no""", {"parted": PARTED}, "feed"))
def feed_by_trace(spark, folder):
    f = traces.feed_by_trace(_steps(spark, folder))
    step = lambda x: F.concat_ws("/", x["source"], x["model"], x["input_tokens"].cast("string"), x["output_tokens"].cast("string"))
    return f.select(_micros(), "request_id", "part_no", "n_parts", "prompt", F.size("steps").cast("bigint").alias("n_steps"),
                    F.array_join(F.transform("steps", step), ",").alias("steps"))


@query("reverse_steps", I.extend("""SELECT trace_id AS request_id, any_value(n_parts) - 1 - part_no AS part_no,
  string_agg(model, ',' ORDER BY ts DESC, step_id DESC) AS models FROM parted GROUP BY trace_id, part_no""", {"parted": PARTED}, "feed"))
def reverse_steps(spark, folder):
    f = traces.reverse_steps(traces.feed_by_trace(_steps(spark, folder)))
    return f.select("request_id", "part_no", F.array_join(F.transform("steps", lambda x: x["model"]), ",").alias("models"))


@query("step_categories", I.sql("""
SELECT trace_id, arg_min(model, step_id) FILTER (source = 'embed') AS embedding,
  arg_min(model, step_id) FILTER (source = 'rerank') AS reranker,
  arg_min(model, step_id) FILTER (source IN ('web', 'qdrant', 'none')) AS reasoning,
  arg_min(model, step_id) FILTER (source = 'coder' OR contains(model, 'coder')) AS coder
FROM feed GROUP BY trace_id""", "feed"))
def step_categories(spark, folder):
    return traces.first_step_per_category(_steps(spark, folder))


@query("fmt_duration", """
SELECT event_id, CASE WHEN event_type = 'view' THEN '—' WHEN value * 10 < 1000 THEN printf('%.0f', floor(value * 10)) || 'ms'
  ELSE (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 's' END AS shown, strftime(ts, '%H:%M') AS clock FROM (SELECT *, (CAST(floor(value * 10) AS BIGINT) + 5) // 10 AS h FROM events)""")
def fmt_duration(spark, folder):
    ms = F.when(F.col("event_type") != "view", F.floor(F.col("value") * 10))
    return I.events(spark, folder).select("event_id", traces.fmt_duration(ms).alias("shown"), traces.fmt_clock(F.col("ts")).alias("clock"))


BUCKETS = ", ".join(f"count(*) FILTER (duration_ms <= {b:g}) AS le_{b:g}" for b in traces.LATENCY_BOUNDS)
NAMES = ", ".join(f"le_{b:g}" for b in traces.LATENCY_BOUNDS)


@query("span_metrics", I.sql(f"""
SELECT service, name, status, strftime(time_bucket(INTERVAL 15 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS step_start, count(*) AS calls,
  CAST(sum(CAST(duration_ms AS DECIMAL(18, 3))) AS DOUBLE) AS latency_sum, {BUCKETS} FROM spans GROUP BY 1, 2, 3, 4""", "spans"))
def span_metrics(spark, folder):
    return traces.span_metrics(I.spans(spark, folder)).withColumn("step_start", F.date_format("step_start", STAMP))


def _quantile_sql(q):
    out, bounds = f"{traces.LATENCY_BOUNDS[-1]}", traces.LATENCY_BOUNDS
    for i in reversed(range(len(bounds))):
        le, below, low = f"le_{bounds[i]:g}", f"le_{bounds[i - 1]:g}" if i else "0", bounds[i - 1] if i else 0.0
        out = (f"CASE WHEN {le} >= {q} * calls THEN CASE WHEN {le} = {below} THEN {bounds[i]} ELSE "
               f"{low} + {bounds[i] - low} * ({q} * calls - {below}) / ({le} - {below}) END ELSE {out} END")
    return out


@query("latency_quantiles", I.extend(f"""SELECT service, name, calls, round({_quantile_sql(0.5)}, 6) AS p50, round({_quantile_sql(0.95)}, 6) AS p95 FROM m""",
                                     {"m": f"SELECT service, name, count(*) AS calls, {BUCKETS} FROM spans GROUP BY 1, 2"}, "spans"))
def latency_quantiles(spark, folder):
    per_step = traces.span_metrics(I.spans(spark, folder))
    total = per_step.groupBy("service", "name").agg(
        F.sum("calls").alias("calls"), *[F.sum(f"le_{b:g}").alias(f"le_{b:g}") for b in traces.LATENCY_BOUNDS])
    return total.select("service", "name", "calls",
                        D6(traces.histogram_quantile(0.5, traces.LATENCY_BOUNDS)).alias("p50"),
                        D6(traces.histogram_quantile(0.95, traces.LATENCY_BOUNDS)).alias("p95"))


@query("service_graph", I.sql("""
SELECT p.service AS client, c.service AS server, count(*) AS calls, count(*) FILTER (c.status = 'error') AS failures,
  CAST(sum(CAST(c.duration_ms AS DECIMAL(18, 3))) AS DOUBLE) AS latency_sum
FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id WHERE p.service <> c.service GROUP BY 1, 2""", "spans"))
def service_graph(spark, folder):
    return traces.service_graph(I.spans(spark, folder))


# --- logs and alerts --------------------------------------------------------

@query("parse_cri", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000000000Z') AS log_ts, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
  CASE WHEN value < 20 THEN 'P' ELSE 'F' END AS flag, props AS content FROM events WHERE event_type <> 'signup'""")
def parse_cri(spark, folder):
    return logs.parse_cri(_cri(spark, folder)).select("event_id", "log_ts", "stream", "flag", "content")


def _cri(spark, folder):
    e = I.events(spark, folder)
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.'000000000Z'"),
                       F.when(F.col("event_type") == "error", "stderr").otherwise("stdout"),
                       F.when(F.col("value") < 20, "P").otherwise("F"), "props")
    return e.select("event_id", "user_id", F.when(F.col("event_type") == "signup", "not a log line").otherwise(line).alias("line"))


@query("join_partial_lines", """
SELECT user_id, stream, line_no, part_no, count(*) AS n_pieces, string_agg(props, '' ORDER BY event_id) AS content FROM (
  SELECT *, (row_number() OVER (PARTITION BY user_id, stream, line_no ORDER BY event_id) - 1) // 1000000 AS part_no FROM (
  SELECT *, CAST(coalesce(sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, stream ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream FROM events WHERE event_type <> 'signup')))
GROUP BY user_id, stream, line_no, part_no""")
def join_partial_lines(spark, folder):
    lines = logs.parse_cri(_cri(spark, folder))
    return logs.join_partial_lines(lines, ["user_id", "stream"], ["event_id"])


@query("parse_json_log", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_log(spark, folder):
    return logs.parse_json_log(I.events(spark, folder).drop("k"), "k BIGINT", "props").select("event_id", "log.k")


@query("log_volume", I.sql("""SELECT pod, namespace, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS step_start,
  count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM logs GROUP BY 1, 2, 3""", "logs"))
def log_volume(spark, folder):
    return logs.log_volume(I.logs(spark, folder), ["pod", "namespace"]).withColumn("step_start", F.date_format("step_start", STAMP))


@query("alert_view", I.sql("""SELECT alert_id, alert_no, status, name, pod, namespace, left(full_description, 4000) AS description, colour,
  needs_diagnosis FROM alerts""", "alerts"))
def alert_view(spark, folder):
    return logs.alert_view(I.alert_payloads(spark, folder)).drop("ts", "full_description")


LOOK_BACK = 240

ALERT_LOGS = f"""
SELECT alert_id, alert_no, pod, namespace, least(count(l.seq), 50) AS n_lines,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.ts, l.seq) FILTER (rn <= 50), 'No logs found or Loki unreachable.') AS log_text,
  any_value(full_description) AS full_description
FROM (SELECT a.alert_id, a.alert_no, a.pod, a.namespace, a.full_description, g.ts, g.seq, g.line,
        row_number() OVER (PARTITION BY a.alert_id, a.alert_no ORDER BY g.ts DESC, g.seq DESC) AS rn
      FROM (SELECT * FROM alerts WHERE needs_diagnosis) a
      LEFT JOIN logs g ON g.pod = a.pod AND g.namespace = a.namespace AND g.ts <= a.ts AND g.ts >= a.ts - INTERVAL {LOOK_BACK} HOUR) l
GROUP BY alert_id, alert_no, pod, namespace"""


def _firing(spark, folder):
    """Alerts that need a diagnosis; the key is that of the payload and the place in it."""
    alerts = logs.needs_diagnosis(logs.alert_view(I.alert_payloads(spark, folder)))
    return alerts.withColumn("alert_key", F.struct("alert_id", "alert_no"))


def _texts(spark, folder):
    return logs.alert_logs(_firing(spark, folder), I.logs(spark, folder), alert_id="alert_key", look_back_hours=LOOK_BACK)


@query("alert_logs", I.extend("SELECT alert_id, alert_no, pod, namespace, n_lines, log_text FROM al", {"al": ALERT_LOGS}, "alerts", "logs"))
def alert_logs(spark, folder):
    return _texts(spark, folder).select("alert_key.*", "pod", "namespace", "n_lines", "log_text")


@query("diagnosis_input", I.extend("""
SELECT alert_id, alert_no, length(p) AS n_chars, CASE WHEN length(p) > 4000 THEN left(p, 1000) || '...' || chr(10) || chr(10)
  || '📄 **Full diagnostic report attached below.**' ELSE p END AS shown
FROM (SELECT alert_id, alert_no, 'You are an SRE assistant. Analyze the following alert and logs to identify the root cause.' || chr(10) || chr(10)
  || 'ALERT: ' || full_description || chr(10) || chr(10) || 'LOGS:' || chr(10) || log_text || chr(10) || chr(10) || 'Diagnosis:' AS p FROM al)""",
    {"al": ALERT_LOGS}, "alerts", "logs"))
def diagnosis_input(spark, folder):
    alerts = _firing(spark, folder)
    both = alerts.select("alert_key", "alert_id", "alert_no", "full_description").join(_texts(spark, folder), "alert_key").withColumn(
        "prompt", logs.diagnosis_prompt(F.col("full_description"), F.col("log_text")))
    return logs.overflow_split(both, "prompt").select("alert_id", "alert_no", F.length("prompt").cast("bigint").alias("n_chars"), "shown")


# --- metrics ----------------------------------------------------------------

@query("label_matchers", I.sql("""SELECT epoch_us(ts) AS us, model, pod, value FROM samples WHERE metric = 'requests_total'
  AND model <> 'view' AND pod IN ('m-0', 'm-2')""", "samples"))
def label_matchers(spark, folder):
    s = metrics.raw_gauge(I.samples(spark, folder), "requests_total", {"model": ("!=", "view"), "pod": ("=~", "m-[02]")})
    return s.select(_micros(), "model", "pod", "value")


RULES = [
    Rule(sources=["app"], regex="click|view|purchase|", action="keep"),
    Rule(sources=["app"], target="job"),
    Rule(sources=["job"], regex="view", replacement="gpu-metrics", target="job"),
    Rule(sources=["job"], regex="", replacement="pods", target="job"),
    Rule(sources=["uid", "container"], separator="/", target="path", replacement="/var/log/pods/*$1/*.log"),
    Rule(sources=["address", "port"], regex=r"([^:]+)(?::\d+)?;(\d+)", replacement="$1:$2", target="address"),
    Rule(replacement="anonymous", target="tenant"),
]


@query("relabel", """
SELECT event_id, CASE app WHEN '' THEN 'pods' WHEN 'view' THEN 'gpu-metrics' ELSE app END AS job,
  '/var/log/pods/*' || user_id || '/c' || (k % 3) || '/*.log' AS path,
  CASE WHEN k % 2 = 0 THEN 'host' || (k % 5) || ':' || k ELSE 'host' || (k % 5) || ':80' END AS address, 'anonymous' AS tenant
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS app FROM events)
WHERE app IN ('click', 'view', 'purchase', '')""")
def relabel(spark, folder):
    k, text = F.col("k"), lambda c: c.cast("string")
    labels = F.map_filter(F.create_map(
        F.lit("app"), F.when(F.col("event_type") != "signup", F.col("event_type")), F.lit("uid"), text(F.col("user_id")),
        F.lit("container"), F.concat(F.lit("c"), text(k % 3)), F.lit("address"), F.concat(F.lit("host"), text(k % 5), F.lit(":80")),
        F.lit("port"), F.when(k % 2 == 0, text(k))), lambda n, v: v.isNotNull())
    out = metrics.relabel(I.events(spark, folder).select("event_id", labels.alias("labels")), RULES)
    return out.select("event_id", *[F.col("labels")[n].alias(n) for n in ("job", "path", "address", "tenant")])


@query("series_admission", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 <= 200 AS admitted FROM events")
def series_admission(spark, folder):
    names = F.transform(F.sequence(F.lit(1), F.col("k") * 3), lambda i: F.concat(F.lit("l"), i.cast("string")))
    labels = F.when(F.col("k") > 0, F.map_from_arrays(names, names)).otherwise(F.create_map().cast("map<string,string>"))
    kept, rejected = metrics.series_admission(I.events(spark, folder).select("event_id", labels.alias("labels")))
    return kept.select("event_id", F.lit(True).alias("admitted")).unionByName(rejected.select("event_id", F.lit(False).alias("admitted")))


@query("resource_to_labels", """SELECT event_id, 'pod-' || user_id AS pod, CASE WHEN event_type = 'view' THEN 'label' ELSE 'resource' END AS origin, event_type AS kind FROM events""")
def resource_to_labels(spark, folder):
    res = F.create_map(F.lit("pod"), F.concat(F.lit("pod-"), F.col("user_id").cast("string")), F.lit("origin"), F.lit("resource"))
    lab = F.when(F.col("event_type") == "view", F.create_map(F.lit("origin"), F.lit("label"), F.lit("kind"), F.col("event_type"))).otherwise(
        F.create_map(F.lit("kind"), F.col("event_type")))
    m = I.events(spark, folder).select("event_id", metrics.resource_to_labels(res, lab).alias("m"))
    return m.select("event_id", *[F.col("m")[n].alias(n) for n in ("pod", "origin", "kind")])


# Customers stand for pods: events name them by id.
@query("enrich_pods", "SELECT event_id, c_name AS name, c_nationkey AS node FROM events LEFT JOIN customer ON c_custkey = user_id")
def enrich_pods(spark, folder):
    from tidemark.sources.files import table
    pods = table(spark, folder, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("node"))
    e = I.events(spark, folder).select("event_id", F.col("user_id").alias("pod_uid"))
    return metrics.enrich_pods(e, pods).select("event_id", "name", "node")


@query("counter_deltas", I.sql("SELECT series, model, sec, value, round(delta, 6) AS delta FROM deltas", "deltas"))
def counter_deltas(spark, folder):
    return metrics.counter_deltas(I.samples(spark, folder), ["series", "model"]).withColumn("delta", D6(F.col("delta")))


RATE = """SELECT series, model, sec, value, round(CAST(sum(CAST(delta AS DECIMAL(30, 6))) OVER (PARTITION BY series ORDER BY sec
  RANGE BETWEEN {n} PRECEDING AND CURRENT ROW) AS DOUBLE) / {m}, {d}) AS rate FROM deltas"""


@query("counter_rate", I.sql(RATE.format(n=59, m=60, d=6), "deltas"))
def counter_rate(spark, folder):
    return metrics.counter_rate(I.samples(spark, folder), ["series", "model"]).withColumn("rate", D6(F.col("rate")))


@query("counter_rate_6h", I.sql(RATE.format(n=21599, m=21600, d=9), "deltas"))
def counter_rate_6h(spark, folder):
    return metrics.counter_rate(I.samples(spark, folder), ["series", "model"], 21600).withColumn("rate", F.round("rate", 9))


STEPS = """
SELECT model, at_sec, round(CAST(sum(CAST(delta AS DECIMAL(30, 6))) AS DOUBLE) / 60, 6) AS rate
FROM deltas, LATERAL (SELECT unnest(range((sec + 14) // 15 * 15, (sec + 59) // 15 * 15 + 1, 15)) AS at_sec)
GROUP BY model, at_sec"""


@query("sum_rate", I.sql(STEPS, "deltas"))
def sum_rate(spark, folder):
    return metrics.sum_rate(I.samples(spark, folder), ["series", "model"], ["model"]).withColumn("rate", D6(F.col("rate")))


@query("sum_gauge", I.sql("SELECT pod, epoch_us(ts) AS us, CAST(sum(CAST(value AS DECIMAL(30, 6))) AS DOUBLE) / 1024 AS value FROM samples GROUP BY pod, ts", "samples"))
def sum_gauge(spark, folder):
    s = metrics.sum_gauge(I.samples(spark, folder), ["pod"], 1 / 1024)
    return s.select("pod", _micros(), "value")


@query("either", I.extend("""
SELECT at_sec, rate, 'new' AS origin FROM a UNION ALL SELECT at_sec, rate, 'old' FROM b WHERE at_sec NOT IN (SELECT at_sec FROM a)""",
    {"s": STEPS, "a": "SELECT at_sec, rate FROM s WHERE model = 'click'", "b": "SELECT at_sec, rate FROM s WHERE model = 'view'"}, "deltas"))
def either(spark, folder):
    r = metrics.sum_rate(I.samples(spark, folder), ["series", "model"], ["model"])
    side = lambda m, o: r.filter(F.col("model") == m).select("at_sec", D6(F.col("rate")).alias("rate"), F.lit(o).alias("origin"))
    return metrics.either(side("click", "new"), side("view", "old"), ["at_sec"])


@query("unit_conversion", "SELECT event_id, round(value * 1000, 4) AS ms, round(value * 1000000 / 1073741824, 9) AS gib FROM events")
def unit_conversion(spark, folder):
    v = F.col("value")
    return I.events(spark, folder).select("event_id", F.round(metrics.to_ms(v), 4).alias("ms"),
                                          F.round(metrics.to_gib(v * 1_000_000), 9).alias("gib"))


# --- token streams ----------------------------------------------------------

@query("reassemble", I.sql("""SELECT request_id, CAST(seq // 100000 AS BIGINT) AS part_no, string_agg(token, '' ORDER BY seq) AS text, count(*) AS n_tokens
  FROM tokens GROUP BY request_id, seq // 100000""", "tokens"))
def reassemble(spark, folder):
    events = replies.until_done(replies.parse_events(I.sse_lines(spark, folder)))
    return replies.reassemble(events)


@query("final_usage", "SELECT conv_id || '-' || turn AS request_id, turn * 10 AS prompt_tokens, len(string_split(text, ' ')) AS completion_tokens FROM conversations WHERE role = 'assistant'")
def final_usage(spark, folder):
    return replies.final_usage(replies.until_done(replies.parse_events(I.sse_lines(spark, folder))))


@query("latency_stats", I.sql("""
SELECT request_id, count(*) FILTER (NOT reasoning) AS output_tokens, round(CAST(0.025 AS DOUBLE) * min(seq + 1) FILTER (NOT reasoning), 6) AS ttft,
  round((max(n) + 4 - min(seq + 1) FILTER (NOT reasoning)) * 0.025 / count(*) FILTER (NOT reasoning), 6) AS tpot,
  round(CAST(0.025 AS DOUBLE) * (max(n) + 4), 6) AS total_duration FROM tokens GROUP BY request_id""", "tokens"))
def latency_stats(spark, folder):
    lines = I.sse_lines(spark, folder)
    parsed = replies.parse_events(lines)
    ends = parsed.filter("done").groupBy("request_id").agg(F.min("ts").alias("ended"))
    starts = lines.filter("seq = 0").select("request_id", (F.col("ts") - F.expr("INTERVAL 25 MILLISECOND")).alias("started"))
    stats = replies.latency_stats(replies.until_done(parsed), starts.join(ends, "request_id"))
    return stats.select("request_id", "output_tokens", *[D6(F.col(c)).alias(c) for c in ("ttft", "tpot", "total_duration")])


# --- load tests -------------------------------------------------------------

@query("parse_load_log", I.sql("""SELECT log_id, run * 2 + 1 AS line_no, model, target, CASE WHEN ok THEN round(seconds, 2) END AS seconds,
  CASE WHEN ok THEN target + 56 END AS actual, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM load_runs""", "load_runs"))
def parse_load_log(spark, folder):
    return ladder.parse_log_lines(_log_lines(spark, folder), ["log_id"])


def _log_lines(spark, folder):
    r = I.load_runs(spark, folder)
    head = F.printf(F.lit("Testing %s | Context: %d tokens..."), "model", "target")
    done = F.when(F.col("ok"), F.printf(F.lit("  SUCCESS: %.2fs (Actual tokens: %d)"), "seconds", F.col("target") + 56)).otherwise(
        F.lit("  Error 502: bad gateway"))
    return r.select("log_id", F.explode(F.array(
        F.struct((F.col("run") * 2).alias("line_no"), head.alias("line")),
        F.struct((F.col("run") * 2 + 1).alias("line_no"), done.alias("line")))).alias("l")).select("log_id", "l.line_no", "l.line")


GRID = """
SELECT m.model, t.target, coalesce(p.runs, 0) AS runs, p.seconds, CASE WHEN p.runs IS NULL THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT DISTINCT model FROM load_runs) m CROSS JOIN (SELECT unnest(range(10000, 80001, 10000)) AS target) t
LEFT JOIN (SELECT model, target, count(*) AS runs, round(min(seconds), 2) AS seconds FROM load_runs WHERE ok AND seconds < 5 GROUP BY 1, 2) p
  ON p.model = m.model AND p.target = t.target"""


def _grid(spark, folder):
    status = F.when(F.col("ok") & (F.col("seconds") < 5), "PASS").otherwise("FAIL")
    return ladder.result_grid(I.load_runs(spark, folder).withColumn("status", status))


@query("result_grid", I.sql(GRID, "load_runs"))
def result_grid(spark, folder):
    return _grid(spark, folder)


@query("pass_counts", I.extend("SELECT model, count(*) FILTER (status = 'PASS') AS passed, count(*) AS cells FROM g GROUP BY model", {"g": GRID}, "load_runs"))
def pass_counts(spark, folder):
    return ladder.pass_counts(_grid(spark, folder))


@query("pivot_grid", I.extend("SELECT target, " + ", ".join(f"max(status) FILTER (model = 'model-{i}') AS \"model-{i}\"" for i in range(7)) + " FROM g GROUP BY target", {"g": GRID}, "load_runs"))
def pivot_grid(spark, folder):
    return ladder.pivot_grid(_grid(spark, folder), [f"model-{i}" for i in range(7)])


@query("max_stable_context", """
SELECT user_id, max(CASE WHEN f IS NULL OR ctx < f THEN ctx END) AS max_ctx, max(f) AS first_fail FROM (
  SELECT user_id, ctx, min(CASE WHEN NOT ok THEN ctx END) OVER (PARTITION BY user_id) AS f FROM (
    SELECT user_id, 28288 + 8000 * (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1) AS ctx, event_type <> 'error' AS ok FROM events)) GROUP BY user_id""")
def max_stable_context(spark, folder):
    e = I.events(spark, folder)
    runs = e.select("user_id", (F.lit(28288) + ladder.CONTEXT_STEP * (F.col("k") % 10 + 1)).alias("ctx"), (F.col("event_type") != "error").alias("ok"))
    return ladder.max_stable_context(runs, "user_id")
