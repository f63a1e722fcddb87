"""The concepts of the library derived from the test tables, in Spark and as SQL.

Each function has a SQL twin of the same name in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.corpus import with_chapter_keys
from tidemark.operators.metrics import series_key
from tidemark.sources.files import table

CTE: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def sql(body: str, *inputs: str) -> str:
    """A statement with the common table expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in inputs:
        add(name)
    ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in order)
    return f"WITH {ctes} {body}" if ctes else body


def extend(body: str, ctes: dict[str, str], *inputs: str) -> str:
    """Like ``sql`` with further expressions of the query's own."""
    head = sql("", *inputs).strip()
    own = ", ".join(f"{n} AS ({b})" for n, b in ctes.items())
    return f"{head}, {own} {body}" if head else f"WITH {own} {body}"


# --- chapters ---------------------------------------------------------------

def chapters(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    name = F.printf(F.lit("%d_vol._%d_chapter.pdf"), F.col("doc_id") % 20, F.expr("doc_id div 20"))
    return with_chapter_keys(d.select("doc_id", name.alias("file_name"), "text", "lang", "source"))


CTE["chapters"] = r"""
SELECT doc_id, file_name, text, lang, source,
       'vol_' || lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') AS vol_key,
       doc_id % 20 AS vol, CAST(doc_id // 20 AS DOUBLE) AS chap,
       regexp_replace(file_name, '\.[^.]*$', '') AS stem
FROM (SELECT *, printf('%d_vol._%d_chapter.pdf', doc_id % 20, doc_id // 20) AS file_name FROM documents)"""


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies about documents: fenced JSON, JSON in prose, bare JSON, broken JSON."""
    d = table(spark, folder, "documents")
    body = F.printf(
        F.lit('{"characters":{"%s":{"gender":"%s","titles_held":["T%d","T1"],"aliases":"A%d"}},'
              '"terminology":{"skills":{"w%d":"c%d"}},"gender_fixes":["f%d"]}'),
        F.col("source"), F.col("lang"), F.col("doc_id") % 3, F.col("doc_id") % 5,
        F.col("doc_id") % 7, F.col("doc_id") % 2, F.col("doc_id") % 4)
    kind = F.col("doc_id") % 4
    raw = (F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(kind == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
           .when(kind == 2, body).otherwise(F.concat(F.lit("{bad "), F.left("text", F.lit(20)))))
    return d.select("doc_id", raw.alias("raw"))


CTE["replies"] = r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 1 THEN 'Here it is: ' || body || ' done' WHEN 2 THEN body ELSE '{bad ' || left(text, 20) END AS raw, body
FROM (SELECT *, '{"characters":{"' || source || '":{"gender":"' || lang || '","titles_held":["T' || (doc_id % 3)
  || '","T1"],"aliases":"A' || (doc_id % 5) || '"}},"terminology":{"skills":{"w' || (doc_id % 7) || '":"c'
  || (doc_id % 2) || '"}},"gender_fixes":["f' || (doc_id % 4) || '"]}' AS body FROM documents)"""


# --- facts ------------------------------------------------------------------

def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge facts from events: ten events are one partial result."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    t = F.col("event_type")
    policy = (t == "signup") & (k % 10 == 0)
    path = (F.when(t == "click", F.array(F.lit("characters"), user, F.lit("gender")))
            .when(t == "view", F.array(F.lit("characters"), user, F.lit("aliases")))
            .when(t == "purchase", F.array(F.lit("terminology"), text("t", k % 5), text("w", F.col("user_id"))))
            .when(t == "error", F.array(F.lit("relationships")))
            .when(policy, F.array(F.lit("honorifics_policy"))).otherwise(F.array(F.lit("gender_fixes"))))
    value = (F.when(t == "click", F.when(k % 3 == 0, "male").otherwise("female"))
             .when(t == "view", text("a", k)).when(t == "purchase", text("c", k))
             .when(t == "error", F.printf(F.lit('{"from":"u%d","to":"u%d","address_term":"k%d"}'),
                                          F.col("user_id"), k % 10, k))
             .when(policy, text("policy ", k)).otherwise(text("fix ", k)))
    return e.select(F.expr("event_id div 10").alias("seq"), (F.col("event_id") % 10).alias("pos"), path.alias("path"),
                    F.when(t.isin("click", "purchase") | policy, "scalar").otherwise("list").alias("kind"),
                    value.alias("value"))


CTE["ev"] = """SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
CTE["facts"] = """
SELECT event_id // 10 AS seq, event_id % 10 AS pos,
  CASE WHEN event_type = 'click' THEN 'characters.u' || user_id || '.gender'
       WHEN event_type = 'view' THEN 'characters.u' || user_id || '.aliases'
       WHEN event_type = 'purchase' THEN 'terminology.t' || (k % 5) || '.w' || user_id
       WHEN event_type = 'error' THEN 'relationships'
       WHEN k % 10 = 0 THEN 'honorifics_policy' ELSE 'gender_fixes' END AS path,
  CASE WHEN event_type IN ('click', 'purchase') OR (event_type = 'signup' AND k % 10 = 0)
       THEN 'scalar' ELSE 'list' END AS kind,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 'male' ELSE 'female' END
       WHEN event_type = 'view' THEN 'a' || k WHEN event_type = 'purchase' THEN 'c' || k
       WHEN event_type = 'error' THEN '{"from":"u' || user_id || '","to":"u' || (k % 10) || '","address_term":"k' || k || '"}'
       WHEN k % 10 = 0 THEN 'policy ' || k ELSE 'fix ' || k END AS value
FROM ev"""
NEEDS["facts"] = ["ev"]
CTE["merged_scalars"] = """
SELECT path, arg_max(value, seq * 10 + pos) AS value, min(seq * 10 + pos) // 10 AS first_seq,
  min(seq * 10 + pos) % 10 AS first_pos, count(*) AS n_mentions FROM facts WHERE kind = 'scalar' GROUP BY path"""
NEEDS["merged_scalars"] = ["facts"]
CTE["merged_lists"] = """
SELECT path, value, seq, pos FROM (SELECT *, min(seq) OVER (PARTITION BY path, value) AS f FROM facts
  WHERE kind = 'list') WHERE seq = f"""
NEEDS["merged_lists"] = ["facts"]
CTE["merged"] = """
SELECT first_seq AS seq, first_pos AS pos, path, 'scalar' AS kind, value FROM merged_scalars
UNION ALL SELECT seq, pos, path, 'list', value FROM merged_lists"""
NEEDS["merged"] = ["merged_scalars", "merged_lists"]


# --- model calls ------------------------------------------------------------

def llm_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A call per assistant turn: the turn before is its prompt."""
    c = table(spark, folder, "conversations")
    prompt = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").alias("p"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return (c.filter("role = 'assistant'").join(prompt, ["conv_id", "turn"], "left")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
                    F.timestamp_seconds(F.unix_seconds(start) + F.col("conv_id") * 7 + F.col("turn") * 3).alias("ts"),
                    F.when(F.col("conv_id") % 2 == 0, "planner").otherwise("executor").alias("model"),
                    F.expr("cast(coalesce(p, 0) as bigint) div 4").alias("prompt_tokens"),
                    F.expr("cast(length(text) as bigint) div 4").alias("completion_tokens"),
                    (F.col("conv_id") % 5 != 0).alias("is_local")))


CTE["llm_calls"] = """
SELECT c.conv_id * 1000 + c.turn AS call_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.conv_id * 7 + c.turn * 3) AS ts,
  CASE WHEN c.conv_id % 2 = 0 THEN 'planner' ELSE 'executor' END AS model,
  coalesce(length(p.text), 0) // 4 AS prompt_tokens, length(c.text) // 4 AS completion_tokens,
  c.conv_id % 5 <> 0 AS is_local
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn
WHERE c.role = 'assistant'"""


def sse_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as token events, a usage event, the end mark, and an event that comes too late."""
    c = table(spark, folder, "conversations").filter("role = 'assistant'")
    rid = F.concat_ws("-", "conv_id", "turn")
    words = F.split("text", " ")
    delta = lambda name, v: F.concat(F.lit('data: {"choices":[{"delta":'), F.to_json(F.struct(v.alias(name))), F.lit("}]}"))
    body = F.transform(words, lambda w, i: F.when(i % 11 == 3, delta("reasoning_content", F.concat(w, F.lit(" "))))
                       .otherwise(delta("content", F.concat(w, F.lit(" ")))))
    usage = F.printf(F.lit('data: {"choices":[],"usage":{"prompt_tokens":%d,"completion_tokens":%d}}'),
                     F.col("turn") * 10, F.size(words))
    tail = F.array(F.lit(": keep-alive"), F.lit("data: {broken"), usage, F.lit("data: [DONE]"), delta("content", F.lit("late")))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return (c.select(rid.alias("request_id"), "conv_id", "turn", F.posexplode(F.concat(body, tail)).alias("seq", "raw"))
            .select("request_id", F.col("seq").cast("bigint").alias("seq"),
                    F.timestamp_micros(F.unix_micros(start) + F.col("conv_id") * 60_000_000
                                       + F.col("turn") * 1_000_000 + (F.col("seq") + 1) * 25_000).alias("ts"), "raw"))


# Tokens of the replies before the end mark, as the parser must find them.
CTE["tokens"] = """
SELECT conv_id || '-' || turn AS request_id, conv_id, turn, i - 1 AS seq, words[i] || ' ' AS token,
  (i - 1) % 11 = 3 AS reasoning, len(words) AS n
FROM (SELECT *, string_split(text, ' ') AS words FROM conversations WHERE role = 'assistant'),
  LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)"""


# --- telemetry --------------------------------------------------------------

def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number ``k`` of their properties."""
    return (table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.get_json_object("props", "$.k").cast("bigint")))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits of a trace store, one per event; a trace is a user's day."""
    e = events(spark, folder)
    pair = lambda key, s, i: F.struct(F.lit(key).alias("key"), F.struct(s.alias("stringValue"), i.alias("intValue")).alias("value"))
    none = F.lit(None).cast("string")
    attrs = F.array(
        pair("gen_ai.request.model", F.when(F.col("k") % 4 > 0, F.concat(F.lit("coder-"), (F.col("k") % 4).cast("string"))), none),
        pair("gen_ai.usage.prompt_tokens", none, F.col("k").cast("string")),
        pair("gen_ai.usage.completion_tokens", none, (F.col("k") * 3).cast("string")),
        pair("app.user_message", F.repeat(F.concat(F.col("event_type"), F.lit(" question ")), F.col("k").cast("int")), none),
        pair("app.context_source", F.when(F.col("k") % 5 == 0, "web").when(F.col("k") % 5 == 1, "embed")
             .when(F.col("k") % 5 == 2, "rerank").when(F.col("k") % 5 == 3, "coder"), none))
    name = (F.when(F.col("event_type") == "error", "get_embedding").when(F.col("event_type") == "view", "ollama_chat")
            .otherwise("POST chat_request"))
    sets = F.when(F.col("k") == 7, F.array()).otherwise(F.array(F.struct(F.array(F.struct(attrs.alias("attributes"))).alias("spans"))))
    return e.select(
        "event_id", F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("traceID"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 3).cast("string")).alias("rootServiceName"), "ts",
        name.alias("rootSpanName"), (F.unix_micros("ts") * 1000).cast("string").alias("startTimeUnixNano"),
        F.floor(F.col("value") * 10).alias("durationMs"), sets.alias("spanSets"))


CTE["feed"] = """
SELECT event_id AS step_id, ts, user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace_id,
  CASE WHEN k % 4 > 0 THEN 'coder-' || (k % 4) ELSE 'unknown' END AS model,
  k AS input_tokens, k * 3 AS output_tokens, CAST(floor(value * 10) AS DOUBLE) AS duration_ms,
  left(repeat(event_type || ' question ', k), 300) AS prompt,
  CASE k % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'embed' WHEN 2 THEN 'rerank' WHEN 3 THEN 'coder' ELSE 'none' END AS source
FROM ev WHERE event_type <> 'error' AND k <> 7"""
NEEDS["feed"] = ["ev"]


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans from events: fifty events are a trace, the first of them is the parent of the others."""
    e = events(spark, folder)
    root = F.expr("event_id div 50 * 50")
    return e.select(
        F.concat(F.lit("t"), F.expr("event_id div 50").cast("string")).alias("trace_id"), F.col("event_id").alias("span_id"),
        F.when(F.col("event_id") != root, root).alias("parent_id"),
        F.col("event_type").alias("service"), F.concat(F.lit("op"), (F.col("k") % 3).cast("string")).alias("name"),
        F.when(F.col("k") % 10 == 0, "error").otherwise("ok").alias("status"), "ts",
        F.col("value").alias("duration_ms"))


CTE["spans"] = """
SELECT 't' || (event_id // 50) AS trace_id, event_id AS span_id,
  CASE WHEN event_id % 50 <> 0 THEN event_id // 50 * 50 END AS parent_id, event_type AS service,
  'op' || (k % 3) AS name, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END AS status, ts, value AS duration_ms FROM ev"""
NEEDS["spans"] = ["ev"]


def logs(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).filter("event_type <> 'error'")
    return e.select(
        "ts", F.col("event_id").alias("seq"), F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.concat(F.lit("ns-"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        F.concat_ws(" ", "event_type", "props").alias("line"))


CTE["logs"] = """
SELECT ts, event_id AS seq, 'pod-' || user_id AS pod, 'ns-' || (user_id % 3) AS namespace,
  event_type || ' ' || props AS line FROM events WHERE event_type <> 'error'"""


def alert_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Error events as webhook payloads; some lack labels, some hold two alerts."""
    e = events(spark, folder).filter("event_type = 'error'")
    k = F.col("k")
    labels = F.map_filter(F.create_map(
        F.lit("alertname"), F.when(k % 6 != 0, F.concat(F.lit("Alert"), (k % 4).cast("string"))),
        F.lit("pod"), F.when(k % 5 != 0, F.concat(F.lit("pod-"), F.col("user_id").cast("string"))),
        F.lit("namespace"), F.when(k % 7 != 0, F.concat(F.lit("ns-"), (F.col("user_id") % 3).cast("string")))),
        lambda n, v: v.isNotNull())
    note = F.map_filter(F.create_map(F.lit("description"), F.when(k % 8 != 0, F.repeat(F.lit("value high "), (k * 5).cast("int")))),
                        lambda n, v: v.isNotNull())
    status = F.when(k % 3 == 0, "resolved").when(k % 3 == 1, "firing")
    alert = F.struct(status.alias("status"), labels.alias("labels"), note.alias("annotations"))
    return e.select(F.col("event_id").alias("alert_id"), "ts", F.lit("firing").alias("status"),
                    F.when(k % 2 == 0, F.array(alert)).otherwise(F.array(alert, alert)).alias("alerts"))


CTE["alerts"] = """
SELECT event_id AS alert_id, ts, alert_no, CASE k % 3 WHEN 0 THEN 'resolved' ELSE 'firing' END AS status,
  CASE WHEN k % 6 <> 0 THEN 'Alert' || (k % 4) ELSE 'Unknown' END AS name,
  CASE WHEN k % 5 <> 0 THEN 'pod-' || user_id END AS pod,
  CASE WHEN k % 7 <> 0 THEN 'ns-' || (user_id % 3) ELSE 'ai-agent' END AS namespace,
  CASE WHEN k % 8 <> 0 THEN repeat('value high ', k * 5) ELSE 'No description' END AS full_description,
  CASE WHEN k % 3 = 0 THEN 'green' ELSE 'red' END AS colour,
  k % 3 <> 0 AND k % 5 <> 0 AS needs_diagnosis
FROM ev, LATERAL (SELECT unnest(range(0, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END)) AS alert_no)
WHERE event_type = 'error'"""
NEEDS["alerts"] = ["ev"]


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Counter samples: one series per event type and k group; falling values are resets."""
    e = events(spark, folder)
    return e.select(
        "ts", F.when(F.col("k") % 2 == 0, "requests_total").otherwise("tokens_total").alias("metric"),
        F.create_map(F.lit("model"), F.col("event_type"), F.lit("pod"), F.concat(F.lit("m-"), (F.col("k") % 3).cast("string")),
                     F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.col("event_type").alias("model"), F.concat(F.lit("m-"), (F.col("k") % 3).cast("string")).alias("pod"), "value"
    ).withColumn("series", F.concat("metric", series_key(F.col("labels"))))


CTE["samples"] = """
SELECT ts, CASE WHEN k % 2 = 0 THEN 'requests_total' ELSE 'tokens_total' END AS metric, event_type AS model,
  'm-' || (k % 3) AS pod, user_id, value FROM ev"""
NEEDS["samples"] = ["ev"]
CTE["steps_up"] = """
SELECT series, model, us, value, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta
FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY us) AS prev
      FROM (SELECT metric || '{"model":"' || model || '","pod":"' || pod || '","user":"' || user_id || '"}' AS series, model,
              epoch_us(ts) AS us, max(value) AS value FROM samples GROUP BY 1, 2, 3))"""
NEEDS["steps_up"] = ["samples"]
CTE["deltas"] = """
SELECT series, model, us // 1000000 AS sec, arg_max(value, us) AS value, CAST(sum(CAST(delta AS DECIMAL(30, 6))) AS DOUBLE) AS delta
FROM steps_up GROUP BY 1, 2, 3"""
NEEDS["deltas"] = ["steps_up"]


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Load-test runs from events: model, context stage, seconds, outcome."""
    e = events(spark, folder)
    return e.select(
        F.col("event_id").alias("run"), F.concat(F.lit("model-"), (F.col("user_id") % 7).cast("string")).alias("model"),
        ((F.expr("k div 13") + 1) * 10000).alias("target"), F.col("value").alias("seconds"),
        (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 10).alias("log_id"))


CTE["load_runs"] = """
SELECT event_id AS run, 'model-' || (user_id % 7) AS model, (k // 13 + 1) * 10000 AS target, value AS seconds,
  event_type <> 'error' AS ok, user_id % 10 AS log_id FROM ev"""
NEEDS["load_runs"] = ["ev"]


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Web results from pages: 25 per query; some have no content, some no title."""
    p = table(spark, folder, "pages")
    content = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    return p.select(
        "page_id", F.expr("page_id div 25").alias("query_id"), (F.col("page_id") % 25 + 1).alias("rank"),
        F.when(F.col("page_id") % 3 != 0, content).otherwise("").alias("content"),
        F.when(F.col("page_id") % 7 != 0, F.col("url")).otherwise(F.left("url", F.lit(9))).alias("title"),
        ((F.col("page_id") * 37) % 100 / 100).alias("relevance"))


CTE["usable"] = """
SELECT query_id, rank, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS index, relevance
FROM (SELECT page_id // 25 AS query_id, page_id % 25 + 1 AS rank, ((page_id * 37) % 100) / 100.0 AS relevance,
  coalesce(nullif(CASE WHEN page_id % 3 <> 0 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) ELSE '' END, ''),
           CASE WHEN page_id % 7 <> 0 THEN url ELSE left(url, 9) END, '') AS text FROM pages)
WHERE rank <= 20 AND length(text) > 10"""
