"""Written tables read back, and small rules not covered elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import corpus, facts, ladder, replies, usage
from tidemark.session import scratch_folder
from tidemark.sources import files, telemetry
from tidemark.sources.files import table
from tidemark.streaming import tables


@query("json_state", I.sql("SELECT DISTINCT vol_key AS key FROM chapters", "chapters"))
def json_state(spark, folder):
    path = scratch_folder(spark, "state")
    files.save_json_state(I.chapters(spark, folder).select(F.col("vol_key").alias("key")).distinct(), path)
    return files.load_json_state(spark, path, "key STRING")


@query("write_documents", I.sql("SELECT vol_key, stem, length(text) AS n_chars, md5(text) AS digest FROM chapters", "chapters"))
def write_documents(spark, folder):
    """Written twice, read back by volume and name."""
    path = scratch_folder(spark, "documents")
    for _ in range(2):
        files.write_documents(I.chapters(spark, folder), path)
    back = files.read_documents(spark, path)
    return back.select("vol_key", "stem", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("save_outputs", I.sql("""SELECT vol_key, count(*) AS n FROM chapters WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY vol_key""", "chapters"))
def save_outputs(spark, folder):
    """Two runs append to the same outputs; the second has nothing to do."""
    path = scratch_folder(spark, "outputs")
    work = corpus.new_keys(I.chapters(spark, folder).select("doc_id", "stem", "vol_key"), table(spark, folder, "labels"), "doc_id")
    corpus.save_outputs(work, path)
    rest, _ = corpus.carry_over(work, corpus.load_outputs(spark, path, work.schema), "stem")
    corpus.save_outputs(rest, path)
    return corpus.load_outputs(spark, path, work.schema).groupBy("vol_key").agg(F.count(F.lit(1)).alias("n"))


@query("bench_results", I.sql("""SELECT model, target, count(error) AS errors, count(*) AS n,
  round(CAST(sum(CASE WHEN ok THEN CAST(seconds AS DECIMAL(18, 2)) END) AS DOUBLE), 2) AS seconds
  FROM (SELECT *, CASE WHEN NOT ok THEN 'Status 502' END AS error FROM load_runs) GROUP BY model, target""", "load_runs"))
def bench_results(spark, folder):
    path = scratch_folder(spark, "bench")
    r = I.load_runs(spark, folder)
    ok = lambda c: F.when(F.col("ok"), c)
    files.write_bench_results(r.select(
        "model", ok(F.col("target")).alias("input_tokens"), ok(F.col("seconds")).alias("total_duration"),
        F.when(~F.col("ok"), F.col("target")).alias("target"), F.when(~F.col("ok"), "Status 502").alias("error")), path)
    return files.scan_bench_results(spark, path, multi_line=False).groupBy("model", "target").agg(
        F.count("error").alias("errors"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("total_duration").cast("decimal(18,2)")).cast("double"), 2).alias("seconds"))


@query("scan_load_logs", I.sql("""SELECT model, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM load_runs GROUP BY model""", "load_runs"))
def scan_load_logs(spark, folder):
    """Load-test logs written as text files, scanned by line."""
    from tidemark.catalog.telemetry import _log_lines
    path = scratch_folder(spark, "logs")
    _log_lines(spark, folder).repartitionByRange(4, "log_id").sortWithinPartitions("log_id", "line_no").select("line").write.text(path)
    runs = ladder.parse_log_lines(files.scan_lines(spark, path, "*.txt"), ["file_name"])
    return runs.filter("model IS NOT NULL").groupBy("model").agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))


@query("stream_tenant_sink", """SELECT 'anonymous' AS tenant, strftime(ts, '%Y-%m-%d') AS date, event_type AS metric, count(*) AS n
  FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2, 3""")
def stream_tenant_sink(spark, folder):
    """Metrics by tenant and day; retention then reads the days that are left."""
    root = scratch_folder(spark, "tenant")
    e = I.events(spark, folder)
    e.select("ts", F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
             "value").write.json(f"{root}/in")
    stream = telemetry.metric_stream(spark, f"{root}/in")
    tables.start(telemetry.tenant_sink(stream, f"{root}/out", f"{root}/state"), every=None).awaitTermination()
    tables.expire(spark, f"{root}/out/tenant=anonymous", "2024-01-30 00:00:00", 24)
    kept = tables.retained(spark.read.parquet(f"{root}/out"), "2024-01-30 00:00:00", 24)
    return kept.groupBy("tenant", F.date_format("date", "yyyy-MM-dd").alias("date"), "metric").agg(F.count(F.lit(1)).alias("n"))


# --- small rules ------------------------------------------------------------

@query("fill_sections", I.sql("""SELECT doc_id, n AS characters, 0 * n AS relationships, n AS terminology, n AS gender_fixes, '' AS honorifics_policy
  FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS BIGINT) AS n FROM replies)""", "replies"))
def fill_sections(spark, folder):
    parsed = facts.parse_replies(I.replies(spark, folder))
    kb = parsed.select("doc_id", facts.fill_sections(F.from_json("kb", facts.KB_SCHEMA)).alias("k"))
    return kb.select("doc_id", *[F.size(F.col("k")[s]).cast("bigint").alias(s) for s in facts.SECTIONS[:4]],
                     F.col("k.honorifics_policy").alias("honorifics_policy"))


@query("coerce_list", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang || ', ' || source ELSE '' END AS items FROM documents""")
def coerce_list(spark, folder):
    """Aliases as a plain text, as a list with empty items, or empty."""
    kind = F.col("doc_id") % 3
    raw = (F.when(kind == 0, F.concat(F.lit('"'), "source", F.lit('"')))
           .when(kind == 1, F.concat(F.lit('["'), "lang", F.lit('", "", "'), "source", F.lit('", null]'))).otherwise(F.lit('""')))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(facts.coerce_list(F.parse_json(raw)), ", ").alias("items"))


@query("page_breaks", I.sql("""SELECT doc_id, md5(CASE WHEN row_number() OVER (PARTITION BY vol_key ORDER BY vol, chap, stem) > 1
  THEN chr(10) || chr(10) || '<div style=''page-break-before: always;''></div>' || chr(10) || chr(10) || text ELSE text END) AS digest FROM chapters""", "chapters"))
def page_breaks(spark, folder):
    c = I.chapters(spark, folder)
    placed = corpus.chapter_position(c.select("doc_id", "vol_key", "vol", "chap", "stem")).select("doc_id", "chapter_pos")
    return corpus.page_breaks(c.join(placed, "doc_id")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _picky(text: str, temperature: float) -> str:
    if len(text) % 10 == 3:
        raise ValueError(f"length {len(text)}")
    return text[::-1]


@query("isolate_errors", """SELECT doc_id, CASE WHEN length(text) % 10 = 3 THEN 'error' ELSE 'processed' END AS status,
  CASE WHEN length(text) % 10 = 3 THEN 'ValueError: length ' || length(text) END AS error FROM documents""")
def isolate_errors(spark, folder):
    done = corpus.batch_transform(table(spark, folder, "documents").select("doc_id", "text"), _picky)
    good, bad = corpus.split_errors(done.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("error")))
    return good.unionByName(bad).select("doc_id", "status", "error")


@query("guard_reply", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM conversations""")
def guard_reply(spark, folder):
    c = table(spark, folder, "conversations")
    text = F.when(F.col("turn") % 3 == 0, " \n\t").otherwise(F.concat(F.lit(" "), "text"))
    return replies.guard_reply(c.select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"]).select("conv_id", "turn", "status")


@query("fill_usage", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 7 ELSE length(text) // 4 END AS prompt_tokens,
  CASE WHEN turn % 2 = 0 THEN 8 ELSE length(text) // 2 END AS completion_tokens FROM conversations""")
def fill_usage(spark, folder):
    known = F.col("turn") % 2 == 0
    c = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.repeat("text", F.lit(2)).alias("reply"),
        F.when(known, F.lit(7).cast("bigint")).otherwise(0).alias("prompt_tokens"),
        F.when(known, F.lit(8).cast("bigint")).otherwise(0).alias("completion_tokens"))
    return usage.fill_usage(c).select("conv_id", "turn", "prompt_tokens", "completion_tokens")


@query("format_amounts", """SELECT event_id, printf('$%.4f', value) AS cost, format('{:,}', event_id * 1000) AS count FROM events""")
def format_amounts(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", usage.format_cost(F.col("value")).alias("cost"), usage.thousands(F.col("event_id") * 1000).alias("count"))
