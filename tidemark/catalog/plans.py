"""Whole flows over the test tables with small deterministic text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.knowledge import _context
from tidemark.catalog.corpus import RUN_DATE, TITLE, WORK, WS
from tidemark.catalog.registry import query
from tidemark.catalog.usage import _centroids
from tidemark.operators import corpus, facts, retrieval
from tidemark.plans import corpus as flows
from tidemark.plans import operations, questions
from tidemark.sources.files import table


def _extract(prompt: str, temperature: float) -> str:
    """A fact about the length of the chunk; every fifth length gives no JSON."""
    body = prompt.split("]\n\n", 1)[1]
    return "no idea" if len(body) % 5 == 0 else '```json\n{"gender_fixes": ["rest %d"]}\n```' % (len(body) % 7)


EXTRACTED = """
SELECT doc_id, i + 1 AS chunk_no, length(substr(text, CAST(i * 111500 + 1 AS BIGINT), 112000)) AS n
FROM (SELECT *, (length(text) + 111499) // 111500 AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
  LATERAL (SELECT unnest(range(0, n)) AS i)"""


@query("extract_facts", I.extend("SELECT doc_id * 1000000 + chunk_no AS seq, 'rest ' || (n % 7) AS value FROM x WHERE n % 5 <> 0", {"x": EXTRACTED}))
def extract_facts(spark, folder):
    found, _ = flows.extract_facts(I.chapters(spark, folder), table(spark, folder, "labels"), _extract)
    return found.select("seq", "value")


@query("extract_errors", I.extend("SELECT doc_id, chunk_no, 'reply is not JSON' AS error FROM x WHERE n % 5 = 0", {"x": EXTRACTED}))
def extract_errors(spark, folder):
    return flows.extract_facts(I.chapters(spark, folder), table(spark, folder, "labels"), _extract)[1]


def _clean(prompt: str, temperature: float) -> str:
    body = prompt.split(") ===\n\n", 1)[1]
    if body.startswith("Th"):
        raise ValueError("refused")
    return "<think>hm</think><cleaned_text>" + body.replace("e", "E") + "</cleaned_text>"


def _review(prompt: str, temperature: float) -> str:
    return prompt.split("=== CLEANED VERSION (needs QA) ===\n", 1)[1] + " Reviewed"


FINISHED = {
    **_context(3500),
    "room": "SELECT 64000 - length(context) - 1000 AS size, length(context) AS used FROM context",
    "parts": f"""
SELECT doc_id, string_agg(nullif(trim(replace(substr(text, CAST(i * (size - 2000) + 1 AS BIGINT), size), 'e', 'E'), {WS}), ''),
  chr(10) || chr(10) ORDER BY i) AS cleaned, bool_or(starts_with(substr(text, CAST(i * (size - 2000) + 1 AS BIGINT), size), 'Th')) AS bad
FROM chapters, room, LATERAL (SELECT unnest(range(0, (length(text) + size - 2001) // (size - 2000))) AS i) GROUP BY doc_id""",
    "finished": f"""
SELECT c.stem, c.vol_key, c.vol, c.chap,
  CASE WHEN l.doc_id IS NOT NULL THEN 'old ' || c.stem WHEN length(trim(c.text, {WS})) < 100 OR bad THEN NULL
  ELSE '# ' || {TITLE} || chr(10) || chr(10) || '<p class="meta">' || upper(replace(vol_key, '_', ' '))
    || ' · Cleaned {RUN_DATE} · {WORK}</p>' || chr(10) || chr(10)
    || trim(regexp_replace(CASE WHEN (used + length(c.text) + 2 * length(cleaned)) // 4 <= 32000 THEN cleaned || ' Reviewed' ELSE cleaned END,
            '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) || chr(10) END AS text,
  CASE WHEN l.doc_id IS NOT NULL OR length(trim(c.text, {WS})) < 100 THEN 'skipped' WHEN bad THEN 'error' ELSE 'processed' END AS status,
  CASE WHEN l.doc_id IS NULL AND length(trim(c.text, {WS})) >= 100 AND bad THEN 'ValueError: refused' END AS error
FROM chapters c JOIN room ON true LEFT JOIN parts p ON p.doc_id = c.doc_id LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = c.doc_id"""}


def _finished(spark, folder):
    chapters = I.chapters(spark, folder)
    done = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    outputs = chapters.join(done, "doc_id", "left_semi").select(
        "stem", "vol_key", "vol", "chap", F.concat(F.lit("old "), "stem").alias("text"))
    context = facts.pack_context(facts.merge_facts(I.facts(spark, folder)), flows.CONTEXT_CHARS)
    return flows.clean_chapters(chapters, outputs, context, _clean, _review, RUN_DATE, WORK)


@query("clean_chapters", I.extend("SELECT stem, vol_key, status, error, length(text) AS n_chars, md5(text) AS digest FROM finished",
                                  FINISHED, "merged", "chapters"))
def clean_chapters(spark, folder):
    return _finished(spark, folder).select("stem", "vol_key", "status", "error", F.length("text").cast("bigint").alias("n_chars"),
                                           F.md5(F.col("text").cast("binary")).alias("digest"))


@query("clean_volumes", I.extend("""
SELECT vol_key, count(*) AS n_chapters, md5(string_agg(text, chr(10) || chr(10) || chr(10) || chr(10)
  || '<div style=''page-break-before: always;''></div>' || chr(10) || chr(10) ORDER BY vol, chap, stem)) AS digest
FROM finished WHERE text IS NOT NULL GROUP BY vol_key""", FINISHED, "merged", "chapters"))
def clean_volumes(spark, folder):
    """One row per whole volume, however many parts it has."""
    return corpus.volume_digests(flows.volumes(_finished(spark, folder)))


# --- questions --------------------------------------------------------------

# A question per label; stored texts are the documents with the id of the vector.
@query("question_turns", r"""
WITH dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings,
  LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY label, i),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(v ORDER BY i) AS qv FROM dims GROUP BY label),
hits AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings) WHERE score > 0.25),
stored AS (SELECT query_id, list(text ORDER BY rank) AS l FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY query_id),
usable AS (""" + I.CTE["usable"] + r"""),
web AS (SELECT query_id, list(text ORDER BY ord) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, index) AS ord FROM usable) WHERE ord <= 5 AND relevance > 0.2 AND query_id % 4 <> 0 GROUP BY query_id
  UNION ALL SELECT query_id, list(text ORDER BY index) FROM usable WHERE query_id % 4 = 0 AND index < 5 GROUP BY query_id),
ctx AS (SELECT q.query_id, CASE WHEN w IS NOT NULL THEN 'web' WHEN l IS NOT NULL THEN 'qdrant' ELSE 'none' END AS source,
  CASE WHEN w IS NOT NULL THEN array_to_string(w, '{s}') || CASE WHEN l IS NULL THEN '' ELSE '{b}' || array_to_string(l[1:2], '{s}') END
       WHEN l IS NOT NULL THEN array_to_string(l, '{s}') ELSE '' END AS context
  FROM q LEFT JOIN web ON web.query_id = q.query_id LEFT JOIN stored ON stored.query_id = q.query_id)
SELECT query_id, source, md5(context) AS digest, CAST(CASE source WHEN 'none' THEN 2 ELSE 4 END AS BIGINT) AS n_turns FROM ctx""".replace(
    "{s}", retrieval.HIT_SEPARATOR).replace("{b}", retrieval.BACKGROUND_HEADER))
def question_turns(spark, folder):
    results = I.search_results(spark, folder)
    docs = retrieval.usable_results(results)
    scored = docs.join(results.select("query_id", "rank", "relevance"), ["query_id", "rank"]).drop("rank")
    ranked = retrieval.top_k(scored, 5, score="relevance", tie="index").select(
        "query_id", F.col("rank").alias("ord"), "index", F.col("relevance").alias("relevance_score"))
    failed = docs.select("query_id").distinct().filter(F.col("query_id") % 4 == 0)
    asked = _centroids(spark, folder).withColumn("message", F.concat(F.lit(" question "), F.col("query_id").cast("string")))
    stored = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    out = questions.question_turns(asked, table(spark, folder, "embeddings"), stored, results, ranked, failed, cut=0.25)
    return out.select("query_id", "source", F.md5(F.col("context").cast("binary")).alias("digest"),
                      F.size("messages").cast("bigint").alias("n_turns"))


# --- operations -------------------------------------------------------------

@query("request_feed", I.extend("""
SELECT trace_id AS request_id, epoch_us(min(ts)) AS us, count(*) AS n_steps, CAST(sum(input_tokens) AS BIGINT) AS input_tokens
FROM w WHERE trace_id IN (SELECT trace_id FROM w GROUP BY trace_id ORDER BY min(ts) DESC, trace_id LIMIT 50) GROUP BY trace_id""",
    {"w": """SELECT * FROM feed WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '2024-01-31 00:00:00'
  AND CAST(split_part(trace_id, '/', 1) AS BIGINT) % 3 = 1"""}, "feed"))
def request_feed(spark, folder):
    feed = operations.request_feed(I.traces(spark, folder), "2024-01-31 00:00:00", 240, service="svc-1", stored_ts="ts")
    total = F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, x: a + x["input_tokens"])
    return feed.select("request_id", F.unix_micros("ts").alias("us"), F.size("steps").cast("bigint").alias("n_steps"),
                       total.alias("input_tokens"))


def _ask(prompt: str, temperature: float) -> str:
    if prompt.count("purchase") % 3 == 1:
        raise TimeoutError("slow")
    return prompt.split("LOGS:\n", 1)[1].replace("view", "VIEW") * 4


@query("diagnose", I.extend("""
SELECT alert_id, alert_no, length(d) AS n_chars, CASE WHEN length(d) > 4000 THEN left(d, 1000) || '...' || chr(10) || chr(10)
  || '📄 **Full diagnostic report attached below.**' ELSE d END AS shown, CASE WHEN length(d) > 4000 THEN md5(d) END AS attached
FROM (SELECT alert_id, alert_no, CASE WHEN (length(log_text) - length(replace(log_text, 'purchase', ''))) // 8 % 3 = 1
  THEN 'Local LLM unreachable for diagnosis.' ELSE repeat(replace(log_text || chr(10) || chr(10) || 'Diagnosis:', 'view', 'VIEW'), 4) END AS d FROM al)""",
    {"al": """
SELECT alert_id, alert_no, coalesce(string_agg(l.line, chr(10) ORDER BY l.ts, l.seq) FILTER (rn <= 50), 'No logs found or Loki unreachable.') AS log_text
FROM (SELECT a.alert_id, a.alert_no, g.ts, g.seq, g.line, row_number() OVER (PARTITION BY a.alert_id, a.alert_no ORDER BY g.ts DESC, g.seq DESC) AS rn
      FROM (SELECT * FROM alerts WHERE needs_diagnosis) a
      LEFT JOIN logs g ON g.pod = a.pod AND g.namespace = a.namespace AND g.ts <= a.ts AND g.ts >= a.ts - INTERVAL 240 HOUR) l GROUP BY alert_id, alert_no"""}, "alerts", "logs"))
def diagnose(spark, folder):
    told = operations.diagnose(I.alert_payloads(spark, folder), I.logs(spark, folder), _ask, look_back_hours=240)
    return told.select("alert_id", "alert_no", F.length("diagnosis").cast("bigint").alias("n_chars"), "shown",
                       F.md5(F.col("attachment").cast("binary")).alias("attached"))
