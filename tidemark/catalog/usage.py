"""Token accounting and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import retrieval, usage, vectors
from tidemark.session import scratch_folder
from tidemark.sources.files import table

SUMS = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS calls"""


@query("usage_by_model", I.sql(f"SELECT model, {SUMS} FROM llm_calls GROUP BY model", "llm_calls"))
def usage_by_model(spark, folder):
    return usage.usage_by_model(I.llm_calls(spark, folder))


@query("usage_by_locality", I.sql(f"""SELECT coalesce(kind, 'TOTAL') AS kind, {SUMS}
  FROM (SELECT *, CASE WHEN is_local THEN 'Local' ELSE 'Cloud' END AS kind FROM llm_calls) GROUP BY ROLLUP (kind)""", "llm_calls"))
def usage_by_locality(spark, folder):
    return usage.usage_by_locality(I.llm_calls(spark, folder))


@query("all_calls", I.sql("SELECT call_id, model, is_local FROM llm_calls", "llm_calls"))
def all_calls(spark, folder):
    calls = I.llm_calls(spark, folder)
    part = lambda flag: calls.filter(F.col("is_local") == flag).drop("is_local")
    return usage.all_calls(part(True), part(False)).select("call_id", "model", "is_local")


COST = """
SELECT count(*) AS calls,
  round(CAST(sum(CASE WHEN is_local THEN prompt_tokens * 5 + completion_tokens * 15 ELSE 0 END) AS DOUBLE) / 1000000, 4) AS equivalent_cost,
  round(CAST(sum(CASE WHEN is_local THEN 0 ELSE prompt_tokens * 5 + completion_tokens * 15 END) AS DOUBLE) / 1000000, 4) AS actual_cost,
  round(CAST(sum(CASE WHEN is_local THEN prompt_tokens * 5 + completion_tokens * 15 ELSE 0 END) AS DOUBLE) / 1000000, 4) AS savings
FROM llm_calls"""


@query("cost_report", I.sql(COST, "llm_calls"))
def cost_report(spark, folder):
    return usage.cost_report(I.llm_calls(spark, folder))


@query("flat_savings", I.sql("""SELECT model, round(CAST(sum(prompt_tokens + completion_tokens) AS DOUBLE) / 1000000 * 12.5, 6) AS savings
  FROM llm_calls GROUP BY model""", "llm_calls"))
def flat_savings(spark, folder):
    return usage.usage_by_model(I.llm_calls(spark, folder)).select(
        "model", F.round(usage.flat_savings(F.col("total_tokens")), 6).alias("savings"))


@query("token_counter", I.sql("""
SELECT model, strftime(s + INTERVAL 15 SECOND, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(sum(p) OVER w AS BIGINT) AS input_tokens_total, CAST(sum(c) OVER w AS BIGINT) AS output_tokens_total
FROM (SELECT model, time_bucket(INTERVAL 15 SECOND, ts) AS s, sum(prompt_tokens) AS p, sum(completion_tokens) AS c
      FROM llm_calls GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY s)""", "llm_calls"))
def token_counter(spark, folder):
    return usage.token_counter(I.llm_calls(spark, folder)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("usage_report", I.extend(r"""
SELECT 0 AS line_no, '# Usage report' AS line UNION ALL SELECT 1, '**Run date:** 2024-01-31 09:00  '
UNION ALL SELECT 2, '**Duration:** 12.5 minutes  ' UNION ALL SELECT 3, '**Total calls:** ' || calls || '  ' FROM cost
UNION ALL SELECT 10, '| Type | Prompt Tokens | Output Tokens | Total |' UNION ALL SELECT 11, '|------|--------------:|--------------:|------:|'
UNION ALL SELECT n, '| ' || b || kind || b || ' | ' || b || format('{:,}', p) || b || ' | ' || b || format('{:,}', c) || b || ' | ' || b || format('{:,}', p + c) || b || ' |'
FROM (SELECT CASE kind WHEN 'Local' THEN 20 WHEN 'Cloud' THEN 21 ELSE 22 END AS n, CASE kind WHEN 'TOTAL' THEN '**' ELSE '' END AS b, * FROM
  (SELECT coalesce(kind, 'TOTAL') AS kind, CAST(sum(prompt_tokens) AS BIGINT) AS p, CAST(sum(completion_tokens) AS BIGINT) AS c
   FROM (SELECT *, CASE WHEN is_local THEN 'Local' ELSE 'Cloud' END AS kind FROM llm_calls) GROUP BY ROLLUP (kind)))
UNION ALL SELECT 30, '| Metric | Cost (USD) |' UNION ALL SELECT 31, '|--------|----------:|'
UNION ALL SELECT 32, '| Local inference | $0.0000 |' UNION ALL SELECT 33, printf('| Actual cloud cost | $%.4f |', actual_cost) FROM cost
UNION ALL SELECT 34, printf('| Equivalent cloud cost | $%.4f |', equivalent_cost) FROM cost
UNION ALL SELECT 35, printf('| **Total savings** | **$%.4f** |', savings) FROM cost""", {"cost": COST}, "llm_calls"))
def usage_report(spark, folder):
    return usage.usage_report(I.llm_calls(spark, folder), "2024-01-31 09:00", 12.5)


# --- retrieval --------------------------------------------------------------

@query("reject_empty", """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'Empty message' END AS error,
  CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) END AS n_chars FROM conversations""")
def reject_empty(spark, folder):
    c = table(spark, folder, "conversations").withColumn(
        "message", F.when(F.col("turn") % 4 == 3, " \n\t ").otherwise(F.concat(F.lit("\n "), "text", F.lit(" "))))
    good, bad = retrieval.reject_empty(c)
    both = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return both.select("conv_id", "turn", "error", F.length("message").cast("bigint").alias("n_chars"))


# One query per label: the mean of its vectors.
def _centroids(spark, folder):
    e = table(spark, folder, "embeddings")
    means = (e.select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim")
             .agg(F.avg(F.col("v").cast("double")).alias("v")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("embedding"))


VECTOR_SQL = """
WITH dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings,
  LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY label, i),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(v ORDER BY i) AS qv FROM dims GROUP BY label)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings))
WHERE rank <= {k} AND score > {cut}"""


@query("vector_top_k", VECTOR_SQL.format(k=5, cut=0.25))
def vector_top_k(spark, folder):
    hits = retrieval.vector_top_k(_centroids(spark, folder), table(spark, folder, "embeddings"), 5, 0.25)
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("vector_index_top_k", VECTOR_SQL.format(k=5, cut=0.25))
def vector_index_top_k(spark, folder):
    stored = scratch_folder(spark, "vectors")
    vectors.write_index(table(spark, folder, "embeddings"), stored)
    hits = vectors.Index(spark, stored).search(_centroids(spark, folder), 5, 0.25).hits
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("usable_results", "WITH usable AS (" + I.CTE["usable"] + ") SELECT query_id, rank, index, text FROM usable")
def usable_results(spark, folder):
    docs = retrieval.usable_results(I.search_results(spark, folder))
    return docs.withColumn("index", F.col("index").cast("bigint"))


RERANK = {"usable": I.CTE["usable"], "hits": """
SELECT query_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, index) AS ord FROM usable)
WHERE ord <= 5 AND relevance > 0.2 AND query_id % 4 <> 0
UNION ALL SELECT query_id, index AS ord, text FROM usable WHERE query_id % 4 = 0 AND index < 5"""}


def _reranked(spark, folder):
    """Scores come with the results; the service fails for every fourth query."""
    results = I.search_results(spark, folder)
    docs = retrieval.usable_results(results)
    scored = docs.join(results.select("query_id", "rank", "relevance"), ["query_id", "rank"])
    ranked = retrieval.top_k(scored.drop("rank"), 5, score="relevance", tie="index").select(
        "query_id", F.col("rank").alias("ord"), "index", F.col("relevance").alias("relevance_score"))
    failed = docs.select("query_id").distinct().filter(F.col("query_id") % 4 == 0)
    return retrieval.rerank_apply(docs, ranked, failed, 5)


@query("rerank_apply", I.extend("SELECT query_id, ord, text FROM hits", RERANK))
def rerank_apply(spark, folder):
    return _reranked(spark, folder).withColumn("ord", F.col("ord").cast("bigint"))


CONTEXTS = {**RERANK, "web": """SELECT query_id, list(text ORDER BY ord) AS w FROM hits WHERE query_id % 3 <> 0 GROUP BY query_id""",
            "loc": """SELECT query_id, list(text ORDER BY index) AS l FROM usable WHERE query_id % 2 = 0 AND index >= 15 GROUP BY query_id""",
            "req": """SELECT DISTINCT page_id // 25 AS query_id FROM pages""",
            "ctx": """
SELECT req.query_id, CASE WHEN w IS NOT NULL THEN array_to_string(w, '

---

') || CASE WHEN l IS NULL THEN '' ELSE
  chr(10) || chr(10) || '--- [Internal Background] ---' || chr(10) || chr(10) || array_to_string(l[1:2], '

---

') END
  WHEN l IS NOT NULL THEN array_to_string(l, '

---

') ELSE '' END AS context,
  CASE WHEN w IS NOT NULL THEN 'web' WHEN l IS NOT NULL THEN 'qdrant' ELSE 'none' END AS source
FROM req LEFT JOIN web ON web.query_id = req.query_id LEFT JOIN loc ON loc.query_id = req.query_id"""}


def _contexts(spark, folder):
    """Questions with web hits (not every third) and stored hits (every second)."""
    none = F.array().cast("array<string>")
    listed = lambda df, order, name: df.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias(name))
    results = I.search_results(spark, folder)
    web = listed(_reranked(spark, folder).filter(F.col("query_id") % 3 != 0), "ord", "web_hits")
    stored = listed(retrieval.usable_results(results).filter((F.col("query_id") % 2 == 0) & (F.col("index") >= 15)), "index", "local_hits")
    req = results.select("query_id").distinct().join(web, "query_id", "left").join(stored, "query_id", "left")
    return retrieval.assemble_context(req.withColumn("web_hits", F.coalesce("web_hits", none))
                                      .withColumn("local_hits", F.coalesce("local_hits", none)))


@query("assemble_context", I.extend("SELECT query_id, context, source FROM ctx", CONTEXTS))
def assemble_context(spark, folder):
    return _contexts(spark, folder).select("query_id", "context", "source")


@query("build_messages", I.extend("""
SELECT query_id, 0 AS n, 'system' AS role, CASE source WHEN 'qdrant' THEN '{qdrant}' WHEN 'web' THEN '{web}' ELSE '{none}' END AS content FROM ctx
UNION ALL SELECT query_id, 1, 'user', 'Context for my next question:' || chr(10) || CASE source WHEN 'web' THEN 'Web Search Context:' ELSE 'Internal Knowledge:' END || chr(10) || context FROM ctx WHERE source <> 'none'
UNION ALL SELECT query_id, 2, 'assistant', 'Understood. I will use that context. What is your question?' FROM ctx WHERE source <> 'none'
UNION ALL SELECT query_id, CASE source WHEN 'none' THEN 1 ELSE 3 END, 'user', 'question ' || query_id FROM ctx""".format(
    **{k: v.replace("'", "''") for k, v in retrieval.SYSTEM_PROMPTS.items()}), CONTEXTS))
def build_messages(spark, folder):
    question = F.concat(F.lit("question "), F.col("query_id").cast("string"))
    turns = retrieval.build_messages(question, F.col("context"), F.col("source"))
    return _contexts(spark, folder).select("query_id", F.posexplode(turns).alias("n", "m")).select(
        "query_id", "n", "m.role", "m.content")
