"""Vector search, reranking and context assembly for questions in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.operators import vectors
from tidemark.operators.facts import first_n

# Score cuts, limits and separators of the retrieval rules.
VECTOR_CUT = 0.6
RERANK_CUT = 0.2
TOP_VECTORS = 5
MAX_RESULTS = 20
MIN_RESULT_CHARS = 10
BACKGROUND_HITS = 2
HIT_SEPARATOR = "\n\n---\n\n"
BACKGROUND_HEADER = "\n\n--- [Internal Background] ---\n\n"
SYSTEM_PROMPTS = {
    "qdrant": "You are a helpful assistant with access to an internal knowledge base. "
              "Use the provided context to answer the user's question accurately and concisely. "
              "For comparisons or multi-entity analysis, always provide the output in a clean Markdown table. "
              "If the context doesn't fully answer the question, say so.",
    "web": "You are a helpful assistant. The following information was retrieved from the internet. "
           "Use it to answer the question concisely. For logical comparisons, prefer using Markdown tables.",
    "none": "You are a helpful assistant. Provide the best answer based on your general knowledge.",
}
CONTEXT_PREFIX = {"qdrant": "Internal Knowledge:\n", "web": "Web Search Context:\n"}
CONTEXT_TURN = "Context for my next question:\n"
CONTEXT_REPLY = "Understood. I will use that context. What is your question?"

MESSAGE = "array<struct<role:string,content:string>>"


def reject_empty(requests: DataFrame, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """(requests with their message stripped, requests that are empty with an error)."""
    stripped = requests.withColumn(message, strip(F.col(message)))
    empty = F.coalesce(F.col(message), F.lit("")) == ""
    return (stripped.filter(~empty),
            stripped.filter(empty).withColumn("error", F.lit("Empty message")))


def score_cut(score: Column, cut: float) -> Column:
    return F.coalesce(score.cast("double"), F.lit(0.0)) > cut


def top_k(scored: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "vec_id") -> DataFrame:
    """Best ``k`` rows per key; ties go to the smaller id."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_VECTORS, cut: float = VECTOR_CUT, **options) -> DataFrame:
    """Exact nearest corpus vectors per query: (query_id, vec_id, score, rank), score above ``cut``; one scan of the
    corpus, see ``vectors.top_k_by_scan``.  ``vectors.Index`` answers from a stored corpus without reading all of it.

    Cutting before ranking gives the same rows as ranking before cutting, and less to shuffle.
    """
    return vectors.top_k_by_scan(queries, corpus, k, cut, **options)


def usable_results(results: DataFrame) -> DataFrame:
    """First 20 results; content, else title; longer than 10 characters; ``index`` counts from 0."""
    text = F.coalesce(F.nullif("content", F.lit("")), F.col("title"), F.lit(""))
    kept = (results.filter(F.col("rank") <= MAX_RESULTS)
            .select("query_id", "rank", text.alias("text")).filter(F.length("text") > MIN_RESULT_CHARS))
    # At most 20 rows per query are left, so numbering them is cheap.
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("index", F.row_number().over(w) - 1)


def rerank_apply(docs: DataFrame, ranked: DataFrame, failed: DataFrame, k: int, cut: float = RERANK_CUT) -> DataFrame:
    """Documents in the order of the reranker above the cut; first ``k`` where it failed.

    ``ranked``: (query_id, ord, index, relevance_score); ``failed``: query_id.
    """
    hits = (ranked.filter(score_cut(F.col("relevance_score"), cut))
            .join(docs.select("query_id", "index", "text"), ["query_id", "index"])
            .select("query_id", "ord", "text"))
    fallback = (docs.filter(F.col("index") < k).join(failed.select("query_id"), "query_id", "left_semi")
                .select("query_id", F.col("index").alias("ord"), "text"))
    return hits.join(failed.select("query_id"), "query_id", "left_anti").unionByName(fallback)


def split_hits(web_text: Column) -> Column:
    """Joined web text back to hits: a result that holds a blank line becomes several."""
    return F.when(F.coalesce(web_text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(web_text, "\n\n"))


def assemble_context(requests: DataFrame, web: str = "web_hits", local: str = "local_hits") -> DataFrame:
    """Add ``context`` and ``source``; web hits come first, then two background hits."""
    web_hits, local_hits = F.col(web), F.col(local)
    background = F.when(F.size(local_hits) > 0, F.concat(
        F.lit(BACKGROUND_HEADER), F.array_join(F.slice(local_hits, 1, BACKGROUND_HITS), HIT_SEPARATOR))).otherwise("")
    context = (F.when(F.size(web_hits) > 0, F.concat(F.array_join(web_hits, HIT_SEPARATOR), background))
               .when(F.size(local_hits) > 0, F.array_join(local_hits, HIT_SEPARATOR)).otherwise(""))
    source = (F.when(F.size(web_hits) > 0, "web").when(F.size(local_hits) > 0, "qdrant").otherwise("none"))
    return requests.withColumn("context", context).withColumn("source", source)


def build_messages(message: Column, context: Column, source: Column) -> Column:
    """Chat turns for a question: system, context and its acknowledgement, question."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    system = F.lit(SYSTEM_PROMPTS["none"])
    prefix = F.lit("")
    for name in ("web", "qdrant"):
        system = F.when(source == name, F.lit(SYSTEM_PROMPTS[name])).otherwise(system)
        prefix = F.when(source == name, F.lit(CONTEXT_PREFIX[name])).otherwise(prefix)
    with_context = F.array(
        turn("system", system), turn("user", F.concat(F.lit(CONTEXT_TURN), prefix, context)),
        turn("assistant", F.lit(CONTEXT_REPLY)), turn("user", message))
    return F.when(source.isin(*CONTEXT_PREFIX), with_context).otherwise(
        F.array(turn("system", system), turn("user", message)))
