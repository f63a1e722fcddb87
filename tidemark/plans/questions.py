"""From questions to the chat turns sent to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R


def _listed(df: DataFrame, order: str, name: str) -> DataFrame:
    # At most a handful of hits per question are left here.
    return df.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias(name))


def question_turns(questions: DataFrame, corpus: DataFrame, payload: DataFrame, results: DataFrame, ranked: DataFrame,
                   failed: DataFrame, cut: float = R.VECTOR_CUT) -> DataFrame:
    """``questions``: (query_id, message, embedding).  Adds context, source and messages.

    ``payload``: (vec_id, text) of the stored vectors; ``results``, ``ranked`` and ``failed``
    as for ``usable_results`` and ``rerank_apply``.
    """
    asked, _ = R.reject_empty(questions)
    hits = R.vector_top_k(asked.filter(F.col("embedding").isNotNull()), corpus, cut=cut)
    stored = _listed(hits.join(payload, "vec_id").select("query_id", "rank", "text"), "rank", "local_hits")
    web = R.rerank_apply(R.usable_results(results), ranked, failed, R.TOP_VECTORS)
    pieces = web.select("query_id", F.posexplode(R.split_hits(F.col("text"))).alias("piece", "text"), "ord").select(
        "query_id", F.struct("ord", "piece").alias("ord"), "text")
    none = F.array().cast("array<string>")
    full = (asked.join(stored, "query_id", "left").join(_listed(pieces, "ord", "web_hits"), "query_id", "left")
            .withColumn("local_hits", F.coalesce("local_hits", none)).withColumn("web_hits", F.coalesce("web_hits", none)))
    out = R.assemble_context(full)
    return out.withColumn("messages", R.build_messages(F.col("message"), F.col("context"), F.col("source")))
