"""Knowledge building and chapter cleaning with text functions given by the user."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus, facts

Reply = Callable[[str, float], str]

CONTEXT_CHARS = 3_500
SEQ_CHUNKS = 1_000_000


def has_body(reply: str | None) -> bool:
    """True when ``clean_reply`` leaves something of the reply: it decides in the task whether to ask again."""
    rest = reply or ""
    for pattern in T.REASONING_PATTERNS:
        rest = re.sub(pattern, "", rest)
    body = re.search(f"(?s)<{T.BODY_TAG}>(.*?)</{T.BODY_TAG}>", rest)
    return not (rest if body is None else body[1]).isspace() and bool(rest if body is None else body[1])


def extract_facts(documents: DataFrame, processed: DataFrame, extract: Reply, key: str = "doc_id",
                  partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts of the documents not processed yet, chunks that failed).

    ``key`` is a whole number: documents merge in its order, chunks in theirs.
    """
    fresh = corpus.new_keys(documents, processed, key)
    size, overlap = T.FACT_CHUNK
    chunks = corpus.chunk_text(fresh.select(key, "stem", "text"), size, overlap)
    header = F.concat(F.lit("[Source: "), F.col("stem"), F.lit(" chunk "), F.col("chunk_no").cast("string"),
                      F.lit("/"), F.col("n_chunks").cast("string"), F.lit("]\n\n"))
    prompts = chunks.select(key, "chunk_no", F.concat(header, F.col("text")).alias("prompt"))
    replies = corpus.batch_transform(prompts, extract, "prompt", temperature=0.1, partitions=partitions)
    parsed = facts.parse_replies(replies.drop("prompt").withColumn("raw", T.clean_reply(F.col("result"))))
    # The upper digits order documents, the lower ones chunks; a document fits in one cell, so it never has more.
    seq = F.col(key) * SEQ_CHUNKS + F.col("chunk_no")
    found = facts.flatten_kb(parsed.filter("error IS NULL AND NOT failed").withColumn("seq", seq))
    failed = parsed.filter("error IS NOT NULL OR failed").select(
        key, "chunk_no", F.coalesce("error", F.lit("reply is not JSON")).alias("error"))
    return found, failed


def build_context(known: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Merged, reconciled and packed facts (one row)."""
    return facts.pack_context(facts.synthesise(facts.drop_overwritten(known)), max_chars)


def clean_chapters(chapters: DataFrame, outputs: DataFrame, context: DataFrame, clean: Reply, review: Reply | None,
                   run_date: str, work: str, force: bool = False, partitions: int | None = None) -> DataFrame:
    """Finished chapters: ``stem``, ``vol_key``, ``vol``, ``chap``, ``text``, ``status``, ``error``.

    ``outputs`` (same columns) are kept unless ``force``.  Short chapters are skipped, a
    chapter with a failing chunk is an error, and a chapter too long for the review keeps
    its cleaned text.  The context is at most a few thousand characters.
    """
    keys = ["stem", "vol_key", "vol", "chap"]
    todo, kept = corpus.carry_over(chapters, outputs, "stem", force)
    todo = corpus.with_status(todo)
    pending = todo.filter("status = 'pending'")

    used, room = context.select(*T.chunk_limit(F.col("context"))).first()
    shown = context.sparkSession.createDataFrame([(used,)], "context STRING")
    chunks = corpus.chunk_text(pending.select("stem", "text"), room, T.CLEAN_OVERLAP)
    prompts = corpus.attach_context(chunks, shown, F.col("stem")).drop("text")
    replies = corpus.batch_transform(prompts, clean, "prompt", partitions=partitions, accept=has_body).drop("prompt")
    replies = replies.withColumn("text", T.clean_reply(F.col("result")))
    problems = replies.filter("error IS NOT NULL").groupBy("stem").agg(F.min("error").alias("problem"))
    # The chunks come from one cell, so together they fit in one: a single part.
    stitched = corpus.stitch_chunks(replies, "stem", max_chunks=2 ** 31 - 1).select(
        "stem", F.col("text").alias("cleaned"), F.col("status").alias("outcome"))
    error = F.when(F.col("status") == "pending", F.coalesce("problem", F.when(F.col("outcome") == "error", "no text")))
    drafts = (todo.join(stitched, "stem", "left").join(problems, "stem", "left").withColumn("failure", error))

    ready = (F.col("status") == "pending") & F.col("failure").isNull()
    body, failure = F.col("cleaned"), F.col("failure")
    if review is not None:
        # Rows without a prompt pass the review untouched, so one pass serves all chapters.
        fits = T.qa_fits(F.lit(used), F.col("text"), F.col("cleaned"))
        prompt = F.concat(F.lit(used), F.lit("\n\n=== RAW TEXT ===\n"), F.col("text"),
                          F.lit("\n\n=== CLEANED VERSION (needs QA) ===\n"), F.col("cleaned"))
        drafts = corpus.batch_transform(
            drafts.select(*keys, "status", "failure", "cleaned", F.when(ready & fits, prompt).alias("prompt")),
            review, "prompt", temperature=0.15, partitions=partitions)
        body = F.when(F.col("prompt").isNotNull(), T.clean_reply(F.col("result"))).otherwise(F.col("cleaned"))
        failure = F.coalesce("failure", "error")

    page = T.render_chapter(T.title_from_stem(F.col("stem")), body, F.col("vol_key"), run_date, work)
    good = (F.col("status") == "pending") & failure.isNull()
    finished = drafts.select(
        *keys, F.when(good, page).alias("text"),
        F.when(F.col("status") == "skipped", "skipped").when(good, "processed").otherwise("error").alias("status"),
        failure.alias("error"))
    earlier = kept.select(*keys, "text", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    return finished.unionByName(earlier)


def volumes(finished: DataFrame) -> DataFrame:
    """Volume documents of the chapters that have text."""
    return corpus.assemble_volume(finished.filter("text IS NOT NULL"))
