"""Chapters, chunks and volumes: splitting, incremental work, cleaning hooks, reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions import text as T
from tidemark.operators.scan import beside, ordered_text, with_parts, with_position
from tidemark.session import cut_lineage, slice_count, small_batches
from tidemark.sources.generations import Generations, Parts

BLOCK_CHUNKS = 64
PART_CHAPTERS = 1_000
PART_PAGES = 10_000
PART_CHUNKS = 1_000


# --- keys and filters -------------------------------------------------------

def with_chapter_keys(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Add ``vol_key``, ``vol``, ``chap`` and ``stem`` derived from the file name."""
    name = F.col(file_name)
    return df.select(
        "*", T.volume_key(name).alias("vol_key"), T.chapter_volume(name).alias("vol"),
        T.chapter_number(name).alias("chap"), T.stem(name).alias("stem"),
    )


def filter_volumes(df: DataFrame, volumes: Sequence[int], file_name: str = "file_name") -> DataFrame:
    """Keep files whose leading number is listed; names without one are dropped."""
    return df.filter(T.leading_number(F.col(file_name)).isin(list(volumes)))


def with_status(df: DataFrame, text: str = "text", min_chars: int = T.MIN_TEXT_CHARS) -> DataFrame:
    """``skipped`` for short text, else ``pending``."""
    ok = T.long_enough(F.col(text), min_chars)
    return df.withColumn("status", F.when(ok, "pending").otherwise("skipped"))


# --- incremental runs -------------------------------------------------------

def new_keys(available: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return available.join(processed.select(key), key, "left_anti")


def carry_over(work: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows still to do, earlier outputs to reuse).  ``force`` redoes everything."""
    if force:
        return work, outputs.limit(0)
    return (work.join(outputs.select(key), key, "left_anti"),
            outputs.join(work.select(key), key, "left_semi"))


def resolve_chapters(members: DataFrame, outputs: DataFrame, key: str = "stem") -> DataFrame:
    """Volume members that have an output."""
    return members.join(outputs.select(key), key, "left_semi")


def raw_and_clean(raw: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Raw and cleaned text side by side."""
    return raw.select(key, F.col("text").alias("raw")).join(
        clean.select(key, F.col("text").alias("cleaned")), key)


def run_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def volume_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("vol_key").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.min("chap").alias("first_chap"),
        F.max("chap").alias("last_chap"))


def _newest(name: str) -> Callable[[Parts], Parts]:
    def combine(parts: Parts) -> Parts:
        rows = parts["rows"]
        last = rows.groupBy(name).agg(F.max("_generation").alias("_last"))
        return {"rows": beside(rows, last, ["_last"], [name]).filter("_generation = _last").drop("_last")}

    return combine


def save_outputs(results: DataFrame, path: str, name: str = "stem") -> None:
    """Finished rows: the restart state of the next run, read by ``load_outputs``.

    A run's rows are a generation of their own beside the older ones, and the manifest that names it is written last:
    a run that dies leaves the old state whole.  A row replaces those saved before under the same name, also where it
    moved to another volume.  Only a folder without a manifest is a first run; one that cannot be read is an error.
    """
    store = Generations(results.sparkSession, path, _newest(name))
    number = store.manifest()["last"] + 1
    store.add(number, {"rows": results.withColumn("_generation", F.lit(number).cast("bigint"))})


def load_outputs(spark: SparkSession, path: str, schema: str | StructType, name: str = "stem") -> DataFrame:
    """The saved rows; none before the first run."""
    parts = Generations(spark, path, _newest(name)).read()
    return spark.createDataFrame([], schema) if parts is None else parts["rows"].drop("_generation")


# --- chunks -----------------------------------------------------------------

def chunk_text(df: DataFrame, max_chars: int, overlap: int = 500, text: str = "text") -> DataFrame:
    """One row per overlapping window: ``chunk_no`` (from 1), ``n_chunks``, ``start``, ``text``.

    Long texts are cut into blocks of 64 windows first, so a window is taken from
    its block and not searched from the start of the whole text.
    """
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")
    step = max_chars - overlap
    span = step * BLOCK_CHUNKS
    rest = [c for c in df.columns if c != text]
    size = F.length(F.col(text))
    blocks = df.filter(size > 0).select(
        *rest, size.alias("_size"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), size - 1, F.lit(span)),
            lambda p: F.substr(F.col(text), p + 1, F.lit(span + overlap)))).alias("_block_no", "_block"),
    )
    left = F.least(F.lit(span), F.col("_size") - F.col("_block_no") * span)
    return blocks.select(
        *rest, "_size", "_block_no",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), left - 1, F.lit(step)),
            lambda p: F.substr(F.col("_block"), p + 1, F.lit(max_chars)))).alias("_i", text),
    ).select(
        *rest,
        (F.col("_block_no") * BLOCK_CHUNKS + F.col("_i") + 1).cast("bigint").alias("chunk_no"),
        F.ceil(F.col("_size") / step).alias("n_chunks"),
        (F.col("_block_no") * span + F.col("_i") * step).cast("bigint").alias("start"),
        text,
    )


def chunk_label(label: Column, word: str = "part") -> Column:
    return F.concat(label, F.lit(f" [{word} "), F.col("chunk_no").cast("string"), F.lit("/"),
                    F.col("n_chunks").cast("string"), F.lit("]"))


def attach_context(chunks: DataFrame, context: DataFrame, label: Column, text: str = "text") -> DataFrame:
    """Prompt of each chunk: the one-row context, a header, the chunk.

    The context is a scalar subquery, read once; nothing is joined.
    """
    return chunks.withColumn("prompt", F.concat(
        context.scalar(), F.lit("\n\n=== RAW CHAPTER TEXT ("), chunk_label(label),
        F.lit(") ===\n\n"), F.col(text)))


def stitch_chunks(chunks: DataFrame, key: str, text: str = "text", drop_overlap: int = 0,
                  max_chunks: int = PART_CHUNKS) -> DataFrame:
    """Non-empty chunk texts in order, joined by a blank line; a key without text is an error.

    ``drop_overlap`` removes that many leading characters from all but the first
    chunk.  ``part_no`` is (chunk - 1) div ``max_chunks``, so a key with very many chunks
    comes in ordered parts; all parts of a key have the status of the whole key.
    """
    body = F.col(text)
    if drop_overlap:
        body = F.when(F.col("chunk_no") > 1, F.substr(body, F.lit(drop_overlap + 1))).otherwise(body)
    part = F.expr(f"(chunk_no - 1) div {int(max_chunks)}")
    full = chunks.select(key, "chunk_no", part.alias("part_no"), F.nullif(body, F.lit("")).alias("_body"))
    items = F.sort_array(F.collect_list(F.when(F.col("_body").isNotNull(), F.struct("chunk_no", "_body"))))
    joined = F.array_join(F.transform(items, lambda x: x["_body"]), "\n\n")
    out = full.groupBy(key, "part_no").agg(joined.alias("text"))
    some = full.groupBy(key).agg(F.max(F.col("_body").isNotNull()).alias("_some"))
    status = F.when(F.col("_some"), "processed").otherwise("error")
    return out.join(some, key).select(key, "part_no", "text", status.alias("status"))


def guard_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """``status`` error when there is no text at all."""
    missing = F.coalesce(F.col(text), F.lit("")) == ""
    return df.withColumn("status", F.when(missing, "error").otherwise("processed"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("status") != "error"), df.filter(F.col("status") == "error")


# --- user-supplied text functions -------------------------------------------

def batch_transform(df: DataFrame, fn: Callable[[str, float], str], text: str = "text",
                    temperature: float = 0.25, retry_temperature: float = 0.7,
                    partitions: int | None = None, accept: Callable[[str], bool] = bool) -> DataFrame:
    """Apply ``fn(text, temperature)`` to each row: adds ``result``, ``attempts``, ``error``.

    A result that is not accepted (by default: an empty one) is tried again once at
    the higher temperature.  Rows without text are passed on.  A row that
    raises gets its message in ``error`` and the run goes on.  Rows are few and
    heavy, so they are spread evenly first (``partitions``, or as many as a shuffle has).
    Calls are paid for: the result is written to the shared folder here and now, so no later use calls again.
    """
    small_batches(df.sparkSession)
    df = df.repartition(partitions or slice_count(df.sparkSession))

    def one(value: str | None) -> tuple[str | None, int, str | None]:
        calls = 0
        if value is None:
            return None, calls, None
        try:
            for heat in (temperature, retry_temperature):
                calls += 1
                result = fn(value, heat)
                if accept(result):
                    break
            return result, calls, None
        except Exception as problem:  # one bad row must not end the run
            return None, calls, f"{type(problem).__name__}: {problem}"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(v) for v in batch[text]]
            yield batch.assign(result=[r[0] for r in rows], attempts=[r[1] for r in rows],
                               error=[r[2] for r in rows])

    out = StructType([*df.schema.fields, StructField("result", StringType()),
                      StructField("attempts", LongType()), StructField("error", StringType())])
    return cut_lineage(df.mapInPandas(apply, out))


# --- documents and volumes --------------------------------------------------

def assemble_pages(pages: DataFrame, key: str = "doc_id", max_pages: int = PART_PAGES) -> DataFrame:
    """Pages in order joined by a newline; ``part_no`` is the page div ``max_pages``."""
    part = F.expr(f"page_no div {int(max_pages)}").cast("bigint")
    return (pages.withColumn("part_no", part).groupBy(key, "part_no")
            .agg(ordered_text(["page_no"], "text", "\n").alias("text"),
                 F.count(F.lit(1)).alias("n_pages")))


def chapter_position(chapters: DataFrame) -> DataFrame:
    """``chapter_pos``: 0-based place inside the volume, by chapter number then name."""
    return with_position(chapters, ["vol_key"], ["vol", "chap", "stem"], "chapter_pos")


def page_breaks(chapters: DataFrame, text: str = "text") -> DataFrame:
    """Put a page break before every chapter but the first of its volume."""
    return chapters.withColumn(text, F.when(
        F.col("chapter_pos") > 0, F.concat(F.lit(T.PAGE_BREAK), F.col(text))).otherwise(F.col(text)))


def assemble_volume(chapters: DataFrame, max_chapters: int = PART_CHAPTERS, text: str = "text") -> DataFrame:
    """One document per volume and part; ``part_no`` is the chapter's position div ``max_chapters``.
    Joining the parts of a volume by a blank line gives the whole document."""
    parted = with_parts(chapters, ["vol_key"], ["vol", "chap", "stem"], max_chapters)
    # A break goes before every chapter but the first, so it is part of the separator.
    body = ordered_text(["vol", "chap", "stem"], text, "\n\n" + T.PAGE_BREAK)
    return parted.groupBy("vol_key", "part_no").agg(
        body.alias("_body"), F.count(F.lit(1)).alias("n_chapters"),
    ).select("vol_key", "part_no", F.when(
        F.col("part_no") > 0, F.concat(F.lit(T.PAGE_BREAK), F.col("_body"))
    ).otherwise(F.col("_body")).alias("document"), "n_chapters")


def volume_digests(parts: DataFrame) -> DataFrame:
    """``n_chapters`` and md5 ``digest`` of each whole volume, from the parts of ``assemble_volume``.

    The parts of a volume go through one task in order, a few at a time; the whole document is never put together.
    """
    small_batches(parts.sparkSession)
    ordered = (parts.select("vol_key", "part_no", "n_chapters", "document")
               .repartition("vol_key").sortWithinPartitions("vol_key", "part_no"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_pydict({"vol_key": pa.array([key], pa.string()), "n_chapters": [n], "digest": [md5.hexdigest()]})
        key, n, md5 = None, 0, None
        for batch in batches:
            for vol_key, chapters, document in zip(batch["vol_key"], batch["n_chapters"], batch["document"], strict=True):
                if md5 is None or vol_key.as_py() != key:
                    if md5 is not None:
                        yield row()
                    key, n, md5 = vol_key.as_py(), 0, hashlib.md5()
                elif n:
                    md5.update(b"\n\n")
                n += chapters.as_py()
                md5.update(document.as_py().encode())
        if md5 is not None:
            yield row()

    return ordered.mapInArrow(digest, "vol_key string, n_chapters bigint, digest string")
