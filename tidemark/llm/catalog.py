"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import alignment, bagminhash, language, main_text, mixing, nearest, packing, quality, secrets, spelling, token_files, url_filter, warc
from tidemark.llm.batches import small_batches
from tidemark.session import scratch_folder

QUERIES, ORACLE = {}, {}


def op3_pack(spark, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "tokens")
    token_files.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.digests(warc.reassemble(warc.read_records(spark, folder)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def over_texts(run):
    """The query, with whole texts sent to Python in small batches."""
    @functools.wraps(run)
    def query(spark, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, sf_dir)

    return query


QUERIES |= {name: over_texts(run) for name, run in {
    "op1_mix": mixing.query, "op2_warc": op2_warc, "op3_pack": op3_pack, "op4_quality": quality.query,
    "op5_main_text": main_text.query, "op6_token_files": op6_token_files, "op7_url_filter": url_filter.query,
    "op8_nearest": nearest.query, "op9_near_duplicates": bagminhash.query, "op10_secrets": secrets.query,
    "op11_spelling_groups": spelling.query,
    "op12_alignment": alignment.query,
    "op13_language": language.query,
    "pipeline": corpus_pipeline.run,
}.items()}
ORACLE |= {"op1_mix": mixing.QUERY_SQL, "op2_warc": warc.QUERY_SQL, "op7_url_filter": url_filter.QUERY_SQL, "op11_spelling_groups": spelling.QUERY_SQL}
