"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A folder holds ``kind=ids`` with files of one block each and ``kind=index`` with
one line per range of documents (range, documents, ids).  A block is

    magic, crc32 of the rest | header | document ids | boundaries | ids | newline

Document ids (less the smallest; rows without one come first and are counted in
the header) and boundaries are Elias-Fano codes; the ids take two bytes each where
the vocabulary allows it, else four.  Spark's text writer commits the files, so
they may lie in any store Spark writes to, and lost tasks leave nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.tokens import END_ID, default_path, shared_encoder
from tidemark.session import slice_count

MAGIC = b"TIDETOK2"
HEAD = "<QQQqQB"  # range, ids before it in the range, rows without id, smallest id, rows, bytes per id
BLOCK_IDS = 4_000_000
ROWS_A_CALL, ROWS_ENCODED = 256, 1_000


def block_bytes(span: int, before: int, doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    body = b"".join([
        struct.pack(HEAD, span, before, len(doc_ids) - len(known), least, len(doc_ids), width),
        EliasFano.of(known.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)).to_bytes(),
        EliasFano.of(bounds).to_bytes(), ids.astype(f"<u{width}", copy=False).tobytes()])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Block:
    """A block as it is stored: ``docs`` and ``ends`` of a run of documents are read by select."""

    def __init__(self, data: bytes):
        view = memoryview(data)[:-1]
        if bytes(view[:8]) != MAGIC or struct.unpack_from("<I", view, 8)[0] != zlib.crc32(view[12:]):
            raise ValueError("not a whole block of token ids")
        self.span, self.before, self.missing, self.least, self.rows, width = struct.unpack_from(HEAD, view, 12)
        self.known, at = EliasFano.from_bytes(view, 12 + struct.calcsize(HEAD))
        self.bounds, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.bounds.universe, at)

    def docs(self, first: int, last: int) -> list[int | None]:
        none = max(0, min(last, self.missing) - first)
        known = self.known.run(first + none - self.missing, last - self.missing) if first + none < last else np.zeros(0, np.uint64)
        return [None] * none + (known + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)).astype(np.int64).tolist()

    def ends(self, first: int, last: int) -> np.ndarray:
        """Where the documents first to last - 1 begin, and where the last of them ends."""
        return self.bounds.run(first, last + 1).astype(np.int64)


def read_block(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(range, ids before the block in its range, document ids, boundaries, ids) of a whole block"""
    block = Block(data)
    return block.span, block.before, block.docs(0, block.rows), block.ends(0, block.rows), block.ids.astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, doc_id: str = "doc_id",
                      text: str = "text", block_ids: int = BLOCK_IDS, ranges: int | None = None) -> None:
    """Encode every text, END_ID behind each, in ascending ``doc_id`` order (rows without an id first).

    A missing text is an empty one.  Rows that share an id come in the order of
    their texts.  Other columns are not read.  A block holds about ``block_ids``
    ids and is all a task keeps; one document is never cut.
    """
    path = tokenizer or default_path()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, span, width = None, 0, 4
        before = total = rows = held = 0
        own_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            data = block_bytes(span, before, own_ids, bounds, np.concatenate(parts), width)
            return pa.RecordBatch.from_arrays([pa.array(["ids"]), pa.array([data], pa.binary())], ["kind", "value"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_ENCODED):
                piece = batch.slice(at, ROWS_ENCODED)
                if encoder is None:
                    encoder = shared_encoder(path)
                    width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
                span = piece.column(2)[0].as_py()
                ids, bounds = encoder.encode(piece.column(1))
                own_ids += piece.column(0).to_pylist()
                sizes.append(np.diff(bounds))
                parts.append(ids.astype(f"<u{width}"))  # a block waits in the bytes it is stored in
                held += len(ids)
                if held >= block_ids:
                    yield block()
                    before, total, rows = before + held, total + held, rows + len(own_ids)
                    held, own_ids, sizes, parts = 0, [], [], []
        if own_ids:
            yield block()
            total, rows = total + held, rows + len(own_ids)
        if rows:
            line = f"{span} {rows} {total}".encode()
            yield pa.RecordBatch.from_arrays([pa.array(["index"]), pa.array([line], pa.binary())], ["kind", "value"])

    ordered = (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(ranges or slice_count(docs.sparkSession), "doc_id")
               .sortWithinPartitions("doc_id", "text").withColumn("span", F.spark_partition_id()))
    (ordered.mapInArrow(blocks, "kind string, value binary")
     .select("kind", F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).partitionBy("kind").text(folder))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (unsigned 32-bit little-endian) per document."""
    stored = spark.read.format("binaryFile").load(folder)
    if "kind" not in stored.columns:  # files of an empty table
        return spark.createDataFrame([], "doc_id bigint, start bigint, ids binary")
    line = F.split("value", " ")
    # One row per range that was written, so the running sum over all of them is small.
    index = (spark.read.schema("value string").text(f"{folder}/kind=index")
             .select(line[0].cast("bigint").alias("span"), line[2].cast("bigint").alias("n")))
    starts = index.select(F.col("span").alias("_span"), (
        F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("_start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                block = Block(value.as_py())
                for at in range(0, block.rows, ROWS_A_CALL):
                    to = min(at + ROWS_A_CALL, block.rows)
                    ends = block.ends(at, to)
                    whole = block.ids[ends[0]:ends[-1]].astype("<u4").tobytes()
                    offsets = ((ends - ends[0]) * 4).astype(np.int32)
                    values = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.span] * (to - at), pa.int64()), pa.array(block.docs(at, to), pa.int64()),
                         pa.array(ends[:-1] + block.before, pa.int64()), values], ["span", "doc_id", "start", "ids"])

    found = stored.filter("kind = 'ids'").select("content").mapInArrow(rows, "span bigint, doc_id bigint, start bigint, ids binary")
    return found.join(F.broadcast(starts), F.col("span") == F.col("_span")).select(
        "doc_id", (F.col("start") + F.col("_start")).alias("start"), "ids")
