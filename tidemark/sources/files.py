"""Document, state, report and benchmark files."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce
from itertools import islice
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import BATCH_ROWS, cut_lineage, slice_count, small_batches

BROADCAST_SPLITS = 200_000
READ_BYTES = 8_000_000
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
PATH_SIGNS = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
PATH_CODE = re.compile("%([0-9A-Fa-f]{2})")
BENCH_SCHEMA = (
    "model STRING, input_tokens BIGINT, output_tokens BIGINT, ttft DOUBLE, tpot DOUBLE, "
    "total_duration DOUBLE, target BIGINT, error STRING"
)
STATE_SCHEMA = "processed_volumes ARRAY<STRING>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_files(spark: SparkSession, folder: str, glob: str = "*", fmt: str = "text") -> DataFrame:
    """Files of a folder with their names.  Text files come as one row each; an empty folder is an error.

    A file of another format may also be a folder of parts, as Spark writes a table: its rows have the folder's name.
    """
    reader = spark.read.format(fmt).option("pathGlobFilter", glob)
    if fmt == "text":
        reader = reader.option("wholetext", True)
    parted = {} if fmt == "text" else folders_of(spark, folder, glob)
    frames = [spark.read.format(fmt).load(f"{folder}/{name}").withColumn("file_name", F.lit(name)) for name in parted]
    try:
        df = reader.load(folder)
    except AnalysisException as problem:
        # No file of its own matches, so there is no schema either.
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
    else:
        path = F.regexp_replace(F.col("_metadata.file_path"), "^[^:/]+:(//[^/]*)?", "")
        apart = reduce(and_, [~F.startswith(path, F.lit(f"{at}/")) for at in parted.values()], F.lit(True))
        if df.inputFiles():
            frames.append(df.filter(apart).select("*", F.col("_metadata.file_name").alias("file_name")))
    if not frames:
        raise FileNotFoundError(f"no file matches {glob} in {folder}")
    named = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return named.withColumnRenamed("value", "text") if fmt == "text" else named


def folders_of(spark: SparkSession, folder: str, glob: str) -> dict[str, str]:
    """Names and paths of the folders in ``folder`` that match."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return {s.getPath().getName(): s.getPath().toUri().getRawPath() for s in found if s.isDirectory()}


def scan_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Lines of text files with file name and line number (from 0); files of any size are read in splits.

    A first pass counts the lines of each split; a line's number is that of its split's first line and its place there,
    so no line is shuffled, sorted or written.  Lines end with a line feed, a carriage return or both.  Files of equal
    names in different folders are numbered each for itself.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(folder)
    if not lines.inputFiles():
        raise FileNotFoundError(f"no file matches {glob} in {folder}")
    # The rows of a split have ascending ids without gaps, and both passes read the same splits in the same tasks.
    placed = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                          F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    # One row per split; a file has few of them, and all of them together are what the driver lists to plan the scan.
    splits = cut_lineage(placed.groupBy("_path", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    starts = splits.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), (before - F.col("_first")).alias("_shift"))
    if splits.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return (placed.join(starts, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
            .select("file_name", (F.col("_row") + F.col("_shift")).cast("bigint").alias("line_no"), "line"))


def load_json_state(spark: SparkSession, path: str, schema: str = STATE_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Saved state; a missing or unreadable file is an empty state.  ``multi_line``: one indented document per file."""
    fields = StructType.fromDDL(schema)
    try:
        df = spark.read.schema(fields).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)
    return df.dropna("all")


def save_json_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machines (a shared mount on a cluster); None if it lies in another store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def partition_folder(column: str, value: str | None) -> str:
    """Name of the folder of a value, as Spark's writers give it."""
    return f"{column}={PATH_SIGNS.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else NO_VALUE}"


def partition_value(folder: str) -> str | None:
    value = folder.split("=", 1)[1]
    return None if value == NO_VALUE else PATH_CODE.sub(lambda m: chr(int(m[1], 16)), value)


def write_documents(df: DataFrame, path: str, key: str = "vol_key", name: str = "stem", text: str = "text") -> None:
    """One text file per document, in the folder of its name below that of its volume; a rerun replaces the folder.

    Documents that share volume and name are files beside each other.  The documents of a volume are spread over tasks
    by their names, so a large volume is not one task.  In a local or mounted folder the tasks write the files
    themselves, as Spark's local writer starts three programs a file to set its rights; they are put in place once all
    are written.
    """
    spark = df.sparkSession
    dealt = df.select(key, name, text).repartitionByRange(slice_count(spark), key, name)
    root = local_path(spark, path)
    if root is None:
        (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1)
         .partitionBy(key, name).text(path))
        return
    run = uuid.uuid4().hex
    staged = f"{root}/_writing-{run}"
    os.makedirs(staged)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        # An attempt that is lost leaves its files here, where no one looks for them.
        own = f"{staged}/{context.partitionId()}-{context.taskAttemptId()}"
        os.makedirs(own)
        n = 0
        with open(f"{own}/list", "w", encoding="utf-8") as places:
            for batch in batches:
                for volume, stem, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with open(f"{own}/{n}", "wb") as f:
                        f.write((value or b"") + b"\n")
                    places.write(json.dumps(f"{partition_folder(key, volume)}/{partition_folder(name, stem)}") + "\n")
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (f for batch in batches for f in batch.column(0).to_pylist()):
            task = os.path.basename(own).split("-")[0]
            with open(f"{own}/list", encoding="utf-8") as places:
                for n, place in enumerate(map(json.loads, places)):
                    folder = f"{root}/{place}"
                    os.makedirs(folder, exist_ok=True)
                    old = [f for f in os.listdir(folder) if run not in f]
                    with suppress(FileNotFoundError):  # an attempt that was lost has put it there
                        os.rename(f"{own}/{n}", f"{folder}/part-{int(task):05d}-{run}-{n:08d}.txt")
                    for f in old:
                        os.unlink(f"{folder}/{f}")
        yield from ()

    small_batches(spark)
    rows = (dealt.select(F.col(key).cast("string"), F.col(name).cast("string"), F.col(text).cast("binary"))
            .mapInArrow(written, "folder string").collect())  # a row per task
    if rows:
        done = spark.createDataFrame(rows, "folder string").repartition(len(rows))
        done.mapInArrow(placed, "folder string").write.format("noop").mode("overwrite").save()
    shutil.rmtree(staged)


def read_documents(spark: SparkSession, path: str, key: str = "vol_key", name: str = "stem", text: str = "text") -> DataFrame:
    """The documents written there, with volume and name.

    In a local or mounted folder the driver lists the volumes, and tasks the documents.
    """
    root = local_path(spark, path)
    if root is None:
        files = spark.read.schema(f"value STRING, {key} STRING, {name} STRING").text(path, wholetext=True)
        # The writer ends a file with a new line.
        return files.select(key, name, F.left("value", F.length("value") - 1).alias(text))
    volumes = [(e.name,) for e in os.scandir(root) if e.name.startswith(f"{key}=")]
    if not volumes:
        return spark.createDataFrame([], f"{key} string, {name} string, {text} string")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for volume in (v for batch in batches for v in batch.column(0).to_pylist()):
            found = (f"{volume}/{stem.name}/{file.name}" for stem in os.scandir(f"{root}/{volume}") if stem.name.startswith(f"{name}=")
                     for file in os.scandir(stem.path) if not file.name.startswith((".", "_")))
            while some := list(islice(found, BATCH_ROWS)):
                yield pa.RecordBatch.from_pydict({"file": some})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], [key, name, text])

        for file in (f for b in batches for f in b.column(0).to_pylist()):
            with open(f"{root}/{file}", "rb") as f:
                value = f.read()[:-1]  # the writer ends a file with a new line
            rows.append((*map(partition_value, file.split("/")[:2]), value))
            held += len(value)
            if len(rows) == BATCH_ROWS or held >= READ_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    small_batches(spark)
    found = spark.createDataFrame(volumes, "volume string").repartition(min(len(volumes), slice_count(spark))).mapInArrow(listed, "file string")
    return (found.repartition(slice_count(spark)).mapInArrow(read, f"{key} string, {name} string, {text} binary")
            .withColumn(text, F.col(text).cast("string")))


def write_report(lines: DataFrame, path: str) -> None:
    """Ordered report lines as one small text file (a report has a fixed number of lines)."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def scan_bench_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Load-test results and error rows, as JSON arrays or (not ``multi_line``) a row per line; ``target`` is set in both."""
    df = spark.read.schema(BENCH_SCHEMA).option("multiLine", multi_line).json(path)
    return df.withColumn("target", F.coalesce("target", "input_tokens"))


def write_bench_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
