"""Exact nearest vectors: by one scan that leaves the corpus where it is, or from an index in storage."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, scratch_folder, slice_count

QUERY_BYTES = 32 << 20
SAMPLE_ROWS, MOST_CELLS, ROWS_A_CELL, ROUNDS = 10_000, 1_024, 2_000, 8
VECTOR_ROWS = 1_024
SCORE_DIGITS = 9
SLACK = 1e-6
HITS = "query_id bigint, vec_id bigint, score double"


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def usable(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key and a vector of finite numbers, as doubles."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("bigint").alias(key), vector.alias("embedding")).filter(
        F.col(key).isNotNull() & (F.size("embedding") > 0) & finite)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lists of that many numbers, these lists as rows)"""
    sizes = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero(sizes == size)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return at, values[starts[at][:, None] + np.arange(size)]


class Best:
    """The best ``k`` rows of each query so far; ``wanted`` are unit vectors of one length."""

    def __init__(self, ids: np.ndarray, wanted: np.ndarray, k: int, cut: float):
        self.ids, self.wanted, self.k, self.cut = ids, wanted, k, cut
        self.place, self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, vectors: np.ndarray, asking: np.ndarray | None = None) -> None:
        """See corpus rows; only the queries at ``asking`` look at them."""
        asking = np.arange(len(self.ids)) if asking is None else asking
        for at in range(0, len(rows), VECTOR_ROWS):
            # Rounded, so that equal vectors tie and the smaller id comes first.
            scores = np.round(self.wanted[asking] @ unit(vectors[at:at + VECTOR_ROWS]).T, SCORE_DIGITS)
            keep = scores > self.cut
            if scores.shape[1] > self.k:
                keep &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k:].min(axis=1, keepdims=True)
            query, row = np.nonzero(keep)
            self.place = np.concatenate([self.place, asking[query]])
            self.rows = np.concatenate([self.rows, rows[at + row]])
            self.scores = np.concatenate([self.scores, scores[query, row]])
            order = np.lexsort((self.rows, -self.scores, self.place))
            order = order[np.arange(len(order)) - np.searchsorted(self.place[order], self.place[order]) < self.k]
            self.place, self.rows, self.scores = self.place[order], self.rows[order], self.scores[order]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.place]), pa.array(self.rows), pa.array(self.scores)],
                                          ["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(usable queries, in how many blocks of at most about ``limit`` bytes they go)"""
    asked = usable(queries, "query_id")
    size = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    return asked, math.ceil(size / limit)


def in_memory(asked: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a block of queries, by the length of the vectors."""
    rows: dict[int, list] = {}
    for r in asked.collect():
        rows.setdefault(len(r.embedding), []).append(r)
    return {n: (np.array([r.query_id for r in own], np.int64), unit(np.array([r.embedding for r in own], np.float64)))
            for n, own in rows.items()}


def block_of(asked: DataFrame, i: int, n: int) -> DataFrame:
    return asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else asked


def scan_best(corpus: DataFrame, wanted: dict[int, tuple[np.ndarray, np.ndarray]], k: int, cut: float) -> DataFrame:
    """Best rows of each task for a block of queries; the corpus is read where it lies."""
    shared = corpus.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(*own, k, cut) for n, own in shared.value.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for n, own in best.items():
                at, vectors = matrix(batch.column(1), n)
                own.add(ids[at], vectors)
        yield from (own.batch() for own in best.values() if len(own.rows))

    return usable(corpus, "vec_id").mapInArrow(run, HITS)


def top_k_by_scan(queries: DataFrame, corpus: DataFrame, k: int, cut: float, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` rows of largest cosine above ``cut``, ties to the smaller id.

    The queries are counted in bytes and go out in blocks of at most ``query_bytes``; every task keeps the best ``k``
    rows of each query among its own, and only these are shuffled.  Several blocks read the corpus once each, and their
    hits are written before the next block is fetched, so the driver holds one block.  A query is compared with the
    vectors of its own length; rows without an id, without a vector or with a component that is null or not finite
    take no part, on either side.
    """
    spark = queries.sparkSession
    asked, blocks = query_blocks(queries, query_bytes)
    if blocks <= 1:
        return ranked(scan_best(corpus, in_memory(asked), k, cut), k)
    folder = scratch_folder(spark, "hits")
    for i in range(blocks):
        ranked(scan_best(corpus, in_memory(block_of(asked, i, blocks)), k, cut), k).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


# --- index ------------------------------------------------------------------

def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit vectors; starts from evenly spread rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


def write_index(corpus: DataFrame, folder: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Store the corpus by cells: ``folder/rows`` (a folder per cell) and ``folder/cells`` (centre, radius, rows).

    Centres come from at most ``sample_rows`` vectors, those of the smallest id hashes; every usable vector is stored,
    in the cell of its nearest centre.  The radius is the largest distance of the cell's unit vectors from the centre.
    Vectors of another length than the most frequent one are left out (ties: the longer).  ``cells`` is about one per
    ROWS_A_CELL rows, MOST_CELLS at most, unless given; a large cell lies in several files.  ``cells`` is written last,
    so an index that died on the way cannot be read.
    """
    rows = usable(corpus, "vec_id")
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size, n = (sizes["size"], sizes["n"]) if sizes else (1, 0)
    rows = rows.filter(F.size("embedding") == size)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    sample = unit(np.array([r.embedding for r in picked], np.float64).reshape(len(picked), size))
    wanted = min(cells or math.ceil(n / ROWS_A_CELL), MOST_CELLS, max(1, len(sample)))
    centres = centroids(sample, wanted) if len(sample) else np.zeros((1, size))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = matrix(batch.column(1), size)
            vectors = unit(vectors)
            own = np.empty(len(at), np.int32)
            away = np.empty(len(at))
            for i in range(0, len(at), VECTOR_ROWS):
                part = vectors[i:i + VECTOR_ROWS]
                own[i:i + len(part)] = (part @ shared.value.T).argmax(axis=1)
                away[i:i + len(part)] = np.linalg.norm(part - shared.value[own[i:i + len(part)]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(away)],
                                             ["vec_id", "embedding", "cell", "away"])

    dealt = rows.mapInArrow(run, "vec_id bigint, embedding array<double>, cell int, away double")
    # Ranges of (cell, id) cut a large cell into several files.
    (dealt.repartitionByRange(slice_count(corpus.sparkSession), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
     .write.partitionBy("cell").parquet(f"{folder}/rows"))
    spark = corpus.sparkSession
    if n:
        extents = (spark.read.parquet(f"{folder}/rows").groupBy(F.col("cell").cast("int").alias("cell"))
                   .agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect())
    else:
        extents = []
    spark.createDataFrame([(r.cell, r.n, r.radius, centres[r.cell].tolist()) for r in extents],
                          "cell int, n bigint, radius double, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")


@dataclass
class Found:
    hits: DataFrame  #: query_id, vec_id, score, rank
    work: DataFrame  #: query_id, cells_read, cells, rows_read, rows


class Index:
    """An index that ``write_index`` stored; its cells' centres and radii are held by the driver."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.cells = np.array([r.cell for r in cells], np.int64)
        self.sizes = np.array([r.n for r in cells], np.int64)
        self.radii = np.array([r.radius for r in cells], np.float64)
        self.centres = np.array([r.centre for r in cells], np.float64)

    def _read(self, ids: np.ndarray, wanted: np.ndarray, asking: np.ndarray, k: int, cut: float) -> DataFrame | None:
        """Best rows of the cells each query asks for (``asking``: queries by cells); other cells' folders are not opened."""
        used = np.flatnonzero(asking.any(axis=0))
        if not len(used):
            return None
        shared = self.spark.sparkContext.broadcast((ids, wanted, {int(self.cells[c]): np.flatnonzero(asking[:, c]) for c in used}))
        size = wanted.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, askers = shared.value
            best = Best(names, vectors, k, cut)
            for batch in batches:
                cells, rows = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                at, values = matrix(batch.column(1), size)
                for cell in np.unique(cells).tolist():
                    own = cells[at] == cell
                    best.add(rows[at[own]], values[own], askers[cell])
            if len(best.rows):
                yield best.batch()

        stored = self.spark.read.parquet(f"{self.folder}/rows").filter(F.col("cell").isin(*map(int, self.cells[used])))
        return stored.select("vec_id", "embedding", F.col("cell").cast("int").alias("cell")).mapInArrow(run, HITS)

    def _block(self, ids: np.ndarray, wanted: np.ndarray, k: int, cut: float) -> tuple[DataFrame | None, np.ndarray]:
        own = (wanted ** 2).sum(axis=1, keepdims=True)
        away = np.sqrt(np.maximum(0, own - 2 * wanted @ self.centres.T + (self.centres ** 2).sum(axis=1)))
        zero = np.linalg.norm(wanted, axis=1) == 0
        least = np.maximum(0, away - self.radii - SLACK)  # no row of the cell is nearer: the triangle inequality
        far = math.sqrt(max(0.0, 2 - 2 * cut)) if cut > -1 else 2.0
        possible = (least <= far) & ~(zero[:, None] & (cut >= 0))
        possible |= zero[:, None] & (cut < 0)  # a query of zeros scores 0 everywhere
        # First the nearest cells that hold k rows; what is found there bounds the rest.
        order = np.argsort(np.where(possible, away, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        first = np.zeros_like(possible)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= possible
        near = self._read(ids, wanted, first, k, cut)
        if near is None:
            return None, first
        near = cut_lineage(near)  # read for the bound and for the result
        kth = ranked(near, k).filter(F.col("rank") == k).select("query_id", "score").collect()  # a row per query of the block
        bound = np.full(len(ids), far)
        at = {int(q): i for i, q in enumerate(ids)}
        for r in kth:
            bound[at[r.query_id]] = min(far, math.sqrt(max(0.0, 2 - 2 * r.score)) + SLACK)
        bound[zero] = np.inf
        rest = possible & ~first & (least <= bound[:, None])
        further = self._read(ids, wanted, rest, k, cut)
        return (near if further is None else near.union(further)), first | rest

    def search(self, queries: DataFrame, k: int, cut: float, query_bytes: int = QUERY_BYTES) -> Found:
        """The same rows as ``top_k_by_scan`` over the stored vectors, from the cells that can hold one of them.

        A cell is left out when its radius keeps all its rows below ``cut``, or below the ``k``-th best score found in
        the query's nearest cells.  ``work`` says how much was read.  Queries go in blocks as there.
        """
        spark = self.spark
        asked, blocks = query_blocks(queries, query_bytes)
        folder = scratch_folder(spark, "hits")
        spark.createDataFrame([], f"{HITS}, rank int").write.parquet(f"{folder}/hits")
        spark.createDataFrame([], "query_id bigint, cells_read bigint, cells bigint, rows_read bigint, rows bigint").write.parquet(f"{folder}/work")
        for i in range(blocks):
            own = in_memory(block_of(asked, i, blocks))
            for size, (ids, wanted) in own.items():
                # Vectors of another length than the stored ones meet none.
                read = np.zeros((len(ids), len(self.cells)), bool)
                if len(self.cells) and size == self.centres.shape[1]:
                    found, read = self._block(ids, wanted, k, cut)
                    if found is not None:
                        ranked(found, k).write.mode("append").parquet(f"{folder}/hits")
                work = [(int(q), int(c.sum()), len(self.cells), int(self.sizes[c].sum()), int(self.sizes.sum())) for q, c in zip(ids, read, strict=True)]
                spark.createDataFrame(work, spark.read.parquet(f"{folder}/work").schema).write.mode("append").parquet(f"{folder}/work")
        return Found(spark.read.parquet(f"{folder}/hits"), spark.read.parquet(f"{folder}/work"))
