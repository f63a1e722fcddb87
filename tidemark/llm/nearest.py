"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

NEIGHBOURS = 10
QUERY_STEP = 100
PROJECTIONS = 8
CONFIDENCE = 0.98
LEAF = 64
BLOCK_ROWS = 16_384
QUERY_BLOCK = 2_048


def chi_square_below(x: float, m: int) -> float:
    """Probability that a chi-square variable with an even number ``m`` of degrees of freedom is below x."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_bound(p: float, m: int) -> float:
    """The x that a chi-square variable stays below with probability ``p``."""
    low, high = 0.0, 1.0
    while chi_square_below(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, m) < p else (low, mid)
    return high


class KdTree:
    """Boxes around projected points, halved at the median of their widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.spans, self.lows, self.highs, self.children = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            node = len(self.spans)
            self.spans.append((a, b))
            self.lows.append(own.min(axis=0))
            self.highs.append(own.max(axis=0))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            if b - a > leaf:
                widest = int(np.argmax(self.highs[node] - self.lows[node]))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, widest], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)

    def leaves(self, point: np.ndarray):
        """(squared distance to the box, rows) of all leaves, nearest box first."""
        gap = np.maximum(0, np.maximum(self.lows - point, point - self.highs))
        near = np.einsum("ij,ij->i", gap, gap).tolist()
        heap = [(near[0], 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            left, right = self.children[node]
            if left < 0:
                a, b = self.spans[node]
                yield distance, self.order[a:b]
            else:
                heapq.heappush(heap, (near[left], left))
                heapq.heappush(heap, (near[right], right))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, projections: int,
           confidence: float, seed: int, counter: list | None = None) -> list[tuple[int, int, float]]:
    """(query, row, distance) of the k nearest found in one block.

    The squared projected distance of a row at distance d is d^2 times a chi-square variable.  Boxes
    come nearest first; a row is verified unless one nearer than the k-th found would be projected
    nearer with the wanted probability, and once that holds for a whole box, the search of this query ends.
    """
    matrix = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
    projected = vectors @ matrix
    tree = KdTree(projected)
    bound = chi_square_bound(confidence, projections)
    # Equal vectors may differ here by rounding; they must not fall behind the bound.
    slack = 1e-9 * (1 + float(np.abs(projected).max()) ** 2)
    out = []
    for query_id, query, at in zip(query_ids.tolist(), queries, queries @ matrix, strict=True):
        best_d, best_i, verified = np.zeros(0), np.zeros(0, np.int64), 0
        for distance, rows in tree.leaves(at):
            if len(best_d) == k and distance > bound * best_d[-1] ** 2 + slack:
                break
            rows = rows[ids[rows] != query_id]
            if len(best_d) == k:  # the same test for each row of the box
                gap = projected[rows] - at
                rows = rows[np.einsum("ij,ij->i", gap, gap) <= bound * best_d[-1] ** 2 + slack]
            difference = vectors[rows] - query
            d = np.concatenate([best_d, np.sqrt((difference * difference).sum(axis=1))])
            i = np.concatenate([best_i, ids[rows]])
            order = np.lexsort([i, d])[:k]
            best_d, best_i = d[order], i[order]
            verified += len(rows)
        if counter is not None:
            counter.append(verified)
        out += [(query_id, i, d) for i, d in zip(best_i.tolist(), best_d.tolist(), strict=True)]
    return out


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return (vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, vec_id: str = "vec_id", vector: str = "embedding",
            projections: int = PROJECTIONS, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS,
            query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest rows found for every row whose id is divisible by ``step``.

    Rows whose vector is missing, zero, or has missing or infinite components, and
    rows without an id, take no part.  Rows that share an id count as one, the
    smallest vector.  Only vectors of equal length are compared.  Every row is indexed: rows are dealt
    into blocks of about ``block_rows`` and queries into blocks of about
    ``query_block``; each pair of blocks is one group with a kd-tree of its own, of which k
    rows per query leave.  Nearest first, ties to the smaller id.
    """
    rows = cut_lineage(usable(vectors, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")))
    asked = rows.filter(F.col("vec_id") % step == 0)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    parts = max(1, math.ceil(asked.count() / query_block))
    dealt = lambda name, n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select(dealt("block", blocks, 1), "vec_id", "v").select("*", every("part", parts))
    right = asked.select(dealt("part", parts, 2), F.col("vec_id").alias("query_id"), "v").select("*", every("block", blocks))

    def group(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, own in asked.groupby(asked["v"].map(len)):
            near = rows[rows["v"].map(len) == width]
            if len(near):
                out += search(near["vec_id"].to_numpy(), np.stack(near["v"]), own["query_id"].to_numpy(), np.stack(own["v"]),
                              k, projections, confidence, seed)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        group, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
