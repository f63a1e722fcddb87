"""Vector search against brute force, reranking and context rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.operators import vectors as V

VECTOR = "vec_id BIGINT, embedding ARRAY<DOUBLE>"


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id BIGINT, embedding ARRAY<DOUBLE>")


def test_cut_is_strict(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], VECTOR)
    hits = R.vector_top_k(queries(spark, [(9, [1.0, 0.0])]), corpus).orderBy("rank").collect()
    assert [(h.vec_id, h.score, h["rank"]) for h in hits] == [(0, 1.0, 1), (2, 0.8, 2)]


def brute(vectors, wanted, k, cut):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    out = {}
    for i, q in enumerate(wanted):
        scores = np.round(unit @ (q / max(np.linalg.norm(q), 1e-300)), 9)
        out[i] = [(int(j), float(scores[j])) for j in np.lexsort((np.arange(len(scores)), -scores))[:k] if scores[j] > cut]
    return out


def by_query(hits, n):
    rows = hits.collect()
    assert all(r["rank"] >= 1 for r in rows)
    return {i: [(h.vec_id, h.score) for h in sorted((h for h in rows if h.query_id == i), key=lambda h: h["rank"])] for i in range(n)}


@pytest.fixture(scope="module")
def clustered():
    """Clusters of different spread, a group of copies (ties go to the smaller id) and one far row."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = np.concatenate([c + rng.normal(size=(200, 6)) * s for c, s in zip(centres, np.linspace(0.01, 0.6, 12), strict=True)])
    vectors[50:90] = vectors[7]
    vectors[500] = 0
    wanted = np.vstack([vectors[7], centres[:5], rng.normal(size=(6, 6)), -centres[0], np.zeros(6)])
    return vectors, wanted


def frames(spark, vectors, wanted):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTOR).repartition(5)
    return queries(spark, [(i, q.tolist()) for i, q in enumerate(wanted)]), corpus


@pytest.mark.parametrize(("limit", "cut"), [(1 << 20, 0.4), (300, 0.4), (1 << 20, -2.0)])
def test_brute_force(spark, clustered, limit, cut):
    vectors, wanted = clustered
    asked, corpus = frames(spark, vectors, wanted)
    assert by_query(R.vector_top_k(asked, corpus, 5, cut, query_bytes=limit), len(wanted)) == brute(vectors, wanted, 5, cut)


@pytest.mark.parametrize(("limit", "cut", "k"), [(1 << 20, 0.4, 5), (300, 0.9, 3), (1 << 20, -2.0, 250)])
def test_index_gives_the_same_rows(spark, clustered, tmp_path, limit, cut, k):
    vectors, wanted = clustered
    asked, corpus = frames(spark, vectors, wanted)
    V.write_index(corpus, f"{tmp_path}/index", cells=20)
    found = V.Index(spark, f"{tmp_path}/index").search(asked, k, cut, query_bytes=limit)
    assert by_query(found.hits, len(wanted)) == brute(vectors, wanted, k, cut)
    work = found.work.collect()
    assert len(work) == len(wanted) and all(w.rows == len(vectors) and w.rows_read <= w.rows for w in work)
    if k < 10:  # a query inside a tight cluster opens a few cells only
        assert next(w for w in work if w.query_id == 1).cells_read <= 5
        assert sum(w.rows_read for w in work) < 0.6 * sum(w.rows for w in work)


def test_index_work_grows_less_than_the_corpus(spark, tmp_path):
    """Ten times the rows, with cells in proportion: a query reads a smaller share."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 8))
    shares = []
    for n in (1_000, 10_000):
        vectors = centres[rng.integers(0, 300, n)] + rng.normal(size=(n, 8)) * 0.05
        asked, corpus = frames(spark, vectors, centres[:20])
        V.write_index(corpus, f"{tmp_path}/{n}", cells=n // 50)
        found = V.Index(spark, f"{tmp_path}/{n}").search(asked, 3, 0.5)
        assert by_query(found.hits, 20) == brute(vectors, centres[:20], 3, 0.5)
        shares.append(sum(w.rows_read for w in found.work.collect()) / (20 * n))
    assert shares[1] < 0.5 * shares[0]


def test_scan_leaves_the_corpus_in_place(spark, tmp_path):
    asked, corpus = frames(spark, np.eye(6), np.eye(6)[:2])
    corpus.write.parquet(f"{tmp_path}/corpus")
    plan = R.vector_top_k(asked, spark.read.parquet(f"{tmp_path}/corpus"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "ReadSchema: struct<vec_id:bigint,embedding:array<double>>" in below


def test_odd_vectors_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []),
                                    (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0])], VECTOR)
    asked = queries(spark, [(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [1.0]), (None, [1.0, 0.0]), (5, [])])
    assert sorted((h.query_id, h.vec_id) for h in R.vector_top_k(asked, corpus).collect()) == [(1, 0), (4, 2)]
    assert R.vector_top_k(asked.limit(0), corpus).isEmpty() and R.vector_top_k(asked, corpus.limit(0)).isEmpty()
    V.write_index(corpus.filter("vec_id in (0, 1, 3, 4, 5) or vec_id is null"), f"{tmp_path}/one")
    assert [(h.query_id, h.vec_id) for h in V.Index(spark, f"{tmp_path}/one").search(asked, 5, 0.6).hits.collect()] == [(1, 0)]
    V.write_index(corpus.limit(0), f"{tmp_path}/none")
    assert V.Index(spark, f"{tmp_path}/none").search(asked, 5, 0.6).hits.isEmpty()


def test_usable_results(spark):
    df = spark.createDataFrame([(1, 1, "", "a long title"), (1, 2, "short", "ignored title"), (1, 3, None, "another title"),
                                (1, 21, "far too late in the list", None), (1, 4, "content long enough", None)],
                               "query_id INT, rank INT, content STRING, title STRING")
    got = R.usable_results(df).orderBy("index").collect()
    assert [(r["index"], r.text) for r in got] == [(0, "a long title"), (1, "another title"), (2, "content long enough")]


def test_rerank(spark):
    docs = spark.createDataFrame([(q, i, t) for q in (1, 2) for i, t in enumerate("abc")], "query_id INT, index INT, text STRING")
    ranked = spark.createDataFrame([(1, 0, 2, 0.9), (1, 1, 0, 0.2)], "query_id INT, ord INT, index INT, relevance_score DOUBLE")
    failed = spark.createDataFrame([(2,)], "query_id INT")
    got = R.rerank_apply(docs, ranked, failed, 2).orderBy("query_id", "ord").collect()
    assert [(r.query_id, r.text) for r in got] == [(1, "c"), (2, "a"), (2, "b")]


@pytest.mark.parametrize("web, local, context, source", [
    (["a", "b"], ["x", "y", "z"], "a\n\n---\n\nb\n\n--- [Internal Background] ---\n\nx\n\n---\n\ny", "web"),
    (["a"], [], "a", "web"), ([], ["x"], "x", "qdrant"), ([], [], "", "none"),
])
def test_context_and_messages(spark, web, local, context, source):
    df = R.assemble_context(spark.createDataFrame([(web, local)], "web_hits ARRAY<STRING>, local_hits ARRAY<STRING>"))
    row = df.select("context", "source", R.build_messages(F.lit("why?"), F.col("context"), F.col("source")).alias("m")).first()
    assert (row.context, row.source) == (context, source)
    assert len(row.m) == (2 if source == "none" else 4)
    assert row.m[0].role == "system" and row.m[-1].content == "why?"


def test_split_hits(spark):
    df = spark.createDataFrame([("a\n\nb",), ("",), (None,)], "t STRING")
    assert [r.h for r in df.select(R.split_hits(F.col("t")).alias("h")).collect()] == [["a", "b"], [], []]


def test_reject_empty(spark):
    good, bad = R.reject_empty(spark.createDataFrame([(" hi\n",), (" \t",), (None,)], "message STRING"))
    assert [r.message for r in good.collect()] == ["hi"] and bad.count() == 2
