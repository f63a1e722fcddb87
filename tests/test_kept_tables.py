"""Tables that streams keep: generations under a manifest, incremental facts, the feed, replies in parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as K
from tidemark.sources import generations
from tidemark.sources.generations import Generations
from tidemark.streaming import tables
from tidemark.streaming.replies import STATE_STORE, stream_replies, use_state_store

FACTS = "seq BIGINT, pos BIGINT, path ARRAY<STRING>, kind STRING, value STRING"


def total(parts):
    return {"rows": parts["rows"].groupBy("key").agg(F.sum("n").alias("n"))}


def batch(spark, i):
    return {"rows": spark.createDataFrame([("all", 1), (f"k{i % 3}", i)], "key string, n bigint")}


def state(store):
    return {r.key: r.n for r in store.read()["rows"].collect()}


def test_many_batches_leave_few_folders(spark, tmp_path):
    store = Generations(spark, f"{tmp_path}/t", total, fan=3)
    assert store.read() is None
    for i in range(30):
        store.add(i, batch(spark, i))
        assert state(store)["all"] == i + 1
    entries = store.manifest()["entries"]
    assert [e["level"] for e in entries] == sorted((e["level"] for e in entries), reverse=True) and len(entries) <= 2 * 4
    assert len(os.listdir(f"{tmp_path}/t/data")) <= len(entries) + 2 * 3 and len([n for n in os.listdir(f"{tmp_path}/t/manifests") if n.isdigit()]) == 2
    assert state(store) == {"all": 30, **{f"k{k}": sum(range(k, 30, 3)) for k in range(3)}}


def test_batches_that_run_again_or_die(spark, tmp_path, monkeypatch):
    store = Generations(spark, f"{tmp_path}/t", total, fan=2)
    store.add(0, batch(spark, 0))
    store.add(1, batch(spark, 1))
    before = store.manifest()
    store.add(1, batch(spark, 1))
    store.add(0, batch(spark, 0))
    assert store.manifest() == before and state(store)["all"] == 2
    monkeypatch.setattr(Generations, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.add(2, batch(spark, 2))
    monkeypatch.undo()
    assert state(store)["all"] == 2  # what was written is not part of the table
    store.add(2, batch(spark, 2))
    assert state(store)["all"] == 3
    other = Generations(spark, f"{tmp_path}/t", total, fan=2)
    other.manifest = lambda number=None: before
    with pytest.raises(OSError, match="another writer"):
        other.add(9, batch(spark, 9))


def test_reader_in_between_keeps_its_state(spark, tmp_path):
    store = Generations(spark, f"{tmp_path}/t", total, fan=2)
    for i in range(3):
        store.add(i, batch(spark, i))
    seen = store.read()["rows"]
    store.add(3, batch(spark, 3))  # folds what the reader has open
    assert {r.key: r.n for r in seen.collect()}["all"] == 3 and state(store)["all"] == 4


def random_facts(rng, n):
    paths = [["a"], ["a", "b"], ["a", "b", "c"], ["a", "d"], ["e"], ["e", "f"]]
    out, pos = [], {}
    for _ in range(n):
        seq = rng.randrange(14)
        pos[seq] = pos.get(seq, 0) + 1
        out.append((seq, pos[seq], rng.choice(paths), rng.choice(["scalar", "list", "list"]), rng.choice("xyz")))
    return out


def key(rows):
    return sorted((r.seq, r.pos, tuple(r.path), r.kind, r.value) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_incremental_facts_equal_one_merge(spark, tmp_path, seed):
    """Facts in any order, changes of kind and late ones included, in batches of any size."""
    rng = random.Random(seed)
    all_facts = random_facts(rng, 60)
    store = Generations(spark, f"{tmp_path}/kb", tables.surviving_facts, fan=2)
    at = i = 0
    while at < len(all_facts):
        n = rng.randrange(3, 20)
        part = spark.createDataFrame(all_facts[at:at + n], FACTS)
        store.add(i, tables.surviving_facts({"facts": part, "marks": K.kind_marks(part)}))
        at, i = at + n, i + 1
    whole = spark.createDataFrame(all_facts, FACTS)
    assert key(tables.merged_view(spark, f"{tmp_path}/kb").collect()) == key(K.merge_facts(K.drop_overwritten(whole)).collect())


def test_a_batch_reads_its_own_rows(spark, tmp_path, monkeypatch):
    """Below ``fan`` batches nothing older is opened; a fold opens ``fan`` entries."""
    opened = []
    real = Generations._load
    monkeypatch.setattr(Generations, "_load", lambda self, entries: opened.append([e["name"] for e in entries]) or real(self, entries))
    rows = spark.createDataFrame(random_facts(random.Random(1), 40), FACTS)
    rows.repartitionByRange(9, "seq").write.parquet(f"{tmp_path}/in")
    files = sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/in"))
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables.start(tables.fact_updates(stream, f"{tmp_path}/kb", f"{tmp_path}/state", fan=4), every=None).awaitTermination()
    assert files >= 5 and opened == [[f"batch-{i}" for i in range(k, k + 4)] for k in range(0, files - 3, 4)]
    assert key(tables.merged_view(spark, f"{tmp_path}/kb").collect()) == key(K.merge_facts(K.drop_overwritten(rows)).collect())


def test_newest_row_of_a_trace(spark):
    rows = spark.createDataFrame([("t", 1, 0, "old"), ("t", 9, 0, "late time"), ("t", 2, 1, "new"), ("u", None, 0, "no time")],
                                 "trace_id string, ts int, batch_id bigint, model string")
    got = {r.trace_id: r.model for r in tables.newest_rows({"rows": rows})["rows"].collect()}
    assert got == {"t": "new", "u": "no time"}
    assert generations.FAN >= 2


# --- replies in parts -------------------------------------------------------

def token(text):
    return f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}'


USAGE = 'data: {"choices":[],"usage":{"prompt_tokens":7,"completion_tokens":9}}'


@pytest.fixture
def rocks(spark):
    kept = spark.conf.get(STATE_STORE[0])
    use_state_store(spark)
    yield
    spark.conf.set(STATE_STORE[0], kept)


def replies_of(spark, tmp_path, batches, **options):
    """Rows let out by each micro-batch; a batch is a list of (request, number, second, line)."""
    schema = "request_id STRING, seq LONG, t LONG, raw STRING"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).select("request_id", "seq", F.timestamp_seconds(F.col("t") + 1_000).alias("ts"), "raw")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema("request_id STRING, seq LONG, ts TIMESTAMP, raw STRING, b INT").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    writer = tables.each_batch(stream_replies(stream.drop("b"), **options), lambda df, i: out.append([tuple(r) for r in df.collect()]), f"{tmp_path}/state")
    tables.start(writer, every=None).awaitTermination()
    return out


def test_replies_without_end_mark(spark, tmp_path, rocks):
    rows = [("open", 0, 0, token("x")), ("done", 0, 0, token("y")), ("done", 1, 1, "data: [DONE]"), ("done", 2, 2, token("late")), ("clock", 0, 9999, "data: {}")]
    found = sum(replies_of(spark, tmp_path, [rows]), [])
    assert sorted(found) == [("done", 0, "y", None, None, True, True), ("open", 0, "x", None, None, False, True)]


def test_parts_leave_while_the_reply_goes_on(spark, tmp_path, rocks):
    """Parts of four events; the clock moves the watermark; late, doubled and unnumbered events."""
    batches = [
        [("a", i, i, token(str(i))) for i in range(6)] + [("a", 2, 2, token("2")), ("a", None, 3, token("none"))],
        [("clock", 0, 700, "data: {}"), ("a", 6, 6, token("6"))],
        [("a", 1, 90, token("again")), ("a", 8, 140, token("8")), ("a", 9, 141, USAGE)],
        [("a", 10, 142, "data: [DONE]"), ("a", 11, 143, token("behind")), ("clock", 1, 9999, "data: {}")],
    ]
    out = replies_of(spark, tmp_path, batches, part_events=4)
    rows = [r for batch in out for r in batch if r[0] == "a"]
    assert rows == [("a", 0, "0123", None, None, False, False), ("a", 1, "456", None, None, False, False), ("a", 2, "8", 7, 9, True, True)]
    assert len([b for b in out if any(r[0] == "a" for r in b)]) >= 2  # not all at the end


def test_many_replies_share_a_row_of_state(spark, tmp_path, rocks):
    """Requests of one bucket stay apart, and numbers beyond those of floats stay whole."""
    big = 2**53 + 1
    rows = [(f"r{i}", s, s, token(f"{i}.{s} ")) for i in range(300) for s in range(3)]
    rows += [("big", big, 1, token("odd")), ("big", None, 1, token("none")), ("clock", 0, 9999, "data: {}")]
    found = sum(replies_of(spark, tmp_path, [rows], buckets=4), [])
    expected = [(f"r{i}", 0, f"{i}.0 {i}.1 {i}.2 ", None, None, False, True) for i in range(300)] + [("big", big // 1_000, "odd", None, None, False, True)]
    assert sorted(found) == sorted(expected)


def test_a_reply_after_silence_begins_anew(spark, tmp_path, rocks):
    rows = [("a", 0, 0, token("one")), ("a", 1, 1, token(" two")), ("a", 0, 400, token("new")), ("clock", 0, 9999, "data: {}")]
    found = [r for b in replies_of(spark, tmp_path, [rows]) for r in b if r[0] == "a"]
    assert sorted(found) == [("a", 0, "new", None, None, False, True), ("a", 0, "one two", None, None, False, True)]
