"""Readers, writers and streams on files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ladder, replies
from tidemark.sources import files, telemetry
from tidemark.streaming import tables, windows


def test_scan_files(spark, tmp_path):
    (tmp_path / "b_vol.txt").write_text("two\nlines")
    (tmp_path / "a_vol.txt").write_text("one")
    rows = files.scan_files(spark, str(tmp_path), "*.txt").orderBy("file_name").collect()
    assert [(r.file_name, r.text) for r in rows] == [("a_vol.txt", "one"), ("b_vol.txt", "two\nlines")]
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path), "*.pdf")


def test_scan_files_in_parts(spark, tmp_path):
    """A table that Spark wrote as a folder of parts has the folder's name; files beside it keep theirs."""
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "big one.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "small.parquet")
    counts = lambda glob: {r.file_name: r["count"] for r in files.scan_files(spark, str(tmp_path), glob, "parquet").groupBy("file_name").count().collect()}
    assert counts("big*.parquet") == {"big one.parquet": 20}
    assert counts("small.parquet") == {"small.parquet": 5}
    assert {n: c for n, c in counts("*.parquet").items()} == {"big one.parquet": 20, "small.parquet": 5}
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path), "*.orc", "parquet")


def test_streams_of_a_table_in_parts(spark, tmp_path, small):
    from tidemark.catalog import streams
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events = streams._events(spark, str(tmp_path)).select("event_id")
    assert streams._drain(events, "parts").count() == streams._drain(streams._events(spark, small).select("event_id"), "file").count() > 0


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert files.load_json_state(spark, path).isEmpty()
    files.save_json_state(spark.createDataFrame([(["a", "b"],)], "processed_volumes ARRAY<STRING>"), path)
    assert files.load_json_state(spark, path).first().processed_volumes == ["a", "b"]
    (tmp_path / "one.json").write_text('{\n "processed_volumes": [\n  "c"\n ]\n}')
    assert files.load_json_state(spark, str(tmp_path / "one.json"), multi_line=True).first().processed_volumes == ["c"]
    (tmp_path / "broken.json").write_text("{nope")
    assert files.load_json_state(spark, str(tmp_path / "broken.json")).isEmpty()


def test_write_documents_and_report(spark, tmp_path):
    df = spark.createDataFrame([("vol_01", "001", "a\nb\n"), ("vol_02", "x", "c"), ("vol_02", "y", "")], "vol_key STRING, stem STRING, text STRING")
    for part in (df, df.filter("stem = 'x'").withColumn("text", F.lit("new"))):  # a rerun replaces, the rest stays
        files.write_documents(part, str(tmp_path / "docs"))
    back = files.read_documents(spark, str(tmp_path / "docs")).orderBy("vol_key", "stem").collect()
    assert [tuple(r) for r in back] == [("vol_01", "001", "a\nb\n"), ("vol_02", "x", "new"), ("vol_02", "y", "")]
    assert sorted(p.name for p in (tmp_path / "docs").glob("vol_key=*")) == ["vol_key=vol_01", "vol_key=vol_02"]
    files.write_report(spark.createDataFrame([(2, "y"), (1, "x")], "line_no INT, line STRING"), str(tmp_path / "report"))
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")) == "x\ny\n"


def test_bench_results(spark, tmp_path):
    rows = [{"model": "planner", "input_tokens": 1000, "output_tokens": 2192, "ttft": 4.5, "tpot": 0.0437, "total_duration": 100.24},
            {"model": "executor", "target": 2000, "error": "Status 502"}]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=2))
    df = files.scan_bench_results(spark, str(tmp_path / "r.json"))
    assert [(r.model, r.target, r.error) for r in df.orderBy("target").collect()] == [("planner", 1000, None), ("executor", 2000, "Status 502")]
    files.write_bench_results(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_load_log(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "====\nTesting planner | Context: 10000 tokens...\n  SUCCESS: 55.30s (Actual tokens: 10056)\n"
        "Testing executor | Context: 10000 tokens...\n  Error 502: <html>\n<head>\n\n----\n"
        "Testing planner | Context: 20000 tokens...\n  Exception: timeout\n")
    rows = ladder.parse_log_lines(files.scan_lines(spark, str(tmp_path), "*.log"), ["file_name"]).orderBy("line_no").collect()
    assert [(r.model, r.target, r.seconds, r.actual, r.status) for r in rows] == [
        ("planner", 10000, 55.3, 10056, "PASS"), ("executor", 10000, None, None, "FAIL"), ("planner", 20000, None, None, "FAIL")]


def test_signals_to_tenant_store_and_retention(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(
        {"ts": f"2024-01-0{d}T10:00:00Z", "metric": "m", "labels": {"a": "b"}, "value": d}) for d in (1, 2, 3)))
    stream = telemetry.metric_stream(spark, str(source))
    tables.start(telemetry.tenant_sink(stream, store, str(tmp_path / "state")), every=None).awaitTermination()
    assert spark.read.parquet(store).filter("tenant = 'anonymous' AND date = '2024-01-02'").count() == 1
    day_store = f"{store}/tenant=anonymous"
    assert tables.expire(spark, day_store, "2024-01-03 12:00:00", 24) == ["date=2024-01-01"]
    assert spark.read.parquet(day_store).count() == 2
    assert tables.retained(spark.read.parquet(day_store), "2024-01-03 12:00:00", 24).count() == 1


def test_streams_read_their_schemas(spark, tmp_path):
    for reader in (telemetry.log_stream, telemetry.trace_stream, telemetry.alert_stream, telemetry.sse_stream):
        assert reader(spark, str(tmp_path)).isStreaming


def test_counter_state_crosses_batches(spark, tmp_path):
    # 15 comes a batch late but inside the watermark; the last sample moves the watermark past the others.
    values = [(0, 10.0), (30, 70.0), (15, 40.0), (45, 5.0), (60, 35.0), (4000, 35.0)]
    for i, part in enumerate((values[:2], values[2:4], values[4:])):
        spark.createDataFrame([("s", t + 1_000_000, v) for t, v in part], "series STRING, t LONG, value DOUBLE").select(
            "series", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series STRING, ts TIMESTAMP, value DOUBLE").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = (windows.counter_increases(stream).writeStream.format("parquet").outputMode("append")
              .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")))
    tables.start(writer, every=None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("sec").collect()
    assert [(r.sec - 1_000_000, r.delta) for r in got] == [(0, 0.0), (15, 30.0), (30, 30.0), (45, 5.0), (60, 30.0)]


def test_counter_state_of_many_series(spark, tmp_path):
    """Series that share a row of state: each has its own last sample, its late ones and its silence."""
    import random
    rng = random.Random(5)
    base, batches = 1_000_000, []
    for i in range(4):  # every batch reaches 700 s further and brings some samples a little late
        batches.append([(f"s{rng.randrange(40)}" if rng.random() < 0.97 else None, base + 700 * i + rng.randrange(-300, 700), float(rng.randrange(50))) for _ in range(150)])
    batches += [[("end", base + 9_000, 1.0)], [("end", base + 9_050, 2.0)]]
    batches.append([("s1", base + 9_100, 7.0), ("end", base + 9_100, 3.0)])  # s1 was silent for an hour
    batches.append([("end", base + 20_000, 4.0)])
    for part in batches:
        spark.createDataFrame(part, "series STRING, t LONG, value DOUBLE").select(
            "series", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series STRING, ts TIMESTAMP, value DOUBLE").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for n in (1, 64):  # all series in one row of state, or one or two in each
        made = windows.counter_increases(stream, buckets=n)
        assert made.columns == ["series", "ts", "sec", "value", "delta"]
        writer = made.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / f"out{n}")).option("checkpointLocation", str(tmp_path / f"state{n}"))
        tables.start(writer, every=None).awaitTermination()
        got[n] = sorted(((r.series or "", r.sec - base, r.delta) for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()))
    largest = {}
    for s, t, v in sum(batches, []):
        largest[s or "", t - base] = max(v, largest.get((s or "", t - base), v))
    expected, last = [], {}
    for (s, t), v in sorted(largest.items()):
        if t < 19_400:  # what the watermark has passed at the end
            before = last.get(s) if (s, t) != ("s1", 9_100) else None
            expected.append((s, t, 0.0 if before is None else v - before if v >= before else v))
            last[s] = v
    assert got[1] == got[64] == expected


def test_baseline_alert_finds_its_landed_lines(spark, tmp_path):
    """A webhook payload without id and time goes through the alert stream against lines of the log stream."""
    payload = {"status": "firing", "alerts": [{"status": "firing", "labels": {"alertname": "Baseline", "pod": "harness", "namespace": "ai-agent", "severity": "critical"},
                                               "annotations": {"description": "timeout"}}]}
    for name in ("alerts", "lines"):
        (tmp_path / name).mkdir()
    (tmp_path / "alerts" / "a.json").write_text(json.dumps(payload))
    (tmp_path / "lines" / "l.json").write_text("\n".join(json.dumps(
        {"ts": "2024-01-01T10:00:00Z", "seq": i, "labels": {"k8s_pod_name": "harness", "namespace": "ai-agent"}, "line": f"line {i}"}) for i in range(3)))
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    tables.start(telemetry.tenant_sink(telemetry.log_stream(spark, str(tmp_path / "lines")), store, str(tmp_path / "s1")), every=None).awaitTermination()
    logs = lambda: spark.read.parquet(store).select("ts", "seq", "pod", "namespace", "line")
    writer = tables.alert_diagnoses(telemetry.alert_stream(spark, str(tmp_path / "alerts")), logs, out, str(tmp_path / "s2"), look_back_hours=24 * 3650)
    tables.start(writer, every=None).awaitTermination()
    row = spark.read.parquet(out).first()
    assert row.log_text == "line 0\nline 1\nline 2" and row.alert_id is not None


OUTPUTS = "vol_key STRING, stem STRING, text STRING"


def outputs(spark, path):
    from tidemark.operators import corpus
    return sorted((r.vol_key, r.stem, r.text) for r in corpus.load_outputs(spark, path, OUTPUTS).collect())


def test_outputs_of_a_rerun(spark, tmp_path):
    from tidemark.operators import corpus
    path = str(tmp_path / "o")
    assert outputs(spark, path) == []
    corpus.save_outputs(spark.createDataFrame([("v1", "a", "1"), ("v1", "b", "2"), ("v2", "c", "3")], OUTPUTS), path)
    for _ in range(2):
        corpus.save_outputs(spark.createDataFrame([("v1", "b", "new"), ("v1", "d", "4")], OUTPUTS), path)
    assert outputs(spark, path) == [("v1", "a", "1"), ("v1", "b", "new"), ("v1", "d", "4"), ("v2", "c", "3")]
    corpus.save_outputs(spark.createDataFrame([("v2", "a", "moved")], OUTPUTS), path)  # no copy stays in v1
    assert outputs(spark, path) == [("v1", "b", "new"), ("v1", "d", "4"), ("v2", "a", "moved"), ("v2", "c", "3")]


def test_outputs_of_a_run_that_dies(spark, tmp_path):
    """The write of the second run fails half-way: what was saved stays whole, and a later run goes on."""
    from tidemark.operators import corpus
    path = str(tmp_path / "o")
    corpus.save_outputs(spark.createDataFrame([("v1", "a", "1")], OUTPUTS), path)

    def dies(batches):
        for i, batch in enumerate(batches):
            yield batch
            raise RuntimeError("lost")

    work = spark.range(100).selectExpr("'v1' AS vol_key", "concat('s', id) AS stem", "'x' AS text").mapInPandas(dies, OUTPUTS)
    with pytest.raises(Exception, match="lost"):
        corpus.save_outputs(work, path)
    assert outputs(spark, path) == [("v1", "a", "1")]
    corpus.save_outputs(spark.createDataFrame([("v1", "b", "2")], OUTPUTS), path)
    assert outputs(spark, path) == [("v1", "a", "1"), ("v1", "b", "2")]
    (tmp_path / "o" / "manifests" / "9").write_text("{ not a manifest")
    with pytest.raises(ValueError):  # an unreadable state is no first run
        corpus.save_outputs(work, path)


def test_documents_that_share_a_name(spark, tmp_path):
    df = spark.createDataFrame([("v", "a", "one"), ("v", "a", "two"), ("v", "a", "two"), ("v", "b", "x")], "vol_key STRING, stem STRING, text STRING")
    for _ in range(2):
        files.write_documents(df, str(tmp_path / "docs"))
    back = sorted(tuple(r) for r in files.read_documents(spark, str(tmp_path / "docs")).collect())
    assert back == [("v", "a", "one"), ("v", "a", "two"), ("v", "a", "two"), ("v", "b", "x")]


def test_many_documents_are_written_in_spark_layout(spark, tmp_path):
    """As Spark's writer lays them out, without its programs per file; a lost run leaves what was there."""
    odd = [("v/1", "a=b%", "x\ny"), ("v/1", "é [1]", ""), (None, "n", None), ("v", None, "z")]
    rows = odd + [("many", f"{i:05d}", f"t{i}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "vol_key STRING, stem STRING, text STRING")
    path = str(tmp_path / "docs")
    begun = time.monotonic()
    files.write_documents(df, path)
    assert time.monotonic() - begun < 10  # 6 ms a document before
    expected = sorted(((k, n, t or "") for k, n, t in rows), key=str)
    assert sorted((tuple(r) for r in files.read_documents(spark, path).collect()), key=str) == expected
    df.limit(4).write.partitionBy("vol_key", "stem").text(str(tmp_path / "sparks"))
    folders = lambda top: {"/".join(p.relative_to(tmp_path / top).parts[:2]) for p in (tmp_path / top).glob("vol_key=*/stem=*")}
    assert folders("sparks") == {f for f in folders("docs") if "=many" not in f}
    assert sorted((tuple(r) for r in files.read_documents(spark, str(tmp_path / "sparks")).collect()), key=str) == sorted(
        ((k, n, t or "") for k, n, t in odd), key=str)
    broken = df.withColumn("text", F.when(F.col("stem") == "03999", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        files.write_documents(broken, path)
    assert sorted((tuple(r) for r in files.read_documents(spark, path).collect()), key=str) == expected


def test_line_numbers_without_a_shuffle(spark, tmp_path):
    """Files of several splits, of one, with both kinds of line ends, and of equal names in two folders."""
    long_ = [f"line {i} {'x' * (i % 50)}" for i in range(5_000)]
    (tmp_path / "in" / "d=1").mkdir(parents=True)
    (tmp_path / "in" / "d=2").mkdir()
    (tmp_path / "in" / "d=1" / "long.log").write_text("\n".join(long_))
    (tmp_path / "in" / "d=1" / "crlf.log").write_bytes(b"a\r\nb\r\n\r\nc\r\n")
    (tmp_path / "in" / "d=2" / "crlf.log").write_bytes(b"only\n")
    (tmp_path / "in" / "d=2" / "none.log").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = files.scan_lines(spark, str(tmp_path / "in"), "*.log")
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        got.setdefault(r.file_name, []).append((r.line_no, r.line))
    assert sorted(got["long.log"]) == list(enumerate(long_))
    assert sorted(got["crlf.log"]) == [(0, "a"), (0, "only"), (1, "b"), (2, ""), (3, "c")] and "none.log" not in got
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_paid_calls_are_made_once(spark, tmp_path):
    """Each call leaves a line in a file; every row is asked once, twice where the first answer is empty."""
    from tidemark.operators import corpus
    from tidemark.plans import corpus as flows
    log = tmp_path / "calls"

    def ask(prompt, temperature):
        with log.open("a") as f:
            f.write(f"{len(prompt)}\n")
        if "bad" in prompt:
            raise ValueError("no")
        return "" if "retry" in prompt and temperature < 0.5 else "thinking\nhm\n" if "reason" in prompt and temperature < 0.5 else f"ok {prompt[:5]}"

    def calls():
        n = len(log.read_text().splitlines()) if log.exists() else 0
        log.unlink(missing_ok=True)
        return n

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "retry", "bad", "reason", None, "two"])], "i INT, text STRING")
    out = corpus.batch_transform(df, ask, accept=flows.has_body)
    good, bad = corpus.split_errors(out.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise("ok")))
    assert (good.count(), bad.count(), good.count()) == (5, 1, 5) and calls() == 7
    assert {r.text: r.attempts for r in out.collect()} == {"one": 1, "retry": 2, "bad": 1, "reason": 2, None: 0, "two": 1}

    chapters = spark.createDataFrame([(f"s{i}", "vol_01", 1, float(i), f"text {i} " * 40) for i in range(4)], "stem STRING, vol_key STRING, vol BIGINT, chap DOUBLE, text STRING")
    earlier = chapters.limit(0)
    context = spark.createDataFrame([("bible",)], "context STRING")
    finished = flows.clean_chapters(chapters, earlier, context, lambda p, t: ask("x" + p[-9:], t), lambda p, t: ask("y" + p[-9:], t), "2024-01-01", "work")
    assert flows.volumes(finished).count() == 1 and finished.count() == 4 and calls() == 8


@pytest.mark.parametrize("reply, some", [(None, False), ("", False), (" \n", False), ("thinking\nplan\n", False), ("<think>a</think> ", False),
                                         ("<thought>a</thought><cleaned_text> </cleaned_text>", False), ("text", True),
                                         ("<think>a</think><cleaned_text>b</cleaned_text>", True)])
def test_body_of_a_reply(spark, reply, some):
    from tidemark.functions import text as T
    from tidemark.plans.corpus import has_body
    assert has_body(reply) is some
    cleaned = spark.createDataFrame([(reply,)], "a STRING").select(T.clean_reply(F.col("a"))).first()[0]
    assert bool(cleaned) is some
