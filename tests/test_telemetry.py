"""Golden rows of traces, alerts, metrics, token streams and load tests."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sse
from tidemark.operators import audit, ladder, logs, metrics, replies, traces, usage
from tidemark.operators.metrics import Rule


def attrs(**values):
    return [{"key": k, "value": {"stringValue": v if isinstance(v, str) else None, "intValue": None if isinstance(v, str) else str(v)}} for k, v in values.items()]


def trace(name, sets, start="1700000000123456789", duration=1234):
    return ("t1", name, start, duration, sets)


def test_flatten_traces(spark):
    span = [{"spans": [{"attributes": attrs(**{"gen_ai.request.model": "m", "gen_ai.usage.prompt_tokens": 7, "app.user_message": "x" * 400})}]}]
    df = spark.createDataFrame([trace("POST chat_request", span), trace("get_embedding", span), trace("ollama_chat", [])], traces.TRACE_SCHEMA)
    rows = traces.flatten_traces(traces.root_span_filter(df)).withColumn("us", F.unix_micros("ts")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.model, r.input_tokens, r.output_tokens, len(r.prompt), r.source) == ("m", 7, 0, 300, "none")
    assert r.us == 1700000000123456 and r.duration_ms == 1234.0


@pytest.mark.parametrize("ms, shown", [(None, "—"), (999.0, "999ms"), (1500.0, "1.50s"), (0.0, "0ms")])
def test_fmt_duration(spark, ms, shown):
    df = spark.createDataFrame([(ms,)], "ms DOUBLE")
    assert df.select(traces.fmt_duration(F.col("ms")).alias("x")).first()["x"] == shown


def test_categories_overlap(spark):
    items = spark.createDataFrame([("t", 1, 1, "web", "coder-1"), ("t", 2, 2, "embed", "e"), ("t", 3, 3, "web", "late")],
                                  "trace_id STRING, ts INT, step_id INT, source STRING, model STRING")
    r = traces.first_step_per_category(items).first()
    assert (r.embedding, r.reranker, r.reasoning, r.coder) == ("e", None, "coder-1", "coder-1")


def test_own_source_is_reasoning(spark):
    items = spark.createDataFrame([("t", 1, 1, "desk", "m")], "trace_id STRING, ts INT, step_id INT, source STRING, model STRING")
    assert traces.first_step_per_category(items).first().reasoning is None
    assert traces.first_step_per_category(items, own=["desk"]).first().reasoning == "m"


def test_time_range_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "id").write.parquet(str(tmp_path / "t"))
    df = traces.time_range(spark.read.parquet(str(tmp_path / "t")), "1970-01-01 06:00:00", 2)
    assert [r.id for r in df.orderBy("id").collect()] == [4, 5, 6]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in df._jdf.queryExecution().executedPlan().toString()


def test_search_and_newest(spark):
    df = spark.createDataFrame([("a", 1, "Find Me"), ("b", 2, "other"), ("c", 3, "find too")], "trace_id STRING, ts INT, prompt STRING")
    assert [r.trace_id for r in traces.newest(traces.feed_search(df, "FIND"), 1).collect()] == ["c"]
    assert traces.feed_search(df, "").count() == 3


def test_alert_view(spark):
    df = spark.createDataFrame([("firing", [
        {"status": "firing", "labels": {"alertname": "Baseline", "pod": "p", "namespace": "n"}, "annotations": {"description": "d" * 5000}},
        {"status": None, "labels": {}, "annotations": None}, {"status": "resolved", "labels": {"pod": "p"}, "annotations": {}}])], logs.ALERT_SCHEMA)
    a, b, c = logs.alert_view(df).orderBy("alert_no").collect()
    assert (a.name, a.colour, a.needs_diagnosis, len(a.description)) == ("Baseline", "red", True, 4000)
    assert (b.status, b.name, b.namespace, b.description, b.needs_diagnosis) == ("firing", "Unknown", "ai-agent", "No description", False)
    assert (c.colour, c.needs_diagnosis) == ("green", False)


def test_parse_cri(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z stdout P he",), ("broken",)], "line STRING")
    assert [tuple(r) for r in logs.parse_cri(df).collect()] == [("2024-01-01T00:00:00Z", "stdout", "P", "he")]


@pytest.mark.parametrize("app, job", [("nvidia-dcgm-exporter", "gpu-metrics"), (None, "kubernetes-pods"), ("x", "x")])
def test_relabel_job(spark, app, job):
    rules = [Rule(sources=["app"], target="job"), Rule(sources=["job"], regex="nvidia-dcgm-exporter", replacement="gpu-metrics", target="job"),
             Rule(sources=["job"], regex="", replacement="kubernetes-pods", target="job")]
    df = spark.createDataFrame([({"app": app} if app else {"other": "1"},)], "labels MAP<STRING, STRING>")
    assert metrics.relabel(df, rules).first().labels["job"] == job


def test_relabel_keep_join_and_drop(spark):
    df = spark.createDataFrame([({"ns": "ai", "addr": "h:1", "port": "80"},), ({"ns": "other"},)], "labels MAP<STRING, STRING>")
    rules = [Rule(sources=["ns"], regex="ai", action="keep"),
             Rule(sources=["addr", "port"], regex=r"([^:]+)(?::\d+)?;(\d+)", replacement="$1:$2", target="addr"),
             Rule(sources=["missing"], target="ns")]
    rows = metrics.relabel(df, rules).collect()
    assert [r.labels for r in rows] == [{"addr": "h:80", "port": "80"}]
    assert metrics.relabel(df, [Rule(sources=["ns"], regex="ai", action="drop")]).count() == 1


def test_matchers_are_anchored(spark):
    df = spark.createDataFrame([({"pod": "builder-0"},), ({"pod": "xbuilder-0"},), ({"a": "b"},)], "labels MAP<STRING, STRING>")
    count = lambda **rules: df.filter(metrics.matches(F.col("labels"), rules)).count()
    assert (count(pod=("=~", "builder-.*")), count(pod=("!~", "builder-.*")), count(pod=("=", "")), count(pod=("!=", ""))) == (1, 2, 1, 2)


def test_resource_to_labels(spark):
    df = spark.createDataFrame([({"a": "r", "b": "r"}, {"a": "l", "c": "l"})], "r MAP<STRING, STRING>, l MAP<STRING, STRING>")
    assert df.select(metrics.resource_to_labels(F.col("r"), F.col("l")).alias("m")).first().m == {"a": "l", "b": "r", "c": "l"}


def test_series_key_ignores_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},)], "l MAP<STRING, STRING>")
    assert df.select(metrics.series_key(F.col("l"))).distinct().count() == 1


COUNTER = [(0, 10.0), (15, 40.0), (30, 70.0), (45, 5.0), (60, 35.0)]


@pytest.mark.parametrize("bucket", [3600, 20])
def test_counter_rate(spark, bucket):
    df = spark.createDataFrame([("s", t, v) for t, v in COUNTER], "series STRING, t LONG, value DOUBLE").withColumn("ts", F.timestamp_seconds("t"))
    got = [round(r.rate, 6) for r in metrics.counter_rate(df, ["series"]).orderBy("sec").collect()]
    assert got == [0.0, 0.5, 1.0, 1.083333, 1.583333]
    deltas = [r.delta for r in metrics.counter_deltas(df, ["series"], bucket).orderBy("sec").collect()]
    assert deltas == [0.0, 30.0, 30.0, 5.0, 30.0]


def test_series_without_a_label_is_kept(spark):
    df = spark.createDataFrame([(None, t, v) for t, v in COUNTER], "series STRING, t LONG, value DOUBLE").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.delta for r in metrics.counter_deltas(df, ["series"], 20).orderBy("sec").collect()] == [0.0, 30.0, 30.0, 5.0, 30.0]


def test_rate_across_buckets_matches_brute_force(spark):
    rows = [("s", t, float((t * 37) % 101)) for t in range(0, 4000, 7)]
    df = spark.createDataFrame(rows, "series STRING, t LONG, value DOUBLE").withColumn("ts", F.timestamp_seconds("t"))
    delta, last = {}, None
    for _, t, v in rows:
        delta[t] = 0.0 if last is None else (v if v < last else v - last)
        last = v
    want = {t: round(sum(d for s, d in delta.items() if t - 60 < s <= t) / 60, 6) for t in delta}
    assert {r.sec: round(r.rate, 6) for r in metrics.counter_rate(df, ["series"]).collect()} == want
    stepped = {r.at_sec: round(r.rate, 6) for r in metrics.sum_rate(df, ["series"]).collect()}
    assert all(abs(v - round(sum(d for s, d in delta.items() if t - 60 < s <= t) / 60, 6)) < 1e-6 for t, v in stepped.items())


def test_either(spark):
    left = spark.createDataFrame([(1, "a", 1.0)], "ts INT, l STRING, v DOUBLE")
    right = spark.createDataFrame([(1, "a", 9.0), (1, "b", 2.0), (2, "a", 3.0)], "ts INT, l STRING, v DOUBLE")
    assert sorted(r.v for r in metrics.either(left, right, ["ts", "l"]).collect()) == [1.0, 2.0, 3.0]


def test_admission(spark):
    wide = {f"k{i}": "v" for i in range(201)}
    kept, rejected = metrics.series_admission(spark.createDataFrame([(wide,), ({"a": "b"},)], "labels MAP<STRING, STRING>"))
    assert (kept.count(), rejected.count()) == (1, 1)


SSE = ['data: {"choices":[{"delta":{"content":"a"}}]}', 'data: {"choices":[{"delta":{"reasoning_content":"b"}}]}',
       'data: {"choices":[{"delta":{"thought":"c"}}]}', "data: {broken", ": comment", 'data: {"usage":{"prompt_tokens":5,"completion_tokens":2}}',
       "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']


def events(spark, lines=SSE, max_events=100_000):
    df = spark.createDataFrame([("r", i, l) for i, l in enumerate(lines)], "request_id STRING, seq LONG, raw STRING")
    return replies.until_done(replies.parse_events(df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 2))), max_events)


def test_sse(spark):
    e = events(spark)
    r = replies.reassemble(e).first()
    assert (r.text, r.n_tokens) == ("abc", 3)
    u = replies.final_usage(e).first()
    assert (u.prompt_tokens, u.completion_tokens) == (5, 2)
    assert "".join(x.text for x in replies.reassemble(events(spark, max_events=2)).orderBy("part_no").collect()) == "abc"
    assert replies.guard_reply(replies.reassemble(events(spark, SSE[3:4] + SSE[6:7]))).first().status == "error"
    assert replies.guard_reply(spark.createDataFrame([(" \n",), ("x",)], "text STRING")).filter("status = 'error'").count() == 1


def test_latency(spark):
    e = spark.createDataFrame([("a", 2, "x")] + [("a", 3 + i, "x") for i in range(99)] + [("b", 1, "")], "request_id STRING, s LONG, content STRING")
    req = spark.createDataFrame([("a", 0, 12), ("b", 0, 5)], "request_id STRING, s LONG, e LONG").select(
        "request_id", F.timestamp_seconds("s").alias("started"), F.timestamp_seconds("e").alias("ended"))
    got = {r.request_id: r for r in replies.latency_stats(e.withColumn("ts", F.timestamp_seconds("s")), req).collect()}
    assert (got["a"].ttft, got["a"].tpot, got["a"].output_tokens) == (2.0, 0.1, 100)
    assert (got["b"].ttft, got["b"].tpot, got["b"].output_tokens) == (0.0, 0.0, 0)


@pytest.mark.parametrize("oks, want", [([True, True, False], 44288), ([False], None), ([True, True], 44288)])
def test_max_stable_context(spark, oks, want):
    df = spark.createDataFrame([("m", 28288 + 8000 * (i + 1), ok) for i, ok in enumerate(oks)], "model STRING, ctx LONG, ok BOOLEAN")
    assert ladder.max_stable_context(df).first().max_ctx == want


def test_result_grid_counts(spark):
    """The published ladder runs: 12, 6 and 16 of 16 cells pass."""
    for fails, passed in (({("a", 70000), ("b", 70000), ("a", 80000), ("b", 80000)}, 12), ({("a", s) for s in ladder.STAGES} | {("b", 70000), ("b", 80000)}, 6), (set(), 16)):
        rows = [(m, s, 1.234, "FAIL" if (m, s) in fails else "PASS") for m in "ab" for s in ladder.STAGES]
        grid = ladder.result_grid(spark.createDataFrame(rows, "model STRING, target LONG, seconds DOUBLE, status STRING"))
        assert grid.count() == 16 and ladder.pass_counts(grid, []).first().passed == passed
    assert ladder.pivot_grid(grid, ["a", "b"]).filter("a = 'PASS' AND b = 'PASS'").count() == 8


def test_costs(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 100_000, True)], "model STRING, prompt_tokens LONG, completion_tokens LONG, is_local BOOLEAN")
    r = usage.cost_report(calls).first()
    assert (r.equivalent_cost, r.actual_cost, r.savings) == (6.5, 0.0, 6.5)
    assert calls.select(usage.flat_savings(F.lit(1_100_000)).alias("x")).first().x == pytest.approx(13.75)
    assert calls.select(usage.format_cost(F.lit(6.5)).alias("a"), usage.money(F.lit(1234.5)).alias("b"), usage.thousands(F.lit(1234567)).alias("c")).first() == ("$6.5000", "$1,234.50", "1,234,567")
    by_model, total = usage.usage_by_model(calls).first(), usage.usage_by_locality(calls).filter("kind = 'TOTAL'").first()
    assert by_model.total_tokens == total.total_tokens == 1_100_000


@pytest.mark.parametrize("limit", [1 << 20, 250])
def test_glossary_is_single_pass(spark, limit):
    g = spark.createDataFrame([("foo", "bar"), ("bar", "baz"), ("fire ball", "flame"), ("fire", "blaze"), ("ball x", "never"), ("", "empty"), (None, "n"),
                               ("void", None), ("bar", "zzz"), ("a.b", "dot")], "term STRING, canonical STRING")
    texts = ["foo x bar, fire ball fire foobar", None, "nothing", "", "fire ballast fire_ball void", "a.b axb fire ball x", "foo"]
    df = spark.createDataFrame([(None if i < 2 else 7, t) for i, t in enumerate(texts)], "id INT, text STRING")
    got = [r.text for r in audit.apply_glossary(df, g, shared_bytes=limit).collect()]
    assert got == ["bar x baz, flame blaze foobar", None, "nothing", "", "blaze ballast fire_ball void", "dot axb flame x", "bar"]
    assert audit.apply_glossary(df, g.limit(0)).collect() == df.collect()


def test_large_glossary(spark):
    """200,000 terms, one automaton or many: as replacing word by word from a table."""
    g = spark.range(200_000).selectExpr("concat('w', hex(id)) AS term", "concat('<', id, '>') AS canonical")
    df = spark.range(200).selectExpr("concat_ws(' ', concat('w', hex(id * 997)), 'wXYZ', concat('w', hex(id * 2003 + 100000)), 'w') AS text", "id")
    want = {i: f"<{i * 997}> wXYZ " + (f"<{i * 2003 + 100_000}>" if i * 2003 + 100_000 < 200_000 else f"w{i * 2003 + 100_000:X}") + " w" for i in range(200)}
    for limit in (audit.SHARED_BYTES * 4, 12 << 20):
        assert {r.id: r.text for r in audit.apply_glossary(df, g, shared_bytes=limit).collect()} == want


def test_glossary_equals_trying_every_place():
    import random
    rng = random.Random(2)
    for _ in range(300):
        terms = {"".join(rng.choice("ab _.") for _ in range(rng.randint(1, 4))): str(i) for i in range(6)}
        text = "".join(rng.choice("ab _.é") for _ in range(30))
        at, want = 0, ""
        touched = lambda c: c.isalnum() or c == "_"
        while at < len(text):
            fits = [t for t in sorted(terms, key=len, reverse=True) if text.startswith(t, at) and not (at and touched(text[at - 1]))
                    and not (at + len(t) < len(text) and touched(text[at + len(t)]))]
            want += terms[fits[0]] if fits else text[at]
            at += len(fits[0]) if fits else 1
        found = audit.whole_words(audit.build_automaton(terms.items()), text)
        rows = pd.Series([[{"at": a, "size": n, "canonical": c} for a, n, c in found]])
        assert audit.replace_found(pd.Series([text]), rows)[0] == want


def test_gender_audit(spark):
    df = spark.createDataFrame([(1, "Mr. Zoe met Mrs Al and Mr Al. Ms. Zoe")], "id INT, text STRING")
    genders = spark.createDataFrame([("Zoe", "female"), ("Al", "male")], "name STRING, gender STRING")
    got = {(r.title, r.name) for r in audit.gender_audit(audit.title_mentions(df, "id"), genders).collect()}
    assert got == {("Mr", "Zoe"), ("Mrs", "Al")}


def test_structure_audit(spark):
    df = spark.createDataFrame([(1, "# H\n\na\n\n***\n\nb", "# H\n\na\n\n***\n\nb!"), (2, "a\n\n***\n\nb", "a b")], "id INT, raw STRING, cleaned STRING")
    got = {r.id: r for r in audit.structure_audit(df).collect()}
    assert got[1].kept and not got[2].kept
    assert (got[1].raw_paragraphs, got[1].raw_scene_breaks, got[1].raw_headings) == (4, 1, 1)


def test_service_graph_hot_parent(spark):
    rows = [("t", 0, None, "front", "ok", 1.0)] + [("t", i, 0, "back" if i % 2 else "front", "error" if i % 5 == 0 else "ok", 2.0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "trace_id STRING, span_id LONG, parent_id LONG, service STRING, status STRING, duration_ms DOUBLE")
    r = traces.service_graph(df).collect()
    assert [(x.client, x.server, x.calls, x.failures, x.latency_sum) for x in r] == [("front", "back", 50, 10, 100.0)]


def test_payload_needs_prefix(spark):
    df = spark.createDataFrame([("data: x",), ("event: y",)], "raw STRING")
    assert [r.p for r in df.select(sse.payload(F.col("raw")).alias("p")).collect()] == ["x", None]
