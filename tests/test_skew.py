"""Large groups: the sliced paths give the same rows as the plain ones."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ladder, logs, scan, traces


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds two thirds of the rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("key"),
        (F.col("id") * 7919 % 3001).alias("ord"), F.col("id"), (F.col("id") % 11).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("slices", [1, 7])
def test_prefix_scan(hot, slices):
    got = scan.prefix_scan(hot, ["key"], ["ord"], slices=slices, sums={"n": F.lit(1), "s": F.col("v")}, maxes={
        "m": F.when(F.col("v") == 3, F.col("ord")), "p": F.struct("ord", "v")})
    by_key = {}
    for r in hot.collect():
        by_key.setdefault(r.key, []).append(r)
    expected = []
    for group in by_key.values():
        group.sort(key=lambda r: r.ord)
        for i, r in enumerate(group):
            seen = group[:i]
            expected.append((*r, i, sum(x.v for x in seen), max((x.ord for x in seen if x.v == 3), default=None),
                             (seen[-1].ord, seen[-1].v) if seen else None))
    assert sorted(((*r[:-1], r[-1] and tuple(r[-1])) for r in map(tuple, got.collect())), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("keys", [["key"], []])
def test_prefix_scan_null_key(spark, keys):
    df = spark.range(40).select(F.when(F.col("id") > 10, F.col("id") % 2).alias("key"), "id")
    sliced = scan.prefix_scan(df, keys, ["id"], sums={"n": F.lit(1)}, slices=5)
    assert rows(sliced) == rows(scan.prefix_scan(df, keys, ["id"], sums={"n": F.lit(1)}, slices=1))


def test_parts_are_bounded_and_ordered(hot):
    parted = scan.with_parts(hot, ["key"], ["ord"], 100, slices=5)
    assert parted.count() == hot.count()
    sizes = parted.groupBy("key", "part_no").agg(F.count("*").alias("n"), F.min("ord").alias("a"), F.max("ord").alias("b"))
    assert sizes.agg(F.max("n")).first()[0] == 100
    spans = sorted((r.key, r.part_no, r.a, r.b) for r in sizes.collect())
    assert all(x[3] < y[2] for x, y in zip(spans, spans[1:]) if x[0] == y[0])


def test_parts_of_small_groups_are_zero(hot):
    assert scan.with_parts(hot, ["key"], ["ord"], 5000).filter("part_no <> 0").isEmpty()


def test_alert_logs(spark):
    lines = spark.range(400).select(
        F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("pod"), F.lit("n").alias("namespace"),
        F.concat(F.lit("line"), F.col("id").cast("string")).alias("line"))
    alerts = spark.range(60).select(
        F.col("id").alias("alert_id"), F.timestamp_seconds(F.col("id") * 25 - 40).alias("ts"),
        F.when(F.col("id") % 4 < 3, "hot").when(F.col("id") % 8 == 3, "cold").otherwise("silent").alias("pod"),
        F.lit("n").alias("namespace"))
    plain = rows(logs.alert_logs(alerts, lines, n=7))
    assert plain == rows(logs.alert_logs(alerts, lines, n=7, look_back_hours=9))
    all_lines, by_brute = lines.collect(), {}
    for a in alerts.collect():
        mine = [x for x in all_lines if (x.pod, x.namespace) == (a.pod, a.namespace) and x.ts <= a.ts]
        mine.sort(key=lambda x: (x.ts, x.seq))
        by_brute[a.alert_id] = "\n".join(x.line for x in mine[-7:]) or logs.NO_LOGS
    assert {r[0]: r[4] for r in plain} == by_brute


def test_alert_logs_of_equal_lines(spark):
    """Lines that share time and number, equal lines and lines without a number: each is given once."""
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows_ = [("p", 100, 1, "B"), ("p", 100, 1, "A"), ("p", 100, None, "C"), ("p", 50, 7, "same"), ("p", 50, 7, "same"), ("p", 50, 7, "same"),
             (None, 60, 1, "no pod"), ("p", None, 1, "no time"), ("p", 60, 2, None), ("p", -4000, 1, "too old"), ("p", 200, 1, "too new"), ("q", 100, 1, "other")]
    lines = spark.createDataFrame(rows_, "pod string, s bigint, seq bigint, line string").select(
        "pod", F.lit("n").alias("namespace"), F.timestamp_seconds("s").alias("ts"), "seq", "line")
    alerts = spark.createDataFrame([(1, "p"), (2, "p"), (3, None), (4, "silent")], "alert_id bigint, pod string").select(
        "alert_id", "pod", F.lit("n").alias("namespace"), F.when(F.col("alert_id") == 2, at(99)).otherwise(at(101)).alias("ts"))
    got = {r.alert_id: (r.n_lines, r.log_text) for r in logs.alert_logs(alerts, lines, n=50).collect()}
    assert got[1][0] == 7 and sorted(got[1][1].split("\n")) == ["A", "B", "C", "same", "same", "same"]
    assert got[1][1].startswith("same\nsame\nsame\nC\n")
    assert got[2] == (4, "same\nsame\nsame") and got[3] == (0, logs.NO_LOGS) and got[4] == (0, logs.NO_LOGS)
    two = {r.alert_id: (r.n_lines, r.log_text) for r in logs.alert_logs(alerts, lines, n=2).collect()}
    assert two[1][1] == "\n".join(got[1][1].split("\n")[-2:]) and two[2] == (2, "same")


def test_alerts_are_read_once(spark):
    """Payloads of alerts are parsed once for their log lines."""
    read = spark.sparkContext.accumulator(0)

    def parsed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    alerts = spark.range(0, 30, 1, 3).select(F.col("id").alias("alert_id"), F.lit("p").alias("pod"), F.lit("n").alias("namespace"),
                                             F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("long").alias("full_description"))
    alerts = alerts.mapInArrow(parsed, alerts.schema)
    lines = spark.range(300).select(F.lit("p").alias("pod"), F.lit("n").alias("namespace"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
                                    F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    out = logs.alert_logs(alerts, lines, n=5)
    assert {r.alert_id: r.log_text for r in out.collect()} == {
        i: "\n".join(str(k) for k in range(max(0, 10 * i - 4), 10 * i + 1)) for i in range(30)}
    assert read.value == 30


def test_a_long_look_back_is_a_few_spans(spark):
    """An alert that looks back 240 hours is ten rows at most, and these meet the lines without a broadcast."""
    alerts = spark.createDataFrame([(i, "p", "n", 3_600_000 + 5_000 * i) for i in range(20)], "alert_id bigint, pod string, namespace string, s bigint")
    alerts = alerts.select("alert_id", "pod", "namespace", F.timestamp_seconds("s").alias("ts"))
    lines = spark.range(2_000).select(F.lit("p").alias("pod"), F.lit("n").alias("namespace"), F.timestamp_seconds(F.col("id") * 1_900).alias("ts"),
                                      F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    out = logs.alert_logs(alerts, lines, n=10_000, look_back_hours=240)
    plan = out._jdf.queryExecution().executedPlan().toString()
    spans = [x for x in plan.splitlines() if "LeftSemi" in x and "hour" in x]
    assert spans and all("SortMergeJoin" in x for x in spans)
    for r in out.collect():
        at = 3_600_000 + 5_000 * r.alert_id
        assert r.log_text.split("\n") == [str(i) for i in range(2_000) if at - 240 * 3_600 <= i * 1_900 <= at]
    assert logs.hours_seen(alerts.filter("alert_id = 0"), 240, 30).count() <= 10


def test_hours_without_alerts_are_not_numbered(spark, tmp_path):
    """The semi-join on pod and hour stands right above the scan, below the numbering."""
    hours = spark.range(0, 480).select(F.lit("p").alias("pod"), F.lit("n").alias("namespace"), F.timestamp_seconds(F.col("id") * 900).alias("ts"),
                                       F.col("id").alias("seq"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    hours.write.parquet(f"{tmp_path}/logs")
    alerts = spark.createDataFrame([(1, "p", "n", 36_000), (2, "p", "n", 36_500), (3, "p", "n", 360_000)], "alert_id bigint, pod string, namespace string, s bigint")
    alerts = alerts.select("alert_id", "pod", "namespace", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.hour for r in logs.hours_seen(alerts, 1).collect()) == [9, 10, 99, 100]
    seen = []
    real = logs.prefix_scan

    def counting(df, *args, **options):
        seen.append(df.filter("kind = 0").count())
        return real(df, *args, **options)

    logs.prefix_scan = counting
    try:
        got = {r.alert_id: r.log_text for r in logs.alert_logs(alerts, spark.read.parquet(f"{tmp_path}/logs")).collect()}
    finally:
        logs.prefix_scan = real
    assert seen == [16] and got == {1: "l36\nl37\nl38\nl39\nl40", 2: "l37\nl38\nl39\nl40", 3: "l396\nl397\nl398\nl399\nl400"}


def test_partial_lines(spark):
    pieces = spark.range(300).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("pod"), "id",
        F.when((F.col("id") % 10 == 9) & (F.col("id") < 150), "F").otherwise("P").alias("flag"),
        F.concat(F.col("id").cast("string"), F.lit(".")).alias("content"))
    whole = {(r.pod, r.line_no): r.content for r in logs.join_partial_lines(pieces, ["pod"], ["id"]).collect()}
    parts = logs.join_partial_lines(pieces, ["pod"], ["id"], max_rows=20).orderBy("pod", "line_no", "part_no").collect()
    assert all(p.part_no == 0 for p in logs.join_partial_lines(pieces, ["pod"], ["id"]).collect())
    assert max(p.n_pieces for p in parts) <= 20 and max(p.part_no for p in parts) > 0
    joined = {}
    for p in parts:
        joined[p.pod, p.line_no] = joined.get((p.pod, p.line_no), "") + p.content
    assert joined == whole


def test_golden_partial_lines(spark):
    df = spark.createDataFrame([("p", 1, "P", "he"), ("p", 2, "F", "llo"), ("p", 3, "F", "x")], "pod STRING, id INT, flag STRING, content STRING")
    assert [r.content for r in logs.join_partial_lines(df, ["pod"], ["id"]).orderBy("line_no").collect()] == ["hello", "x"]


def test_feed_of_a_large_trace(spark):
    items = spark.range(90).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("trace_id"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("step_id"), F.lit("web").alias("source"),
        F.col("id").cast("string").alias("model"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"),
        F.lit(3.0).alias("duration_ms"), F.lit("q").alias("prompt"))
    whole = [r for r in traces.feed_by_trace(items).collect() if r.request_id == "hot"][0]
    parts = sorted((r for r in traces.feed_by_trace(items, max_steps=8).collect() if r.request_id == "hot"), key=lambda r: r.part_no)
    assert len(whole.steps) == 60 and all(len(p.steps) <= 8 for p in parts)
    assert [s.model for p in parts for s in p.steps] == [s.model for s in whole.steps]
    assert {(p.ts, p.prompt, p.n_parts) for p in parts} == {(whole.ts, whole.prompt, 8)}
    back = sorted((r for r in traces.reverse_steps(traces.feed_by_trace(items, max_steps=8)).collect() if r.request_id == "hot"), key=lambda r: r.part_no)
    assert [s.model for p in back for s in p.steps] == [s.model for s in whole.steps][::-1]


def test_load_log_of_many_lines(spark):
    lines = spark.range(200).select(F.lit("log").alias("file_name"), F.explode(F.array(
        F.struct((F.col("id") * 3).alias("line_no"), F.printf(F.lit("Testing m%d | Context: %d tokens..."), "id", F.col("id") * 10).alias("line")),
        F.struct((F.col("id") * 3 + 1).alias("line_no"), F.lit("noise").alias("line")),
        F.struct((F.col("id") * 3 + 2).alias("line_no"), F.lit("  SUCCESS: 1.50s (Actual tokens: 7)").alias("line")))).alias("l")
    ).select("file_name", "l.*")
    plain = ladder.parse_log_lines(lines, ["file_name"])
    assert plain.filter("model <> concat('m', cast(target / 10 as int))").isEmpty()


@pytest.mark.parametrize("n", [3, 1500])
def test_first_n(hot, n):
    from tidemark.operators.facts import first_n
    got = first_n(hot, ["key"], ["ord"], n)
    by_key = {}
    for r in hot.collect():
        by_key.setdefault(r.key, []).append(r.ord)
    assert sorted((r.key, r.ord) for r in got.collect()) == sorted((k, o) for k, os in by_key.items() for o in sorted(os)[:n])
    if n == 3:  # each input partition is cut before the shuffle
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(hot):
    from tidemark.operators.retrieval import top_k
    plan = top_k(hot, 5, key="key", score="v", tie="id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_context_sections_are_cut_before_the_shuffle(spark):
    from tidemark.operators import facts
    merged = spark.createDataFrame([], "seq BIGINT, pos BIGINT, path ARRAY<STRING>, kind STRING, value STRING")
    plan = facts.pack_context(merged)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join Cross" not in plan
