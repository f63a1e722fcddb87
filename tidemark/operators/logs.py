"""Log lines, alerts and their diagnosis input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import overflow_attachment, overflow_view
from tidemark.operators.scan import beside, ordered_text, prefix_scan
from tidemark.session import cut_lineage

# Defaults, limits and texts of alert handling.
DEFAULT_STATUS = "firing"
DEFAULT_NAMESPACE = "ai-agent"
DEFAULT_NAME = "Unknown"
DEFAULT_DESCRIPTION = "No description"
DESCRIPTION_CHARS = 4_000
LOG_LINES = 50
LOOK_BACK_HOURS = 1
LOOK_BACK_SPANS = 8
NO_LOGS = "No logs found or Loki unreachable."
PROMPT_HEAD = ("You are an SRE assistant. Analyze the following alert and logs to identify the root cause."
               "\n\nALERT: ")

PART_PIECES = 1_000_000

# Container runtime line format.
CRI_PATTERN = r"^(\S+) (stdout|stderr) (P|F) (.*)$"

ALERT_SCHEMA = (
    "status STRING, alerts ARRAY<STRUCT<status: STRING, labels: MAP<STRING, STRING>, "
    "annotations: MAP<STRING, STRING>>>"
)


# --- lines ------------------------------------------------------------------

def parse_cri(raw: DataFrame, line: str = "line") -> DataFrame:
    """Container log lines to ``log_ts``, ``stream``, ``flag``, ``content``; other lines are dropped."""
    field = lambda n: F.regexp_extract(line, CRI_PATTERN, n)
    return raw.filter(F.rlike(F.col(line), F.lit(CRI_PATTERN))).select(
        *[c for c in raw.columns if c != line], field(1).alias("log_ts"), field(2).alias("stream"),
        field(3).alias("flag"), field(4).alias("content"))


def parse_json_log(raw: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """JSON log lines as a struct ``log``; unreadable lines give null."""
    return raw.withColumn("log", F.from_json(F.col(line), schema))


def join_partial_lines(lines: DataFrame, keys: list[str], order: list[str],
                       max_rows: int = PART_PIECES) -> DataFrame:
    """Pieces flagged P joined up to the next F.  ``part_no`` is the position of a piece in its
    line div ``max_rows``, so a very long line comes in ordered parts.

    One scan of the keys and flags gives each piece its line and its place; the contents move afterwards, once to
    meet them and once to be joined.
    """
    ends = F.when(F.col("flag") == "F", 1).otherwise(0).cast("bigint")
    scanned = cut_lineage(prefix_scan(lines.select(*keys, *order, "flag"), keys, order, sums={"line_no": ends, "_place": F.lit(1).cast("bigint")}))
    starts = scanned.groupBy(*keys, "line_no").agg(F.min("_place").alias("_start"))
    placed = beside(scanned, starts, ["_start"], [*keys, "line_no"]).withColumn("part_no", F.expr(f"(_place - _start) div {int(max_rows)}"))
    parted = beside(lines.select(*keys, *order, "content"), placed, ["line_no", "part_no"], [*keys, *order])
    return parted.groupBy(*keys, "line_no", "part_no").agg(
        ordered_text(order, "content", "").alias("content"), F.count(F.lit(1)).alias("n_pieces"))


def log_volume(logs: DataFrame, labels: list[str], step: str = "1 hour", line: str = "line") -> DataFrame:
    """Lines and bytes per label set and step."""
    return (logs.groupBy(*labels, F.window("ts", step).alias("w"))
            .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line)).alias("bytes"))
            .select(*labels, F.col("w.start").alias("step_start"), "lines", "bytes"))


# --- alerts -----------------------------------------------------------------

def alert_view(payloads: DataFrame) -> DataFrame:
    """One row per alert of each payload, with the defaults filled in."""
    rest = [c for c in payloads.columns if c not in ("status", "alerts")]
    a = payloads.select(*rest, F.posexplode("alerts").alias("alert_no", "a"))
    labels = F.col("a.labels")
    status = F.coalesce("a.status", F.lit(DEFAULT_STATUS))
    description = F.coalesce(F.col("a.annotations")["description"], F.lit(DEFAULT_DESCRIPTION))
    return a.select(
        *rest, F.col("alert_no").cast("bigint").alias("alert_no"), status.alias("status"),
        F.coalesce(labels["alertname"], F.lit(DEFAULT_NAME)).alias("name"), labels["pod"].alias("pod"),
        F.coalesce(labels["namespace"], F.lit(DEFAULT_NAMESPACE)).alias("namespace"),
        description.alias("full_description"),
        F.left(description, F.lit(DESCRIPTION_CHARS)).alias("description"),
        F.when(status == "firing", "red").otherwise("green").alias("colour"),
        ((status == "firing") & (F.coalesce(labels["pod"], F.lit("")) != "")).alias("needs_diagnosis"))


def needs_diagnosis(alerts: DataFrame) -> DataFrame:
    return alerts.filter("needs_diagnosis")


def hours_seen(alerts: DataFrame, look_back_hours: int, width: int = 1) -> DataFrame:
    """``pod``, ``namespace``, ``hour`` of every span of ``width`` hours (counted from 1970) that an alert's look-back touches."""
    hour = lambda back: F.floor((F.unix_seconds("ts") - back * 3_600) / (width * 3_600))
    return alerts.filter("ts IS NOT NULL").select("pod", "namespace", F.explode(F.sequence(hour(look_back_hours), hour(0))).alias("hour")).distinct()


def alert_logs(alerts: DataFrame, logs: DataFrame, n: int = LOG_LINES, alert_id: str = "alert_id",
               look_back_hours: int = LOOK_BACK_HOURS) -> DataFrame:
    """Newest ``n`` log lines of the alert's pod in the hours up to the alert, oldest first, as ``log_text``.

    Lines are read only of the pods and hours that an alert looks back on; the hours of a longer look-back are taken
    together in at most ``LOOK_BACK_SPANS`` + 2 spans, so an alert is a few rows however far it looks.  No alert is paired with all lines of its
    pod: lines, alerts and the beginnings of their ranges are numbered together in time order, without the text.  What
    an alert sees is then a range of line numbers, at most ``n``; only these lines' texts are looked up.  Lines of one
    instant come by ``seq`` (null first), then by a digest of the text; every line counts once, equal ones too.  A line
    without pod, namespace or time belongs to no alert, and an alert without one of them sees none.  ``alert_id`` names
    the key of an alert.
    """
    pod = ["pod", "namespace"]
    line = [*pod, "ts", "seq", "digest"]
    width = max(1, -(-look_back_hours // LOOK_BACK_SPANS))
    hour = F.floor(F.unix_seconds("ts") / (width * 3_600)).alias("hour")
    # Alerts are read for their spans, twice for the numbers and once more for the ranges of these; their keys are written, so payloads are parsed once.
    alerts = cut_lineage(alerts.select(*pod, "ts", alert_id))
    # The planner takes the spans for as small as the alerts they are made of; they grow with pods and time, so they are shuffled.
    spans = hours_seen(alerts, look_back_hours, width).hint("merge")
    near = (logs.select(*pod, "ts", "seq", "line", hour).join(spans, [*pod, "hour"], "left_semi")
            .withColumn("digest", F.unhex(F.md5(F.coalesce("line", F.lit(""))))).drop("hour"))
    none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    mark = lambda ts, kind: alerts.select(*pod, ts.alias("ts"), F.lit(kind).alias("kind"), none("seq", near), none("digest", near), alert_id)
    began = F.col("ts") - F.make_interval(hours=F.lit(look_back_hours))
    # Equal lines are numbered one after the other and share one text.
    times = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")
    counted = near.groupBy(*line).agg(F.count(F.lit(1)).alias("times"))
    both = (counted.select(*pod, "ts", F.lit(0).alias("kind"), "seq", "digest", none(alert_id, alerts), times)
            .unionByName(mark(began, -1).withColumn("nth", F.lit(0))).unionByName(mark(F.col("ts"), 1).withColumn("nth", F.lit(0))))
    is_line = F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")
    # Lines and alerts both read the numbers, so they are written once.
    numbered = cut_lineage(prefix_scan(both, pod, ["ts", "kind", "seq", "digest", alert_id, "nth"], sums={"n_before": is_line}))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n_before")))
    seen = (numbered.filter("kind <> 0").groupBy(*pod, alert_id).agg(at(1).alias("n_seen"), at(-1).alias("n_old"))
            .withColumn("n_first", F.greatest("n_old", F.col("n_seen") - n)))
    wanted = seen.filter("n_first < n_seen").withColumn("n_before", F.explode(F.sequence(F.col("n_first"), F.col("n_seen") - 1)))
    lines = (numbered.filter("kind = 0").select(*line, "n_before")
             .join(wanted.select(*pod, "n_before").distinct(), [*pod, "n_before"]))
    named = lines.select(*[F.col(c).alias(f"_{c}") for c in line], "n_before")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in line]
    # One text per digest is enough, and only those that an alert sees leave the log.
    found = (near.join(named.drop("n_before").distinct(), same, "left_semi").groupBy(*line).agg(F.first("line").alias("line")))
    texts = found.join(named, same).select(*pod, "n_before", "line")
    joined = (wanted.join(texts, [*pod, "n_before"]).groupBy(*pod, alert_id)
              .agg(ordered_text(["n_before"], "line", "\n").alias("_text")))
    # An alert without pod or namespace is a row all the same.
    return (seen.join(joined.select(*[F.col(c).alias(f"_{c}") for c in (*pod, alert_id)], "_text"),
                      on=[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*pod, alert_id)], how="left")
            .select(alert_id, *pod, (F.col("n_seen") - F.col("n_first")).alias("n_lines"),
                    F.coalesce("_text", F.lit(NO_LOGS)).alias("log_text")))


def diagnosis_prompt(description: Column, logs: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), description, F.lit("\n\nLOGS:\n"), logs, F.lit("\n\nDiagnosis:"))


def overflow_split(df: DataFrame, text: str) -> DataFrame:
    """``shown`` and, for long text, ``attachment`` with all of it."""
    return df.withColumn("shown", overflow_view(F.col(text))).withColumn("attachment", overflow_attachment(F.col(text)))
