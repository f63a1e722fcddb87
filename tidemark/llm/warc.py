"""WARC archives: records in segments with chunked bodies, written and put together again.

Records are text lines to Spark with CR LF CR LF as line end, so its text writer makes and commits
the archives in any store, and its reader splits them at what starts a record.  For
that, no block holds ``WARC/1.`` in one piece: the writer cuts a chunk there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 8_192
LEAST_REVISIT = 100
SALTS = 8

# Framing and header lines of the formats.
END = "\r\n\r\n"
START = "WARC/1."
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = "Transfer-Encoding: chunked\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX = re.compile(rb"[0-9A-Fa-f]+").fullmatch
DATE = "2000-01-01T00:00:00Z"


def chunk_body(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; a chunk also ends inside every ``WARC/1.``."""
    cuts, at = set(range(0, len(payload), size)), payload.find(START.encode())
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(START.encode(), at + 1)
    bounds = [*sorted(cuts), len(payload)]
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        digits = body[at:line].split(b";")[0].strip(b" \t")
        if not HEX(digits):
            raise ValueError("a chunk size is not a hexadecimal number")
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        if body[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[line + 2:line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    chunked = any(k.strip() == b"transfer-encoding" and v.strip().endswith(b"chunked") for k, _, v in lines)
    return unchunk(body) if chunked else body


def record_id(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name made of what the record holds, in the form of a UUID, so a rerun gives the same."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest, copy.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def segmenter(segment_bytes: int, chunk_bytes: int):
    @F.pandas_udf("array<binary>")
    def cut(payloads: pd.Series) -> pd.Series:
        def one(payload: bytes | None) -> list[bytes]:
            if payload is None:
                return [f"{HTTP_HEAD}\r\n".encode()]
            block = f"{HTTP_HEAD}{CHUNKED}\r\n".encode() + chunk_body(payload, chunk_bytes)
            return [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
        return payloads.map(one)

    # pandas gives NaN-free objects for binary columns, so a missing payload is None.
    return cut


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> None:
    """One response or revisit record per row, in gzip archives below ``folder``.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest
    id is the response and the others revisit it (rows that share that id are
    responses all; so is a row without an id, and nothing refers to it).  A missing
    html is an empty payload.  Repeated rows get records of their own.  Blocks above
    ``segment_bytes`` go on in continuation records.  Control characters and spaces of a url are escaped.
    """
    p = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int"))
    # Counted on each task first; only payloads that occur again meet the pages, once per salt.
    first = (p.filter(F.octet_length("payload") >= least).filter("page is not null")
             .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "url")).alias("first")).filter("n > 1")
             .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    copy = F.row_number().over(Window.partitionBy("digest", "salt", "page", "url").orderBy(F.lit(0)))
    joined = p.join(first, ["digest", "salt"], "left").withColumn("copy", copy)
    revisit = F.coalesce(F.col("page") != F.col("first.page"), F.lit(False))
    records = joined.select(
        "page", "url", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"),
        record_id(F.col("page"), F.col("url"), F.col("digest"), F.col("copy")).alias("id"),
        F.when(revisit, record_id(F.col("first.page"), F.col("first.url"), F.col("digest"), F.lit(1))).alias("refers"),
        segmenter(segment_bytes, chunk_bytes)(F.when(~revisit, F.col("payload"))).alias("segments"))
    parts = records.select("*", F.posexplode("segments").alias("k", "block")).withColumn("n", F.size("segments")).withColumn(
        "total", F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s))).drop("segments")
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    some = lambda test, value: F.when(test, value).otherwise("")
    none = F.lit("")
    k, n = F.col("k"), F.col("n")
    safe_url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", "%00"), " ", "%20")
    own = F.concat(
        line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("id")),
        F.coalesce(line("WARC-Target-URI", safe_url), none), F.coalesce(line("X-Page-ID", F.col("page")), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(F.concat(line("WARC-Refers-To", F.col("refers")), line("WARC-Profile", F.lit(PROFILE))), none),
        some(n > 1, line("WARC-Segment-Number", F.lit(1))))
    more = F.concat(
        line("WARC-Type", F.lit("continuation")), line("WARC-Record-ID", record_id(F.col("page"), F.col("id"), F.col("digest"), k)),
        line("WARC-Segment-Origin-ID", F.col("id")), line("WARC-Segment-Number", k + 1),
        some(k + 1 == n, line("WARC-Segment-Total-Length", F.col("total"))))
    head = F.concat(F.lit("WARC/1.1"), F.when(k == 0, own).otherwise(more), line("WARC-Date", F.lit(DATE)),
                    line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length("block")))
    (parts.select(F.concat(head, F.lit(END), F.col("block").cast("string")).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(folder))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record as it stands: header fields, ``block``, and ``whole`` (the block has its declared length).

    A foreign archive whose block holds an end of record followed by ``WARC/1.``
    is cut there; such a record is not ``whole``.
    """
    lines = spark.read.option("lineSep", END + START).text(folder)
    head = F.substring_index("value", END, 1)
    name = lambda n: F.nullif(F.regexp_extract("head", rf"(?i)\r\n{n}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    parsed = lines.withColumn("head", head).select(
        name("WARC-Type").alias("type"), name("WARC-Record-ID").alias("id"), name("WARC-Target-URI").alias("url"),
        name("X-Page-ID").cast("bigint").alias("page_id"), name("WARC-Payload-Digest").alias("digest"),
        name("WARC-Refers-To").alias("refers"), name("WARC-Segment-Origin-ID").alias("origin"),
        name("WARC-Segment-Number").cast("int").alias("segment"), name("WARC-Segment-Total-Length").cast("bigint").alias("total"),
        name("Content-Length").cast("int").alias("length"), F.octet_length("head").alias("at"), F.col("value").cast("binary").alias("value"))
    return parsed.filter("type is not null").withColumn("block", F.expr("substring(value, at + 5, length)")).withColumn(
        "whole", F.octet_length("block") == F.col("length")).drop("value", "at")


def decoder():
    @F.pandas_udf("struct<payload: binary, error: string>")
    def decode(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(block: bytes | None) -> tuple[bytes | None, str | None]:
            try:
                return payload_of(block), None
            except (ValueError, AttributeError) as problem:
                return None, str(problem) or "broken framing"

        for part in blocks:
            yield pd.DataFrame([one(b) for b in part], columns=["payload", "error"])

    return decode


def reassemble(records: DataFrame) -> DataFrame:
    """Records put together from their segments: ``record_id``, ``page_id``, ``url``, ``record_type``, ``refers``
    (a record id), ``digest`` as declared, ``payload`` and ``error`` (null when all is well).

    Only segmented records are shuffled, each to where its origin is.  Their
    segments must be numbered from 1 without a gap and add up to the declared length.
    """
    kept = ["id", "page_id", "url", "type", "refers", "digest", "block", "problem"]
    single = records.filter("segment is null and origin is null").withColumn(
        "problem", F.when(~F.col("whole"), F.lit("block is cut short"))).select(*kept)
    own = F.col("segment") == 1
    parts = F.sort_array(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("text"))))
    of_first = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    grouped = (records.filter("segment is not null or origin is not null").groupBy(F.coalesce("origin", "id").alias("id"))
               .agg(*map(of_first, ("page_id", "url", "type", "refers", "digest")), parts.alias("parts"), F.max("total").alias("total"),
                    F.count(F.lit(1)).alias("n"), F.countDistinct("segment").alias("numbers"), F.max("segment").alias("last"), F.every("whole").alias("whole")))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    joined = grouped.withColumn("block", text.cast("binary")).withColumn("problem", F.when(
        ~F.coalesce((F.col("n") == F.col("last")) & (F.col("numbers") == F.col("n")) & F.col("whole") & F.col("type").isNotNull()
                    & (F.col("total") == F.octet_length("block")), F.lit(False)), F.lit("segments are missing or do not add up"))).select(*kept)
    whole = single.unionByName(joined).withColumn("d", decoder()(F.when(F.col("problem").isNull(), F.col("block"))))
    return whole.select(F.col("id").alias("record_id"), "page_id", "url", F.col("type").alias("record_type"), "refers", "digest",
                        F.col("d.payload").alias("payload"), F.coalesce("problem", "d.error").alias("error"))


def digests(found: DataFrame) -> DataFrame:
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (a page), ``error``.

    A revisit has no payload of its own; what it refers to is looked up, and its size and digest are those of that payload.
    """
    narrow = cut_lineage(found.select("record_id", "page_id", "record_type", "refers", "error", F.octet_length("payload").cast("bigint").alias("bytes"),
                                      F.sha2("payload", 256).alias("sha")))
    own = narrow.filter("refers is null").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type",
        F.lit(None).cast("bigint").alias("refers_to"), "error")
    target = narrow.filter("refers is null").select(F.col("record_id").alias("refers"), F.col("page_id").alias("_p"), F.col("bytes").alias("_b"), F.col("sha").alias("_s"))
    back = narrow.filter("refers is not null").select("page_id", "record_type", "refers", "error").join(target, "refers", "left").select(
        "page_id", F.col("_b").alias("payload_bytes"), F.col("_s").alias("payload_digest"), "record_type", F.col("_p").alias("refers_to"),
        F.coalesce("error", F.when(F.col("_s").isNull(), "the record referred to is missing")).alias("error"))
    return own.unionByName(back)


QUERY_SQL = """
WITH p AS (
  SELECT page_id, encode(COALESCE(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, MIN(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> d.page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
