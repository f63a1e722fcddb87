"""URL verdicts from a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the registered query, (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

DEFAULT_VERDICT = "allow"
MOST_CHARS = 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the last to the first, then, below the key None, whole path segments.

    Where a rule's path ends inside a segment (``/en`` fits ``/english``), its
    end is kept at the node of the segments before it, by length.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *whole, end = path.split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            # Of equal rules a block stands before an allow.
            ends = node.setdefault(None, {})
            if ends.get(end, ("allow",))[0] != "block":
                ends[end] = (verdict, host + path, len(host), len(path))

    def find(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """The rule with the longest host, and of those the longest path, that fits."""
        nodes, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")
        for node in reversed(nodes):
            paths, best = node.get(None), None
            for segment in segments:
                if paths is None:
                    break
                for end, rule in paths.get(None, {}).items():
                    if segment.startswith(end) and (best is None or rule[3] >= best[3]):
                        best = rule
                paths = paths.get(segment)
            if best:
                return best
        return None


def chunks(rules: Sequence[tuple[str, str, str]], most: int) -> list[list[tuple[str, str, str]]]:
    out, size = [[]], 0
    for rule in rules:
        n = sum(map(len, rule))
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += n
    return out


def matcher(trie: Broadcast):
    @F.pandas_udf("struct<verdict: string, rule: string, host: int, path: int>")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            rows = [trie.value.find(h, p) or (None, None, -1, -1) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(rows, columns=["verdict", "rule", "host", "path"])

    return match


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url",
          default: str = DEFAULT_VERDICT, most_chars: int = MOST_CHARS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (its host and path, or null) and ``verdict`` to each row.

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains
    where the path starts with its own, character by character; the longest host
    wins, then the longest path, and between equal rules the block.  Without a rule
    the verdict is ``default``.  A missing url has empty host and path.  Columns of
    these names are replaced.  The trie is broadcast; rules of more than
    ``most_chars`` characters go in several tries one after the other, and the longest match stays.
    """
    taken = {"host", "path", "rule", "verdict"}
    found = pages.select(*[c for c in pages.columns if c not in taken or c == url],
                         url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    steps = chunks(rules, most_chars)
    for i, part in enumerate(steps):
        match = matcher(pages.sparkSession.sparkContext.broadcast(Trie(part)))
        found = found.withColumn(f"_m{i}", match("_host", "_path"))
    first = [F.struct(F.col(f"_m{i}.host"), F.col(f"_m{i}.path"), (F.col(f"_m{i}.verdict") == "block").alias("b"),
                      F.col(f"_m{i}.rule"), F.col(f"_m{i}.verdict")) for i in range(len(steps))]
    best = F.greatest(*first) if len(first) > 1 else first[0]
    kept = [c for c in found.columns if not c.startswith("_m") and c not in ("_host", "_path", *(taken - {url}))]
    return found.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), best["rule"].alias("rule"),
                        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


QUERY_SQL = r"""
WITH cut AS (
  SELECT page_id, COALESCE(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS rule,
       COALESCE((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h) DESC, length(p) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
