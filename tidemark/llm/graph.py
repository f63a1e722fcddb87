"""Connected components of links, in few and small shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROWS_A_TASK = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """In no more tasks than ``rows`` rows are worth: a small table leaves few files at each shuffle."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def _star(edges: DataFrame, larger: bool, rows: int) -> DataFrame:
    """Ties neighbours to the smallest node of each neighbourhood.

    ``larger`` ties the larger neighbours of a node, else the smaller ones and the node itself.  The minimum is summed up
    before the shuffle.  The way back sends a row per link to the task of its node, two ids and no text; a node with very
    many links makes that task the longest, and no longer holds it once a round has tied its neighbours to a smaller one.
    """
    two = edges.union(edges.select("v", "u"))
    least = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    back = two.join(least, "u")
    if larger:
        out = back.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = back.filter(F.col("v") <= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))
    return gathered(out.filter(F.col("u") != F.col("v")), rows).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is linked to, over any number of links) for nodes with a link.

    ``edges`` has ``u`` and ``v``.  Large-star and small-star steps take turns until nothing changes; each round's edges
    are written to the shared folder, and one row (their count and checksum) reaches the driver.
    """
    edges = cut_lineage(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        rows = 2 * mark[0]
        edges = cut_lineage(gathered(_star(_star(gathered(edges, rows), True, rows), False, rows), rows))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return least.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """``node`` and ``root`` for nodes with a ``parent`` and for the roots themselves.

    A node has one parent at most, and no way leads back to it.  Each round doubles the steps a node has gone.
    """
    ways = cut_lineage(parents.select("node", F.col("parent").alias("root")))
    rows = ways.count()
    while rows:
        ways = gathered(ways, rows)
        on = ways.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        further = cut_lineage(gathered(ways.join(on, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), rows))
        ways = further.drop("_moved")
        if further.filter("_moved").isEmpty():
            break
    return ways.union(ways.select(F.col("root").alias("node"), "root").distinct())


def add_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``node``, ``root``) with the links ``u``, ``v`` added; a node without a row is its own root.

    Only the roots of linked nodes go through ``components``, so a component counts as one node however large it is.
    """
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    between = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(
        F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    found = cut_lineage(components(between))
    single = found.select("node").join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    onward = found.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return roots.unionByName(single).join(onward, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
