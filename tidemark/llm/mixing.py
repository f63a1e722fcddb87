"""Mixing sources to target weights with exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan
from tidemark.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3

# Fixed value: a word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, source: str, weights: Sequence[int] = WEIGHTS,
                   repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: ``source_size`` and ``target``, from rows with ``size``.

    Sources by code point (null last) weigh ``weights`` in turn and share the sum
    of all sizes; none gets more than ``repeats`` times its own size, and what is
    over goes to the others by weight.  With sources sorted by size per weight, the
    capped ones are the first k, so the common level is a running sum away and
    nothing is iterated.  There are as many rows as sources.
    """
    total = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    by_name = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (by_name % len(weights) + 1).cast("int"))
    weighed = total.withColumn("_weight", weight.cast("bigint")).withColumn("_cap", F.col("source_size") * repeats)
    all_rows = Window.partitionBy()
    # The order by cap per weight; the name makes it total.
    earlier = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = weighed.select(
        "*", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))).alias("_left"),
        (F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))).alias("_shares"))
    # Sources from the first one below its cap on share what the capped ones leave.
    free = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_shares")
    levelled = ranked.select("*", F.max(F.when(free, F.struct("_shares", "_left"))).over(all_rows).alias("_level"))
    share = F.col("_weight") * F.col("_level._left") / F.col("_level._shares")
    return levelled.select(
        "_source", "source_size",
        F.when(F.col("_shares") > F.col("_level._shares"), F.col("_cap").cast("double"))
        .otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        weights: Sequence[int] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    Documents of a source are put in the order of a hash of (seed, id), the words
    before each are summed over range-partitioned slices, and a source's whole-word
    budget is cut there: every full epoch takes the document whole, the last one as
    many of its words as still fit.  Rows with the same id and text follow each other and are
    counted each.  A missing text has no words; rows without a source are one source.
    Nothing is drawn at random, so reruns agree.  The text is read once; only narrow
    rows are shuffled.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    narrow = cut_lineage(docs.select(
        F.col(source).alias("_source"), F.col(doc_id).alias("doc_id"), key.alias("_key"),
        count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("_tie")))
    placed = prefix_scan(narrow, ["_source"], ["_key", "doc_id", "size", "_tie"], sums={"_before": F.col("size")})
    targets = source_targets(narrow, "_source", weights, repeats)
    # One row per source; the side grows with the sources only, so Spark measures it before it broadcasts.
    joined = placed.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    budget = F.floor("target").cast("bigint")
    size = F.greatest(F.col("source_size"), F.lit(1))
    rest = budget % size
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    epochs = F.expr("floor(target) div greatest(source_size, 1)")
    return joined.select("doc_id", "size", "source_size", "target",
                         (epochs * F.col("size") + last).cast("bigint").alias("taken"),
                         F.col("_source").alias("source"), F.col("_tie").alias("text_hash"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def repeated(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of the mix: a document once for every epoch that takes it, all columns as they were.

    Where a source's budget ends inside a document, that last copy has only the words
    that fit.  Documents without words are in no budget; they stay once.
    """
    taken = mix(docs, source, doc_id, text, **options)
    # Rows that share source, id and text are alike here: what they take together is dealt to them from the front.
    same = ["source", "doc_id", "text_hash"]
    sums = taken.groupBy(*same).agg(F.sum("taken").alias("_sum"), F.max("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    renamed = sums.select(*[F.col(c).alias(f"_{c}") for c in same], "_sum", "_size", "_rows")
    on = (F.xxhash64(F.col(text)) == F.col("_text_hash")) & F.col(doc_id).eqNullSafe(F.col("_doc_id")) & F.col(source).eqNullSafe(F.col("_source"))
    whole, rest = F.expr("_sum div greatest(_size, 1)"), F.col("_sum") % F.greatest("_size", F.lit(1))
    # Copies of a group of equal rows: every row has as many, the first ones one more.
    nth = F.row_number().over(Window.partitionBy("_text_hash", "_doc_id", "_source").orderBy(F.lit(0)))
    joined = docs.join(renamed, on).withColumn("_nth", nth)
    total = whole + F.when(rest > 0, 1).otherwise(0)
    own = F.floor((total + F.col("_rows") - F.col("_nth")) / F.col("_rows"))
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(own).cast("int")
    # The cut copy is the last copy of the row that holds the group's last one.
    last = (rest > 0) & (F.pmod(total - 1, F.col("_rows")) + 1 == F.col("_nth"))
    out = joined.withColumn("_last", F.coalesce(last, F.lit(False))).withColumn("_rest", rest).withColumn("_copies", copies).filter("_copies > 0")
    spread = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    cut = (F.col("_copy") == F.col("_copies")) & F.col("_last")
    return spread.withColumn(text, F.when(cut, first_words(F.col(text), F.col("_rest"))).otherwise(F.col(text))).select(*docs.columns)


QUERY_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || COALESCE(doc_id::VARCHAR, '')) AS k, text
  FROM documents),
total AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM total),
ranked AS (
  SELECT *, SUM(source_size) OVER () - COALESCE(SUM(cap) OVER w, 0) AS rest,
         SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS shares
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_max(rest, shares)::BIGINT AS rest, MAX(shares)::BIGINT AS shares FROM ranked WHERE rest * weight <= cap * shares),
targets AS (
  SELECT source, source_size, CASE WHEN r.shares > l.shares THEN cap::DOUBLE
         ELSE COALESCE((weight * l.rest)::DOUBLE / l.shares, 0) END AS target
  FROM ranked r, level l),
placed AS (
  SELECT s.*, t.source_size, t.target, FLOOR(target)::BIGINT AS budget,
         COALESCE(SUM(size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (budget // GREATEST(source_size, 1) * size
        + GREATEST(0, LEAST(size, budget % GREATEST(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
