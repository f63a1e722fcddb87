"""Ordered work over groups of any size.

``row_number``, running sums and ordered concatenation put a whole group in one
task when written as ``Window.partitionBy(key)``.  A key that holds a third of
the input makes that one task as large as a third of the input.  The functions
here range-partition rows on (key, order) instead, so a large group is cut into
ordered slices; each slice is scanned on its own and the totals of the slices
before it are added.  Only keys that lie in several slices have such totals, so
there are fewer of them than slices, however many keys there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, slice_count


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                sums: Mapping[str, Column] | None = None,
                maxes: Mapping[str, Column] | None = None, slices: int | None = None) -> DataFrame:
    """Running sum and running maximum of all EARLIER rows of the key (the row itself is left out).

    ``order`` must be a total order inside a key; without keys all rows are one
    group.  Sums start at 0, maxima at null.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys, order = list(keys), list(order)

    # Slice ids must stay the same for both uses below, so the slices are written out once.
    sliced = cut_lineage(
        df.repartitionByRange(slices or slice_count(df.sparkSession), *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    w = (Window.partitionBy("_slice", *keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = sliced.select(
        "*",
        *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()],
        *[F.max(e).over(w).alias(n) for n, e in maxes.items()],
    )
    totals = sliced.groupBy("_slice", *keys).agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_t_{n}") for n, e in maxes.items()],
    )
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(
        F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        F.count(F.lit(1)).over(before).alias("_earlier"),
    ).filter("_earlier > 0").drop("_earlier")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
                F.col("_slice") == F.col("_s"))
    return local.join(carried, on, "left").select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_c_{n}")).alias(n) if not _is_struct(local, n)
          else F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in maxes],
    )


def _is_struct(df: DataFrame, name: str) -> bool:
    # A struct maximum starts with the order columns, so a later slice always wins.
    return df.schema[name].dataType.typeName() == "struct"


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                  slices: int | None = None) -> DataFrame:
    """0-based position of each row inside its key."""
    return prefix_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, slices=slices)


def beside(df: DataFrame, numbered: DataFrame, names: Sequence[str], on: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names`` that ``numbered`` has for the same values of ``on``, nulls alike."""
    narrow = numbered.select(*[F.col(c).alias(f"_n_{c}") for c in on], *names)
    return df.join(narrow, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in on])).select(*df.columns, *names)


def with_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int,
               name: str = "part_no", slices: int | None = None) -> DataFrame:
    """``part_no`` = position inside the key div ``max_rows``: ordered parts of bounded size.

    Only ``keys`` and ``order`` are sorted into ranges and written for the scan, the rest of a row, texts above all,
    meets its number in one join.  Rows of a key that ``order`` does not tell apart are in one part, that of the first.
    """
    counted = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_times"))
    numbered = prefix_scan(counted, keys, order, sums={"_position": F.col("_times")}, slices=slices)
    return beside(df, numbered.withColumn(name, F.expr(f"_position div {int(max_rows)}")), [name], [*keys, *order])


def ordered_text(order: Sequence[str], text: str, separator: str) -> Column:
    """Aggregate: texts of the group in order, joined by the separator.  Use on bounded parts."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(items, lambda x: x["_text"]), separator)
