"""Ordered computations along a partition that no single task has to walk.

A window over one log partition puts the partition in one task. Here the order (a whole number that never repeats within a
partition) is cut into blocks of a fixed width: block totals are small and are summed or shifted by a window over blocks,
and the rows of one block are handled together. A partition of N rows costs N / width rows in the window over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], width: int = BLOCK) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the earlier rows of the partition (0 for the first)."""
    cut = df.withColumns({"__block": _block(order, width), **{f"__v_{n}": c.cast("long") for n, c in sums.items()}})
    totals = cut.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__block", *[F.coalesce(F.sum(f"__t_{n}").over(along), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(before, [*keys, "__block"])
    out = out.withColumns({n: F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.drop("__block", *[f"__{p}_{n}" for n in sums for p in "vb"])


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int = BLOCK) -> DataFrame:
    """``df`` with ``name``, the greatest value of the earlier rows of the partition; null for the first."""
    cut = df.withColumn("__block", _block(order, width))
    tops = cut.groupBy(*keys, "__block").agg(F.max(value).alias("__top"))
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "__block", F.max("__top").over(along).alias("__upto"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(before, [*keys, "__block"]).withColumn(name, F.greatest("__upto", F.max(value).over(inside))).drop("__block", "__upto")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], width: int = BLOCK) -> DataFrame:
    """``df`` with ``previous``, a struct of ``columns`` of the row before in the partition; null for the first row."""
    row = F.struct(*columns)
    cut = df.withColumn("__block", _block(order, width))
    last = cut.groupBy(*keys, "__block").agg(F.max_by(row, order).alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__block")
    carried = last.select(*keys, "__block", F.lag("__last").over(along).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    out = cut.join(carried, [*keys, "__block"])
    return out.withColumn("previous", F.coalesce(F.lag(row).over(inside), F.col("__carried"))).drop("__block", "__carried")


def within_budget(df: DataFrame, keys: Sequence[str], order: str, size: str, budget: int, width: int = BLOCK) -> DataFrame:
    """The rows of each partition, in order, whose sizes' running sum fits the budget; the first row always.

    Only the blocks in which the sum before is still within the budget are ordered row by row.
    """
    cut = df.withColumn("__block", _block(order, width))
    totals = cut.groupBy(*keys, "__block").agg(F.sum(size).alias("__sum"))
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    open_blocks = totals.select(*keys, "__block", F.sum("__sum").over(along).alias("__before")).where(F.coalesce(F.col("__before"), F.lit(0)) <= budget)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    rows = cut.join(open_blocks, [*keys, "__block"])
    rows = rows.withColumn("__upto", F.coalesce("__before", F.lit(0)) + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__first", F.col("__before").isNull() & (F.row_number().over(inside) == 1))
    return rows.where(F.col("__first") | (F.col("__upto") <= budget)).drop("__block", "__before", "__upto", "__first")


def first_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each partition; Spark limits groups in every task before it shuffles them."""
    along = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(along)).where(F.col("__rank") <= n).drop("__rank")


def run_end(df: DataFrame, keys: Sequence[str], first: str, last: str, start: DataFrame, start_col: str) -> DataFrame:
    """(keys, run_end): where the unbroken run of ranges that begins at each partition's start ends (exclusive).

    Ranges do not overlap. The run ends at the least place after the start where more ranges end than begin; places are summed
    in every task before they are shuffled, and nothing is ordered. ``start`` has one row per partition.
    """
    origin = start.select(*keys, F.col(start_col).alias("__start"))
    begins = F.struct(F.col(first).alias("place"), F.lit(-1).alias("net"), F.lit(1).alias("begins"))
    ends = F.struct((F.col(last) + 1).alias("place"), F.lit(1).alias("net"), F.lit(0).alias("begins"))
    places = df.select(*keys, F.explode(F.array(begins, ends)).alias("x")).groupBy(*keys, F.col("x.place").alias("place")).agg(F.sum("x.net").alias("net"), F.max("x.begins").alias("begins"))
    stop = F.min(F.when((F.col("net") > 0) & (F.col("place") > F.col("__start")), F.col("place")))
    begun = F.max((F.col("place") == F.col("__start")) & (F.col("begins") == 1))
    found = places.join(origin, list(keys)).groupBy(*keys).agg(stop.alias("__stop"), begun.alias("__begun"))
    return origin.join(found, list(keys), "left").select(*keys, F.when(F.col("__begun"), F.col("__stop")).otherwise(F.col("__start")).alias("run_end"))
