"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Every source has a target number of words. A target of k whole sources and a rest means k copies of each document, and one more
of those whose hash lies under a threshold. The threshold is found without sorting documents: words are summed by source and the
first 12 bits of the hash, the bucket where the running sum passes the rest is the boundary, and only its documents are
summed again by the next 12 bits, three times in all. The last bucket, which holds one document or a few, is then passed over and the search
goes on behind it, so that a long document at the threshold does not spoil a small source; after ``ROUNDS`` searches the nearer of
the last bucket's two ends is taken.

Sources are ordered by code point, null last; their weights repeat. A target is stopped at ``most`` times its source's words and
what is over is shared among the others by weight until no target is above.

Defined cases: a null text has no words; a null source is a source; a null id hashes as an empty text; rows of one id are taken
together; an empty table gives an empty mix; other columns stay as they are, and those named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, Scope, written

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 3
ROUNDS = 3
#: The table of sources is broadcast up to so many rows, and joined by shuffling beyond.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(column: Column) -> Column:
    """36 bits: the first nine hexadecimal digits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def by_source(many: DataFrame, few: DataFrame, n_sources: int) -> DataFrame:
    """``many`` with the columns of ``few``, which has one row per source."""
    side = few.withColumnRenamed("source", "__source")
    side = F.broadcast(side) if n_sources <= BROADCAST_ROWS else side
    return many.join(side, many["source"].eqNullSafe(side["__source"])).drop("__source")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size) with ``target``: one row per source, so the windows over all of them are small.

    By rising stop per weight, sources are stopped as long as the level that the rest would share exceeds the stop.
    """
    listed = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int")).cast("long")
    rated = sources.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most)
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = rated.withColumn("level", level)
    free = F.col("stop") / F.col("weight") > F.col("level")
    # the level of the first source that is not stopped holds for all that follow
    final = levelled.withColumn("level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select("source", "source_size", F.least(F.col("stop").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("stop").cast("double"))).alias("target"))


def bucket(level: int) -> Column:
    """The hash bucket of a level; 0 is the coarsest."""
    return F.shiftright(F.col("h"), BITS * (LEVELS - 1 - level)).bitwiseAND(2**BITS - 1)


def thresholds(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> tuple[DataFrame, int]:
    """One row per source: source_size, target, copies of every document, ``below``, the hash under which there is one more, and
    ``skipped``, hashes for which there is not.

    ``sizes`` has source, size and h (a small table; text is not read here). Returns the number of sources too.
    """
    with Scope() as tables:
        found, n = _edges(sizes, weights, most, share)
        tables.keep(found)
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("under")
    everything = F.when(F.col("source_size") > 0, F.lit(2 ** (BITS * LEVELS))).otherwise(0)
    return found.select("source", "source_size", "target", "copies", "skipped", F.coalesce(F.col("prefix") + nearer.cast("long"), everything).alias("below")), n


def _edges(sizes: DataFrame, weights: Sequence[int], most: int, share: float) -> tuple[DataFrame, int]:
    """One row per source with the last bucket that the searches have come to."""
    sources = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share), "targets")
    n = sources.count()
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = sources.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    found = found.withColumn("skipped", F.array().cast("array<bigint>"))
    running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for turn in range(ROUNDS):
        # prefix: the boundary bucket so far, null if all that is left fits
        found = found.withColumns({"under": F.lit(0).cast("long"), "upto": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long")})
        for level in range(LEVELS):
            edge = found.select("source", "prefix", "under", "rest", "skipped")
            inside = by_source(sizes, edge, n).where((F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix")) & ~F.array_contains("skipped", F.col("h")))
            sums = inside.groupBy("source", bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.first("under").alias("under"), F.first("rest").alias("rest"))
            summed = sums.withColumn("upto", F.col("under") + F.sum("words").over(running))
            passing = summed.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("b", "upto", (F.col("upto") - F.col("words")).alias("before")), "b").alias("edge"))
            columns = ("source", "source_size", "target", "copies", "rest", "skipped")
            found = by_source_left(found, passing, n).select(*columns, F.col("edge.before").alias("under"), F.col("edge.upto").alias("upto"), (F.col("prefix") * 2**BITS + F.col("edge.b")).alias("prefix"))
            found = written(found, "edges")
        if turn < ROUNDS - 1:
            found = found.withColumn("skipped", F.when(F.col("prefix").isNotNull(), F.array_append("skipped", F.col("prefix"))).otherwise(F.col("skipped")))
    return found, n


def times_taken() -> Column:
    """Copies of a row with ``h`` and its source's ``copies``, ``below`` and ``skipped``."""
    more = (F.col("h") < F.col("below")) & ~F.array_contains("skipped", F.col("h"))
    return F.col("copies") + more.cast("long")


def by_source_left(many: DataFrame, few: DataFrame, n_sources: int) -> DataFrame:
    side = few.withColumnRenamed("source", "__source")
    side = F.broadcast(side) if n_sources <= BROADCAST_ROWS else side
    return many.join(side, many["source"].eqNullSafe(side["__source"]), "left").drop("__source")


def size_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h) of every row, written to the shared folder: texts are read once."""
    return written(df.select(F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h")), "sizes")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    sizes = size_table(df, id_col, text_col, source_col)
    edges, n = thresholds(sizes, weights, most, share)
    return by_source(sizes, edges, n).select(id_col, "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """The rows that the mix takes, all columns kept, each row as often as it is taken (at most ``most`` times)."""
    edges, n = thresholds(size_table(df, id_col, text_col, source_col), weights, most, share)
    side = edges.select(F.col("source").alias("__source"), F.struct("copies", "below", "skipped").alias("__edge"))
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    joined = df.join(side, df[source_col].eqNullSafe(side["__source"])).withColumn("__h", id_hash(F.col(id_col)))
    more = (F.col("__h") < F.col("__edge.below")) & ~F.array_contains("__edge.skipped", F.col("__h"))
    times = (F.col("__edge.copies") + more.cast("long")).cast("int")
    repeated = joined.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times"))))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])
