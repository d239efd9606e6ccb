"""Ordered indexes as tables: dense ones, whose keys follow one another, and sparse ones in order of first insertion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import running_sums


def dense_appends(pushes: DataFrame, group: str, key: str, arrival: str, first_key: int = 0) -> DataFrame:
    """``pushes`` with ``expected``, the key that the index wanted, and ``outcome``: accepted where it got that key, else out_of_order.

    Each push depends on those before, so an index is one stream; rows are read in order in bounded memory.
    """
    names = pushes.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, wanted = object(), first_key
        for frame in frames:
            expected, outcomes = [], []
            for g, k in zip(frame[group].tolist(), frame[key].tolist(), strict=True):
                if g != at:
                    at, wanted = g, first_key
                expected.append(wanted)
                outcomes.append("accepted" if k == wanted else "out_of_order")
                wanted += k == wanted
            yield frame.assign(expected=expected, outcome=outcomes)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pushes.schema)
    return pushes.repartition(group).sortWithinPartitions(group, arrival).select(*names).mapInPandas(walk, f"{schema}, expected long, outcome string")


def truncated(index: DataFrame, key: str, first_retained: int) -> DataFrame:
    """What is left of an index when its front goes."""
    return index.where(F.col(key) >= first_retained)


def sparse(inserts: DataFrame, key: str, value: str, arrival: str) -> DataFrame:
    """(key, value, ordinal): a key keeps the place of its first insertion and has the value of its last. ``arrival`` never repeats.

    Places are counted over blocks of arrivals, so no task orders all keys.
    """
    kept = inserts.groupBy(key).agg(F.max_by(value, arrival).alias(value), F.min(arrival).alias("__first")).withColumn("__all", F.lit(0))
    return running_sums(kept, ["__all"], "__first", {"ordinal": F.lit(1)}).select(key, value, "ordinal")
