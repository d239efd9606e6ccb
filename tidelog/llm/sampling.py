"""Bounded samples of labelled rows, the only part of the corpus on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold: those whose ids have the lowest MD5.

    ``labels`` has the id and the label; of several labels of one id the greatest counts; null labels and ids are left out. The
    chosen ids, at most ``rows`` of them, are the one thing that is broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(rows)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(chosen), id_col).select("text", "label"), "sample")
