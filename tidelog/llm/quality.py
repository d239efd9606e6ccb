"""Quality rules as a short-circuit cascade: the rule that rejects most per unit of cost runs first.

A rule is a named test of one text. On a bounded sample of rows each rule's cost (seconds a text) and selectivity (share of texts
it rejects) are measured; rules then run in falling order of rejections per second, and a text leaves at its first rejection.
The verdict is the conjunction of the rules, so neither the sample nor the order can change it.

Defined cases: a null or empty text has no words and fails the rule of fewest words; repeated rows are judged alike; columns of
the input that have a computed column's name are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import append_columns

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
#: Rows on which cost and selectivity are measured, and the longest texts among them.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 16


class Measures:
    """Counts of one text, each made when first asked for. Words are runs of bytes other than ASCII white space."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def full_lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.full_lines) - len(set(self.full_lines))

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in an 8-word window which the text holds at least twice."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        h, key = self.hashes, np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        starts = np.isin(key, twice)
        cover = np.zeros(self.n_words + 1, np.int64)
        cover[:n] += starts
        cover[WINDOW:] -= starts
        return int((np.cumsum(cover)[:-1] > 0).sum())

    @cached_property
    def n_shouted(self) -> int:
        """Words with an ASCII capital and no small ASCII letter."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_stuttered(self) -> int:
        """Words equal to the word before."""
        h = self.hashes
        return int((h[1:] == h[:-1]).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The two rules that every text must pass, whatever else is asked.
BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 100 * m.n_symbols > 5 * m.word_chars),
    Rule("shouting", lambda m: 2 * m.n_shouted > m.n_words),
    Rule("stutter", lambda m: 5 * m.n_stuttered > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.full_lines)),
)


def cascade_order(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by falling rejections per second on ``texts``; ties keep the given order."""

    def worth(rule: Rule) -> float:
        began, rejected = time.perf_counter(), 0
        for t in texts:
            rejected += rule.rejects(Measures(t))
        return rejected / max(time.perf_counter() - began, 1e-9)

    return sorted(rules, key=worth, reverse=True) if texts else list(rules)


def passes(measures: Measures, ordered: Sequence[Rule]) -> bool:
    return not any(rule.rejects(measures) for rule in ordered)


def sampled_order(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The cascade's order from at most ``rows`` rows of ``df``, drawn over the whole table, none of more than ``SAMPLE_BYTES``."""
    share = 1.5 * rows / max(1, df.count())
    drawn = df.select(text_col).where((F.rand(7) < share) & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES)).limit(rows)
    return cascade_order([r[0] for r in drawn.collect()], rules)


def quality_filter(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``df`` with ``kept`` boolean: whether no rule rejects the text."""
    order = sampled_order(df, text_col, rules, sample_rows)
    fields = T.StructType([T.StructField("kept", T.BooleanType())])
    return append_columns(df, text_col, fields, lambda: lambda texts: [[passes(Measures(t), order) for t in texts]])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``df`` with the five counts (long), ``base_failed`` and ``kept`` (boolean).

    The cascade runs first; counts that it has made are not made again.
    """
    order = sampled_order(df, text_col, rules, sample_rows)
    fields = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def apply(texts):
        rows = []
        for t in texts:
            m = Measures(t)
            kept = passes(m, order)
            rows.append((*(getattr(m, c) for c in COUNTS), failed := any(r.rejects(m) for r in BASE_RULES), kept and not failed))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

    return append_columns(df, text_col, fields, lambda: apply)
