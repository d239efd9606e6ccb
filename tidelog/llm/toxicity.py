"""Toxicity by a weighted lexicon that one Aho-Corasick pass finds in folded text.

Folding lowers letters and maps look-alike letters of other scripts and digits that stand for letters to plain Latin ones. A
term is a whole word (``idiot$``) or the start of longer words (``idiot+``, of 4 to 8 letters), so that inflected forms are caught
and a harmless word that they begin with is not; its weight is the log of how much likelier toxic documents hold it than others.
All terms and all exception phrases are matched in one pass; a hit inside an exception phrase does not count, and of hits that
start at one place the weightiest counts. The sum of weights, taken by itself and for each hundred words, goes through a logistic curve.

The lexicon and the curve are fitted on at most ``SAMPLE_ROWS`` labelled documents outside the held-out fold. Scores use nothing
but the text. Null and empty texts have no hits and get the score of that; repeated rows and ties score alike; a column of the input
that has the score's name is replaced, others stay; without rows of both labels nothing is toxic. Of the sample, all stems that pass
the two thresholds are terms, so the lexicon is as large as the sample makes it and no larger.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import append_columns, slices, tidy

SAMPLE_ROWS = 8_000
LENGTHS = (4, 5, 6, 7, 8)
#: A term is in at least so many toxic documents of the sample, and so many times likelier there than elsewhere.
MIN_TOXIC, MIN_RATIO = 4, 12.0
#: Look-alikes of Latin letters: Cyrillic, then Greek, then digits and signs. Fixed values.
LOOKS = dict(
    zip("аеорсухіјѕԁһӏкмтвнғб", "aeopcyxijsdhlkmtbhfb", strict=True),
) | dict(zip("αοερικντυχ", "aoepikvtux", strict=True)) | dict(zip("013457@$", "oieastas", strict=True))
#: Phrases in which a listed word is harmless. Fixed values.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "class clown", "idiot proof", "disgusting smell of")
FOLDS = str.maketrans(LOOKS)
WORDS = regex.compile(r"[^\W_]+")


def folded(text: str | None) -> str:
    return (text or "").lower().translate(FOLDS)


def stems(text: str | None) -> set[str]:
    """The text's words of 3 letters or more, each with ``$``, and the starts of longer words, each with ``+``."""
    words = set(WORDS.findall(folded(text)))
    return {w[:n] + "+" for n in LENGTHS for w in words if len(w) > n} | {w + "$" for w in words if len(w) >= 3}


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, terms: Sequence[tuple[str, float]], exceptions: Sequence[str] = EXCEPTIONS):
        self.weights = dict(terms)
        self.found = ahocorasick.Automaton()
        for term in {t[:-1] for t in self.weights}:
            self.found.add_word(term, (term, False))
        for phrase in exceptions:
            self.found.add_word(folded(phrase), (folded(phrase), True))
        if len(self.found):
            self.found.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + weights), and the same for each hundred words."""
        flat = folded(text)
        if not flat or not len(self.found):
            return 0.0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (term, exception) in self.found.iter(flat):
            start = end - len(term) + 1
            if start and (flat[start - 1].isalnum()):
                continue
            if exception:
                spared.append((start, end))
            else:
                longer = flat[end + 1 : end + 2].isalnum()
                best[start] = max(best.get(start, 0.0), self.weights.get(term + ("+" if longer else "$"), 0.0))
        total = sum(w for at, w in best.items() if not any(a <= at <= b for a, b in spared))
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(total / (1 + flat.count(" ") / 100))


def _stem_counts(wanted: frozenset[str] | None = None):
    """Counts documents per stem in each task; of all stems, or of ``wanted`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = stems(text)
                counts.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "n"])

    return run


def ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """How much likelier toxic documents hold a stem than others."""
    return (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))


def choose_terms(counts: Sequence[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[tuple[str, float], ...]:
    """Terms with weights from (stem, toxic documents, clean documents); what a shorter kept start covers is left out."""
    kept: dict[str, float] = {}
    for stem, toxic, clean in sorted(counts, key=lambda c: (len(c[0]), c[0])):
        times = ratio(toxic, clean, n_toxic, n_clean)
        if toxic >= MIN_TOXIC and times >= MIN_RATIO and not any(stem[:n] + "+" in kept for n in LENGTHS if n < len(stem) - 1):
            kept[stem] = math.log(times)
    return tuple(sorted(kept.items()))


def fit_curve(features: np.ndarray, labels: np.ndarray, steps: int = 30) -> tuple[float, ...]:
    """Weights of the two features and the constant: logistic regression by Newton's steps, lightly held to 0."""
    x = np.column_stack([features, np.ones(len(features))])
    w, hold = np.zeros(3), np.array([0.1, 0.1, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - hold * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        w = w + np.linalg.solve(hessian, gradient)
    return tuple(float(v) for v in w)


def fit(sample: DataFrame) -> Model:
    """A model from (text, label 0 or 1) rows, whose number is bounded. Without rows of both labels nothing is toxic."""
    by_label = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = by_label.get(True, 0), by_label.get(False, 0)
    if not n_toxic or not n_clean:
        return Model((), (0.0, 0.0, -3.0))
    # stems of toxic documents first, then the likely ones among them in the others; both tables are bounded by the sample
    count = lambda rows, wanted=None: rows.select("text").mapInArrow(tidy(_stem_counts(wanted)), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    toxic = {r["stem"]: r["n"] for r in count(sample.where("label > 0")).where(F.col("n") >= MIN_TOXIC).collect()}
    clean = {r["stem"]: r["n"] for r in count(sample.where("label <= 0"), frozenset(toxic)).collect()}
    counts = [(s, n, clean.get(s, 0)) for s, n in toxic.items()]
    terms = choose_terms([c for c in counts if ratio(c[1], c[2], n_toxic, n_clean) >= MIN_RATIO], n_toxic, n_clean)
    seen = append_columns(sample, "text", _FEATURES, _featurer(terms, EXCEPTIONS)).select("f0", "f1", (F.col("label") > 0).cast("int").alias("y")).collect()
    table = np.array(sorted(map(tuple, seen)), float).reshape(-1, 3)
    return Model(terms, fit_curve(table[:, :2], table[:, 2]))


_FEATURES = T.StructType([T.StructField("f0", T.DoubleType()), T.StructField("f1", T.DoubleType())])


def _featurer(terms, exceptions):
    def make():
        matcher = Matcher(terms, exceptions)

        def apply(texts):
            rows = [matcher.features(t) for t in texts]
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return apply

    return make


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``df`` with ``name``: the likelihood (0 to 1) that the text is toxic."""
    terms, exceptions, (a, b, c) = model.terms, model.exceptions, model.curve

    def make():
        matcher = Matcher(terms, exceptions)

        def one(text):
            x, y = matcher.features(text)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))

        return lambda texts: [[one(t) for t in texts]]

    return append_columns(df, text_col, T.StructType([T.StructField(name, T.DoubleType())]), make)
