"""Language identification by unigrams whose segmentations are summed out.

The pieces are those of a fixed public vocabulary that consist of letters, of any length. Each language has a probability for every
piece; a word's probability in a language is the sum over all ways to cut it into pieces, which a forward pass gives in one sweep, and
a text's is the product over its words. Probabilities are fitted by expectation-maximisation (forward and backward passes) on the
word counts of each language: tasks sum the expected counts of pieces over their words, the driver gets one number per piece and language.

Words are runs of letters, whole, lowered, with the vocabulary's word-start mark before them. Counts come from at most ``SAMPLE_ROWS``
documents with a language outside the held-out fold, all of their words. Prediction reads whole texts and nothing but the text.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no language learned everything is ``und``; of languages
that are equally likely the first by name is predicted; repeated rows get equal answers; columns of the input that have a computed
column's name are replaced, others stay.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import append_columns, fold, slices, tidy, written

SAMPLE_ROWS = 10_000
ROUNDS = 4
UNKNOWN = "und"
START = "▁"
#: What a character gets that is no piece, and what is added to each piece's expected count.
FLOOR, ADDED = 1e-9, 0.01
LETTERS = regex.compile(r"\p{L}+")
#: Stretches without spaces whose scores a task keeps, and their characters; the store is emptied when either is passed.
CACHE, CACHE_CHARS = 300_000, 1 << 25
#: Letters of words of one length that are summed at once, and words that a task of the fit takes together.
CELLS, TOGETHER = 1 << 19, 50_000
#: Characters of texts whose words are looked up together, and words of one text that are summed at once.
GROUP_CHARS, STRETCH = 1_000_000, 20_000
#: ASCII marks that are no letters, stripped before a stretch is looked up.
MARKS = ".,;:!?|&$%#*()[]<>\"'-"


def words_of(token: str) -> list[str]:
    """The letter runs of a stretch without spaces, lowered."""
    lowered = token.lower() if token.isascii() else unicodedata.normalize("NFC", token).lower()
    return [lowered] if lowered.isalpha() else LETTERS.findall(lowered)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public SentencePiece model that are letters, with or without the word-start mark."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p.lower() for p in (model.id_to_piece(i) for i in range(model.get_piece_size()))}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha())


class Lookup:
    """Finds pieces in words of one length, all at once, by hash in one sorted table for each piece length."""

    def __init__(self, pieces: Sequence[str]):
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_size[len(piece)].append(i)
        self.longest = max(by_size, default=0)
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(self.longest)]
        self.tables = {}
        for size, ids in by_size.items():
            codes = _codes([pieces[i] for i in ids], size)
            keys = np.zeros(len(ids), np.uint64)
            for k in range(size):
                keys += (codes[:, size - 1 - k] + np.uint64(1)) * self.powers[k]
            order = np.argsort(keys)
            self.tables[size] = keys[order], np.array(ids, np.int64)[order]

    def hits(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """size -> (word, piece, where each start's hits begin) for marked words of one length; hits come by start."""
        m, found = len(words[0]), {}
        codes = _codes(words, m)
        keys = np.zeros((len(words), m + 1), np.uint64)
        for size in range(1, min(m, self.longest) + 1):
            keys = keys[:, 1:] + (codes[:, : m - size + 1] + np.uint64(1)) * self.powers[size - 1]
            if size not in self.tables:
                continue
            known, ids = self.tables[size]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            starts, rows = np.nonzero((known[at] == keys).T)
            found[size] = rows, ids[at[rows, starts]], np.searchsorted(starts, np.arange(m + 1))
        return found


def _at(hits: tuple[np.ndarray, np.ndarray, np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    rows, ids, begins = hits
    here = slice(begins[start], begins[start + 1])
    return rows[here], ids[here]


def in_groups(words: Sequence[str]) -> Iterator[list[int]]:
    """Places of words of one length, at most ``CELLS`` letters or one word in a group."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for n, places in by_length.items():
        step = max(1, CELLS // (n + 1))
        for at in range(0, len(places), step):
            yield places[at : at + step]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: piece -> one probability per language
    pieces: dict[str, tuple[float, ...]]


def forward(word: str, pieces: dict[str, float]) -> list[float]:
    """alpha[i]: the summed probability of all segmentations of the first i characters of the marked word, by its definition."""
    marked = START + word
    alpha = [1.0] + [0.0] * len(marked)
    for end in range(1, len(marked) + 1):
        alpha[end] = alpha[end - 1] * FLOOR + sum(alpha[start] * pieces.get(marked[start:end], 0.0) for start in range(end))
    return alpha


def expected_counts(words: list[str], counts: np.ndarray, lookup: Lookup, p: np.ndarray | None, n_pieces: int) -> np.ndarray:
    """How often each piece is used in the words, over all segmentations by their probability under ``p``; without ``p``, how often it occurs.

    Sums are kept as logarithms, so a long word does not vanish.
    """
    total = np.zeros(n_pieces)
    for places in in_groups(words):
        marked = [START + words[i] for i in places]
        n, m, found = counts[places], len(marked[0]), lookup.hits(marked)
        if p is None:
            for rows, ids, _ in found.values():
                total += np.bincount(ids, n[rows], n_pieces)
            continue
        ahead, behind = np.zeros((m + 1, len(n))), np.zeros((m + 1, len(n)))
        for end in range(1, m + 1):
            ratio = np.full(len(n), FLOOR)
            for size, hits in found.items():
                if size <= end:
                    rows, ids = _at(hits, end - size)
                    ratio[rows] += np.exp(ahead[end - size, rows] - ahead[end - 1, rows]) * p[ids]
            ahead[end] = ahead[end - 1] + np.log(ratio)
        for start in range(m - 1, -1, -1):
            ratio = np.full(len(n), FLOOR)
            for size, hits in found.items():
                if start + size <= m:
                    rows, ids = _at(hits, start)
                    ratio[rows] += np.exp(behind[start + size, rows] - behind[start + 1, rows]) * p[ids]
            behind[start] = behind[start + 1] + np.log(ratio)
        for size, (rows, ids, begins) in found.items():
            starts = np.repeat(np.arange(m), np.diff(begins))
            share = np.exp(ahead[starts, rows] + behind[starts + size, rows] - ahead[m, rows]) * p[ids]
            total += np.bincount(ids, n[rows] * share, n_pieces)
    return total


def probabilities(counts: np.ndarray) -> np.ndarray:
    return (counts + ADDED) / (counts.sum() + ADDED * len(counts))


def _expect(pieces: list[str], fitted):
    """Sums of expected counts over a task's words; ``fitted``: a broadcast of each language's probabilities, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, sums, held = Lookup(pieces), {}, defaultdict(list)

        def add(one: str) -> None:
            words, counts = zip(*held.pop(one), strict=True)
            p = None if fitted is None else fitted.value[one]
            got = expected_counts(list(words), np.array(counts, float), lookup, p, len(pieces))
            sums[one] = sums[one] + got if one in sums else got

        for batch in batches:
            for one, *counted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[one].append(counted)
                if len(held[one]) >= TOGETHER:
                    add(one)
        for one in list(held):
            add(one)
        for one, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(total[used])], ["lang", "piece", "n"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for t in text.split() for w in words_of(t))
    keys = sorted(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from ``rows`` documents at most: those with the lowest MD5 of the id. Only their ids, so many at most, are broadcast."""
    taught = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)
    chosen = docs.where(taught).select(id_col).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(rows).distinct()
    sample = docs.where(taught).select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("lang", "text")
    counted = written(sample.mapInArrow(tidy(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pieces = vocabulary(path)
    fitted: dict[str, np.ndarray] = {}
    used: set[int] = set()
    for step in range(ROUNDS + 1):  # the first guess: every piece by its occurrences
        shared = None if step == 0 else docs.sparkSession.sparkContext.broadcast(fitted)  # a number per piece and language
        summed = counted.mapInArrow(tidy(_expect(pieces, shared)), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(pieces)))
        for r in summed:
            sums[r["lang"]][r["piece"]] = r["n"]
        fitted = {lang: probabilities(c) for lang, c in sums.items()}
        used |= {r["piece"] for r in summed}
    languages = tuple(sorted(fitted))
    # pieces that no language has seen are left out: the characters' floor stands for them
    return Model(languages, {pieces[i]: tuple(float(fitted[lang][i]) for lang in languages) for i in sorted(used)})


class Scorer:
    """Log-likelihoods of texts in every language; what is kept for reuse has a bound.

    The words of a batch that are not known yet are scored together: one forward sweep over all words of one length.
    """

    def __init__(self, model: Model):
        self.model, self.row, self.used, self.chars = model, {}, 0, 0
        self.known = np.zeros((CACHE, len(model.languages)))
        self.lookup = Lookup(list(model.pieces))
        self.table = np.array(list(model.pieces.values()), float).reshape(len(model.pieces), len(model.languages))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of distinct words, a row each."""
        out = np.zeros((len(words), len(self.model.languages)))
        for places in in_groups(words):
            marked = [START + words[i] for i in places]
            m, found = len(marked[0]), self.lookup.hits(marked)
            alpha, scale = [np.ones((len(places), out.shape[1]))], np.zeros((len(places), out.shape[1]))
            for end in range(1, m + 1):
                total = alpha[-1] * FLOOR
                for size, hits in found.items():
                    if size <= end:
                        rows, ids = _at(hits, end - size)
                        if len(rows):
                            total[rows] += alpha[-size][rows] * self.table[ids]
                alpha = [*alpha[-self.lookup.longest + 1 :], total] if self.lookup.longest > 1 else [total]
                if end % 8 == 0:  # sums of long words would vanish
                    scale += np.log(total)
                    alpha = [a / total for a in alpha]
            out[places] = np.log(alpha[-1]) + scale
        return out

    def learn(self, tokens: list[str]) -> None:
        """Scores the stretches without spaces that are not known; marks at their ends change nothing."""
        inner = {t: t.strip(MARKS) for t in tokens}
        fresh = [t for t in dict.fromkeys(inner.values()) if t not in self.row]
        parts = [words_of(t) for t in fresh]
        distinct = list(dict.fromkeys(w for p in parts for w in p))
        at = {w: i for i, w in enumerate(distinct)}
        logs = self.words(distinct)
        for token, words in zip(fresh, parts, strict=True):
            self.known[self.used] = logs[[at[w] for w in words]].sum(axis=0) if len(words) != 1 else logs[at[words[0]]]
            self.row[token] = self.used
            self.used += 1
            self.chars += len(token)
        for token, t in inner.items():
            self.row[token] = self.row[t]

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log-probabilities of each text, or None for one without a letter."""
        out: list[np.ndarray | None] = []
        for text in texts:
            if not text or not self.model.languages or not LETTERS.search(text):
                out.append(None)
                continue
            total, tokens = np.zeros(len(self.model.languages)), text.split()
            for i in range(0, len(tokens), STRETCH):
                total += self.known[self._rows(tokens[i : i + STRETCH])].sum(axis=0)
            out.append(total)
        return out

    def _rows(self, tokens: list[str]) -> list[int]:
        """Where the scores of the stretches are; those that are not known are learned first."""
        try:
            return list(map(self.row.__getitem__, tokens))
        except KeyError:
            self._known(set(tokens))
            return list(map(self.row.__getitem__, tokens))

    def _known(self, tokens: set[str]) -> None:
        missing = [t for t in tokens if t not in self.row]
        if missing:
            if self.used + 2 * len(missing) > CACHE or len(self.row) + 2 * len(missing) > 2 * CACHE or self.chars > CACHE_CHARS:
                self.row.clear()
                self.used = self.chars = 0
                missing = list(tokens)
            self.learn(sorted(missing))

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The prediction for each text; unknown words of many texts are learned together."""
        found: list[tuple[str, float]] = []
        group: list[str | None] = []
        size = 0
        for text in [*texts, None]:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS or len(found) + len(group) > len(texts):
                pool = set().union(*[x.split() for x in group if x and len(x) < GROUP_CHARS]) if self.model.languages else set()
                if len(pool) <= CACHE // 3:
                    self._known(pool)
                found += map(self.predict_from, self.texts(group))
                group, size = [], 0
        return found[: len(texts)]

    def predict_from(self, logs: np.ndarray | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood; the first in order of name of equal ones."""
        if logs is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(logs))
        return self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.batch([text])[0]


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most one row of numbers per piece of the vocabulary

    def make():
        scorer = Scorer(shared.value)

        def apply(texts):
            rows = scorer.batch(texts)
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return apply

    return append_columns(df, text_col, FIELDS, make)
