"""BPE encoding and decoding by a contiguous rank array, with the vocabulary of a public tokenizer file.

A file of the ``tokenizers`` library with a BPE model and word-end suffixes is read at run time (its path is a parameter); the
merges run here. A word holds its part boundaries and the rank of each adjacent pair in two short lists. The lowest rank is
found by a scan, the boundary between the two parts is deleted, and the ranks on both sides are refreshed. Scans cost the square
of a word's length, so words of more than ``LONG_WORD`` parts, which scans would make slow, keep the same two lists linked and
take the lowest rank from a heap; ties go to the left in both, so the results agree.

Encoding equals ``Tokenizer.encode(text, add_special_tokens=False)`` without truncation or padding (but for letters assigned so
recently that the two Unicode tables differ): special tokens are cut from
the raw text, the rest is NFC-normalised, white space runs are folded, letters are lowered one by one, and words are split and
mapped to byte symbols. A null text is encoded as an empty one; no text is cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import append_columns

LONG_WORD = 48
#: Chunks whose encodings a task keeps; the store is emptied when full, so a task's memory has a bound.
CACHE = 150_000
NONE = 1 << 60
#: A private code point, which is neither letter, number nor space.
OPEN = "\ue000"
#: Control characters that Python's str.split() takes for white space and Unicode's White_Space does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left symbol, right symbol) -> (rank, merged symbol)
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\t-\r \x85\xa0  -     　"))
        self.symbols = byte_symbols()
        self.id_text: dict[int, str] = {i: str(i) for i in self.token_of}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.word_cache: dict[str, tuple[int, ...]] = {}

    # -- one word -------------------------------------------------------------------------------------------------------
    def merge(self, parts: list[str]) -> list[str]:
        """The parts that remain when no adjacent pair has a rank."""
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[str]) -> list[str]:
        get = self.ranks.get
        ranks = [get(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            at = ranks.index(low)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NONE)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        right, left, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := get(pair, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            if j < 0 or get((parts[i], parts[j]), NONE) != rank:
                continue  # a pair that is gone
            parts[i] += parts[j]
            live[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (r := get((parts[a], parts[right[a]]), NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p, alive in zip(parts, live, strict=True) if alive]

    def word(self, word: str) -> list[int]:
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        vocab = self.vocab
        return [vocab[p] for p in self.merge(parts) if p in vocab]

    # -- texts ----------------------------------------------------------------------------------------------------------
    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch without white space; words never reach across white space."""
        lowered = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        known, ids = self.word_cache, []
        for w in self._split(lowered):
            got = known.get(w)
            if got is None:
                got = tuple(self.word(w))
                if len(w) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = got
            ids += got
        return tuple(ids)

    def _split(self, lowered: str) -> list[str]:
        """The words. Code points that Python's Unicode table leaves open count as marks, whatever the newer table of the pattern's library says."""
        if lowered.isascii() or not any(unicodedata.category(c) == "Cn" for c in lowered):
            return self.words.findall(lowered)
        masked = "".join(OPEN if unicodedata.category(c) == "Cn" else c for c in lowered)
        return [lowered[m.start() : m.end()] for m in self.words.finditer(masked)]

    def _plain(self, text: str, ids: list[int]) -> None:
        cache = self.cache
        for c in SPACE.split(text) if ODD_SPACE.search(text) else text.split():
            got = cache.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[c] = got
            ids += got

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                self._plain(text[at : m.start()], ids)
                ids.append(self.specials[m.group()])
                at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def forget(self) -> None:
        self.cache.clear()
        self.word_cache.clear()

    def decode(self, ids: Iterable[int]) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of a file that names no decoder: the tokens, one space between; unknown ids give nothing."""
        tokens = self.token_of
        return " ".join([tokens[i] for i in ids if i in tokens])


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """The vocabulary, read once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def vocabulary_path() -> str:
    """Where the public vocabulary lies on this machine; asked on each executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_texts(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``ids`` (array of int) and ``n_tokens``. Null and empty texts: no ids."""

    def make():
        bpe = loaded(path or vocabulary_path())

        def apply(texts):
            ids = [bpe.encode(t) for t in texts]
            return [ids, [len(i) for i in ids]]

        apply.close = bpe.forget
        return apply

    return append_columns(df, text_col, ENCODED, make)


def decode_ids(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``decoded``. Null ids: empty text."""

    def make():
        bpe = loaded(path or vocabulary_path())
        return lambda rows: [[bpe.decode(r or ()) for r in rows]]

    return append_columns(df, ids_col, T.StructType([T.StructField("decoded", T.StringType())]), make)


def encode_and_check(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``ids``, ``n_tokens`` and ``decoded_sha256``, the digest of what the ids decode to."""
    fields = T.StructType([*ENCODED, T.StructField("decoded_sha256", T.StringType())])

    def make():
        bpe = loaded(path or vocabulary_path())

        def apply(texts):
            ids = [bpe.encode(t) for t in texts]
            return [ids, [len(i) for i in ids], [hashlib.sha256(bpe.decode(i).encode("utf-8")).hexdigest() for i in ids]]

        apply.close = bpe.forget
        return apply

    return append_columns(df, text_col, fields, make)


def round_trip_digests(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encoded, decoded and hashed in one pass, no ids kept."""

    def make():
        bpe = loaded(path or vocabulary_path())
        sha, number = hashlib.sha256, bpe.id_text

        def apply(texts):
            counts, ids_sha, decoded_sha = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                counts.append(len(ids))
                ids_sha.append(sha(" ".join([number[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            return [counts, ids_sha, decoded_sha]

        apply.close = bpe.forget
        return apply

    return append_columns(df, text_col, DIGESTS, make)
