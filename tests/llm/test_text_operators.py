"""Quality, BPE, language, media, toxicity: against plain Python, exact round trips and held-out accuracy."""

import hashlib
import io
import math
import random
import tarfile
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tests.llm.fixtures import WORDS, empty, prose, table, texts
from tidelog.llm import bpe, langid, media, quality, toxicity
from tidelog.llm.sampling import labelled_sample


# -- quality --------------------------------------------------------------------------------------------------------------
def counts_by_hand(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    got = quality.quality_report(table(spark)).select("doc_id", "text", *quality.COUNTS, "base_failed", "kept").collect()
    assert len(got) == len(texts())
    for r in got:
        want = counts_by_hand(r["text"])
        have = tuple(r[c] for c in quality.COUNTS)
        assert have == want
        assert r["base_failed"] == (have[0] < 20 or 100 * have[4] > 30 * have[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_repeats_and_order():
    m = quality.Measures("a b c d e f g h i " * 2)
    assert m.n_repeat_words == 18 and quality.Measures("a b c d e f g h").n_repeat_words == 0
    sample = [prose(i, 100) for i in range(20)] + ["short"] * 5 + ["LOUD!! " * 60] * 5
    orders = [quality.cascade_order(sample), list(quality.RULES), list(reversed(quality.RULES))]
    assert sorted(r.name for r in orders[0]) == sorted(r.name for r in quality.RULES)
    assert len({tuple(quality.passes(quality.Measures(t), o) for t in sample) for o in orders}) == 1
    assert quality.cascade_order([]) == list(quality.RULES)


def test_quality_keeps_clean_and_empty_table(spark):
    rows = [(1, prose(9, 400)), (2, "### " * 200), (3, "WORD!! " * 100), (4, " ".join(w for w in WORDS for _ in range(7)))]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_filter(table(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert quality.quality_report(empty(spark)).count() == 0


# -- BPE ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, library):
    rng = random.Random(5)
    odd = ["<|startoftext|>Hi it's ΣΑΣ İ<|endoftext|>x<|endoftext|>", "a\x1cb\x85c d​é é ﬁ 12³½ don't I'LL 'S", "".join(c for c in map(chr, (rng.randrange(32, 0x2FFF) for _ in range(3000))) if unicodedata.category(c) != "Cn"), "q" * 5000]
    rows = [*texts(), *[(100 + k, t) for k, t in enumerate(odd)]]
    got = bpe.round_trip_digests(table(spark, rows)).select("text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_short_and_long_merges_agree():
    b = bpe.loaded(bpe.vocabulary_path())
    rng = random.Random(1)
    for _ in range(300):
        parts = [rng.choice("abtheinr") for _ in range(rng.randrange(1, 60))]
        assert b._merge_short(list(parts)) == b._merge_long(list(parts))


def test_bpe_columns(spark):
    rows = bpe.decode_ids(bpe.encode_texts(table(spark, [(1, "Hello there"), (2, None)]))).collect()
    assert rows[0]["decoded"] == "hello</w> there</w>" and rows[0]["n_tokens"] == 2 and rows[1]["ids"] == [] and rows[1]["source"] == "s1"
    assert bpe.encode_texts(empty(spark)).count() == 0
    checked = bpe.encode_and_check(table(spark, [(1, "Hello there")])).first()
    assert checked["decoded_sha256"] == hashlib.sha256(b"hello</w> there</w>").hexdigest()


# -- language -------------------------------------------------------------------------------------------------------------
def speech(lang: str, seed: int) -> str:
    words = {"en": "the of and that with from this have which would people about", "de": "der und das nicht mit auch werden einer haben oder durch", "fr": "les des une dans pour avec est qui sur pas nous"}[lang].split()
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(40))


def test_language_held_out_accuracy(spark):
    langs = ("en", "de", "fr")
    rows = [(i, speech(langs[i % 3], i), langs[i % 3]) for i in range(120)] + [(500, None, "en"), (501, "12 34", "en"), (502, "text", None), (None, "und der", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("de", "en", "fr")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == langs[i % 3] and 0.5 < got[i]["score"] <= 1 for i in range(120))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0


def test_language_forward_sums_all_segmentations():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.3, "▁a": 0.15, "ab": 0.25}

    def every_cut(s):
        if not s:
            return 1.0
        single = s[0] not in pieces
        return sum(pieces[s[:n]] * every_cut(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces) + (langid.FLOOR * every_cut(s[1:]) if single else langid.FLOOR * every_cut(s[1:]))

    assert langid.forward("abab", pieces)[-1] == pytest.approx(every_cut("▁abab"), rel=1e-9)
    scorer = langid.Scorer(langid.Model(("x",), {p: (q,) for p, q in pieces.items()}))
    import math

    assert scorer.words(["abab", "b"])[0][0] == pytest.approx(math.log(langid.forward("abab", pieces)[-1]))


def test_language_fit_sums_over_all_cuts():
    """One step of expectation-maximisation against every segmentation of every word."""
    import itertools

    pieces = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a", "▁abcab"]
    words, counts = ["abc", "cab", "abcabc", "b", "bbbb", "abcab"], np.array([3.0, 1, 2, 5, 1, 4])
    lookup = langid.Lookup(pieces)
    p = langid.probabilities(langid.expected_counts(words, counts, lookup, None, len(pieces)))
    prob, want, occurs = dict(zip(pieces, p, strict=True)), np.zeros(len(pieces)), np.zeros(len(pieces))
    for word, n in zip(words, counts, strict=True):
        marked = "▁" + word
        cuts = []
        for k in range(len(marked)):
            for ends in itertools.combinations(range(1, len(marked)), k):
                at = (0, *ends, len(marked))
                parts = [marked[i:j] for i, j in itertools.pairwise(at)]
                # a single character may stand as a piece or at the floor
                for floor in itertools.product(*[(False, True) if len(x) == 1 else (False,) for x in parts]):
                    weight = np.prod([langid.FLOOR if f else prob.get(x, 0.0) for x, f in zip(parts, floor, strict=True)])
                    if weight:
                        cuts.append((weight, [x for x, f in zip(parts, floor, strict=True) if not f]))
        total = sum(w for w, _ in cuts)
        assert langid.forward(word, prob)[-1] == pytest.approx(total)
        for w, used in cuts:
            for x in used:
                want[pieces.index(x)] += n * w / total
        for i, x in enumerate(pieces):
            occurs[i] += n * sum(marked.startswith(x, k) for k in range(len(marked)))
    assert langid.expected_counts(words, counts, lookup, None, len(pieces)) == pytest.approx(occurs)
    assert langid.expected_counts(words, counts, lookup, p, len(pieces)) == pytest.approx(want)


def test_language_long_words_and_long_pieces():
    rng = random.Random(3)
    model = langid.Model(("x", "y"), {"▁": (0.1, 0.1), "a": (0.2, 0.1), "b": (0.1, 0.2), "abababababab": (0.01, 1e-5), "abab": (0.05, 0.04)})
    scorer = langid.Scorer(model)
    words = ["ab" * n for n in (1, 5, 6, 7, 30)] + ["".join(rng.choice("ab") for _ in range(n)) for n in (20, 47, 48, 49, 300)] + ["ü" * 12]
    for word, got in zip(words, scorer.words(words), strict=True):
        for i in range(2):
            assert got[i] == pytest.approx(np.log(langid.forward(word, {p: q[i] for p, q in model.pieces.items()})[-1]), rel=1e-9)
    long = ["a" * 5000, "b" * 5000, "zq" * 4000]
    logs = scorer.words(long)
    assert np.isfinite(logs).all() and logs[0][0] > logs[0][1] and logs[1][1] > logs[1][0]
    assert scorer.predict("a" * 5000)[0] == "x" and scorer.predict("b" * 5000 + " a")[0] == "y"
    assert any(len(p) > 12 for p in langid.vocabulary())


def test_language_store_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 300)
    model = langid.Model(("x", "y"), {"a": (0.1, 0.2), "b": (0.2, 0.1)})
    small = langid.Scorer(model)
    rows = ["".join(random.Random(i).choice("ab") for _ in range(9)) for i in range(2000)]
    text = " ".join(rows[:80])
    monkeypatch.setattr(langid, "CACHE", 300_000)
    big = langid.Scorer(model)
    monkeypatch.setattr(langid, "CACHE", 300)
    for i in range(0, 2000, 80):
        part = " ".join(rows[i : i + 80])
        assert small.predict(part)[0] == big.predict(part)[0]
    assert small.predict(text) == big.predict(text)


def test_language_empty_table(spark):
    model = langid.fit(empty(spark).select("doc_id", "text", "lang"))
    assert model.languages == () and langid.predict(table(spark), model).where("lang_pred <> 'und'").count() == 0


# -- media ----------------------------------------------------------------------------------------------------------------
def test_media_round_trip(spark):
    df = table(spark)
    index = media.write_shards(df)
    rows = media.read_features(media.read_headers(index)).join(df.select(F.col("n_tokens").alias("k"), "doc_id", "text"), "doc_id").collect()
    by_text = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        if r["n_bytes"] != len(raw):
            continue  # repeated ids meet other texts in this join
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["width"] * r["height"] == len(payload) and r["sample_bits"] == 8
        by_text.setdefault(raw, set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert len(by_text) == 14 and all(len(v) == 1 for v in by_text.values())


def test_media_shards_are_tar_files_of_distinct_images(spark):
    index = media.write_shards(table(spark, [(i, "same text" if i < 5 else f"text {i}") for i in range(8)]).coalesce(1)).collect()
    files, folder = fs.FileSystem.from_uri(index[0]["folder"])
    with files.open_input_stream(f"{folder}/{index[0]['shard']}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        names = tar.getnames()
    assert sorted(names) == sorted({f"{r['media_sha256']}.png" for r in index}) and len(names) == 4
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)
    assert media.write_shards(empty(spark)).count() == 0


# -- toxicity -------------------------------------------------------------------------------------------------------------
def corpus(n=400):
    rows = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = prose(i, 60).split()
        if toxic:
            words[10:10] = [["grubbler", "grubblerish", "snorkface"][i % 3]]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out_and_disguises(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", 1000))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(x) for i, _, x in rows)
    hidden = spark.createDataFrame([(1, "what a gruбblеr he is"), (2, "such a 5n0rkf4ce there"), (3, None), (4, ""), (5, prose(999, 50))], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(hidden, model).collect()}
    assert scores[1] >= 0.5 and scores[2] >= 0.5 and max(scores[3], scores[4], scores[5]) < 0.5


def test_toxicity_exceptions_and_word_starts():
    m = toxicity.Matcher([("tras+", 3.0), ("trash$", 3.0)], ["trash can"])
    assert m.features("put it in the trash can") == (0.0, 0.0)
    assert m.features("you trash")[0] > 0 and m.features("catrash")[0] == 0
    assert m.features("trash " * 3 + "word " * 900)[1] < m.features("trash " * 3)[1]
    assert toxicity.Matcher([], []).features("anything") == (0.0, 0.0)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(labelled_sample(table(spark), labels, "toxic", 10))
    assert toxicity.score(table(spark), model).where("score >= 0.5").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0


def test_scores_of_equal_texts_and_clashing_columns(spark):
    """Ties and repeated rows score alike, a column of the score's name is replaced, and other columns stay."""
    rows = [(i, ("you idiot " if i % 3 == 0 else "you friend ") + prose(i, 12)) for i in range(60)]
    sample = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in rows], "text string, label int")
    model = toxicity.fit(sample)
    df = table(spark, [*rows, (900, rows[3][1]), (901, rows[3][1].upper()), (902, None), (903, "")])
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert got[900]["score"] == got[3]["score"] == got[901]["score"] > 0.5 > got[902]["score"] == got[903]["score"]
    assert set(got[3].asDict()) == set(df.columns) and got[3]["spans"] == "x"
    flat = toxicity.fit(sample.where("label = 0"))
    assert flat.terms == () and toxicity.score(df, flat).where("score >= 0.5").count() == 0


def test_lexicon_weights_by_hand(spark):
    """Terms, weights and the choice of starts over whole words, from plain counts of documents; long words are terms too."""
    long = "unspeakably" * 4
    rows = [(f"{prose(i, 8)} {long} damnable{'' if i % 2 else 'd'}", 1) for i in range(12)] + [(prose(100 + i, 8) + (" damn" if i < 2 else ""), 0) for i in range(40)]
    model = dict(toxicity.fit(spark.createDataFrame(rows, "text string, label int")).terms)
    held = {w: [sum(w in toxicity.stems(t) for t, y in rows if y == label) for label in (1, 0)] for t, _ in rows for w in toxicity.stems(t)}
    for term, weight in model.items():
        toxic, clean = held[term]
        ratio = (toxic + 0.5) / 13 / ((clean + 0.5) / 41)
        assert toxic >= toxicity.MIN_TOXIC and ratio >= toxicity.MIN_RATIO and weight == pytest.approx(math.log(ratio))
    for w, (toxic, clean) in held.items():
        likely = toxic >= toxicity.MIN_TOXIC and (toxic + 0.5) / 13 / ((clean + 0.5) / 41) >= toxicity.MIN_RATIO
        covered = any(w[:n] + "+" in model for n in toxicity.LENGTHS if n < len(w) - 1)
        assert (w in model) == (likely and not covered)
    assert "damn$" not in model and long[:4] + "+" in model
