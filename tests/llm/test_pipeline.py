"""Each stage of the pipeline against plain Python, over a table with odd rows and columns of clashing names."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import prose, table, texts
from tests.llm.test_corpus_operators import base_by_hand, components_by_hand
from tidelog.llm import mixing, toxicity
from tidelog.llm.sampling import labelled_sample

STAGE = dict(corpus_pipeline.STAGES)


def rows():
    out = [r for r in texts() if r[1] is None or len(r[1]) < 25_000]
    out += [(1000 + i, prose(i, 40) + (" you idiot moron" if i % 4 == 0 else "")) for i in range(160)]
    out += [(1000 + i, prose(i, 40) + " extra") for i in (1, 2)]  # ids that have another text too
    near = prose(1, 40).split()
    out += [(1200 + i, " ".join([*near[:-1], f"end{i}"])) for i in range(5)]
    out += [(1300 + i, f"call +44 20 7946 09{i:02d} or write to a{i}@b{i}.example from 10.0.{i}.1 " + prose(900 + i, 30)) for i in range(10)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    df = table(spark, rows())
    df.selectExpr("*", "cast(length(text) as bigint) AS n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, i % 2, int(i % 4 == 0)) for i in range(160)] + [(1000, 0, None), (None, 0, 1), (5, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_toxicity_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", toxicity.SAMPLE_ROWS))
    matcher, (a, b, c) = toxicity.Matcher(model.terms, model.exceptions), model.curve

    def score(text):
        x, y = matcher.features(text)
        return 1 / (1 + math.exp(-(a * x + b * y + c)))

    kept = STAGE["toxicity"](spark, docs, folder)
    want = Counter(tuple(r) for r in docs.collect() if score(r["text"]) < 0.5)
    assert kept.columns == docs.columns and counted(kept) == want
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not any(ids[1000 + i] for i in range(0, 160, 4)) and all(ids[1000 + i] for i in range(160) if i % 4)
    assert ids[5] == ids[6] == 1 and ids[None] == 2


def test_near_duplicate_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = STAGE["near_duplicates"](spark, docs, folder)
    first = {(i, n): i == c for i, n, c in components_by_hand(given, 85)}
    size = {k: n for k, (_, n, _) in enumerate(components_by_hand(given, 85))}
    want = Counter(tuple(r) for k, r in enumerate(docs.collect()) if r["doc_id"] is None or first[(r["doc_id"], size[k])])
    assert kept.columns == docs.columns and counted(kept) == want
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and 2 not in ids and len(ids & {1001, *range(1200, 1205)}) == 1


def test_personal_data_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = STAGE["personal_data"](spark, docs, folder)
    assert clean.columns == docs.columns
    text_at, n_at = docs.columns.index("text"), docs.columns.index("n_chars")
    marks = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
    want = Counter()
    for r in map(tuple, docs.collect()):
        text, at, out = r[text_at], 0, ""
        for start, kind, end in base_by_hand(text):
            if start >= at:
                out += text[at:start] + marks[kind]
            at = max(at, end)
        text = None if text is None else out + text[at:]
        want[(*r[:text_at], text, *r[text_at + 1 : n_at], None if text is None else len(text), *r[n_at + 1 :])] += 1
    assert counted(clean) == want  # no term stands with one entity in three documents here
    assert not any(re.search(r"@b|7946", r["text"] or "") for r in clean.collect())


def test_mixing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = STAGE["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, times = Counter(), Counter(), counted(mixed)
    for r, n in counted(docs).items():
        row = dict(zip(docs.columns, r, strict=True))
        size[row["source"]] += n * words(row["text"])
        taken[row["source"]] += times[r] * words(row["text"])
        assert times[r] in (0, n, 2 * n, 3 * n)
    target = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    longest = max(words(t) for _, t in rows())
    assert set(times) <= set(counted(docs)) and all(abs(taken[s] - target[s]) <= longest for s in target)


def test_bpe_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encoded = STAGE["bpe"](spark, docs, folder)
    assert encoded.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], r["source"], len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in encoded.collect()) == want


def test_empty_table_goes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows_of = lambda df: Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in df.collect())
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(docs)
