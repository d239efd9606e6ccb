"""Exact removal of repeated byte strings, and detection of shared passages, by sorted suffixes.

Every 400-byte string that starts at two places, in one document or two, is found, and each byte under such a string is removed.
Passages are found by the same steps over words instead of bytes (``PASSAGES``): a text is then the row of its words' 64-bit hashes,
and a string of 51 words counts where another document holds it too. Sorting a suffix for every byte would shuffle hundreds of
times the input, so suffixes are taken where repeats can be seen:

1. A string's anchor is the leftmost least hash among the short grams at its first ``span`` places. Equal strings have
   equal anchors at equal distances, so it is enough to compare suffixes that start at anchors, with what stands before them. One anchor
   serves a run of starts; its context is all that these strings cover, its core what all of them share.
2. Cores that occur once are dropped. Where a whole context occurs twice, all of it is repeated: it is compared by the hashes of core
   and context, 128 bits together, and counted.
3. Contexts that share a core but differ go on as text, once per distinct context: sampled splitters range-partition them by the
   core, and each bucket sorts its suffixes by multikey quicksort, word by word, all parts of a depth
   at once; the same for what stands before the anchors, reversed. Neighbours' common lengths in both orders say for each distance which
   strings are equal. Equal cores are never cut by a splitter, so no comparison across bucket ends is left over; a task holds
   ``SORTED_ROWS`` contexts and the rest of one core at a time.
4. A core with more than ``HOT`` distinct contexts would fill one bucket. Its contexts are cut into pieces by distance from the anchor and
   compared by 128-bit hashes: a piece that occurs twice is repeated as a whole and goes on once; what all strings at its distances share
   goes on only if it occurs twice, in pieces a quarter as wide, down to single strings. The rule is exact as well, and spreads by piece.

Defined cases: null and empty texts keep nothing and lose nothing; equal rows are copies of each other; for passages, rows of one
id and one text are one document; extra columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scope, slices, tidy, word_hashes, written


@dataclass(frozen=True)
class Scheme:
    """What a string is: ``length`` units of ``unit`` bytes, with its anchor at one of the first ``span`` places, the least gram of
    ``gram`` units. ``across``: whether only another document's string counts. ``widths``: starts in a piece of a hot context, level by level."""

    unit: int
    length: int
    span: int
    gram: int
    across: bool
    widths: tuple[int, ...]

    @property
    def size(self) -> int:
        """Bytes of a string."""
        return self.length * self.unit

    @property
    def core(self) -> int:
        """Bytes that all strings of one anchor share, from the anchor on."""
        return (self.length - self.span + 1) * self.unit

    def units(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8")
        return raw if self.unit == 1 else b"".join(map(xxhash.xxh3_64_digest, raw.split()))


BYTES = Scheme(1, 400, 256, 16, False, (64, 16, 4, 1))
PASSAGES = Scheme(8, 51, 40, 8, True, (16, 4, 1))
LENGTH = BYTES.length
HOT = 2_000
#: Distinct contexts a bucket is meant to hold, and those that are sorted at once.
BUCKET_ROWS, SORTED_ROWS = 20_000, 8_192
#: Windows handled at once; fewer than the positions that the low bits of a key hold.
STRETCH, PLACE = 1 << 18, np.uint64((1 << 20) - 1)


def word_gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` words at each place."""
    n = len(words) - gram + 1
    h = np.full(n, 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each place."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    with np.errstate(over="ignore"):
        a = (x * np.uint64(0x9E3779B97F4A7C15))[: len(data) - BYTES.gram + 1]
        b = (x * np.uint64(0xC2B2AE3D27D4EB4F))[8:]
        h = a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima of blocks."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, scheme: Scheme = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of string starts with one anchor, in units."""
    starts = len(data) // scheme.unit - scheme.length + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(np.frombuffer(data, np.uint8)) if scheme.unit == 1 else word_gram_hashes(np.frombuffer(data, ">u8").astype(np.uint64), scheme.gram)
    places = []
    for at in range(0, starts, STRETCH):
        n = min(STRETCH, starts - at)
        part = h[at : at + n + scheme.span - 1]
        key = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64)
        places.append((window_minima(key, scheme.span) & PLACE).astype(np.int64) + at)
    place = np.concatenate(places)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:] - 1, starts - 1]


ANCHORS = "core long, ctx long, start int, before int, size int"


def _scan(scheme: Scheme):
    """A row per anchor: hashes of core and context, and in bytes the context's start, what stands before the anchor, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, unit = xxhash.xxh3_64_intdigest, scheme.unit
        for batch in slices(batches, 2):
            rows, cores, contexts, starts, before, sizes = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = scheme.units(text)
                place, low, high = (x * unit for x in anchors(data, scheme))
                for a, lo, hi in zip(place.tolist(), low.tolist(), high.tolist(), strict=True):
                    cores.append(digest(data[a : a + scheme.core]))
                    contexts.append(digest(data[lo : hi + scheme.size], a - lo + 1))
                rows += [i] * len(place)
                starts.append(low)
                before.append(place - low)
                sizes.append(high + scheme.size - low)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            joined = lambda v: pa.array(np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32))
            who = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), signed(cores), signed(contexts), joined(starts), joined(before), joined(sizes)], ["id", "th", *(c.split()[0] for c in ANCHORS.split(", "))])

    return run


def sorted_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, and the common length of each with the one before (-1 for the first).

    Multikey quicksort by words of eight bytes. Rows that agree so far form a part; all parts of one depth are split together by
    their next word, and parts of one row are done.
    """
    n, words = len(rows), rows.view(">u8").astype(np.uint64)
    order, common = np.arange(n), np.full(n, rows.shape[1], np.int64)
    common[:1] = -1
    active, part = np.arange(n), np.zeros(n, np.int64)  # places in the order that are still in parts of two rows or more
    for depth in range(words.shape[1]):
        if not len(active):
            break
        word = words[order[active], depth]
        local = np.lexsort((word, part))
        order[active], word = order[active][local], word[local]
        same_part = part[1:] == part[:-1]
        differs = word[1:] != word[:-1]
        cut = np.flatnonzero(same_part & differs)
        if len(cut):
            apart = word[cut + 1] ^ word[cut]
            shared = np.zeros(len(cut), np.int64)
            for byte in range(1, 8):
                shared += (apart >> np.uint64(64 - 8 * byte)) == 0
            common[active[cut + 1]] = 8 * depth + shared
        begins = np.r_[True, ~same_part | differs]
        part = np.cumsum(begins) - 1
        alive = np.bincount(part)[part] > 1
        active, part = active[alive], part[alive]
    return order, common


def _first_apart(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal for rows that agree on their first ``depth`` bytes."""
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(common < depth)
    return of


def repeated_starts(contexts: list[bytes], before: np.ndarray, who: np.ndarray, scheme: Scheme = BYTES) -> np.ndarray:
    """(row, start within the context) of each string of the contexts that a row of another ``who`` holds at the same distance from its anchor."""
    n, sizes = len(contexts), np.array([len(c) for c in contexts])
    right, left = np.zeros((n, scheme.size), np.uint8), np.zeros((n, scheme.span * scheme.unit), np.uint8)
    for i, (c, b) in enumerate(zip(contexts, before.tolist(), strict=True)):
        data = np.frombuffer(c, np.uint8)
        right[i, : len(c) - b] = data[b:]
        left[i, :b] = data[:b][::-1]
    by_right, by_left = sorted_runs(right), sorted_runs(left)
    nearest = before + scheme.size - sizes  # the least distance from a start to the anchor
    found = []
    for d in range(0, int(before.max(initial=-1)) + 1, scheme.unit):
        rows = np.flatnonzero((nearest <= d) & (d <= before))
        if len(rows) < 2:
            continue
        key = _first_apart(*by_right, scheme.size - d)[rows] * (n + 1) + _first_apart(*by_left, d)[rows]
        order = np.lexsort((who[rows], key))
        key, whose = key[order], who[rows[order]]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[begins[1:], len(key)]
        twice = np.repeat(whose[begins] != whose[ends - 1], ends - begins)
        found.append(np.column_stack([rows[order[twice]], before[rows[order[twice]]] - d]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _spans(row: np.ndarray, start: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(row, from, to) of the runs that strings of ``size`` bytes starting at these places cover."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + size)])
    ends = np.r_[begins[1:] - 1, len(row) - 1]
    return list(zip(row[begins].tolist(), start[begins].tolist(), (start[ends] + size).tolist(), strict=True))


def whole_cores(batches: Iterator[pa.RecordBatch], rows: int = SORTED_ROWS) -> Iterator[pa.Table]:
    """Rows that come in order of ``lead`` in stretches of about ``rows``, cut only where the lead changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        leads = table.column("lead").to_pylist()
        cut = leads.index(leads[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if any(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _whose(table: pa.Table, scheme: Scheme) -> np.ndarray:
    """A number for each row's document; representatives of contexts that several documents hold, and all rows of bytes, stand for themselves."""
    own = -1 - np.arange(len(table))
    if not scheme.across:
        return own
    codes = [table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "th")]
    return np.where(table.column("shared").to_numpy(), own, (codes[0] + 1) * (len(table) + 1) + codes[1] + 1)


def _bucket(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cores(batches):
            before, at = table.column("before").to_numpy(), table.column("start").to_numpy()
            found = repeated_starts(table.column("context").to_pylist(), before.astype(np.int64), _whose(table, scheme), scheme)
            spans = _spans(found[:, 0], found[:, 1], scheme.size)
            who = pa.array([s[0] for s in spans], pa.int64())
            ids = table.select(["id", "th"]).combine_chunks().take(who)
            offset = at[[s[0] for s in spans]].astype(np.int64) if spans else np.zeros(0, np.int64)
            ranges = [pa.array(offset + np.array([s[k] for s in spans], np.int64)) for k in (1, 2)]
            yield from pa.table([ids.column(0), ids.column(1), *ranges], names=["id", "th", "low", "high"]).to_batches()

    return run


PIECE = ("id", "th", "shared", "start", "before", "context")


def _pieces(scheme: Scheme, width: int):
    """A row per piece of a context, cut where the distance to the anchor is a multiple of ``width``; a piece is a smaller context.

    ``i1`` and ``i2`` hash what all strings at a piece's distances share, whosever they are, ``o1`` and ``o2`` all that its own strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, step = xxhash.xxh3_128_digest, scheme.size, width * scheme.unit
        for batch in slices(batches, PIECE.index("context")):
            who, made, inner, outer = [], [], [], []
            for i, (start, before, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in PIECE[3:]), strict=True)):
                nearest = before + size - len(context)  # the least distance from a start to the anchor
                for low in range(nearest - nearest % step, before + 1, step):
                    high = min(low + step, scheme.span * scheme.unit) - scheme.unit
                    far = min(high, before)
                    piece = context[before - far : before - max(low, nearest) + size]
                    who.append(i)
                    made.append((start + before - far, far, piece))
                    inner.append(digest(context[before - low : before - high + size], low + 1))
                    outer.append(digest(piece, far + 1))
            who = pa.array(who, pa.int64())
            columns = list(zip(*made, strict=True)) if made else [[]] * 3
            hashes = [np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)[:, k] for h in (inner, outer) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in PIECE[:3]), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)), *map(pa.array, hashes)], [*PIECE, "i1", "i2", "o1", "o2"])

    return run


def hot_spans(contexts: DataFrame, scheme: Scheme) -> list[DataFrame]:
    """Tables (id, th, low, high) of what repeated strings of these contexts cover; contexts that are ``shared`` are known to be repeated.

    Of pieces that are repeated as a whole one goes on, as ``shared``, because others may hold a part of it.
    """
    kind, document = contexts.schema["id"].dataType.simpleString(), F.xxhash64("id", "th")
    several = F.max("shared") | (F.min(document) != F.max(document)) if scheme.across else F.count("*") > 1
    place = F.coalesce(F.hash("id", "th", "start"), F.lit(0))
    found, rest = [], contexts.select(*PIECE)
    for width in scheme.widths:
        pieces = written(rest.mapInArrow(tidy(_pieces(scheme, width)), f"id {kind}, th long, shared boolean, start int, before int, context binary, i1 long, i2 long, o1 long, o2 long"), "pieces")
        if pieces.isEmpty():
            break
        alike = pieces.groupBy("o1", "o2").agg(several.alias("more"), F.min(place).alias("pick")).where("more")
        told = written(pieces.join(alike, ["o1", "o2"], "left"), "told")
        found.append(told.where("more and not shared").select("id", "th", F.col("start").cast("long").alias("low"), (F.col("start") + F.octet_length("context")).cast("long").alias("high")))
        kept = told.where(F.col("more").isNull() | (place == F.col("pick"))).withColumn("shared", F.col("shared") | F.col("more").isNotNull())
        undecided = kept.groupBy("i1", "i2").agg(several.alias("several"), F.min("shared").alias("known")).where("several and not known")
        rest = kept.join(undecided, ["i1", "i2"], "left_semi").select(*PIECE)
    return found


def _contexts(scheme: Scheme):
    """A row per wanted context, with its core and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            who, made = [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                data = scheme.units(text)
                for w in wanted:
                    who.append(i)
                    at = w["start"] + w["before"]
                    made.append((data[at : at + scheme.core], w["hot"], w["shared"], w["start"], w["before"], data[w["start"] : w["start"] + w["size"]]))
            who = pa.array(who, pa.int64())
            columns = list(zip(*made, strict=True)) if made else [[]] * 6
            kinds = (pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(who), batch.column("th").take(who), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", "th", "lead", "hot", "shared", "start", "before", "context"])

    return run


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the spans, and the number of maximal removed runs."""
    pieces, at, runs = [], 0, 0
    for low, high in sorted(spans):
        if low > at or not runs:
            pieces.append(data[at:low])
            runs += 1
        at = max(at, high)
    pieces.append(data[at:])
    return b"".join(pieces), runs


def covered(spans: list[tuple[int, int]]) -> int:
    """How much the spans cover together."""
    total = at = 0
    for low, high in sorted(spans):
        total += max(0, high - max(low, at))
        at = max(at, high)
    return total


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows, left = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode("utf-8")
            kept, runs = kept_bytes(data, [(s["low"], s["high"]) for s in spans or () if not s["words"]])
            passages = covered([(s["low"], s["high"]) for s in spans or () if s["words"]]) // PASSAGES.unit
            rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), passages))
            left.append(kept)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), pa.array(left, pa.binary())], ["id", *(c.split()[0] for c in RESULT.split(", ")), "kept"])


def repeated_spans(docs: DataFrame, scheme: Scheme = BYTES, hot: int = HOT) -> DataFrame:
    """(id, th, low, high): ranges of ``docs`` (id, th, text), in bytes of the scheme's units, that repeated strings cover; they may overlap.

    Only the table of the ranges is left in the shared folder.
    """
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    where = F.octet_length("text") >= (scheme.length if scheme.unit == 1 else 2 * scheme.length - 1)
    spans = f"id {kind}, th long, low long, high long"
    document = F.xxhash64("id", "th")
    whole_context = ("id", "th", F.col("start").cast("long").alias("low"), (F.col("start") + F.col("size")).cast("long").alias("high"))
    several = F.min(document) != F.max(document) if scheme.across else F.count("*") > 1
    with Scope() as tables:
        seen = written(docs.where(where).mapInArrow(tidy(_scan(scheme)), f"id {kind}, th long, {ANCHORS}"), "anchors")
        cores = seen.groupBy("core").agg(several.alias("twice"), (F.min("ctx") == F.max("ctx")).alias("alike")).where("twice")
        cores = written(cores.select("core", "alike"), "cores")  # a plain join follows, whose large partitions Spark splits
        hits = written(seen.join(cores, "core"), "hits")
        tables.drop(seen, cores)
        whole, mixed = hits.where("alike").select(*whole_context), hits.where("not alike").drop("alike")
        place = F.coalesce(F.hash("id", "th", "start"), F.lit(0))
        contexts = written(mixed.groupBy("core", "ctx").agg(several.alias("shared"), F.count("*").alias("n"), F.min(place).alias("pick")), "classes")
        spread = contexts.groupBy("core").agg((F.sum(F.when(F.col("shared"), 1).otherwise(F.col("n"))) > hot).alias("hot"))
        classes = written(contexts.drop("n").join(spread, "core"), "classes")
        judged = written(mixed.join(classes, ["core", "ctx"]), "judged")
        copies = judged.where("shared").select(*whole_context)
        wanted = judged.where(~F.col("shared") | (place == F.col("pick")))
        asked = wanted.groupBy("id", "th").agg(F.collect_set(F.struct("hot", "shared", "start", "before", "size")).alias("wanted"))  # a set: equal rows ask for the same, and each of them fetches it
        texts = docs.where(where)
        named = asked.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
        fetched = texts.join(named, texts["id"].eqNullSafe(named["__id"]) & (texts["th"] == named["__th"])).select("id", "th", "text", "wanted")
        bytes_of = written(fetched.mapInArrow(tidy(_contexts(scheme)), f"id {kind}, th long, lead binary, hot boolean, shared boolean, start int, before int, context binary"), "contexts")
        cool, warm = bytes_of.where("not hot"), bytes_of.where("hot")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(bytes_of.count() / BUCKET_ROWS))
        compared = cool.repartitionByRange(buckets, "lead").sortWithinPartitions("lead").mapInArrow(tidy(_bucket(scheme)), spans)
        return tables.keep(written(functools.reduce(DataFrame.unionByName, [whole, copies, compared, *hot_spans(warm, scheme)]), "spans"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _finish(batches):
        yield batch.select(batch.schema.names[:-1])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """One row per row of ``df``: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_passage_words`` (words under strings
    of 51 words that another document holds too; they are counted, not removed) and, if asked for, ``kept`` (the bytes that stay)."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    each = [repeated_spans(docs, scheme, hot).withColumn("words", F.lit(scheme.unit > 1)) for scheme in (PASSAGES, BYTES)]
    spans = each[0].unionByName(each[1]).groupBy("id", "th").agg(F.collect_list(F.struct("words", "low", "high")).alias("spans"))
    named = spans.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    joined = docs.join(named, docs["id"].eqNullSafe(named["__id"]) & (docs["th"] == named["__th"]), "left").select("id", "text", "spans")
    kind = df.schema[id_col].dataType.simpleString()
    found = joined.mapInArrow(tidy(_finish), f"id {kind}, {RESULT}, kept binary") if with_kept else joined.mapInArrow(tidy(_digests), f"id {kind}, {RESULT}")
    return found.withColumnRenamed("id", id_col)
