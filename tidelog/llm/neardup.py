"""Near-duplicate detection: MinHash bands propose, odd sketches sift, full shingle sets decide.

A document's set is that of its distinct five-word shingles (64-bit hashes). Documents with equal sets form a class; from here on one
class member, the one of the lowest id, stands for it, so copies are never paired with each other.

1. Each class gets ``BANDS`` x ``ROWS`` MinHash samples. A band is ``ROWS`` samples; classes that agree in a band meet in a bucket,
   which is linked to its lowest and its highest member by id XOR bucket (a star, never all pairs; each bucket mixes ids its way).
2. The samples are also folded into an odd sketch: each (place, sample) flips one of ``BITS`` bits. The population count of two
   sketches' XOR estimates their similarity; star links under ``threshold - MARGIN`` go. Members of a bucket that star links leave
   apart are compared with all its others by sketch, in pairs of blocks of about ``PAIRED``, and what passes is linked too: all pairs
   of a bucket whose estimate passes end up connected.
3. The links' connected components are clusters, which contain the true links; texts of clustered classes are fetched once and their full
   sets compared. First each class is compared with the neighbour whose sketch is nearest, a link a class, which joins
   most copies. Where a cluster is in several parts after that, the classes outside its largest part are dealt into blocks of about
   ``BLOCK`` documents, those of the part into blocks of their own, and each pair of blocks, but for two of the part, is a task's unit of work, so
   no cluster lands in one task. In a unit, pairs are taken by falling sketch estimate and compared exactly unless they are
   connected already; what leaves a unit is a spanning forest of confirmed links. So a text is sent twice for each link of the first
   comparison and once for every ``BLOCK`` classes that stay outside the largest part of its cluster.
4. Components of the confirmed links give ``component_id``.

A pair at the threshold meets in no band with probability (1 - t ** ROWS) ** BANDS, 4e-5 at 0.85, and is sifted away where its
estimate falls under ``threshold - MARGIN``, about five standard deviations; components need not every link.

Defined cases: an empty or null text has an empty set and is linked with nothing; a row with a null id is linked with nothing and
has no component; rows of one id and one set are one; extra columns are left out. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scope, slices, tidy, word_hashes, written

WIDTH = 5
BANDS, ROWS, BITS = 32, 8, 1024
MARGIN = 0.15
#: Documents in a block, and the shingles of all of them.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Up to so many rows of two or three numbers (ids of clustered classes, rows to drop, sizes of groups) are broadcast; beyond, tables are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Members of a bucket in a block whose sketches are compared.
PAIRED = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


MULTIPLIERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
_PLACES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The document's set, sorted: hashes of its distinct five-word shingles; ASCII capitals count as small letters."""
    found = (text or "").encode("utf-8").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h, width = word_hashes(found), min(WIDTH, len(found))
    n = len(h) - width + 1
    key = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = mixed(key * _MIX + h[k : k + n])
    return np.unique(key)


def samples(full: np.ndarray) -> np.ndarray:
    """One MinHash sample per multiplier, over the whole set in stretches of bounded memory."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(full), 256):
            np.minimum(low, (full[at : at + 256, None] * MULTIPLIERS).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mixed(key * _MIX + low.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each bit."""
    with np.errstate(over="ignore"):
        bits = (mixed(low + _PLACES) >> np.uint64(20)) % np.uint64(BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    left = np.maximum(1 - 2 * np.asarray(differing, float) / BITS, 1e-9)
    return 1 + BITS * np.log(left) / (4 * len(MULTIPLIERS))


def most_differing(similarity: float) -> int:
    """Sketches of sets that are so similar differ in this many bits on average."""
    return int(np.ceil(BITS * (1 - np.exp(-4 * len(MULTIPLIERS) * (1 - similarity) / BITS)) / 2))


def set_digest(full: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(full.tobytes()) if len(full) else b""


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        sizes, digests, bands, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            full = shingles(text)
            low = samples(full) if len(full) else None
            sizes.append(len(full))
            digests.append(set_digest(full))
            bands.append(band_keys(low) if low is not None else None)
            sketches.append(odd_sketch(low) if low is not None else None)
        arrays = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "n_shingles", "digest", "bands", "sketch"])


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_shingles, digest, bands, sketch) of every row, th a hash of its text, written to the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    frame = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    return written(frame.mapInArrow(tidy(_sign), f"id {kind}, th long, n_shingles long, digest binary, bands array<long>, sketch array<long>"), "signatures")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the lowest id reachable. Large-star and small-star steps, each written.

    Every step keeps the graph connected as before and moves links towards the lowest ids, until they are stars. The centre of a star
    has a row for each of its neighbours: those rows meet the centre's lowest neighbour in a plain join of tables, whose large partitions
    Spark splits.
    """
    with Scope() as tables:
        links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        while not _stars(links):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lows")
            large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
            tables.drop(links, low)
            low = written(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
            # a's lower neighbours and a itself are linked to the lowest of them
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()
            links = written(small, "links")
            tables.drop(large, low)
        tables.keep(links)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every ``a`` has one ``b``, which has no lower neighbour of its own."""
    several = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    inner = links.select(F.col("b").alias("a")).distinct().join(links.select("a").distinct(), "a", "left_semi")
    return several.unionByName(inner).isEmpty()


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed_forest(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, labels: np.ndarray, percent: int, most: int) -> list[tuple[int, int]]:
    """Links that connect all similar pairs, where equal labels are connected already.

    ``side``: the block of each; where there are two, pairs of one block are compared in the unit of that block alone.
    """
    one = len(np.unique(side)) == 1
    pairs, counts = [], []
    for i in range(len(sets)):
        apart = labels[i + 1 :] != labels[i]
        others = np.flatnonzero(apart if one else apart & (side[i + 1 :] != side[i])) + i + 1
        if not len(others):
            continue
        bits = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1)
        near = bits <= most
        pairs.append(np.column_stack([np.full(near.sum(), i), others[near]]).astype(np.int32))
        counts.append(bits[near])
    if not pairs:
        return []
    table, order = np.concatenate(pairs), np.argsort(np.concatenate(counts), kind="stable")
    first = {}
    forest, links = Forest(len(sets)), []
    for i, label in enumerate(labels.tolist()):
        forest.join(i, first.setdefault(label, i))
    for i, j in table[order].tolist():
        if forest.root(i) != forest.root(j) and similar(sets[i], sets[j], percent):
            forest.join(i, j)
            links.append((i, j))
    return links


def near_forest(labels: np.ndarray, sketches: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect all pairs whose sketches differ in ``most`` bits at most, where equal labels are connected already.

    ``side``: the block of each; where there are two, pairs of one block are compared in the unit of that block alone.
    """
    labels, links = np.unique(labels, return_inverse=True)[1], []
    one = len(np.unique(side)) == 1
    for i in range(len(labels)):
        apart = labels[i + 1 :] != labels[i]
        others = np.flatnonzero(apart if one else apart & (side[i + 1 :] != side[i])) + i + 1
        if not len(others):
            continue
        near = others[np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= most]
        for label, at in zip(*np.unique(labels[near], return_index=True), strict=True):
            links.append((i, int(near[at])))
            labels[labels == label] = labels[i]
    return links


def _near_unit(most: int):
    def run(unit: pa.Table) -> pa.Table:
        ids, side, labels = (unit.column(c).to_numpy() for c in ("rep", "block", "label"))
        sketches = unit.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        links = np.array(near_forest(labels, sketches, side, most), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    return run


def near_links(banded: DataFrame, ends: DataFrame, sketch: DataFrame, star: DataFrame, most: int) -> DataFrame:
    """(a, b): links between components of the sifted stars (``star``: id, component) that connect all pairs of a bucket whose sketches pass.

    A star holds all pairs of a bucket of three. In a larger one the members of its first member's component need no comparison among
    themselves; the rest, dealt into blocks, meet each other and them.
    """
    label = F.coalesce("component", "rep")
    large = banded.join(ends.where("m > 3").select("bucket", "first"), "bucket").join(star.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bucket", "first", "rep", label.alias("label"))
    large = written(large, "buckets")
    main = large.groupBy("bucket").agg(F.max(F.when(F.col("rep") == F.col("first"), F.col("label"))).alias("main"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("bucket", "main")
    mixed = large.join(by_group(main, "main"), "bucket").select("bucket", "rep", "label", (F.col("label") == F.col("main")).alias("inside"))
    units = block_pairs(mixed, "bucket", "rep", F.lit(1), PAIRED)
    return units.join(sketch.select(F.col("rep").cast("long").alias("rep"), "sketch"), "rep").groupBy("bucket", "u", "v").applyInArrow(_near_unit(most), "a long, b long")


def by_group(rows: DataFrame, name: str) -> DataFrame:
    """A table of one row per group, to be joined with the groups' members, of which one group may have a third.

    Up to ``BROADCAST_ROWS`` rows are broadcast, so that members stay where they are; beyond, a plain join of tables follows, whose large
    partitions Spark splits.
    """
    rows = written(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def block_pairs(members: DataFrame, group: str, member: str, weight: Column, block: int) -> DataFrame:
    """``members`` with ``block``, once for each pair (``u``, ``v``) of blocks of their group that it belongs to.

    Members that are ``inside`` are settled among themselves and dealt into blocks of their own. Pairs of two such blocks are left out;
    all others are there. A block weighs about ``block``.
    """
    blocks = lambda inside: F.ceil(F.sum(F.when(F.col("inside") if inside else ~F.col("inside"), weight).otherwise(0)) / block).cast("int")
    sizes = by_group(members.groupBy(group).agg(blocks(False).alias("rest"), blocks(True).alias("settled")), "sizes")
    spread = F.xxhash64(member, group)
    dealt = members.join(sizes, group).withColumn("block", F.when(F.col("inside"), F.col("rest") + F.pmod(spread, "settled")).otherwise(F.pmod(spread, "rest")).cast("int"))
    # the rest's blocks meet all blocks; settled ones only the rest's
    reach = F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("settled"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), reach - 1)))
    return paired.withColumns({"u": F.least("block", "other"), "v": F.greatest("block", "other")}).drop("other", "rest", "settled")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = [[shingles(t) for t in batch.column(c).to_pylist()] for c in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([similar(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_()))

    return run


def confirmed(links: DataFrame, texts: DataFrame, percent: int, kind: str) -> DataFrame:
    """The links (a, b) whose texts (id, text) are similar."""
    rows = links.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(tidy(_confirm(percent)), f"a {kind}, b {kind}")


def component_table(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, th) of every row, th a hash of its text; rows whose sets' Jaccard similarity is at least ``percent`` / 100 are linked."""
    kind = df.schema[id_col].dataType.simpleString()
    signed = signatures(df, id_col, text_col)
    with Scope() as tables:
        full = signed.where("n_shingles > 0 and id is not null")
        who = F.min(F.struct("id", "th"))
        classes = full.groupBy("digest").agg(who.alias("who"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
        classes = written(classes.select("digest", F.col("who.id").alias("rep"), F.col("who.th").alias("th"), "bands", "sketch", "n"), "classes")
        # links of each bucket to its lowest and highest member by id XOR bucket
        banded = classes.select(F.col("rep").cast("long").alias("rep"), F.explode("bands").alias("bucket"))
        mix = F.col("rep").bitwiseXOR(F.col("bucket"))
        ends = banded.groupBy("bucket").agg(F.min(mix).alias("low"), F.max(mix).alias("high"), F.count("*").alias("m")).where("low <> high")
        ends = written(ends.select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("first"), F.col("high").bitwiseXOR(F.col("bucket")).alias("last"), "m"), "ends")
        star = banded.join(ends, "bucket").select("rep", F.explode(F.array("first", "last")).alias("end")).where("rep <> end")
        pairs = star.select(F.greatest("rep", "end").alias("a"), F.least("rep", "end").alias("b")).distinct()
        most = most_differing(percent / 100 - MARGIN)
        sketch = classes.select("rep", "sketch")
        bits = _differing(F.col("sa"), F.col("sb"))
        sifted = written(pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", bits.alias("bits")).where(F.col("bits") <= most), "sifted")
        stars = components(sifted.select("a", "b"))
        # what the sift of the stars leaves apart in a bucket, exactly
        further = written(near_links(banded, ends, sketch, stars, most), "further")
        if not further.isEmpty():
            stars = components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(further))
        clusters = written(stars.join(classes.select(F.col("rep").alias("id"), "th", "sketch", "n"), "id"), "clusters")
        tables.drop(ends)
        # the texts of clustered classes, once each
        wanted = clusters.select(F.col("id").alias("__id"), F.col("th").alias("__th"))
        wanted = F.broadcast(wanted) if clusters.count() <= BROADCAST_ROWS else wanted
        texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
        texts = texts.join(wanted, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th"))).groupBy("id", "th").agg(F.first("text").alias("text"))
        texts = written(texts, "texts")
        both = sifted.unionByName(sifted.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
        nearest = both.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        first = written(confirmed(nearest.unionByName(further.select("a", "b")).distinct(), texts.select("id", "text"), percent, kind), "confirmed")
        parts = components(first)
        # clusters in several parts: what is outside the largest part meets everything
        label = F.coalesce("part", "id")
        placed = clusters.join(parts.withColumnRenamed("component", "part"), "id", "left").select("component", "id", "th", "sketch", "n", label.alias("label"))
        sizes = placed.groupBy("component", "label").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("component").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("component", F.col("top.label").alias("main"))
        mixed = placed.join(by_group(largest, "largest"), "component").withColumn("inside", F.col("label") == F.col("main")).drop("main")
        units = block_pairs(mixed, "component", "id", F.greatest(F.lit(1.0), F.col("n") * (BLOCK / BLOCK_SHINGLES)), BLOCK)
        units = units.join(texts, ["id", "th"]).select("component", "u", "v", "block", "id", "label", "sketch", "text")
        second = units.groupBy("component", "u", "v").applyInArrow(_unit(percent, most), f"a {kind}, b {kind}")
        joined = components(first.unionByName(second))
        of_class = classes.select("digest", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
        of_class = tables.keep(written(of_class, "of-class"))
    # hot classes: a plain join on the digest, whose large partitions Spark splits
    placed = signed.select("id", "th", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return placed.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "th")


def drop_near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that are not their component's first; rows of one id and one text stay or go together."""
    with Scope() as tables:
        gone = component_table(df, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("th").alias("__th")).distinct()
        gone = tables.keep(written(gone, "gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return df.join(gone, (df[id_col] == gone["__id"]) & (F.xxhash64(df[text_col]) == gone["__th"]), "left_anti")


def _unit(percent: int, most: int):
    def run(unit: pa.Table) -> pa.Table:
        ids, side, labels = (unit.column(c).to_numpy() for c in ("id", "block", "label"))
        sketches = unit.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        sets = [shingles(t) for t in unit.column("text").to_pylist()]
        links = np.array(confirmed_forest(sets, sketches, side, labels, percent, most), np.int64).reshape(-1, 2)
        kind = unit.schema.field("id").type
        return pa.table({"a": pa.array(ids[links[:, 0]], kind), "b": pa.array(ids[links[:, 1]], kind)})

    return run
