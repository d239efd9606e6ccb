"""Operators, codecs, sources, streams and the store: the cases of the blueprint, and SQL on the driver's smallest tables."""

import os
import random
import struct

import duckdb
import pandas as pd
import pytest

from tidelog import codec_queries, oracles, protocol, queries
from tidelog.clients import Consumer, CursorConsumer, Producer
from tidelog.embedded import EmbeddedLog
from tidelog.functions import codecs, hashing, records
from tidelog.operators import fetch, health, prefix, producers, recovery, reserve, retention, visibility
from tidelog.sources import files
from tidelog.store import LogError, LogStore
from tidelog.streaming import operators as streaming

ALL = queries.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql_agrees(spark, sf_dir, duck, name):
    rel = duck.sql(oracles.SQL[name])
    columns = sorted(rel.columns)
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str)
    df = ALL[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_every_query_but_one_has_sql():
    assert set(ALL) - set(oracles.SQL) == {"cursor_roundtrip"} < set(codec_queries.queries())


# -- ordered computations -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("width", [1, 3, 1000])
def test_prefix_forms_equal_plain_ones(spark, width):
    rng = random.Random(width)
    rows = [(p, i * rng.choice([1, 1, 4]) + p, rng.choice([0, 0, 5, 30, 90])) for p in range(3) for i in range(40)]
    rows = list({(p, o): (p, o, s) for p, o, s in rows}.values())
    df = spark.createDataFrame(rows, "p int, o long, s long")
    by = {p: sorted(r for r in rows if r[0] == p) for p in range(3)}
    sums = {(r["p"], r["o"]): r["before"] for r in prefix.running_sums(df, ["p"], "o", {"before": df["s"]}, width).collect()}
    previous = {(r["p"], r["o"]): r["previous"] and r["previous"]["o"] for r in prefix.with_previous(df, ["p"], "o", ["o"], width).collect()}
    for p, part in by.items():
        for k, (_, o, _) in enumerate(part):
            assert sums[(p, o)] == sum(x[2] for x in part[:k])
            assert previous[(p, o)] == (part[k - 1][1] if k else None)
    for budget in (0, 20, 100, 10**6):
        got = {(r["p"], r["o"]) for r in prefix.within_budget(df, ["p"], "o", "s", budget, width).collect()}
        want = set()
        for p, part in by.items():
            used = 0
            for k, (_, o, s) in enumerate(part):
                used += s
                if k and used > budget:
                    break
                want.add((p, o))
        assert got == want


def test_zero_length_then_oversized(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 2048), (0, 2, 1)], "partition_id int, first_offset long, payload_bytes long")
    assert [r["first_offset"] for r in prefix.within_budget(rows, ["partition_id"], "first_offset", "payload_bytes", 1024).collect()] == [0]


def test_placement_per_batch_and_ring_change(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate((5, 1, 9, 2))], "p int, at long, record_count long")
    placed = reserve.place(reserve.reserve(rows, ["p"], "at"), [(1, 0, (10, 11, 12))]).orderBy("batch_id").collect()
    assert [(r["lane"], r["first_offset"], r["last_offset"]) for r in placed] == [(10, 0, 4), (11, 5, 5), (12, 6, 14), (10, 15, 16)]
    after = reserve.place(spark.createDataFrame([(0,), (1,)], "sequence long"), [(1, 0, (1, 2)), (2, 1, (7, 8, 9))]).orderBy("sequence").collect()
    assert [(r["lane"], r["ring_epoch"]) for r in after] == [(1, 1), (8, 2)]
    for bad in ([(1, 0, ())], [(1, 0, (1, 1))], [(2, 0, (1,)), (2, 1, (2,))]):
        with pytest.raises(ValueError):
            reserve.check_rings(bad)


def test_watermarks_against_a_walk(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for p in range(30):
        start, at, gap = 0, 0, False
        ends = dict.fromkeys("cru", None)
        for _ in range(12):
            n = rng.randrange(1, 4)
            if rng.random() < 0.05:
                at += 2
                gap = True
            status = rng.choices(visibility.STATUSES, (1, 12, 1, 2))[0]
            acks = rng.choice((1, 2, 2, 2, 3))
            rows.append((p, at, at + n - 1, status, acks))
            stop = {"c": status == "pending", "u": status in ("pending", "unresolved"), "r": status == "pending" or (status != "aborted" and acks < 2)}
            for k, blocked in stop.items():
                if ends[k] is None and (gap or blocked):
                    ends[k] = start if gap else at
            if not gap:
                start = at + n
            at += n
        want[p] = tuple(start if ends[k] is None else ends[k] for k in "cru")
    df = spark.createDataFrame(rows, "partition_id int, first_offset long, last_offset long, status string, durable_replicas int")
    got = {r["partition_id"]: (r["contiguous_log_end"], r["replicated_high_watermark"], r["last_stable_offset"]) for r in visibility.watermarks(df, 2).collect()}
    assert got == want


def test_interior_gap(spark):
    only = spark.createDataFrame([(0, 1, 2, 2)], "partition_id int, batch_id long, first_offset long, last_offset long")
    assert [tuple(r) for r in recovery.missing_batches(only).collect()] == [(0, 0, 0, 1, 2)]


def test_producer_rules():
    c = producers.Cursor()
    assert producers.judge(c, 0, 3, 1, "d", None) == "out_of_order"
    assert [producers.judge(c, *a) for a in ((0, 0, 2, "a", None), (0, 0, 2, "a", None), (0, 0, 2, "b", None), (0, 5, 1, "c", None), (0, 2, 1, "c", None))] == ["accepted", "duplicate", "duplicate_mismatch", "out_of_order", "accepted"]
    assert [producers.judge(c, *a) for a in ((1, 0, 1, "x", None), (1, 3, 1, "x", None), (0, 0, 2, "a", None))] == ["out_of_order", "accepted", "stale_epoch"]
    c.failed = True
    assert producers.judge(c, 1, 4, 1, "y", None) == "requires_new_epoch" and producers.judge(c, 1, 3, 1, "x", None) == "duplicate"


def test_retention_and_packs(spark):
    extents = spark.createDataFrame([(0, p, 0, b, b, b, 10) for p in range(3) for b in (p,)], "lane int, pack_sequence long, partition_id int, batch_id long, first_offset long, last_offset long, payload_bytes long")
    starts = spark.createDataFrame([(0, 2)], "partition_id int, log_start long")
    assert sorted(r["pack_sequence"] for r in retention.removable_packs(extents, starts).collect()) == [0, 1]
    assert retention.removable_packs(extents, starts.where("false")).count() == 0
    objects = spark.createDataFrame([(0, 0), (0, 2)], "lane int, pack_sequence long")
    assert retention.tier_coverage(extents, objects).first()["covered_through"] == 1
    assert retention.tier_coverage(extents, objects.where("pack_sequence > 0")).first()["covered_through"] == 0


def test_quantiles_exact(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(997)]
    got = health.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}).first()
    ordered = sorted(values)
    assert [got[k] for k in "abcd"] == [ordered[int(-(-(996 * q) // 1))] for q in (0.0, 0.5, 0.99, 1.0)]
    few = health.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"b": 0.5, "c": 0.993}, ordered=20).first()
    assert [few["b"], few["c"]] == [ordered[498], ordered[int(-(-(996 * 0.993) // 1))]]


def test_fetch_checks(spark):
    marks = spark.createDataFrame([(0, 5)], "partition_id int, log_start long")
    with pytest.raises(fetch.OffsetOutOfRange):
        fetch.check_start(marks, 4)
    fetch.check_start(marks, 5)
    for wrong in (0, 11):
        with pytest.raises(ValueError):
            fetch.check_request(wrong, 10)


# -- codecs ---------------------------------------------------------------------------------------------------------------
def test_hashes():
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.splitmix64(0) == 0xE220A8397B1DCDAF
    assert hashing.blake3(b"a" * 3000) != hashing.blake3(b"a" * 3001)
    assert 0 <= hashing.coordinator_index(2**128 - 1, 3, 7) < 7 and 0 <= hashing.apply_worker(9, 1, 5) < 5


EXTENT = {"topic_id": str(2**128 - 1), "partition_id": 3, "batch_id": "9", "first_offset": 10, "last_offset": 11, "record_count": 2, "virtual_lane_id": 3, "ring_epoch": 4, "leader_epoch": 6, "sequence": 5, "producer_id": "55", "epoch": 1, "producer_first_sequence": 0, "event_id": "7", "payload_digest": bytes(range(16)), "transaction_id": "77", "chunk_sequence": 1, "group_digest": bytes(16), "payload": b"hello"}


def test_extents_round_trip_torn_and_corrupt():
    one, two = codecs.encode_extent(EXTENT), codecs.encode_extent(EXTENT | {"batch_id": "10", "producer_id": None, "event_id": None, "transaction_id": None, "payload": b""})
    assert len(one) == 224 + 5 + 8
    rows = [r for _, r in codecs.scan_extents(one + two)]
    assert {k: rows[0][k] for k in EXTENT} == EXTENT and rows[1]["producer_id"] is None and rows[1]["transaction_id"] is None
    assert len(list(codecs.scan_extents(one + two[:-3]))) == 1
    with pytest.raises(codecs.FormatError):
        list(codecs.scan_extents(one + two[:-3], last=False))
    flipped = bytearray(one)
    flipped[226] ^= 1
    with pytest.raises(codecs.FormatError, match="checksum"):
        list(codecs.scan_extents(bytes(flipped)))
    with pytest.raises(codecs.FormatError, match="duplicate"):
        list(codecs.scan_extents(one + one))


EVENTS = [
    {"kind": "configure", "topic_id": "1", "partition_id": 0, "ring_epoch": 2, "shards": [3, 4]},
    {"kind": "create_partition", "topic_id": "1", "partition_id": 1, "ring_epoch": 1, "shards": [0], "policy_generation": 1, "replication_factor": 3, "min_in_sync_replicas": 2},
    {"kind": "update_replication_policy", "topic_id": "1", "partition_id": 1, "expected_policy_generation": 1, "policy_generation": 2, "replication_factor": 3, "min_in_sync_replicas": 3},
    {"kind": "truncate", "topic_id": "1", "partition_id": 1, "log_start": 9},
    {"kind": "group_commit", "topic_id": "1", "partition_id": 1, "transaction_id": "77"},
    {"kind": "group_abort", "topic_id": "1", "partition_id": 1, "transaction_id": "78"},
]


def test_journal():
    data = b"".join(map(codecs.encode_event, EVENTS))
    assert codecs.scan_journal(data) == (EVENTS, len(data))
    assert codecs.scan_journal(data + data[:9])[1] == len(data)
    with pytest.raises(codecs.FormatError, match="checksum"):
        codecs.scan_journal(data[:20] + b"\xff" + data[21:])
    with pytest.raises(codecs.FormatError):
        codecs.encode_event(EVENTS[2] | {"policy_generation": 1})


def test_frames_and_receipts():
    row = {k: EXTENT[k] for k in ("batch_id", "event_id", "transaction_id", "chunk_sequence", "first_offset", "last_offset", "record_count", "virtual_lane_id", "ring_epoch", "leader_epoch", "sequence", "payload")} | {"request_id": "1"}
    data = codecs.encode_frame(row) + codecs.encode_frame(row | {"event_id": None, "transaction_id": None, "chunk_sequence": None})
    assert len(codecs.encode_frame(row)) == 152 + 5 + 4
    assert codecs.decode_frames(data)[0] == row and codecs.decode_frames(data)[1]["chunk_sequence"] is None
    for cut, kind in ((data[:-1], "truncated"), (b"XXXX" + data[4:], "invalid_magic"), (data[:4] + b"\x09" + data[5:], "unsupported_version"), (data[:160] + b"\xff" + data[161:], "checksum_mismatch")):
        with pytest.raises(codecs.FormatError) as error:
            codecs.decode_frames(cut)
        assert error.value.kind == kind
    receipt = {"request_id": "1", "batch_id": "2", "record_id": "3", "first_offset": 4, "last_offset": 5, "visible_through": 6, "virtual_lane_id": 1, "ring_epoch": 1, "leader_epoch": 1, "sequence": 2}
    assert len(codecs.encode_receipt(receipt)) == 108 and codecs.decode_receipt(codecs.encode_receipt(receipt)) == receipt


def test_cursors():
    plain = {"topic_id": "42", "partition_id": 3, "data_generation": 7, "mode": "active_passive", "next_offset": 99}
    vector = {"topic_id": "42", "partition_id": 3, "data_generation": 8, "mode": "active_active", "membership_epoch": 11, "positions": [{"origin_id": 1, "writer_epoch": 2, "next_sequence": 10}, {"origin_id": 4, "writer_epoch": 3, "next_sequence": 20}]}
    for c in (plain, vector):
        data = codecs.encode_cursor(c)
        assert codecs.decode_cursor(data) == c and codecs.cursor_from_hex(data.hex().upper()) == c
    for change, kind in (({"positions": list(reversed(vector["positions"]))}, "origins_not_canonical"), ({"positions": []}, "empty_origins"), ({"membership_epoch": 0}, "invalid_membership_epoch"), ({"data_generation": 0}, "invalid_generation")):
        with pytest.raises(codecs.FormatError) as error:
            codecs.encode_cursor(vector | change)
        assert error.value.kind == kind
    for text in ("abc", "zz" * 30, "ab" * 10):
        with pytest.raises(codecs.FormatError):
            codecs.cursor_from_hex(text)


def test_record_batches():
    rows = [{"key": None, "value": b"one"}, {"key": b"k", "value": None, "headers": [("h", b"v"), ("n", None)], "timestamp": 5}]
    for codec in (0, 1, 4):
        data = records.encode_batch(rows, producer_id=9, epoch=0, sequence=100, codec=codec) + records.encode_batch(rows, producer_id=9, epoch=0, sequence=102)
        got = records.scan_batches(data)
        assert got["record_count"] == 4 and got["producer"]["first_sequence"] == 100
        assert got["records"][1]["headers"] == [("h", b"v"), ("n", None)] and got["records"][1]["timestamp"] == 5
    gap = records.encode_batch(rows, producer_id=9, epoch=0, sequence=100) + records.encode_batch(rows, producer_id=9, epoch=0, sequence=104)
    bad = bytearray(records.encode_batch(rows))
    bad[-1] ^= 1
    control = bytearray(records.encode_batch(rows))
    control[22] |= 1 << 5
    control[17:21] = struct.pack(">I", hashing.crc32c(bytes(control[21:])))
    for data, kind in ((gap, "invalid_producer_epoch"), (bytes(bad), "corrupt_message"), (bytes(control), "unsupported_for_message_format"), (b"", "unsupported_for_message_format")):
        with pytest.raises(codecs.FormatError) as error:
            records.scan_batches(data)
        assert error.value.kind == kind
    assert records.scan_batches(records.encode_batch(rows))["producer"] is None


# -- sources and streams --------------------------------------------------------------------------------------------------
def test_extent_and_journal_sources(spark, tmp_path):
    rows = [EXTENT | {"batch_id": str(i), "partition_id": i % 2} for i in range(4)]
    (tmp_path / "pack-00000000000000000000.sse").write_bytes(b"".join(map(codecs.encode_extent, rows[:3])))
    (tmp_path / "pack-00000000000000000001.sse").write_bytes(codecs.encode_extent(rows[3]) + b"SSE")
    (tmp_path / "control.ssj").write_bytes(b"".join(map(codecs.encode_event, EVENTS)))
    files.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    log = spark.read.format("extentlog").option("path", str(tmp_path)).load()
    assert log.count() == 4 and log.where("partition_id = 1").count() == 2
    first = log.where("batch_id = '0'").first()
    assert first["topic_id"] == str(2**128 - 1) and first["producer"]["producer_id"] == "55" and bytes(first["payload"]) == b"hello"
    journal = spark.read.format("journallog").option("path", str(tmp_path)).load()
    assert [r["kind"] for r in journal.orderBy("event_no").collect()] == [e["kind"] for e in EVENTS]
    assert recovery.journal_violations(journal).count() == 0


def test_small_packs_share_a_task(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"pack-{i:020d}.sse").write_bytes(codecs.encode_extent(EXTENT | {"batch_id": str(i)}) + (b"SSE" if i == 39 else b""))
    reader = files.ExtentReader({"path": str(tmp_path)})
    assert [len(p.paths) for p in reader.partitions()] == [40]
    files.register(spark)
    read = lambda: sorted((r["pack_sequence"], r["batch_id"], bytes(r["payload"])) for r in spark.read.format("extentlog").option("path", str(tmp_path)).load().collect())
    assert read() == [(i, str(i), b"hello") for i in range(40)]
    (tmp_path / f"pack-{20:020d}.sse").write_bytes(codecs.encode_extent(EXTENT | {"batch_id": "20"}) + b"SSE")
    with pytest.raises(Exception, match="torn_pack"):  # only the folder's last pack may end torn
        read()


def test_packs_are_written_in_order_with_absent_parts(spark, tmp_path):
    rows = [EXTENT | {"batch_id": str(i), "lane": i % 2, "pack_sequence": i // 6, "sequence": 50 - i} for i in range(24)]
    for r in rows[::3]:
        r |= {"transaction_id": None, "chunk_sequence": None}
    columns = ("lane", "pack_sequence", "topic_id", "partition_id", "batch_id", "first_offset", "last_offset", "record_count", "virtual_lane_id", "ring_epoch", "leader_epoch", "sequence", "transaction_id", "chunk_sequence", "payload")
    types = "lane int, pack_sequence long, topic_id string, partition_id int, batch_id string, first_offset long, last_offset long, record_count long, virtual_lane_id int, ring_epoch long, leader_epoch long, sequence long, transaction_id string, chunk_sequence long, payload binary"
    made = files.write_packs(spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], types), str(tmp_path)).collect()
    assert sorted((r["lane"], r["pack_sequence"]) for r in made) == [(lane, p) for lane in range(2) for p in range(4)]
    for lane, number, size in made:
        data = (tmp_path / f"lane-{lane:05d}/pack-{number:020d}.sse").read_bytes()
        found = [x for _, x in codecs.scan_extents(data, False)]
        want = sorted((r for r in rows if (r["lane"], r["pack_sequence"]) == (lane, number)), key=lambda r: r["sequence"])
        assert len(data) == size and [(x["batch_id"], x["transaction_id"], x["chunk_sequence"]) for x in found] == [(r["batch_id"], r.get("transaction_id"), r.get("chunk_sequence")) for r in want]


def test_codec_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("frame_roundtrip", "extent_roundtrip"):
        df = ALL[name](spark, sf_dir)
        assert df.count() == docs
    hashes = {r["doc_id"]: r["payload_sha256"] for r in ALL["frame_roundtrip"](spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "sha2(cast(coalesce(text, '') as binary), 256) as h").collect()
    assert hashes == {r["doc_id"]: r["h"] for r in texts}
    records_ = ALL["record_batch_scan"](spark, sf_dir)
    assert records_.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count() and records_.where("record_offset <> producer_sequence").count() == 0
    assert ALL["cursor_roundtrip"](spark, sf_dir).where("length(cursor_hex) <> 104").count() == 0


def long_rows(spark, n=256):
    """Rows of a MB each in one task."""
    return spark.range(n, numPartitions=1).selectExpr("id", "cast(repeat(cast(id % 10 as string), 1 << 20) as binary) as payload")


def held_mb(_=None):
    """MB of the process that this runs in."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_columns_are_encoded_in_bounded_memory(spark):
    rows = files.encode_column(long_rows(spark), lambda row: str(held_mb()).encode(), "held", ["payload"], ["id"]).collect()
    assert len(rows) == 256 and max(int(bytes(r["held"])) for r in rows) < 180


def test_columns_are_decoded_in_bounded_memory(spark):
    rows = files._exploded(long_rows(spark), "payload", ["id"], files.schemas.struct_of("held bigint, n bigint"), lambda data: [(held_mb(), len(data))]).collect()
    assert [r["n"] for r in rows] == [1 << 20] * 256 and max(r["held"] for r in rows) < 180


def test_stream_equals_batch(spark, sf_dir):
    live = {(r["partition_id"], r["batch_id"]): (r["first_offset"], r["last_offset"]) for r in ALL["stream_sequencer"](spark, sf_dir).collect()}
    plain = {(r["partition_id"], r["batch_id"]): (r["first_offset"], r["last_offset"]) for r in ALL["reserve_offsets"](spark, sf_dir).collect()}
    assert live == plain


def test_stream_reorder(spark, sf_dir):
    rows = ALL["stream_reorder"](spark, sf_dir)
    ends = rows.where("outcome = 'released'").groupBy("partition_id").agg({"batch_id": "max", "*": "count"}).collect()
    assert all(r["max(batch_id)"] + 1 >= r["count(1)"] > 0 for r in ends) and rows.where("outcome not in ('released')").count() == 0


def test_sent_appends_share_state_entries(monkeypatch):
    monkeypatch.setattr(streaming, "SENT_HELD", 2)
    kept, calls = {}, []

    class State:
        getValue = lambda self, at: calls.append(at) or kept.get(at)  # noqa: E731, N815
        updateValue = lambda self, at, value: calls.append(at) or kept.update({at: value})  # noqa: E731, N815

    sent = streaming.Sent(State(), True)
    for i in range(2000):
        sent[(0, i)] = (str(i), None, 1)
    sent.close()
    assert len(calls) < 40 and len(kept) == 8
    again = streaming.Sent(State(), False)
    assert [again.get((0, i)) for i in (0, 1999, 700, 0)] == [(str(i), None, 1) for i in (0, 1999, 700, 0)] and again.get((1, 0)) is None and again.get((0, 2000)) is None


def test_producer_check_over_two_batches(spark, tmp_path):
    schema = "producer_id long, epoch long, first_sequence long, record_count long, digest string, event_id string, arrival_seq long"
    first = [(p, 0, i, 1, f"d{i}", "", 10 * i + 5) for p in (1, 2) for i in range(600)]
    later = [(1, 0, 599, 1, "d599", "", 9000), (1, 0, 3, 1, "other", "", 9001), (1, 0, 600, 1, "d600", None, 9002), (1, 0, 600, 1, "d600", None, 9003), (2, 0, 700, 1, "d", "", 9004), (2, 1, 600, 1, "e", "", 9005), (2, 0, 5, 1, "d5", "", 9006), (3, 0, 1, 1, "f", "", 9007)]
    source, sink, state = (f"file://{tmp_path}/{n}" for n in ("source", "sink", "state"))
    for rows in (first, later):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        streaming.run_to_end(streaming.judged(spark.readStream.schema(schema).parquet(source)), sink, state)
    got = {(r["producer_id"], r["arrival_seq"]): r["outcome"] for r in spark.read.parquet(sink).collect()}
    assert all(got[(r[0], r[-1])] == "accepted" for r in first) and len(got) == len(first) + len(later)
    assert [got[(r[0], r[-1])] for r in later] == ["duplicate", "duplicate_mismatch", "accepted", "duplicate", "out_of_order", "accepted", "stale_epoch", "out_of_order"]


def test_a_keys_rows_are_ordered_in_bounded_memory():
    rng = random.Random(1)
    for n in (0, 1, 40, 99, 5000):
        rows = pd.DataFrame({"arrival_seq": rng.sample(range(n), n), "x": range(n)})
        found = list(streaming.in_order((rows.iloc[i : i + 37] for i in range(0, n, 37)), "arrival_seq", run_rows=100))
        assert [a for f in found for a in f["arrival_seq"]] == list(range(n)) and all(len(f) <= 4 for f in found)
        assert {(a, x) for f in found for a, x in zip(f["arrival_seq"], f["x"], strict=True)} == set(zip(rows["arrival_seq"], rows["x"], strict=True))
    tied = [pd.DataFrame({"arrival_seq": [5] * 50, "x": range(50 * i, 50 * i + 50)}) for i in range(8)]
    assert sorted(x for f in streaming.in_order(iter(tied), "arrival_seq", run_rows=100) for x in f["x"]) == list(range(400))


def test_reorder_buffer_bounds():
    waiting = {}
    out, at, held = streaming.release(waiting, 0, [(1, 5, "b"), (1, 5, "b"), (1, 5, "x"), (0, 5, "a"), (0, 5, "a")], 0)
    assert [(b, o) for b, _, o in out] == [(1, "joined"), (1, "corrupt"), (0, "released"), (1, "released"), (0, "duplicate")] and (at, held) == (2, 0)
    assert streaming.release({}, 0, [(9, 1, "z")], 0, (4, 8, 100))[0][0][2] == "limited"
    assert streaming.release({}, 0, [(2, 200, "z")], 0, (4, 8, 100))[0][0][2] == "limited"
    assert [streaming.linger_micros(200, g) for g in (1, 50, 128)] == [400, 200, 100]


# -- the store ------------------------------------------------------------------------------------------------------------
def requests(spark, rows, columns="partition_id int, arrival_seq long, record_count long, payload string"):
    return spark.createDataFrame(rows, columns)


def shuffles_of(df, column):
    """How the plan of ``df`` deals out what has the column."""

    def walk(node):
        if node.nodeName() == "Exchange" and f"{column}#" in node.output().toString():
            yield node.outputPartitioning().toString()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_store_payloads_are_not_dealt_by_partition(spark, tmp_path, monkeypatch):
    from tidelog import store

    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("1", 2, [0, 1, 2])
    numbered, reserved = [], reserve.reserve
    monkeypatch.setattr(store.reserve, "reserve", lambda df, *a, **k: numbered.append(df.columns) or reserved(df, *a, **k))
    wanted = [(i % 2, i, 1 + i % 3, f"v{i}", str(i) if i % 3 == 0 else None, 0 if i % 3 == 0 else None) for i in range(24)]
    log.append("1", requests(spark, wanted, "partition_id int, arrival_seq long, record_count long, payload string, transaction_id string, chunk_sequence long"))
    assert numbered and "payload" not in numbered[0]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = fetch.visible(log.batches("1"), log.watermarks("1"), "recovery").select("partition_id", "first_offset", "status", "payload")
        assert shuffles_of(rows, "payload") == []
        few = sorted(map(tuple, log.batches("1").select("partition_id", "first_offset", "status", "payload").collect()))
        monkeypatch.setattr(store, "SENT_OUTCOMES", -1)
        assert sorted(map(tuple, log.batches("1").select("partition_id", "first_offset", "status", "payload").collect())) == few
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for p in range(2):
        offset, mine = 0, [r for r in few if r[0] == p]
        for row, (_, _, count, payload, group, _) in zip(mine, [w for w in wanted if w[0] == p], strict=True):
            assert (row[1], row[2], bytes(row[3])) == (offset, "committed" if group is None else "unresolved", payload.encode())
            offset += count


def test_store_append_fetch_and_retention(spark, tmp_path):
    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("1", 1, [0, 1, 2])
    log.create_topic("1", 1, [0, 1, 2])
    with pytest.raises(LogError, match="TopicAlreadyExists"):
        log.create_topic("1", 2, [0, 1, 2])
    got = log.append("1", requests(spark, [(0, i, 1, f"v{i}") for i in range(4)] + [(0, 9, 0, "none"), (5, 10, 1, "where")])).orderBy("arrival_seq").collect()
    assert [r["outcome"] for r in got] == ["accepted"] * 4 + ["ZeroRecordCount", "UnknownPartition"] and [r["first_offset"] for r in got[:4]] == [0, 1, 2, 3]
    rows = log.fetch("1", 0).collect()
    assert [r["lane"] for r in rows] == [0, 1, 2, 0] and [bytes(r["payload"]) for r in rows] == [b"v0", b"v1", b"v2", b"v3"]
    assert len(log.fetch("1", 0, 1, 2).collect()) == 1 and [len(p) for p in log.pages("1", 0, 4)] == [2, 2]
    log.reconfigure_ring("1", 0, 2, [7, 8])
    again = LogStore(spark, f"file://{tmp_path}")
    assert [r["lane"] for r in again.append("1", requests(spark, [(0, 0, 3, "x")])).join(again.batches("1"), "batch_id").select("lane").collect()] == [7]
    with pytest.raises(LogError, match="Fenced"):
        log.reconfigure_ring("1", 0, 3, [1])
    again.truncate("1", 0, 4)
    with pytest.raises(LogError, match="OffsetOutOfRange"):
        again.fetch("1", 0, 1)
    with pytest.raises(LogError):
        again.truncate("1", 0, 2)
    with pytest.raises(LogError):
        again.truncate("1", 0, 5)
    assert again.reclaim() == 1 and again.watermarks("1").first()["allocated_end"] == 7
    assert [r["first_offset"] for r in again.fetch("1", 0, cursor=again.cursor("1", 0)).collect()] == [4]
    assert again.offload(f"file://{tmp_path}/tier")[0]["key"].endswith("-1")


def test_store_producers_and_groups(spark, tmp_path):
    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("7", 1, [0])
    wide = "partition_id int, arrival_seq long, record_count long, payload string, producer_id string, epoch long, first_sequence long, transaction_id string, chunk_sequence long"
    send = lambda *rows: log.append("7", requests(spark, list(rows), wide)).orderBy("arrival_seq").collect()
    assert [r["outcome"] for r in send((0, 0, 2, "a", "55", 0, 0, None, None), (0, 1, 1, "b", "55", 0, 2, None, None))] == ["accepted", "accepted"]
    again = send((0, 0, 2, "a", "55", 0, 0, None, None), (0, 1, 1, "other", "55", 0, 2, None, None), (0, 2, 1, "c", "55", 0, 9, None, None))
    assert [(r["outcome"], r["first_offset"]) for r in again] == [("duplicate", 0), ("duplicate_mismatch", None), ("out_of_order", None)]
    assert log.producer_progress("7").first()["next_sequence"] == 3
    send((0, 0, 1, "g0", None, None, None, "77", 0), (0, 1, 1, "g1", None, None, None, "77", 1), (0, 2, 1, "after", None, None, None, None, None))
    marks = log.watermarks("7").first()
    assert (marks["contiguous_log_end"], marks["last_stable_offset"]) == (6, 3)
    assert len(log.fetch("7", 0).collect()) == 2 and len(log.fetch("7", 0, mode="as_available").collect()) == 3 and len(log.fetch("7", 0, mode="recovery").collect()) == 5
    assert log.inspect_group("7", "77").first()["state"] == "open"
    log.resolve_group("7", 0, "77", "committed")
    log.resolve_group("7", 0, "77", "committed")
    with pytest.raises(LogError, match="AtomicGroupFinalized"):
        log.resolve_group("7", 0, "77", "aborted")
    with pytest.raises(LogError, match="UnknownAtomicGroup"):
        log.resolve_group("7", 0, "99", "aborted")
    assert [bytes(r["payload"]) for r in log.fetch("7", 0).collect()] == [b"a", b"b", b"g0", b"g1", b"after"]
    log.update_policy("7", 1, 2, 1, 1)
    log.update_policy("7", 1, 2, 1, 1)
    with pytest.raises(LogError, match="Fenced"):
        log.update_policy("7", 1, 3, 1, 1)
    files.register(spark)
    kinds = [r["kind"] for r in spark.read.format("journallog").option("path", f"{tmp_path}/journal").load().collect()]
    assert sorted(kinds) == ["create_partition", "group_commit", "update_replication_policy"]


def test_store_publishes_once(spark, tmp_path):
    one, two = (LogStore(spark, f"file://{tmp_path}") for _ in range(2))
    one.create_topic("1", 1, [0])
    with pytest.raises(LogError, match="Fenced"):
        two.create_topic("2", 1, [0])
    (tmp_path / "CURRENT").unlink()
    (tmp_path / "journal" / f"{1:020d}.ssj").unlink()
    later = LogStore(spark, f"file://{tmp_path}")  # a writer that stopped after its manifest is finished by the next
    assert "1" in later.state["topics"] and (tmp_path / "journal" / f"{1:020d}.ssj").exists() and (tmp_path / "CURRENT").read_text() == "1"
    (tmp_path / "ha-metadata").mkdir()
    with pytest.raises(LogError, match="PrivateData"):
        LogStore(spark, f"file://{tmp_path}")


def test_store_plans_tier_and_waiting(spark, tmp_path):
    log = LogStore(spark, f"file://{tmp_path}/log")
    log.create_topic("1", 1, [0, 1])
    for part in range(2):
        log.append("1", requests(spark, [(0, i, 2, f"{part}{i}") for i in range(3)]))
    plan = log.plan("1", 0, 0, 4)
    assert {(r["lane"], r["first_offset"], r["batches"]) for r in plan.lanes().collect()} == {(0, 0, 1), (1, 2, 1)} and plan.next_offset() == 4
    assert "digest" not in log.fetch("1", 0).columns
    rows, cursor = log.fetch_next("1", 0, log.cursor("1", 0), 4)
    assert [r["first_offset"] for r in rows.collect()] == [0, 2] and [r["first_offset"] for r in log.fetch("1", 0, cursor=cursor, expected_data_generation=1).collect()] == [4, 6, 8, 10]
    with pytest.raises(LogError, match="StaleDataGeneration"):
        log.fetch("1", 0, expected_data_generation=2)
    assert log.wait_until_visible("1", 0, 12, "replicated", 5) and not log.wait_until_visible("1", 0, 13, seconds=0)
    with pytest.raises(LogError, match="InvalidConfig"):
        log.wait_until_visible("1", 0, 1, "as_available")
    assert [(p.first_offset, p.next_offset, len(p)) for p in log.replay("1", 0, 8)] == [(0, 8, 4), (8, 12, 2)]
    objects = log.offload(f"file://{tmp_path}/tier")
    assert log.offload(f"file://{tmp_path}/tier") == objects and len(objects) == 2 and log.verify_objects() == []
    broken = objects[0]["files"][0]["name"]
    (tmp_path / "tier" / broken).write_bytes(b"other")
    assert log.verify_objects() == [broken]
    log.truncate("1", 0, 6)
    assert log.reclaim() == 1
    with pytest.raises(LogError, match="StalePlan"):
        log.read_plan(plan)


def test_offsets_reach_the_scan(spark, tmp_path):
    """A read by partition, batch or offset is a filter that Parquet gets, and payloads are not read to choose batches."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else plans show the first filters only
    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("1", 2, [0])
    log.append("1", requests(spark, [(p, i, 1, "x") for p in range(2) for i in range(4)]))
    plan = fetch.point_read(log.batches("1"), 1, 2).select("batch_id", "first_offset")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(batch_id,2)" in plan and "EqualTo(topic_id,1)" in plan and "PartitionFilters: [isnotnull(partition_id" in plan and "payload:binary" not in plan
    chosen = log.plan("1", 0, 2, 10).batches._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_offset,2)" in chosen and "payload:binary" not in chosen
    rows = fetch.catalog(log.batches("1")).select("partition_id", "first_offset").collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows)


def test_store_group_rules(spark, tmp_path):
    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("7", 1, [0], 3, 2)
    wide = "partition_id int, arrival_seq long, record_count long, payload string, transaction_id string, chunk_sequence long"
    send = lambda *rows: [(r["outcome"], r["first_offset"]) for r in log.append("7", requests(spark, list(rows), wide)).orderBy("arrival_seq").collect()]
    assert send((0, 0, 1, "late", "77", 1), (0, 1, 1, "g0", "77", 0), (0, 2, 1, "g0", "77", 0)) == [("out_of_order", None), ("accepted", 0), ("duplicate", 0)]
    assert send((0, 0, 1, "other", "77", 0), (0, 1, 1, "g0", "77", 0), (0, 2, 1, "g1", "77", 1)) == [("chunk_mismatch", None), ("duplicate", 0), ("accepted", 1)]
    with pytest.raises(LogError, match="DurabilityUnavailable"):
        log.resolve_group("7", 0, "77", "committed")  # one copy, two are wanted
    with pytest.raises(LogError, match="InvalidConfig"):
        log.resolve_group("7", 0, "77", "open")
    log.resolve_group("7", 0, "77", "aborted")
    assert send((0, 0, 1, "g2", "77", 2)) == [("finalized", None)]


def test_embedded_log(spark, tmp_path):
    log = EmbeddedLog(spark, f"file://{tmp_path}")
    assert log.bounds() is None and log.compact_before(5)["packs_removed"] == 0
    assert log.append_group(10, [b"a", b"bb"]) == {"first_sequence": 10, "last_sequence": 11, "record_count": 2, "payload_bytes": 3}
    log.append_group(12, [b"ccc"])
    for first, records in ((12, [b"again"]), (14, [b"gap"]), (13, [])):
        with pytest.raises(LogError):
            log.append_group(first, records)
    assert log.bounds() == (10, 13) and [(r["sequence"], bytes(r["payload"])) for r in log.read_from(0, 100, 2).collect()] == [(10, b"a"), (11, b"bb")]
    assert log.compact_before(12) == {"packs_removed": 1, "records_removed": 2, "bytes_removed": 3} and log.bounds() == (12, 13)
    assert EmbeddedLog(spark, f"file://{tmp_path}").bounds() == (12, 13)


def test_clients(spark, tmp_path):
    log = LogStore(spark, f"file://{tmp_path}")
    log.create_topic("1", 1, [0])
    sender = Producer(log, "1", 0, "55", max_request_bytes=6)
    assert [r["first_offset"] for r in sender.send([(b"aaa", 2), (b"bbb", 1), (b"cc", 1)])] == [0, 2, 3] and sender.next_sequence == 4
    again = Producer(log, "1", 0, "55")
    again.resume()
    assert (again.epoch, again.next_sequence) == (0, 4)
    again.next_sequence = 0
    assert [(r["outcome"], r["first_offset"]) for r in again.send([(b"aaa", 2)])] == [("duplicate", 0)]
    assert log.idempotent_receipt("1", 0, "55", 0, 3) == {"batch_id": 2, "first_offset": 3, "last_offset": 3} and log.idempotent_receipt("1", 0, "55", 0, 9) is None
    with pytest.raises(LogError, match="out_of_order"):
        Producer(log, "1", 0, "55", next_sequence=9).send([(b"x", 1)])
    waits = []
    refused = Producer(log, "1", 0, "55", next_sequence=4, retries=2, sleep=waits.append)
    refused.store = type("Busy", (), {"spark": spark, "append": lambda *a: (_ for _ in ()).throw(LogError("AdmissionLimited"))})()
    with pytest.raises(LogError, match="AdmissionLimited"):
        refused.send([(b"x", 1)])
    assert waits == [0.01, 0.02]
    reader = Consumer(log, "1", 0, 0, 6)
    assert [len(p) for p in reader.poll()] == [2, 1] and reader.offset == 4 and list(reader.poll()) == []
    by_cursor = CursorConsumer(log, "1", 0, 6)
    assert [[r["first_offset"] for r in by_cursor.fetch().collect()] for _ in range(3)] == [[0, 2], [3], []]
    with pytest.raises(LogError):
        CursorConsumer(log, "1", 0, 6, "as_available")


def test_dense_bounds(spark):
    rows = spark.createDataFrame([(0, 0, 1, 2), (0, 2, 2, 1), (1, 5, 6, 2)], "partition_id int, first_offset long, last_offset long, record_count long")
    assert {tuple(r) for r in fetch.dense_bounds(rows).collect()} == {(0, 0, 3), (1, 5, 7)}
    with pytest.raises(Exception, match="has a gap in"):
        fetch.dense_bounds(rows.where("first_offset <> 2").unionByName(spark.createDataFrame([(0, 9, 9, 1)], rows.schema))).collect()


def test_hashes_of_long_inputs():
    """Wide inputs are hashed piece by piece side by side; short ones are not, and a checksum goes on from another."""
    rng = random.Random(5)
    for n in (1023, 1024, 1025, 4095, 4096, 9000, 70_001):
        data = rng.randbytes(n)
        assert hashing.crc32c(data) == hashing.crc32c(data[1000:], hashing.crc32c(data[:1000]))
    assert hashing.blake3(bytes(i % 251 for i in range(2048))).hex().startswith("e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a")
    assert hashing.blake3(bytes(i % 251 for i in range(31744))).hex().startswith("62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47")


def test_create_topic_rules(spark):
    rows = spark.createDataFrame([(1, 1, False, False), (0, 1, False, False), (1, -1, False, False), (1, 2, False, False), (1, 1, True, False), (1, 1, False, True)], "p int, rf int, manual boolean, configured boolean")
    got = [r[0] for r in rows.select(protocol.create_topic_error(*(rows[c] for c in rows.columns), 1)).collect()]
    assert [x is None for x in got] == [True, False, True, False, False, False]
