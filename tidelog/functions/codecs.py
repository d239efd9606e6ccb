"""Binary formats of the log: stored extents, journal events, fetch frames, append receipts, cursors.

Every format is a table of fields; one reader and one writer serve them all. Rows are dicts whose 128-bit ids are decimal strings.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from tidelog.functions.hashing import extent_checksum

#: Marks, versions and sizes of the formats. Fixed values.
EXTENT_MAGIC, EXTENT_VERSION, EXTENT_HEADER = b"SSE8", 8, 224
JOURNAL_MAGIC, JOURNAL_VERSION, JOURNAL_PREFIX, MAX_EVENT = b"SSJ3", 3, 12, 1 << 20
FRAME_MAGIC, FRAME_VERSION, FRAME_HEADER = b"SSB5", 5, 152
RECEIPT_MAGIC, RECEIPT_VERSION, RECEIPT_BYTES = b"SAR1", 1, 108
CURSOR_MAGIC, CURSOR_VERSION, MAX_ORIGINS = b"SSCURS01", 1, 1024
XXH3_128_DIGEST = 1
KINDS = {"configure": 1, "truncate": 6, "group_commit": 7, "group_abort": 8, "create_partition": 9, "update_replication_policy": 10}
MODES = {"active_passive": 1, "active_active": 2}


class FormatError(ValueError):
    """Bytes that are not in the format; ``kind`` says why, ``offset`` where."""

    def __init__(self, kind: str, offset: int = 0):
        super().__init__(f"{kind} at {offset}")
        self.kind, self.offset = kind, offset


_STRUCT = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q"}
_SIZE = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "u128": 16, "pad3": 3, "digest": 16}


def pack(fields: list[tuple[str, str]], row: dict) -> bytes:
    """``fields``: (name, type) in order; a missing value is zero."""
    out = bytearray()
    for name, kind in fields:
        value = row.get(name)
        if kind == "pad3":
            out += bytes(3)
        elif kind == "digest":
            out += bytes(value) if value else bytes(16)
        elif kind == "u128":
            out += int(value or 0).to_bytes(16, "little")
        else:
            out += struct.pack("<" + _STRUCT[kind], int(value or 0))
    return bytes(out)


def unpack(fields: list[tuple[str, str]], data: bytes, at: int = 0) -> tuple[dict, int]:
    row: dict = {}
    for name, kind in fields:
        size = _SIZE[kind]
        part = data[at : at + size]
        if len(part) < size:
            raise FormatError("truncated", at)
        if kind == "pad3":
            if any(part):
                raise FormatError("reserved_bytes", at)
        elif kind == "digest":
            row[name] = bytes(part)
        elif kind == "u128":
            row[name] = str(int.from_bytes(part, "little"))
        else:
            row[name] = struct.unpack("<" + _STRUCT[kind], part)[0]
        at += size
    return row, at


_RANGE = [("batch_id", "u128"), ("first_offset", "u64"), ("last_offset", "u64"), ("record_count", "u32")]
_PLACE = [("virtual_lane_id", "u32"), ("ring_epoch", "u64"), ("leader_epoch", "u64"), ("sequence", "u64")]
_EVENT = [("has_event", "u8"), ("_", "pad3"), ("event_id", "u128")]
_GROUP = [("has_group", "u8"), ("_", "pad3"), ("transaction_id", "u128"), ("chunk_sequence", "u64")]
_PRODUCER = [("has_producer", "u8"), ("_", "pad3"), ("producer_id", "u128"), ("epoch", "u32"), ("producer_first_sequence", "u64"), ("digest_algorithm", "u8"), ("_", "pad3"), ("payload_digest", "digest")]
_EXTENT = [("topic_id", "u128"), ("partition_id", "u32"), *_RANGE, *_PLACE, *_PRODUCER, *_EVENT, *_GROUP, ("group_digest", "digest"), ("payload_len", "u64")]
_FRAME = [("request_id", "u128"), *_RANGE, *_PLACE, *_EVENT, *_GROUP, ("payload_len", "u64")]
_RECEIPT = [("request_id", "u128"), ("batch_id", "u128"), ("record_id", "u128"), ("first_offset", "u64"), ("last_offset", "u64"), ("visible_through", "u64"), *_PLACE]


def _flagged(row: dict, flag: str, names: tuple[str, ...]) -> None:
    """An absent part must be all zeros, a present one has flag 1; absent parts become null."""
    present = row.pop(flag)
    if present not in (0, 1) or (not present and any(row[n] not in (0, "0", bytes(16)) for n in names)):
        raise FormatError(f"invalid_{flag}")
    if not present:
        row.update(dict.fromkeys(names))


_PARTS = {
    "has_producer": ("producer_id", "epoch", "producer_first_sequence", "digest_algorithm", "payload_digest"),
    "has_event": ("event_id",),
    "has_group": ("transaction_id", "chunk_sequence", "group_digest"),
}


def _flags(row: dict) -> dict:
    """The flags of optional parts, and null for every field of an absent part."""
    out: dict = {}
    for flag, names in _PARTS.items():
        out[flag] = row.get(names[0]) is not None
        if not out[flag]:
            out.update(dict.fromkeys(names))
    return out


def _check_range(row: dict, at: int) -> None:
    if not row["record_count"] or row["first_offset"] + row["record_count"] - 1 != row["last_offset"]:
        raise FormatError("invalid_record_range", at)


# -- stored extents -------------------------------------------------------------------------------------------------------
def encode_extent(row: dict) -> bytes:
    payload = bytes(row["payload"])
    flags = _flags(row) | {"payload_len": len(payload)}
    flags["digest_algorithm"] = XXH3_128_DIGEST if flags["has_producer"] else 0
    size = EXTENT_HEADER + len(payload) + 8
    header = EXTENT_MAGIC + struct.pack("<BBHQ", EXTENT_VERSION, 0, EXTENT_HEADER, size) + pack(_EXTENT, row | flags)
    return header + payload + struct.pack("<Q", extent_checksum(header, payload))


def decode_extent(frame: bytes, at: int = 0) -> dict:
    header, payload = frame[:EXTENT_HEADER], frame[EXTENT_HEADER:-8]
    if len(frame) < EXTENT_HEADER + 8:
        raise FormatError("frame_too_short", at)
    if struct.unpack("<Q", frame[-8:])[0] != extent_checksum(header, payload):
        raise FormatError("checksum_mismatch", at)
    row, _ = unpack(_EXTENT, header, 16)
    _check_range(row, at)
    if row.pop("payload_len") != len(payload):
        raise FormatError("payload_length", at)
    if row["has_producer"] and row["digest_algorithm"] != XXH3_128_DIGEST:
        raise FormatError("digest_algorithm", at)
    if row["has_event"] and not row["has_producer"]:
        raise FormatError("invalid_has_event", at)
    for flag, names in _PARTS.items():
        _flagged(row, flag, names)
    return row | {"payload": bytes(payload)}


def scan_extents(data: bytes, last: bool = True) -> Iterator[tuple[int, dict]]:
    """(offset, extent) of a pack's frames. A torn tail ends the scan in the last pack and is corruption elsewhere; a wrong checksum always is."""
    at, seen = 0, set()
    while at < len(data):
        rest = len(data) - at
        torn = rest < 16
        if not torn:
            magic, version, flags, header, size = struct.unpack("<4sBBHQ", data[at : at + 16])
            if (magic, version, flags, header) != (EXTENT_MAGIC, EXTENT_VERSION, 0, EXTENT_HEADER) or size < EXTENT_HEADER + 8:
                raise FormatError("invalid_prefix", at)
            torn = size > rest
        if torn:
            if last:
                return
            raise FormatError("torn_pack", at)
        row = decode_extent(data[at : at + size], at)
        key = (row["topic_id"], row["partition_id"], row["batch_id"])
        if key in seen:
            raise FormatError("duplicate_batch", at)
        seen.add(key)
        yield at, row
        at += size


# -- journal --------------------------------------------------------------------------------------------------------------
_PARTITION = [("topic_id", "u128"), ("partition_id", "u32")]
_POLICY = [("policy_generation", "u64"), ("replication_factor", "u32"), ("min_in_sync_replicas", "u32")]


def encode_event(event: dict) -> bytes:
    kind, body = event["kind"], pack(_PARTITION, event)
    if kind in ("configure", "create_partition"):
        if not event["shards"]:
            raise FormatError("empty_ring")
        body += struct.pack("<QI", event["ring_epoch"], len(event["shards"])) + struct.pack(f"<{len(event['shards'])}I", *event["shards"])
    if kind == "update_replication_policy":
        body += struct.pack("<Q", event["expected_policy_generation"])
    if kind in ("create_partition", "update_replication_policy"):
        _check_policy(event)
        body += pack(_POLICY, event)
    if kind == "truncate":
        body += struct.pack("<Q", event["log_start"])
    if kind in ("group_commit", "group_abort"):
        body += pack([("transaction_id", "u128")], event)
    frame = JOURNAL_MAGIC + struct.pack("<BBHI", JOURNAL_VERSION, KINDS[kind], 0, len(body)) + body
    return frame + struct.pack("<I", zlib.crc32(frame))


def _check_policy(event: dict) -> None:
    if not event["policy_generation"] or not 1 <= event["min_in_sync_replicas"] <= event["replication_factor"]:
        raise FormatError("invalid_policy")
    if event["kind"] == "update_replication_policy" and not 0 < event["expected_policy_generation"] < event["policy_generation"]:
        raise FormatError("policy_generation")


def _decode_event(kind: int, body: bytes, at: int) -> dict:
    name = {v: k for k, v in KINDS.items()}.get(kind)
    if name is None:
        raise FormatError("unknown_kind", at)
    event, used = unpack(_PARTITION, body)
    event["kind"] = name
    if name in ("configure", "create_partition"):
        part, used = unpack([("ring_epoch", "u64"), ("n", "u32")], body, used)
        n = part.pop("n")
        if not n:
            raise FormatError("empty_ring", at)
        ring, used = unpack([(str(i), "u32") for i in range(n)], body, used) if used + 4 * n <= len(body) else (None, used)
        if ring is None:
            raise FormatError("truncated", at)
        event |= part | {"shards": list(ring.values())}
    if name == "update_replication_policy":
        part, used = unpack([("expected_policy_generation", "u64")], body, used)
        event |= part
    if name in ("create_partition", "update_replication_policy"):
        part, used = unpack(_POLICY, body, used)
        event |= part
        _check_policy(event)
    if name == "truncate":
        part, used = unpack([("log_start", "u64")], body, used)
        event |= part
    if name in ("group_commit", "group_abort"):
        part, used = unpack([("transaction_id", "u128")], body, used)
        event |= part
    if used != len(body):
        raise FormatError("trailing_bytes", at)
    return event


def scan_journal(data: bytes) -> tuple[list[dict], int]:
    """The events, and the length that is whole: a torn tail is left out, a wrong checksum is corruption."""
    at, events = 0, []
    while len(data) - at >= JOURNAL_PREFIX:
        magic, version, kind, flags, size = struct.unpack("<4sBBHI", data[at : at + JOURNAL_PREFIX])
        if (magic, version, flags) != (JOURNAL_MAGIC, JOURNAL_VERSION, 0):
            raise FormatError("invalid_prefix", at)
        if size > MAX_EVENT:
            raise FormatError("event_too_large", at)
        end = at + JOURNAL_PREFIX + size + 4
        if end > len(data):
            break
        if zlib.crc32(data[at : end - 4]) != struct.unpack("<I", data[end - 4 : end])[0]:
            raise FormatError("checksum_mismatch", at)
        events.append(_decode_event(kind, data[at + JOURNAL_PREFIX : end - 4], at))
        at = end
    return events, at


# -- fetch frames and receipts --------------------------------------------------------------------------------------------
def encode_frame(row: dict) -> bytes:
    payload = bytes(row["payload"])
    flags = _flags(row) | {"payload_len": len(payload)}
    header = FRAME_MAGIC + struct.pack("<BBHQ", FRAME_VERSION, 0, FRAME_HEADER, FRAME_HEADER + len(payload) + 4) + pack(_FRAME, row | flags)
    return header + payload + struct.pack("<I", zlib.crc32(payload, zlib.crc32(header)))


def decode_frames(data: bytes, max_frame: int = 1 << 30) -> list[dict]:
    at, rows = 0, []
    while at < len(data):
        if len(data) - at < 16:
            raise FormatError("truncated", at)
        magic, version, flags, header, size = struct.unpack("<4sBBHQ", data[at : at + 16])
        for wrong, kind in ((magic != FRAME_MAGIC, "invalid_magic"), (version != FRAME_VERSION, "unsupported_version"), (flags, "unsupported_flags"), (header != FRAME_HEADER, "invalid_header_length"), (not FRAME_HEADER + 4 <= size <= max_frame, "invalid_frame_length"), (size > len(data) - at, "truncated")):
            if wrong:
                raise FormatError(kind, at)
        frame = data[at : at + size]
        if zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
            raise FormatError("checksum_mismatch", at)
        row, used = unpack(_FRAME, frame, 16)
        payload = frame[used:-4]
        if row.pop("payload_len") != len(payload):
            raise FormatError("invalid_frame_length", at)
        _check_range(row, at)
        _flagged(row, "has_event", _PARTS["has_event"])
        _flagged(row, "has_group", _PARTS["has_group"][:2])
        rows.append(row | {"payload": payload})
        at += size
    return rows


def encode_receipt(row: dict) -> bytes:
    return RECEIPT_MAGIC + struct.pack("<BBH", RECEIPT_VERSION, 0, RECEIPT_BYTES) + pack(_RECEIPT, row)


def decode_receipt(data: bytes) -> dict:
    if len(data) != RECEIPT_BYTES:
        raise FormatError("truncated" if len(data) < RECEIPT_BYTES else "invalid_frame_length")
    magic, version, flags, size = struct.unpack("<4sBBH", data[:8])
    for wrong, kind in ((magic != RECEIPT_MAGIC, "invalid_magic"), (version != RECEIPT_VERSION, "unsupported_version"), (flags, "unsupported_flags"), (size != RECEIPT_BYTES, "invalid_header_length")):
        if wrong:
            raise FormatError(kind)
    return unpack(_RECEIPT, data, 8)[0]


# -- cursors --------------------------------------------------------------------------------------------------------------
def check_cursor(cursor: dict) -> None:
    if not cursor["data_generation"]:
        raise FormatError("invalid_generation")
    if cursor["mode"] == "active_active":
        positions = cursor["positions"]
        origins = [p["origin_id"] for p in positions]
        for wrong, kind in ((not cursor["membership_epoch"], "invalid_membership_epoch"), (not positions, "empty_origins"), (len(positions) > MAX_ORIGINS, "too_many_origins"), (any(a >= b for a, b in zip(origins, origins[1:], strict=False)), "origins_not_canonical"), (any(not p["writer_epoch"] for p in positions), "invalid_writer_epoch")):
            if wrong:
                raise FormatError(kind)


def encode_cursor(cursor: dict) -> bytes:
    check_cursor(cursor)
    body = CURSOR_MAGIC + struct.pack("<HBB", CURSOR_VERSION, MODES[cursor["mode"]], 0) + pack([*_PARTITION, ("data_generation", "u64")], cursor)
    if cursor["mode"] == "active_passive":
        body += struct.pack("<Q", cursor["next_offset"])
    else:
        body += struct.pack("<QI", cursor["membership_epoch"], len(cursor["positions"]))
        body += b"".join(struct.pack("<IIQ", p["origin_id"], p["writer_epoch"], p["next_sequence"]) for p in cursor["positions"])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_cursor(data: bytes) -> dict:
    if len(data) < 52:
        raise FormatError("truncated")
    body = data[:-4]
    if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise FormatError("checksum_mismatch")
    if body[:8] != CURSOR_MAGIC:
        raise FormatError("invalid_magic")
    version, mode, reserved = struct.unpack("<HBB", body[8:12])
    names = {v: k for k, v in MODES.items()}
    for wrong, kind in ((version != CURSOR_VERSION, "unsupported_version"), (mode not in names, "invalid_mode"), (reserved, "reserved_bits")):
        if wrong:
            raise FormatError(kind)
    cursor, at = unpack([*_PARTITION, ("data_generation", "u64")], body, 12)
    cursor["mode"] = names[mode]
    if cursor["mode"] == "active_passive":
        part, at = unpack([("next_offset", "u64")], body, at)
        cursor |= part
    else:
        part, at = unpack([("membership_epoch", "u64"), ("n", "u32")], body, at)
        n = part.pop("n")
        if n > MAX_ORIGINS:
            raise FormatError("too_many_origins")
        positions = []
        for _ in range(n):
            position, at = unpack([("origin_id", "u32"), ("writer_epoch", "u32"), ("next_sequence", "u64")], body, at)
            positions.append(position)
        cursor |= part | {"positions": positions}
    if at != len(body):
        raise FormatError("trailing_bytes")
    check_cursor(cursor)
    return cursor


def cursor_from_hex(text: str) -> dict:
    try:
        if len(text) % 2 or not text.isascii() or any(c.isspace() for c in text):
            raise ValueError
        data = bytes.fromhex(text)
    except ValueError:
        raise FormatError("invalid_hex") from None
    return decode_cursor(data)
