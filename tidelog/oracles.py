"""DuckDB SQL for the named queries, written against the driver's views."""

from __future__ import annotations

LOG = """WITH RECURSIVE records AS (
  SELECT event_id, user_id, event_type, CAST(user_id % 4 AS INTEGER) AS partition_id, length(props) AS bytes,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS log_offset
  FROM events
), raw AS (
  SELECT partition_id, CAST(log_offset // 5 AS BIGINT) AS batch_id, CAST(min(log_offset) AS BIGINT) AS first_offset, CAST(max(log_offset) AS BIGINT) AS last_offset,
         CAST(count(*) AS BIGINT) AS record_count, CAST(sum(bytes) AS BIGINT) AS payload_bytes, count(*) FILTER (event_type = 'error') AS errs, min(event_id) AS e0
  FROM records GROUP BY 1, 2
), stated AS (
  SELECT *, CASE WHEN e0 % 97 = 13 THEN 'pending' WHEN errs >= 4 THEN 'aborted' WHEN errs = 3 AND batch_id > 12 THEN 'unresolved' ELSE 'committed' END AS status FROM raw
), batches AS (
  SELECT *, CAST(CASE WHEN status = 'aborted' THEN 0 WHEN e0 % 211 = 100 THEN 1 ELSE 2 + e0 % 2 END AS INTEGER) AS durable_replicas FROM stated
), marks AS (
  SELECT partition_id, CAST(0 AS BIGINT) AS log_start, max(last_offset) + 1 AS allocated_end,
         coalesce(min(first_offset) FILTER (status = 'pending'), max(last_offset) + 1) AS contiguous_log_end,
         coalesce(min(first_offset) FILTER (status = 'pending' OR (status <> 'aborted' AND durable_replicas < 2)), max(last_offset) + 1) AS replicated_high_watermark,
         coalesce(min(first_offset) FILTER (status IN ('pending', 'unresolved')), max(last_offset) + 1) AS last_stable_offset
  FROM batches GROUP BY 1
)
"""
DOCS = """WITH RECURSIVE doc_batches AS (
  SELECT CAST(doc_id % 2 AS INTEGER) AS partition_id, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS batch_id,
         strlen(text) AS payload_bytes
  FROM documents
), laned AS (
  SELECT CAST(batch_id % 3 AS INTEGER) AS lane, partition_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         row_number() OVER (PARTITION BY batch_id % 3 ORDER BY batch_id, partition_id) AS rn
  FROM doc_batches
), fold AS (
  SELECT lane, partition_id, batch_id, payload_bytes, rn, payload_bytes + 232 AS used, CAST(0 AS BIGINT) AS pack_sequence FROM laned WHERE rn = 1
  UNION ALL
  SELECT l.lane, l.partition_id, l.batch_id, l.payload_bytes, l.rn,
         CASE WHEN f.used + l.payload_bytes + 232 > 65536 THEN l.payload_bytes + 232 ELSE f.used + l.payload_bytes + 232 END,
         CASE WHEN f.used + l.payload_bytes + 232 > 65536 THEN f.pack_sequence + 1 ELSE f.pack_sequence END
  FROM fold f JOIN laned l ON l.lane = f.lane AND l.rn = f.rn + 1
)
"""
CHUNKS = """WITH chunks AS (
  SELECT CAST(conv_id % 4 AS INTEGER) AS partition_id, CAST(conv_id AS VARCHAR) AS transaction_id, conv_id, turn, coalesce(strlen(text), 0) AS payload_bytes,
         CAST(row_number() OVER (PARTITION BY conv_id % 4 ORDER BY turn, conv_id) - 1 AS BIGINT) AS first_offset
  FROM conversations
)
"""


def fetched(mode: str) -> str:
    bound = {"ordered": "m.last_stable_offset", "replicated": "least(m.replicated_high_watermark, m.last_stable_offset)", "as_available": None, "recovery": "m.contiguous_log_end"}[mode]
    statuses = "'committed', 'unresolved'" if mode == "recovery" else "'committed'"
    limit = f"AND b.last_offset < {bound}" if bound else ""
    return f"""{LOG}, seen AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.partition_id ORDER BY b.first_offset) AS rn,
         sum(b.payload_bytes) OVER (PARTITION BY b.partition_id ORDER BY b.first_offset) AS upto
  FROM batches b JOIN marks m USING (partition_id) WHERE b.last_offset >= 7 AND b.status IN ({statuses}) {limit}
) SELECT partition_id, batch_id, first_offset, last_offset, record_count, payload_bytes FROM seen WHERE rn = 1 OR upto <= 400"""


def doc_fetch(start: int, budget: int, limit: int) -> str:
    return f"""WITH b AS (
  SELECT CAST(doc_id % 2 AS INTEGER) AS partition_id, CAST(row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS BIGINT) AS batch_id, CAST(strlen(text) AS BIGINT) AS payload_bytes FROM documents
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY batch_id) AS rn, sum(payload_bytes) OVER (PARTITION BY partition_id ORDER BY batch_id) AS upto FROM b WHERE batch_id >= {start}
) SELECT partition_id, batch_id, batch_id AS first_offset, batch_id AS last_offset, CAST(1 AS BIGINT) AS record_count, payload_bytes FROM seen WHERE (rn = 1 OR upto <= {budget}) AND rn <= {limit}"""


def group_visible(open_as: str) -> str:
    return f"""{CHUNKS}, stated AS (
  SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'committed' WHEN conv_id % 3 = 1 THEN 'aborted' ELSE '{open_as}' END AS status FROM chunks
), marks AS (
  SELECT partition_id, coalesce(min(first_offset) FILTER (status = 'unresolved'), max(first_offset) + 1) AS stable FROM stated GROUP BY 1
) SELECT partition_id, first_offset AS batch_id, transaction_id, first_offset FROM stated JOIN marks USING (partition_id) WHERE status = 'committed' AND first_offset < stable"""


APPENDS = """WITH numbered AS (
  SELECT event_id, user_id AS producer_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS first_sequence FROM events
), lost AS (
  SELECT producer_id, min(first_sequence) AS gap FROM numbered WHERE event_id % 211 = 5 GROUP BY 1
), sent AS (
  SELECT n.*, copy FROM numbered n, (VALUES (0), (1)) c(copy) WHERE n.event_id % 211 <> 5 AND (copy = 0 OR n.event_id % 50 = 7)
), judged AS (
  SELECT s.producer_id, s.first_sequence, s.event_id * 2 + copy AS arrival_seq,
         CASE WHEN first_sequence > gap THEN 'out_of_order' WHEN copy = 1 THEN 'duplicate' ELSE 'accepted' END AS outcome
  FROM sent s LEFT JOIN lost USING (producer_id)
)
"""
BOUNDS = (10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 5_000_000_000, 10_000_000_000)
FIELDS = "partition_id, batch_id, first_offset, last_offset, record_count, payload_bytes"

FAILING = """WITH numbered AS (
  SELECT event_id, user_id AS producer_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n FROM events
), failed AS (SELECT producer_id, min(n) AS f, min(event_id) AS fe FROM numbered WHERE event_id % 53 = 11 GROUP BY 1
), rows AS (SELECT * FROM numbered LEFT JOIN failed USING (producer_id)
), judged AS (
  SELECT producer_id, CAST(0 AS BIGINT) AS epoch, n AS first_sequence, event_id * 4 AS arrival_seq, f, CASE WHEN f IS NULL OR n <= f THEN 'accepted' WHEN n = f + 1 THEN 'requires_new_epoch' ELSE 'stale_epoch' END AS outcome FROM rows
  UNION ALL SELECT producer_id, 0, n, event_id * 4 + 1, f, 'requires_new_epoch' FROM rows WHERE n = f
  UNION ALL SELECT producer_id, 0, n, fe * 4 + 2, f, 'duplicate' FROM rows WHERE n = f - 1
  UNION ALL SELECT producer_id, 1, n, event_id * 4 + 3, f, 'accepted' FROM rows WHERE n > f
)
"""
ASKED = LOG + """, asked AS (
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey % 6 - 1 AS INTEGER) AS pid, CAST(n_nationkey * 3 - 2 AS BIGINT) AS fetch_offset, CAST(n_nationkey % 5 * 90 - 30 AS BIGINT) AS max_bytes FROM nation
), checked AS (
  SELECT a.*, m.replicated_high_watermark AS hw, CASE WHEN m.partition_id IS NOT NULL THEN CAST(5 AS BIGINT) END AS start, pid >= 0 AND fetch_offset >= 0 AND max_bytes > 0 AND pid NOT IN (2, 4) AS shown,
    CASE WHEN pid < 0 OR fetch_offset < 0 OR max_bytes <= 0 THEN 'OFFSET_OUT_OF_RANGE' WHEN pid IN (2, 4) THEN 'NOT_LEADER_OR_FOLLOWER' WHEN fetch_offset < 5 THEN 'OFFSET_OUT_OF_RANGE' END AS error
  FROM asked a LEFT JOIN marks m ON m.partition_id = a.pid
)
"""
STORED = """WITH stored AS (SELECT doc_id, coalesce(text, '') AS text, CAST(row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS BIGINT) AS batch_id FROM documents)
"""

SQL: dict[str, str] = {
    "reserve_offsets": """WITH r AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS partition_id, 1 + doc_id % 5 AS n FROM documents), w AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY partition_id ORDER BY doc_id) - 1 AS BIGINT) AS batch_id, CAST(sum(n) OVER (PARTITION BY partition_id ORDER BY doc_id) AS BIGINT) AS upto FROM r
) SELECT partition_id, batch_id, upto - n AS first_offset, upto - 1 AS last_offset, batch_id AS sequence FROM w""",
    "lane_placement": LOG + "SELECT partition_id, batch_id, CAST(batch_id % 3 AS INTEGER) AS lane, CAST(1 AS BIGINT) AS ring_epoch FROM batches",
    "lane_placement_after_ring_change": LOG + "SELECT partition_id, batch_id, CAST(CASE WHEN batch_id >= 10 THEN 3 + batch_id % 4 ELSE batch_id % 3 END AS INTEGER) AS lane, CAST(CASE WHEN batch_id >= 10 THEN 2 ELSE 1 END AS BIGINT) AS ring_epoch FROM batches",
    "pack_assignment": DOCS + "SELECT lane, pack_sequence, partition_id, batch_id FROM fold",
    "gap_fill_aborts": LOG + """, kept AS (
  SELECT partition_id, batch_id, first_offset, lag(batch_id, 1, -1) OVER w AS b, lag(last_offset, 1, -1) OVER w AS o FROM batches WHERE batch_id % 11 NOT IN (4, 5) WINDOW w AS (PARTITION BY partition_id ORDER BY batch_id)
), gaps AS (SELECT partition_id, b, o, batch_id - b - 1 AS n, first_offset - o - 1 AS m FROM kept WHERE batch_id - b > 1), each_one AS (SELECT *, unnest(range(n)) AS k FROM gaps)
SELECT partition_id, CAST(b + 1 + k AS BIGINT) AS batch_id, CAST(o + 1 + k * (m // n) + least(k, m % n) AS BIGINT) AS first_offset,
       CAST(o + (k + 1) * (m // n) + least(k + 1, m % n) AS BIGINT) AS last_offset, CAST(m // n + CASE WHEN k < m % n THEN 1 ELSE 0 END AS BIGINT) AS record_count FROM each_one""",
    "partition_watermarks": LOG + "SELECT * FROM marks",
    **{f"{mode}_fetch": fetched(mode) for mode in ("ordered", "replicated", "as_available", "recovery")},
    "uneven_fetch": doc_fetch(11, 20_000, 1_000_000_000),
    "embedded_read": doc_fetch(3, 50_000, 7),
    "batch_count_limited_fetch": LOG + f"SELECT {FIELDS} FROM batches WHERE batch_id < 10",
    "point_read": LOG + f"SELECT {FIELDS} FROM batches WHERE partition_id = 2 AND batch_id = 9",
    "catalog_scan": LOG + "SELECT partition_id, batch_id, first_offset, last_offset FROM batches ORDER BY 1, 3",
    "retained_payload_bytes": LOG + "SELECT m.partition_id, CAST(coalesce(sum(b.payload_bytes) FILTER (b.status = 'committed' AND b.last_offset < m.last_stable_offset), 0) AS BIGINT) AS payload_bytes FROM marks m LEFT JOIN batches b USING (partition_id) GROUP BY 1",
    "list_offsets": LOG + "SELECT partition_id, log_start AS earliest, replicated_high_watermark AS latest FROM marks",
    "producer_dedup_outcome": APPENDS + "SELECT producer_id, first_sequence, arrival_seq, outcome FROM judged",
    "producer_progress": APPENDS + "SELECT producer_id, CAST(0 AS BIGINT) AS epoch, max(first_sequence) + 1 AS next_sequence, false AS requires_new_epoch FROM judged WHERE outcome = 'accepted' GROUP BY 1",
    "producer_gaps": APPENDS + ", linked AS (SELECT producer_id, first_sequence, coalesce(lag(first_sequence) OVER (PARTITION BY producer_id ORDER BY first_sequence) + 1, 0) AS expected FROM sent WHERE copy = 0) SELECT producer_id, first_sequence, CAST(expected AS BIGINT) AS expected FROM linked WHERE first_sequence <> expected",
    "atomic_group_inspect": CHUNKS + """SELECT partition_id, transaction_id, CASE WHEN conv_id % 3 = 0 THEN 'committed' WHEN conv_id % 3 = 1 THEN 'aborted' ELSE 'open' END AS state, CAST(count(*) AS BIGINT) AS chunk_count,
  CAST(count(*) AS BIGINT) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, min(first_offset) AS first_offset, max(first_offset) AS last_offset, min(turn) = 0 AND max(turn) + 1 = count(*) AS dense FROM chunks GROUP BY partition_id, transaction_id, conv_id""",
    "atomic_group_open_visibility": group_visible("unresolved"),
    "atomic_group_commit_visibility": group_visible("committed"),
    "atomic_group_abort_visibility": group_visible("aborted"),
    "retention_truncate": LOG + "SELECT partition_id, batch_id, first_offset FROM batches JOIN marks USING (partition_id) WHERE first_offset >= (last_stable_offset // 10) * 5",
    "retention_errors": LOG + """, asked AS (SELECT partition_id, unnest([10, 12, last_stable_offset + 5, 0]) AS log_start, last_stable_offset FROM marks)
SELECT a.partition_id, CAST(a.log_start AS BIGINT) AS log_start, CASE WHEN a.log_start < 5 THEN 'moves_back' WHEN a.log_start > a.last_stable_offset THEN 'beyond_stable'
  WHEN b.first_offset IS NULL AND a.log_start <> a.last_stable_offset AND a.log_start <> 5 THEN 'not_a_boundary' END AS error FROM asked a LEFT JOIN batches b ON b.partition_id = a.partition_id AND b.first_offset = a.log_start""",
    "gc_removable_packs": DOCS + """, starts AS (SELECT partition_id, count(*) // 2 AS log_start FROM fold GROUP BY 1), packs AS (
  SELECT lane, pack_sequence, bool_and(batch_id < log_start) AS gone, CAST(count(*) AS BIGINT) AS extents, CAST(sum(payload_bytes) AS BIGINT) AS bytes FROM fold JOIN starts USING (partition_id) GROUP BY 1, 2
) SELECT lane, pack_sequence, extents, bytes FROM packs WHERE gone AND pack_sequence < (SELECT max(pack_sequence) FROM packs p WHERE p.lane = packs.lane)""",
    "tier_coverage": DOCS + "SELECT partition_id, coalesce(min(batch_id) FILTER (pack_sequence % 7 = 6), max(batch_id) + 1) AS covered_through FROM fold GROUP BY 1",
    "object_durable_batches": DOCS + "SELECT partition_id, batch_id, pack_sequence % 7 <> 6 AS object_durable FROM fold",
    "replica_progress": LOG + "SELECT partition_id, batch_id, greatest(durable_replicas, 1) AS durable_replicas FROM batches WHERE status IN ('committed', 'unresolved')",
    "recovered_partitions": LOG + "SELECT DISTINCT '1' AS topic_id, partition_id FROM batches",
    "ring_validation": LOG + """, placed AS (SELECT partition_id, batch_id, CASE WHEN batch_id >= 10 THEN 2 ELSE 1 END AS ring_epoch, CASE WHEN batch_id >= 10 THEN 3 + batch_id % 4 ELSE batch_id % 3 END AS right_lane FROM batches)
SELECT partition_id, CAST(ring_epoch AS BIGINT) AS ring_epoch, CAST(count(*) AS BIGINT) AS batches, CAST(count(*) FILTER (batch_id % 13 = 0 AND right_lane <> 0) AS BIGINT) AS mismatches FROM placed GROUP BY 1, 2""",
    "log_bounds": LOG + "SELECT partition_id, min(first_offset) AS first_offset, max(last_offset) + 1 AS next_offset, true AS dense FROM batches GROUP BY 1",
    "lane_kway_merge": LOG + "SELECT partition_id, first_offset, CAST(batch_id % 3 AS INTEGER) AS lane, batch_id FROM batches",
    "cursor_pages": LOG + """, walk AS (
  SELECT partition_id, batch_id, first_offset, last_offset, payload_bytes AS used, CAST(0 AS BIGINT) AS page FROM batches WHERE batch_id = 0
  UNION ALL
  SELECT b.partition_id, b.batch_id, b.first_offset, b.last_offset, CASE WHEN w.used + b.payload_bytes > 400 THEN b.payload_bytes ELSE w.used + b.payload_bytes END, CASE WHEN w.used + b.payload_bytes > 400 THEN w.page + 1 ELSE w.page END
  FROM walk w JOIN batches b ON b.partition_id = w.partition_id AND b.batch_id = w.batch_id + 1
) SELECT partition_id, page, min(first_offset) AS first_offset, max(last_offset) + 1 AS next_offset FROM walk GROUP BY 1, 2""",
    "request_validation": "SELECT doc_id AS request_id, CASE WHEN doc_id % 7 = 0 THEN 'ZeroRecordCount' WHEN strlen(text) > 4096 THEN 'PayloadTooLarge' ELSE 'accepted' END AS outcome FROM documents",
    "topic_bindings": """SELECT CAST(n_nationkey AS VARCHAR) AS logical_topic_id, CASE WHEN n_regionkey = 1 THEN 'active_active' ELSE 'active_passive' END AS mode,
  n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AND NOT ((n_nationkey % 5 > 1 OR n_regionkey = 1) AND n_nationkey % 2 <> 0)
  AND CASE WHEN n_nationkey % 5 = 2 THEN regexp_full_match('p-' || n_name, '[A-Za-z0-9._-]{1,128}') WHEN n_nationkey % 5 = 3 THEN false ELSE true END AS valid FROM nation""",
    "health_rollup": LOG + "SELECT CAST(max(partition_id) + 1 AS BIGINT) AS leader_epoch, min(last_stable_offset) AS visible_end, min(replicated_high_watermark) AS replicated_end, CAST(count(*) AS BIGINT) AS partitions, '1,2,3,4,7' AS isr FROM marks",
    "readiness_blockers": "SELECT * FROM (VALUES ('lifecycle', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER)), ('low_disk_space', NULL, NULL), ('health_probe_failed', NULL, NULL), ('assignment_stale', NULL, NULL), ('insufficient_isr', '1', 3), ('write_fenced', '1', 1)) t(reason, topic_id, partition_id)",
    "latency_quantiles": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT max(value) FILTER (i = ceil((n - 1) * 0.5::DOUBLE)) AS p50, max(value) FILTER (i = ceil((n - 1) * 0.95::DOUBLE)) AS p95, max(value) FILTER (i = ceil((n - 1) * 0.99::DOUBLE)) AS p99, max(value) FILTER (i = ceil((n - 1) * 0.999::DOUBLE)) AS p999, max(value) AS max FROM s""",
    "stage_histogram": "WITH e AS (SELECT event_type, CAST(floor(value * 100000) AS BIGINT) AS nanos FROM events), b AS (SELECT unnest(" + repr([*BOUNDS, -1]) + ") AS bound) SELECT event_type AS stage, CAST(bound AS BIGINT) AS bound, CAST(count(*) FILTER (bound < 0 OR nanos <= bound) AS BIGINT) AS observations FROM e, b GROUP BY 1, 2",
    "throughput": LOG + "SELECT count(*) / 4.0::DOUBLE AS batches_per_second, CAST(sum(record_count) AS BIGINT) / 4.0::DOUBLE AS records_per_second, CAST(sum(payload_bytes) AS BIGINT) / 1048576::DOUBLE / 4.0::DOUBLE AS mib_per_second FROM batches",
    "acknowledged_batches": LOG + """SELECT partition_id, batch_id, ['leader', 'quorum', 'all_replicas', 'object'][batch_id % 4 + 1] AS durability,
  CASE batch_id % 4 WHEN 0 THEN durable_replicas >= 1 WHEN 1 THEN durable_replicas >= 2 WHEN 2 THEN durable_replicas >= 3 ELSE batch_id % 3 = 0 END AS acknowledged FROM batches""",
    "hosted_partitions": LOG + "SELECT DISTINCT '1' AS topic_id, partition_id FROM batches WHERE partition_id IN (1, 2)",
    "recovered_statuses": CHUNKS + "SELECT partition_id, CASE conv_id % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'aborted' ELSE 'unresolved' END AS status, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM chunks GROUP BY 1, 2",
    "replication_backlog": LOG + "SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(coalesce(sum(payload_bytes), 0) AS BIGINT) AS bytes, min(e0) AS oldest FROM batches WHERE status <> 'aborted' AND durable_replicas < 3",
    "spellings": """WITH n AS (SELECT ['leader', 'async', 'sync-quorum', 'all', 'object', 'as_available', 'ordered', 'replicated', 'none'][event_id % 9 + 1] AS name, count(*) AS n FROM events GROUP BY 1)
SELECT name, CAST(n AS BIGINT) AS n, CASE WHEN name IN ('leader', 'async') THEN 'leader' WHEN name = 'sync-quorum' THEN 'quorum' WHEN name = 'all' THEN 'all_replicas' WHEN name = 'object' THEN 'object' END AS durability,
  CASE WHEN name IN ('ordered', 'replicated', 'as_available') THEN name END AS fetch_mode FROM n""",
    "producer_failures": FAILING + "SELECT producer_id, epoch, first_sequence, arrival_seq, outcome FROM judged",
    "producer_failure_progress": FAILING + "SELECT producer_id, max(epoch) AS epoch, max(first_sequence) + 1 AS next_sequence, coalesce(max(f) = max(n), false) AS requires_new_epoch FROM (SELECT *, max(first_sequence) OVER (PARTITION BY producer_id) AS n FROM judged) WHERE outcome = 'accepted' GROUP BY 1",
    "atomic_chunk_outcomes": """WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS i FROM conversations), c AS (
  SELECT t.*, copy FROM t, (VALUES (0), (1), (2)) v(copy) WHERE NOT (conv_id % 7 = 3 AND i = 1) AND (copy = 0 OR (copy = 1 AND i % 2 = 0) OR (copy = 2 AND conv_id % 5 = 2 AND i = 0))
) SELECT CAST(conv_id AS VARCHAR) AS transaction_id, i AS chunk_sequence, i * 3 + copy AS arrival_seq,
  CASE WHEN conv_id % 11 = 5 THEN 'finalized' WHEN conv_id % 7 = 3 AND i > 1 THEN 'out_of_order' WHEN copy = 0 THEN 'accepted' WHEN copy = 1 THEN 'duplicate' ELSE 'chunk_mismatch' END AS outcome FROM c""",
    "group_finish_blockers": CHUNKS + """SELECT transaction_id, CASE WHEN bool_or(first_offset % 29 = 7) THEN 'ReplicaInFlight' ELSE 'DurabilityUnavailable' END AS committed_blocker, CASE WHEN bool_or(first_offset % 29 = 7) THEN 'ReplicaInFlight' END AS aborted_blocker
  FROM chunks GROUP BY 1 HAVING bool_or(first_offset % 29 = 7 OR first_offset % 3 = 0)""",
    "protocol_produce_checks": """SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN 'all_replicas' WHEN event_id % 4 < 3 THEN 'leader' END AS durability,
  CASE WHEN event_id % 13 = 0 THEN 'UNSUPPORTED_FOR_MESSAGE_FORMAT' WHEN event_id % 6 = 0 THEN 'UNKNOWN_TOPIC_OR_PARTITION' WHEN event_id % 6 IN (3, 5) THEN 'NOT_LEADER_OR_FOLLOWER' WHEN event_id % 4 = 3 THEN 'INVALID_REQUIRED_ACKS'
    WHEN event_id % 17 = 0 THEN 'INVALID_RECORD' WHEN event_id % 19 = 0 THEN 'CORRUPT_MESSAGE' END AS error, event_id % 4 <> 1 AS answered FROM events""",
    "protocol_list_offsets": LOG + """, r AS (SELECT event_id AS request_id, CAST(event_id % 6 - 1 AS INTEGER) AS partition_id, -(event_id % 4) AS ts FROM events), j AS (
  SELECT r.*, m.*, CASE WHEN r.partition_id < 0 THEN 'UNKNOWN_TOPIC_OR_PARTITION' WHEN r.partition_id IN (2, 4) THEN 'NOT_LEADER_OR_FOLLOWER' WHEN ts NOT IN (-1, -2) THEN 'UNSUPPORTED_VERSION' END AS error FROM r LEFT JOIN marks m ON m.partition_id = r.partition_id
) SELECT request_id, CASE WHEN error IS NOT NULL THEN -1 WHEN ts = -2 THEN log_start ELSE replicated_high_watermark END AS "offset", error FROM j""",
    "protocol_fetch_checks": ASKED + "SELECT request_id, least(max_bytes, 200) AS bytes, CASE WHEN shown THEN hw END AS high_watermark, CASE WHEN shown THEN hw END AS last_stable_offset, CASE WHEN shown THEN start END AS log_start, error FROM checked",
    "protocol_fetch": ASKED + """, seen AS (
  SELECT c.request_id, least(c.max_bytes, 200) AS bytes, b.*, row_number() OVER w AS rn, sum(b.payload_bytes) OVER w AS upto FROM checked c JOIN batches b ON b.partition_id = c.pid JOIN marks m ON m.partition_id = b.partition_id
  WHERE c.error IS NULL AND b.last_offset >= c.fetch_offset AND b.status = 'committed' AND b.last_offset < least(m.replicated_high_watermark, m.last_stable_offset) WINDOW w AS (PARTITION BY c.request_id ORDER BY b.first_offset)
) SELECT request_id, """ + FIELDS + " FROM seen WHERE rn = 1 OR upto <= bytes",
    "protocol_metadata": LOG + """, p AS (SELECT DISTINCT partition_id FROM batches)
SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'UNKNOWN_TOPIC_OR_PARTITION' END AS topic_error, partition_id, CASE WHEN partition_id <> 3 THEN partition_id END AS leader,
  CASE WHEN partition_id <> 3 THEN partition_id || ',' || (partition_id + 1) END AS replicas, CASE WHEN partition_id <> 3 THEN partition_id || ',' || (partition_id + 1) END AS isr, CASE WHEN partition_id = 3 THEN 'UNKNOWN_TOPIC_OR_PARTITION' END AS error
FROM nation LEFT JOIN p ON n_nationkey % 3 <> 0""",
    "dense_index": LOG + """SELECT partition_id, CAST(log_offset + CASE WHEN event_id % 23 = 9 AND copy = 0 THEN 1 ELSE 0 END AS BIGINT) AS key, event_id * 2 + copy AS arrival_seq, CAST(log_offset AS BIGINT) AS expected,
  CASE WHEN event_id % 23 = 9 AND copy = 0 THEN 'out_of_order' ELSE 'accepted' END AS outcome FROM records, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 23 = 9""",
    "sparse_index": "SELECT user_id, arg_max(event_type, event_id) AS event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS ordinal FROM events GROUP BY 1",
    "replica_append_outcomes": LOG + """, s AS (SELECT b.*, copy, copy = 1 AND e0 % 11 = 0 AS changed FROM batches b, (VALUES (0), (1)) c(copy) WHERE NOT (partition_id = 0 AND batch_id = 300) AND (copy = 0 OR e0 % 7 = 0))
SELECT partition_id, batch_id, batch_id * 2 + copy AS arrival_seq, CASE WHEN batch_id < 40 AND status = 'aborted' THEN 'retried' WHEN batch_id < 40 AND changed THEN 'corrupt' WHEN batch_id < 40 AND status = 'pending' THEN 'in_flight' WHEN batch_id < 40 THEN 'duplicate'
  WHEN partition_id = 0 AND batch_id > 300 THEN 'fenced' WHEN copy = 0 THEN 'reserved' WHEN changed THEN 'corrupt' ELSE 'in_flight' END AS outcome FROM s""",
    "recovery_replay": LOG + "SELECT partition_id, batch_id, first_offset, first_offset // 65536 AS stretch FROM batches JOIN marks USING (partition_id) WHERE status IN ('committed', 'unresolved') AND last_offset < contiguous_log_end",
    "journal_violations": """WITH j AS (SELECT event_id AS event_no, CAST(user_id % 4 AS INTEGER) AS partition_id, event_id // 20 AS ring_epoch, event_id - CASE WHEN event_id % 31 = 1 THEN 40 ELSE 0 END AS log_start FROM events)
SELECT event_no, partition_id, 'ring_epoch' AS violation FROM (SELECT *, lag(ring_epoch) OVER (PARTITION BY partition_id ORDER BY event_no) AS before FROM j WHERE event_no % 3 = 0) WHERE ring_epoch <= before
UNION ALL SELECT event_no, partition_id, 'log_start' FROM (SELECT *, lag(log_start) OVER (PARTITION BY partition_id ORDER BY event_no) AS before FROM j WHERE event_no % 3 = 1) WHERE log_start < before""",
    "fenced_appends": "SELECT event_id AS request_id, CASE WHEN event_id % 5 <> 0 AND event_id % 4 < user_id % 4 THEN 'Fenced' ELSE 'accepted' END AS outcome FROM events",
    "request_values": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders), n AS (SELECT *, '1844674407370955' || substr(lpad(k, 4, '9'), 1, 4) AS big FROM o)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN CAST(big AS HUGEINT) <= 18446744073709551615 THEN big END ELSE k END AS number,
  CASE WHEN length(k) % 2 = 0 THEN k END AS hex, NOT (o_orderkey % 2 <> 0 AND o_orderkey % 7 = 0) AS producer_complete FROM n""",
    "frame_roundtrip": STORED + "SELECT doc_id, CAST(batch_id AS VARCHAR) AS batch_id, batch_id AS first_offset, batch_id AS last_offset, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) END AS transaction_id, sha256(text) AS payload_sha256 FROM stored",
    "extent_roundtrip": STORED + "SELECT doc_id, CAST(batch_id AS VARCHAR) AS batch_id, batch_id AS first_offset, CAST(strlen(text) AS BIGINT) AS payload_bytes, sha256(text) AS payload_sha256 FROM stored",
    "record_batch_scan": LOG + "SELECT r.partition_id, CAST(log_offset // 5 AS BIGINT) AS batch_id, CAST(log_offset AS BIGINT) AS record_offset, props AS value, CAST(log_offset AS INTEGER) AS producer_sequence FROM records r JOIN events USING (event_id)",
    "stream_sequencer": """WITH r AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS partition_id, 1 + doc_id % 5 AS n FROM documents), w AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY partition_id ORDER BY doc_id) - 1 AS BIGINT) AS batch_id, CAST(sum(n) OVER (PARTITION BY partition_id ORDER BY doc_id) AS BIGINT) AS upto FROM r
) SELECT partition_id, doc_id AS arrival_seq, batch_id, upto - n AS first_offset, upto - 1 AS last_offset FROM w""",
    "stream_reorder": LOG + "SELECT partition_id, batch_id, CAST(e0 AS VARCHAR) AS payload, 'released' AS outcome FROM batches",
    "error_status": """SELECT kind, CASE WHEN kind = 'InvalidConfig' THEN 400 WHEN kind = 'UnknownPartition' THEN 404 WHEN kind = 'OffsetOutOfRange' THEN 416 WHEN kind IN ('AdmissionLimited', 'WorkerStopped', 'DurabilityUnavailable', 'ObjectDurabilityUnavailable', 'ReplicaInFlight') THEN 503 WHEN kind IN ('CorruptState', 'Storage') THEN 500 ELSE 409 END AS http,
  CASE WHEN kind = 'InvalidConfig' THEN 'INVALID_ARGUMENT' WHEN kind LIKE 'Unknown%' THEN 'NOT_FOUND' WHEN kind IN ('AdmissionLimited', 'ReplicaReorderLimited', 'ReplicaBufferLimited', 'ReplicaInFlight', 'WorkerStopped', 'DurabilityUnavailable', 'ObjectDurabilityUnavailable') THEN 'UNAVAILABLE'
    WHEN kind = 'OffsetOutOfRange' THEN 'OUT_OF_RANGE' WHEN kind = 'UnsupportedDurability' THEN 'UNIMPLEMENTED' WHEN kind IN ('CorruptState', 'Storage') THEN 'INTERNAL' ELSE 'FAILED_PRECONDITION' END AS rpc,
  CASE WHEN kind IN ('UnknownPartition', 'UnknownShard') THEN 'UNKNOWN_TOPIC_OR_PARTITION' WHEN kind IN ('AdmissionLimited', 'ReplicaReorderLimited', 'ReplicaBufferLimited', 'ReplicaInFlight') THEN 'THROTTLING_QUOTA_EXCEEDED' WHEN kind IN ('WorkerStopped', 'ObjectDurabilityUnavailable') THEN 'NOT_ENOUGH_REPLICAS'
    WHEN kind = 'DurabilityUnavailable' THEN 'NOT_ENOUGH_REPLICAS_AFTER_APPEND' WHEN kind = 'OffsetOutOfRange' THEN 'OFFSET_OUT_OF_RANGE' WHEN kind = 'RetentionPinned' THEN 'POLICY_VIOLATION' WHEN kind = 'StaleProducerEpoch' THEN 'INVALID_PRODUCER_EPOCH'
    WHEN kind IN ('ProducerSequenceOutOfOrder', 'ProducerRequiresNewEpoch', 'DuplicateSequenceMismatch') THEN 'OUT_OF_ORDER_SEQUENCE_NUMBER' WHEN kind = 'Fenced' THEN 'NOT_LEADER_OR_FOLLOWER' WHEN kind = 'UnsupportedDurability' THEN 'UNSUPPORTED_VERSION' WHEN kind = 'TopicAlreadyExists' THEN 'TOPIC_ALREADY_EXISTS'
    WHEN kind IN ('CorruptState', 'Storage') THEN 'UNKNOWN_SERVER_ERROR' ELSE 'INVALID_REQUEST' END AS protocol
FROM (SELECT unnest(['InvalidConfig', 'UnknownPartition', 'UnknownShard', 'UnknownAtomicGroup', 'TopicAlreadyExists', 'AdmissionLimited', 'ReplicaReorderLimited', 'ReplicaBufferLimited', 'ReplicaInFlight', 'WorkerStopped', 'DurabilityUnavailable', 'ObjectDurabilityUnavailable', 'UnsupportedDurability', 'OffsetOutOfRange', 'RetentionPinned', 'Fenced',
  'StaleProducerEpoch', 'ProducerSequenceOutOfOrder', 'ProducerRequiresNewEpoch', 'DuplicateSequenceMismatch', 'AtomicGroupFinalized', 'AtomicGroupSequenceOutOfOrder', 'AtomicGroupChunkMismatch', 'Sequencer', 'CorruptState', 'Storage']) AS kind)""",
    "sync_groups": DOCS + "SELECT lane, partition_id, batch_id, CAST((rn - 1) // 128 AS BIGINT) AS write_group, CAST((rn - 1) // 1024 AS BIGINT) AS sync FROM laned",
    "sealed_packs": DOCS + """, p AS (SELECT lane, pack_sequence, min(batch_id) AS opened FROM fold GROUP BY 1, 2)
SELECT lane, pack_sequence, opened, pack_sequence < max(pack_sequence) OVER (PARTITION BY lane) OR (SELECT max(batch_id) FROM fold) - opened >= 20 AS sealed FROM p""",
    "duplicate_follow_ups": LOG + """SELECT partition_id, batch_id, ['leader', 'quorum', 'all_replicas', 'object'][batch_id % 4 + 1] AS durability,
  CASE WHEN batch_id % 4 = 3 AND batch_id % 3 <> 0 THEN 'ObjectDurabilityUnavailable' WHEN batch_id % 5 = 0 THEN CASE WHEN durable_replicas >= [1, 2, 3, 1][batch_id % 4 + 1] THEN 'receipt' ELSE 'DurabilityUnavailable' END
    WHEN durable_replicas >= [3, 2, 3, 3][batch_id % 4 + 1] THEN 'receipt' ELSE 'replicate' END AS follow_up FROM batches""",
    "partition_roles": LOG + "SELECT DISTINCT '1' AS topic_id, partition_id, CASE WHEN partition_id <> 3 THEN partition_id END AS leader, CASE WHEN partition_id <> 3 THEN CAST(partition_id + 10 AS BIGINT) END AS leader_epoch, ['none', 'follower', 'leader', 'unassigned'][partition_id + 1] AS role FROM batches",
    "observed_leader_epochs": """WITH r AS (SELECT event_id AS report_no, CAST(user_id % 4 AS INTEGER) AS partition_id, event_id // 50 - CASE WHEN event_id % 17 = 3 THEN 2 ELSE 0 END AS epoch FROM events), m AS (SELECT *, max(epoch) OVER (PARTITION BY partition_id ORDER BY report_no) AS top FROM r)
SELECT report_no, partition_id, CASE WHEN epoch < top THEN 'Fenced' ELSE 'accepted' END AS outcome, top AS current FROM m""",
    "request_counters": LOG + "SELECT count(*) AS requests, count(*) FILTER (status = 'aborted') AS errors, count(*) FILTER (status <> 'aborted' AND batch_id % 2 = 0) AS appended_batches, CAST(coalesce(sum(payload_bytes) FILTER (status <> 'aborted' AND batch_id % 2 = 0), 0) AS BIGINT) AS appended_bytes, count(*) FILTER (status <> 'aborted' AND batch_id % 2 = 1) AS fetched_batches, CAST(coalesce(sum(payload_bytes) FILTER (status <> 'aborted' AND batch_id % 2 = 1), 0) AS BIGINT) AS fetched_bytes FROM batches",
    "batch_transitions": LOG + "SELECT partition_id, status, CASE WHEN status = 'aborted' THEN 'aborted' ELSE 'committed' END AS after, CAST(count(*) AS BIGINT) AS batches FROM batches GROUP BY 1, 2, 3",
    "cursor_positions": "SELECT CAST(n_nationkey AS VARCHAR) AS topic_id, CAST(n_nationkey % 4 AS BIGINT) AS partition_id, CAST(n_nationkey * 1000 AS BIGINT) AS next_offset, 52 AS cursor_bytes FROM nation",
    "record_counts": LOG + "SELECT partition_id, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT log_offset // 5) AS BIGINT) AS batches FROM records GROUP BY 1",
    "pack_scan": DOCS + ", texts AS (SELECT CAST(doc_id % 2 AS INTEGER) AS partition_id, CAST(row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS BIGINT) AS batch_id, sha256(coalesce(text, '')) AS payload_sha256 FROM documents) SELECT lane, pack_sequence, partition_id, batch_id, batch_id AS first_offset, payload_sha256 FROM fold JOIN texts USING (partition_id, batch_id)",
    "journal_scan": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS event_no, 'truncate' AS kind, CAST(n_nationkey AS VARCHAR) AS topic_id, CAST(n_regionkey AS BIGINT) AS partition_id, CAST(n_nationkey * 10 AS BIGINT) AS log_start FROM nation",
    "store_append_read": STORED + "SELECT CAST(doc_id % 2 AS INTEGER) AS partition_id, batch_id, batch_id AS first_offset, CAST(batch_id % 3 AS INTEGER) AS lane, sha256(text) AS payload_sha256 FROM stored",
    "stream_producer_check": APPENDS + "SELECT producer_id, arrival_seq, outcome FROM judged",
}
