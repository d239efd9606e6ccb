"""Durability needs, assignments, lifecycle, admission, retries, identity."""

import pytest

from tidelog.operators import admission


def test_acknowledged(spark):
    rows = [(0, 0, "leader", 3, 2), (0, 1, "quorum", 3, 2), (0, 2, "all_replicas", 3, 2), (0, 3, "object", 3, 2), (0, 4, "quorum", 3, 2)]
    batches = spark.createDataFrame([(*r, r[1] == 3) for r in rows], "partition_id int, batch_id long, durability string, replication_factor int, min_isr int, object_durable boolean")
    acks = spark.createDataFrame([(0, i, n) for i in range(4) for n in (1, 2)], "partition_id int, batch_id long, durable_replicas int")
    got = {r["batch_id"]: r["acknowledged"] for r in admission.acknowledged(batches, acks).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}
    assert [admission.duplicate_follow_up(*a) for a in (("object", 0, 1, False), ("object", 0, 1, True), ("quorum", 1, 2, False), ("quorum", 2, 2, False))] == ["ObjectDurabilityUnavailable", "receipt", "replicate", "receipt"]


def test_assignments_and_fencing(spark):
    parts = spark.createDataFrame([("1", p) for p in range(3)], "topic_id string, partition_id int")
    assigned = spark.createDataFrame([("1", 0, [1, 2], 1), ("1", 1, [2, 3], 2), ("1", 2, [1, 3], 3)], "topic_id string, partition_id int, replicas array<int>, leader int")
    assert [r["partition_id"] for r in admission.hosted(parts, assigned, 1).orderBy("partition_id").collect()] == [0, 2]
    assert [r["partition_id"] for r in admission.hosted(parts, assigned, 1, leaders_only=True).collect()] == [0]
    asked = spark.createDataFrame([("1", 0, 1), ("1", 0, 2), ("1", 1, None)], "topic_id string, partition_id int, leader_epoch long")
    epochs = spark.createDataFrame([("1", 0, 2)], "topic_id string, partition_id int, leader_epoch long")
    assert sorted(r["outcome"] for r in admission.fenced(asked, epochs).collect()) == ["Fenced", "accepted", "accepted"]
    assert admission.error_status(spark).where("http = 416").count() == 1


def test_models():
    c = admission.BoundedChannel(2, 10)
    assert [c.send("a", 8), c.send("b", 3), c.send("c", 11)] == ["sent", "full", "too_large"]
    assert c.receive() == ("a", 8) and c.send("b", 3) == "full"
    c.release(8)
    assert c.send("b", 3) == "sent"
    c.open = False
    assert c.send("d", 1) == "closed"
    assert admission.moved("recovering", "ready") == "ready"
    with pytest.raises(ValueError):
        admission.moved("stopped", "ready")
    assert [admission.retry_delay_ms(*a) for a in ((0, 429, None), (2, 503, None), (0, 503, 2), (0, 404, None))] == [10.0, 40.0, 2000, None]
    one = admission.next_identity(None, 4)
    assert b'"incarnation": 2' in admission.next_identity(one, 4)
    with pytest.raises(ValueError):
        admission.next_identity(one, 5)
    with pytest.raises(ValueError):
        admission.next_identity(b"x" + one[1:], 4)
