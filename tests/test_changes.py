"""Upkeep by signed changes against recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from chronolake.operators import changes
from chronolake.operators.changes import ChangeLog
from chronolake.sources.snapshots import Snapshots, Stale

CHANGE = "id long, seq long, op string, image_hash string, kind string"


def state(log):
    live = {r["id"]: (r["image_hash"], r["kind"]) for r in log.live().collect()}
    hashes = {r["image_hash"]: r["n"] for r in log.hash_counts().collect()}
    kinds = {r["kind"]: r["n"] for r in log.kind_counts().collect()}
    return live, hashes, kinds, {(r["what"], r["subject_key"]) for r in log.cleanup().collect()}


def count(values):
    out = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def test_upkeep_equals_recomputation(spark, tmp_path):
    rng = random.Random(5)
    log = ChangeLog(Snapshots(spark, f"file://{tmp_path}/s"))
    live, ever, epochs = {}, set(), {}
    for step in range(8):
        if step == 5:
            log.compact()
            log.store.vacuum()
        rows = [(rng.randrange(25), i, rng.choice(["put", "put", "delete"]), rng.choice("abcdef"), rng.choice("xyz")) for i in range(rng.choice([0, 3, 20]))]
        log.apply(spark.createDataFrame([*rows, (None, 0, "put", "a", "x")], CHANGE))
        before = dict(live)
        for i, _, op, h, k in {r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values():
            if op == "put":
                live[i] = (h, k)
            else:
                live.pop(i, None)
        ever |= {("text", str(i)) for i in before} | {("image", h) for h, _ in before.values()}
        moved = {k for i in before.keys() | live.keys() if before.get(i) != live.get(i) for r in (before.get(i), live.get(i)) if r for k in (r[1],)}
        for k in moved:
            epochs[k] = epochs.get(k, 0) + 1
        here = {("text", str(i)) for i in live} | {("image", h) for h, _ in live.values()}
        got = state(log)
        assert got[:3] == (live, count(h for h, _ in live.values()), count(k for _, k in live.values())), step
        assert got[3] == ever - here, step
        assert {k: log.epoch(k) for k in "xyz"} == {k: epochs.get(k, 0) for k in "xyz"}, step


def test_a_batch_that_was_overtaken_is_refused(spark, tmp_path, monkeypatch):
    log = ChangeLog(Snapshots(spark, f"file://{tmp_path}/s"))
    log.apply(spark.createDataFrame([(1, 0, "put", "a", "x")], CHANGE))
    stage, other = log.store.stage, ChangeLog(Snapshots(spark, log.store.path))

    def slow(df, partition_by=()):
        monkeypatch.setattr(log.store, "stage", stage)
        other.apply(spark.createDataFrame([(1, 0, "delete", None, None)], CHANGE))
        return stage(df, partition_by)

    monkeypatch.setattr(log.store, "stage", slow)
    with pytest.raises(Stale):
        log.apply(spark.createDataFrame([(1, 0, "put", "b", "x")], CHANGE))
    assert state(log) == ({}, {}, {}, {("text", "1"), ("image", "a")})
    log.apply(spark.createDataFrame([(1, 0, "put", "b", "x")], CHANGE))
    assert state(log) == ({1: ("b", "x")}, {"b": 1}, {"x": 1}, {("image", "a")})


def test_finalized_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(changes, "SHARE", 500, raising=False)
    parents = spark.range(4000).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id")))
    queue = parents.filter("id is null or id % 2 = 0")
    children = spark.range(4000).filter("id % 3 <> 0").select(F.col("id").alias("parent_id"))
    left, queued = changes.finalized(parents, children, queue)
    gone = {i for i in range(0, 4000, 2) if i % 3 == 0}
    assert sorted(r[0] for r in left.collect() if r[0] is not None) == [i for i in range(4000) if i not in gone]
    assert sorted(r[0] for r in queued.collect() if r[0] is not None) == [i for i in range(0, 4000, 2) if i not in gone]
    assert left.filter("id is null").count() == queued.filter("id is null").count() == 1
    # Adaptive execution would put these few bytes into one partition.
    sizes = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 500
