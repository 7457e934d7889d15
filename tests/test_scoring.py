"""Scoring in batches: cut short, resumed, raced and streamed."""

import pytest
from pyspark.sql import functions as F

from chronolake.operators import scoring
from chronolake.sources.snapshots import Snapshots


@pytest.fixture
def inputs(spark):
    subjects = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(30)], "id long, vector array<double>")
    clusters = spark.createDataFrame([(1, [1.0, 0.0], 0.5, True), (2, [0.0, 1.0], 0.2, True), (3, [1.0, 0.0], 0.0, False), (4, [0.5, 0.5], 0.9, True)], "cluster_id long, vector array<double>, threshold double, enabled boolean")
    scores = spark.createDataFrame([(i, c, ((i * 7 + c * 13) % 100) / 100) for i in range(30) for c in (1, 2, 3, 4) if i != 5], "id long, cluster_id long, score double")
    return subjects, clusters, scores


def want():
    out = set()
    for i in range(30):
        for c, threshold in ((1, 0.5), (2, 0.2), (4, 0.9)):
            near = {1: i % 3 != 0, 2: i % 3 == 0, 4: True}[c]
            s = ((i * 7 + c * 13) % 100) / 100
            if near and i != 5 and s >= threshold:
                out.add((c, i, s))
    return out


def queue_of(spark, tmp_path, n=30):
    q = scoring.ScoringQueue(Snapshots(spark, f"file://{tmp_path}/store"))
    q.put(spark.createDataFrame([(i, 1000 - i) for i in range(n)], "id long, queued_ms long"))
    return q


def found(q):
    return {tuple(r) for r in q.assignments().collect()}


def test_a_run_cut_short_and_resumed_equals_one(spark, tmp_path, inputs):
    q = queue_of(spark, tmp_path)
    asked = iter([False, False, True])
    assert q.run(*inputs, rows=8, late=lambda: next(asked)) == 16
    # The longest waiting went first.
    assert sorted(r["id"] for r in q.waiting().collect()) == list(range(14))
    assert found(q) == {x for x in want() if x[1] >= 14}
    assert q.run(*inputs, rows=8) == 14 and found(q) == want() and q.waiting().count() == 0
    assert q.run(*inputs, rows=8) == 0
    # Queued again, a subject's assignments are replaced and not added to.
    q.put(spark.createDataFrame([(1, 5), (1, 2), (29, 3)], "id long, queued_ms long"))
    assert q.run(*inputs) == 2 and found(q) == want()


def test_a_failed_batch_leaves_no_trace(spark, tmp_path, inputs, monkeypatch):
    q = queue_of(spark, tmp_path)
    commit = q.store.commit
    monkeypatch.setattr(q.store, "commit", lambda **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        q.step(*inputs, rows=10)
    monkeypatch.setattr(q.store, "commit", commit)
    assert found(q) == set() and q.waiting().count() == 30
    # Another run takes the batch between this one's read and its commit.
    stage, other = q.store.stage, scoring.ScoringQueue(Snapshots(spark, q.store.path))

    def raced(df, partition_by=()):
        monkeypatch.setattr(q.store, "stage", stage)
        other.step(*inputs, rows=10)
        return stage(df, partition_by)

    monkeypatch.setattr(q.store, "stage", raced)
    with pytest.raises((scoring.Conflict, scoring.Stale)):
        q.step(*inputs, rows=10)
    assert q.waiting().count() == 20
    assert q.run(*inputs, rows=10) == 20 and found(q) == want()


def test_old_subjects_and_no_clusters(spark, tmp_path, inputs):
    q = queue_of(spark, tmp_path)
    month = scoring.KEEP_DAYS * 86_400_000
    assert q.waiting(month + 985).count() == 16
    assert q.run(inputs[0], inputs[1].withColumn("enabled", F.lit(False)), inputs[2]) == 30
    assert q.waiting().count() == 0 and found(q) == set()


def test_a_stream_merges_once(spark, tmp_path, inputs):
    src, cp = f"{tmp_path}/src", f"{tmp_path}/cp"
    store = Snapshots(spark, f"file://{tmp_path}/s")
    for k in range(3):
        spark.createDataFrame([(i,) for i in range(30) if i % 3 == k or i < 4], "id long").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    scoring.score_stream(stream(), store, cp, *inputs)
    assert {tuple(r) for r in store.table("assignments").collect()} == want() and store.guard("batches/scoring") == 3
    scoring.score_stream(stream(), store, cp, *inputs)
    assert store.table("assignments").count() == len(want())
