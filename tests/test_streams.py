"""Streams in several micro-batches against the same rows as a table."""

import random

import pytest
from pyspark.sql import functions as F

from chronolake.sources.snapshots import Snapshots
from chronolake.streaming import frames, queue


def frame(stream, i, at, window, hash_, excluded=False):
    return (stream, i, at, window, excluded, [hash_], f"{hash_ % 7}")


def frames_of(spark, rows):
    df = spark.createDataFrame(rows, "stream long, id long, t long, window string, excluded boolean, hash array<long>, image_hash string")
    return frames.frame_rows(df, F.timestamp_millis("t"))


def plain_captures(rows, interval):
    out = []
    for s in {r[0] for r in rows}:
        window, looked, kept = None, None, []
        for _, i, at, w, excluded, h, image in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            before, window = window, w
            if excluded or not (w != before or looked is None or at - looked >= interval):
                continue
            why, looked = ("focus" if w != before else "interval"), at
            if any(bin((h[0] ^ k) & (2**64 - 1)).count("1") < 10 for k in kept):
                continue
            kept = [*kept, h[0]][-3:]
            out.append((s, i, at, why, image))
    return sorted(out)


def random_frames(seed, n=120):
    rng = random.Random(seed)
    looks = [rng.getrandbits(62) for _ in range(6)]
    return [frame(rng.randrange(3), i, 1000 * i + rng.randrange(3) * 400, rng.choice("abb"), rng.choice(looks) ^ (1 << rng.randrange(60)), rng.random() < 0.1) for i in range(n)]


def write_batches(df, folder, batches):
    for k in range(batches):
        df.filter(F.col("_b") == k).drop("_b").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("interval", [0, 5000])
def test_captures_of_a_table(spark, interval):
    rows = random_frames(1)
    got = frames.captured_frames(frames_of(spark, rows), interval)
    assert sorted(map(tuple, got.collect())) == plain_captures(rows, interval)


def test_a_stream_out_of_order_equals_the_table(spark, tmp_path):
    rows = random_frames(2)
    end = [frame(s, 1000 + s, 10**7, "z", 0, True) for s in range(3)]
    # Batches overlap in time by less than the delay.
    rng = random.Random(3)
    batch = [min(5, max(0, r[1] // 20 + rng.choice((0, 0, -1, 1)))) for r in rows] + [6] * 3
    df = frames_of(spark, rows + end)
    which = spark.createDataFrame([(r[1], b) for r, b in zip(rows + end, batch, strict=True)], "id long, _b int")
    src = f"{tmp_path}/src"
    write_batches(df.join(which, "id").select(*df.columns, "_b"), src, 7)
    store = Snapshots(spark, f"file://{tmp_path}/store")
    reader = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    frames.run_capture_loop(reader(), store, f"{tmp_path}/cp", "60 seconds", 5000)
    want = plain_captures(rows, 5000)
    stored = store.table("captures").collect()
    assert sorted((r["stream"], r["id"], r["at_ms"], r["image_hash"]) for r in stored) == [(s, i, at, h) for s, i, at, _, h in want]
    # Of one hash the first is pending, all others are its duplicates, across batches.
    first = {}
    for _, i, _, _, h in sorted(want, key=lambda r: r[2]):
        first.setdefault(h, []).append(i)
    for r in stored:
        assert (r["status"], r["duplicate_of"]) == (("pending", None) if r["duplicate_of"] is None else ("duplicate", r["duplicate_of"]))
        assert r["duplicate_of"] is None or r["duplicate_of"] in first[r["image_hash"]]
    assert sum(r["status"] == "pending" for r in stored) == len(first)
    assert sorted(r["id"] for r in store.table("queue").collect()) == sorted(r["id"] for r in stored if r["status"] == "pending")
    # A run that finds nothing new changes nothing, nor does a batch that comes again.
    version = store.read()["version"]
    frames.run_capture_loop(reader(), store, f"{tmp_path}/cp", "60 seconds", 5000)
    assert store.table("captures").count() == len(want)
    frames.store_captures(store, spark.createDataFrame([(1, 999, 5, "focus", "x")], frames.CAPTURE), 0)
    assert store.table("captures").filter("id = 999").count() == 0 and store.read()["version"] >= version


DAY = 86_400_000


def test_a_job_retries_fails_and_expires():
    job = queue.Job()
    assert job.take(0, "fail") == [] and job.take(5, "enqueue") == [(5, "due", 0)] and job.take(6, "enqueue") == []
    at = 10
    for n, wait in enumerate((30, 60, 120, 300), 1):
        assert job.take(at, "fail") == []
        assert job.take(at + 1000 * wait - 1, "done") == []
        at += 1000 * wait
        assert job.until(at) == [(at, "due", n)]
    assert job.take(at, "fail") == [(at, "failed", 5)] and job.timers() == []
    assert job.take(at, "enqueue") == [(at, "due", 0)]
    assert job.until(at + 30 * DAY - 1) == [] and job.until(at + 31 * DAY) == [(at + 30 * DAY, "expired", 0)]
    # A retry that falls on the last moment or later does not come.
    job = queue.Job()
    job.take(0, "enqueue")
    job.take(30 * DAY - 30_000, "fail")
    assert job.until(40 * DAY) == [(30 * DAY, "expired", 1)]


def random_events(seed, n=150):
    rng = random.Random(seed)
    return [(rng.randrange(6), rng.choice(["enqueue", "enqueue", "fail", "fail", "done"]), 20_000 * i + rng.randrange(9), i) for i in range(n)]


def events_of(spark, rows):
    return spark.createDataFrame(rows, "subject long, what string, at_ms long, seq long").select("subject", "what", F.timestamp_millis("at_ms").alias("at"), "at_ms", "seq")


def plain_steps(rows, until):
    out = []
    for s in {r[0] for r in rows}:
        job = queue.Job()
        for _, what, at, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3])):
            out += [(s, *x) for x in job.take(at, what)]
        out += [(s, *x) for x in job.until(until)]
    return sorted(out)


def test_queue_of_a_stream_equals_the_table(spark, tmp_path):
    rows = random_events(5)
    last = rows[-1][2]
    # The clock: a far event of another subject moves the watermark past every expiry.
    far = [(99, "done", last + 31 * DAY, 10_000), (99, "done", last + 32 * DAY, 10_001)]
    until = last + 32 * DAY - 10_000
    df = events_of(spark, rows + far)
    which = df.withColumn("_b", F.when(F.col("seq") >= 10_001, 5).when(F.col("seq") == 10_000, 4).otherwise((F.col("seq") / 40).cast("int")))
    src = f"{tmp_path}/src"
    write_batches(which, src, 6)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = f"{tmp_path}/out"
    q = queue.streamed_queue(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = plain_steps(rows, until)
    assert {s for _, _, s, _ in want} >= {"due", "done", "expired"}
    assert sorted(map(tuple, spark.read.parquet(out).select("subject", "at_ms", "step", "attempts").collect())) == want
    assert sorted(map(tuple, queue.queue_steps(events_of(spark, rows), until).collect())) == want


def test_queries_of_the_loop(spark):
    from chronolake.plans.stores import screen_frames
    from chronolake.plans.catalog import QUERIES
    from chronolake.sources.roles import Roles

    sf = "/root/testdata/sf0.001"
    rows = [(r["stream"], r["id"], r["at_ms"], r["window"], r["excluded"], list(r["hash"]), r["image_hash"]) for r in screen_frames(Roles(spark, sf)).collect()]
    want = []
    for s in {r[0] for r in rows}:
        loop = frames.Decider(interval_ms=3_600_000)
        for _, i, at, w, excluded, h, image in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            if why := loop.take(at, w, excluded, h):
                want.append((s, i, at, why, image))
    first = {}
    for _, i, _, _, image in sorted(want, key=lambda r: r[1]):
        first.setdefault(image, i)
    want = sorted((s, i, at, why, "pending" if first[image] == i else "duplicate", None if first[image] == i else first[image]) for s, i, at, why, image in want)
    assert sorted(map(tuple, QUERIES["stm13_capture_loop"](spark, sf).collect())) == want
    steps = QUERIES["stm10_retry_steps"](spark, sf).collect()
    events = Roles(spark, sf).captures().count()
    assert 0 < len(steps) <= 2 * events and {r["step"] for r in steps} >= {"due", "done", "expired"}
