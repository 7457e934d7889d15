"""Whole commits, fencing, and the stored index against plain postings."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from chronolake.operators import search
from chronolake.operators.fenced import DerivedIndex
from chronolake.operators.bitmap_index import BLOCK_BITS, BitmapIndex, packed, unlinked, unpacked
from chronolake.sources.snapshots import Conflict, Snapshots, Stale
from chronolake.streaming import index as streaming_index


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def values(df):
    return sorted(r[0] for r in df.collect())


def test_a_reader_sees_whole_commits_only(spark, store):
    assert store.read()["version"] == 0 and store.table("a") is None
    a, b = store.stage(ids(spark, 1)), store.stage(ids(spark, 2))
    assert store.table("a") is None
    before = store.commit(add={"a": a, "b": b})
    store.commit(add={"a": store.stage(ids(spark, 3))}, replace={"b": store.stage(ids(spark))})
    assert values(store.table("a")) == [1, 3] and values(store.table("b")) == []
    # A reader that holds an older manifest goes on reading that state.
    assert values(store.table("a", before)) == [1] and values(store.table("b", before)) == [2]


def test_of_two_writers_one_wins(spark, store):
    base = store.commit(add={"a": store.stage(ids(spark, 1))})
    one, two = (store.stage(ids(spark, k)) for k in (10, 20))
    store.commit(replace={"a": one}, base=base)
    with pytest.raises(Conflict):
        store.commit(replace={"a": two}, base=base)
    assert values(store.table("a")) == [10]
    store.replace("a", lambda df: df.select((F.col("id") + 1).alias("id")))
    assert values(store.table("a")) == [11]


def test_additions_of_two_writers_both_stay(spark, store):
    parts = [store.stage(ids(spark, k)) for k in range(4)]
    threads = [threading.Thread(target=store.commit, kwargs={"add": {"a": p}}) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert values(store.table("a")) == [0, 1, 2, 3] and store.read()["version"] == 4


def test_a_manifest_version_is_taken_once(store):
    store.commit(guards={"x": 1})
    assert not store._put({"version": 1, "id": "other", "tables": {}, "guards": {}})
    assert store.guard("x") == 1


def test_stale_tokens_and_epochs_are_refused(spark, store):
    first = store.claim("job")
    second = store.claim("job")
    assert second > first
    with pytest.raises(Stale):
        store.commit(add={"a": store.stage(ids(spark, 1))}, expect={"job": first})
    store.commit(add={"a": store.stage(ids(spark, 2))}, expect={"job": second, "epoch": 0}, guards={"epoch": 1})
    with pytest.raises(Stale):
        store.commit(add={"a": store.stage(ids(spark, 3))}, expect={"job": second, "epoch": 0})
    assert values(store.table("a")) == [2]


def test_vacuum_keeps_what_is_read(spark, store):
    store.commit(add={"a": store.stage(ids(spark, 1))})
    store.commit(replace={"a": store.stage(ids(spark, 2))})
    store.stage(ids(spark, 9))
    assert store.vacuum() == 2 and values(store.table("a")) == [2]


def plain(rows):
    out = {}
    for i, t in rows:
        w = "".join(c for c in t or "" if c.isalnum())
        for k in range(len(w) - 1):
            out.setdefault(w[k : k + 2], set()).add(i)
    return out


def as_sets(index):
    got = {}
    for r in unpacked(index.containers(), "token").collect():
        got.setdefault(r["token"], set()).add(r["id"])
    return got


TEXTS = [(0, "abc d"), (1, "bcd"), (31, "ab ab"), (32767, "abcd"), (32768, "abcd"), (-5, "bc"), (10**12, "漢字ab"), (7, ""), (8, None), (9, "x")]
KIND = "id long, text string"


def test_index_holds_the_postings(spark, store):
    index = BitmapIndex(store)
    assert index.containers().count() == 0 and index.matches(["ab"], False).count() == 0
    index.add(spark.createDataFrame([*TEXTS, (None, "abc")], KIND))
    want = plain(TEXTS)
    assert as_sets(index) == want
    assert {r["token"]: r["df"] for r in index.frequency().collect()} == {t: len(s) for t, s in want.items()}
    assert values(index.matches(["ab", "bc"], False)) == sorted(want["ab"] & want["bc"])
    assert values(index.matches(["ab", "zz"], False)) == []
    hits = {r["id"]: r["hits"] for r in index.matches(["ab", "bc", "zz"], True).collect()}
    assert hits == {i: (i in want["ab"]) + (i in want["bc"]) for i in want["ab"] | want["bc"]}
    assert index.matches([], True).count() == 0


def test_search_takes_either_index(spark, store):
    rng = random.Random(4)
    rows = [(i, i % 7, "".join(rng.choice("abcd ") for _ in range(12)), "c", "p", i) for i in range(200)]
    texts = spark.createDataFrame(rows, "id long, parent_id long, text string, category string, process_name string, created_at long")
    index = BitmapIndex(store)
    index.add(texts)
    for query, fuzzy in (("abc", False), ("abc", True), ("ab cd", False), ("zz abc", True), ("...", False), ("a", False)):
        got, want = (search.search(texts, ix, query, fuzzy, limit=50).select("id", "hits").collect() for ix in (index, search.postings(texts)))
        assert [r["id"] for r in got] == [r["id"] for r in want], query


def test_a_search_reads_its_buckets_only(spark, store):
    index = BitmapIndex(store)
    index.add(spark.createDataFrame([(i, f"w{i}x{i * 7}") for i in range(300)], KIND))
    files = index.containers(["w1"]).inputFiles()
    scan = index.containers(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(token,w1)" in scan and len(files) > 1


def test_a_random_history_equals_recomputation(spark, store):
    rng = random.Random(11)
    index, live = BitmapIndex(store), {}
    for step in range(9):
        what = ("add", "add", "remove", "compact")[rng.randrange(4)] if step else "add"
        if what == "add":
            rows = [(rng.choice([rng.randrange(50), 32760 + rng.randrange(20)]), "".join(rng.choice("abc") for _ in range(5))) for _ in range(15)]
            index.add(spark.createDataFrame(rows, KIND))
            for t, s in plain(rows).items():
                live.setdefault(t, set()).update(s)
        elif what == "remove":
            gone = {rng.randrange(50) for _ in range(10)} | {32768}
            index.remove(ids(spark, *gone, None))
            live = {t: s - gone for t, s in live.items()}
        else:
            index.compact()
            store.vacuum()
        live = {t: s for t, s in live.items() if s}
        assert as_sets(index) == live, (step, what)
    assert BLOCK_BITS == 15


def test_unlinked_takes_hit_blocks_apart(spark):
    rows = spark.createDataFrame([("ab", i) for i in (1, 2, 40_000)] + [("cd", 2)], "token string, id long")
    got = unlinked(packed(rows), ids(spark, 2, 2, None))
    assert {(r["token"], r["block"], r["n"], r["low"], r["high"]) for r in got.collect()} == {("ab", 0, 1, 1, 1), ("ab", 1, 1, 40_000, 40_000)}


def test_a_repeated_batch_adds_nothing(spark, store):
    index = BitmapIndex(store)
    assert index.add(spark.createDataFrame([(1, "ab")], KIND), 0)
    assert not index.add(spark.createDataFrame([(2, "ab")], KIND), 0)
    assert index.add(spark.createDataFrame([(3, "ab")], KIND), 1)
    assert as_sets(index) == {"ab": {1, 3}}


def test_a_stream_of_several_batches_equals_one(spark, tmp_path):
    rows = [(i, f"t{i}ab") for i in range(8)]
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    streaming_index.build_index(spark, f"{tmp_path}/src", KIND, f"file://{tmp_path}/ix", f"{tmp_path}/cp", files_a_batch=1)
    stored = BitmapIndex(Snapshots(spark, f"file://{tmp_path}/ix"))
    assert len(stored.store.read()["tables"]["postings"]["parts"]) == 4
    assert as_sets(stored) == plain(rows)


# The ledger

JOB = "index_kind string, subject_key string, model_id string, model_revision string, embedding_version int, source_fingerprint string"


def contract(k, fp="f", kind="text"):
    return (kind, str(k), "m", "r", 1, fp)


def jobs_of(spark, *rows):
    return spark.createDataFrame([(*contract(k), status, 0, None, None) for k, status in rows], JOB + ", status string, attempts int, next_retry_at timestamp, updated_at timestamp")


def update(spark, token, new, *keys, fp="f"):
    return spark.createDataFrame([(*contract(k, fp), token, new, None) for k in keys], JOB + ", token long, new_status string, retry_at timestamp")


def vector(spark, token, value, *keys, fp="f"):
    return spark.createDataFrame([(*contract(k, fp), token, [value, 1.0]) for k in keys], JOB + ", token long, vector array<double>")


def subjects(spark, *keys):
    return spark.createDataFrame([("text", str(k)) for k in keys], "index_kind string, subject_key string")


def states(index):
    return {r["subject_key"]: (r["status"], r["attempts"], r["lease_token"]) for r in index.jobs().collect()}


def now():
    return F.timestamp_seconds(F.lit(1000))


def test_a_late_worker_is_fenced(spark, store):
    index = DerivedIndex(store)
    index.seed(jobs_of(spark, (1, "pending"), (2, "completed")), spark.createDataFrame([], JOB + ", vector array<double>"))
    first = index.claim(now())
    assert states(index)["1"] == ("processing", 0, first)
    # Start-up recovery puts the job back, and another claim of the same run takes it.
    index.settle(update(spark, first, "pending", 1))
    second = index.claim(now())
    assert second > first
    for act in (lambda: index.settle(update(spark, first, "failed", 1)), lambda: index.complete(vector(spark, first, 9.0, 1), subjects(spark, 1))):
        with pytest.raises(Stale):
            act()
    with pytest.raises(Stale):
        index.settle(update(spark, second, "failed", 1, fp="other"))
    with pytest.raises(ValueError, match="not active"):
        index.complete(vector(spark, second, 5.0, 1), subjects(spark, 2))
    assert states(index)["1"] == ("processing", 0, second) and index.vectors().count() == 0
    index.complete(vector(spark, second, 5.0, 1), subjects(spark, 1))
    assert states(index)["1"] == ("completed", 0, None) and index.vectors().first()["vector"] == [5.0, 1.0]
    assert store.guard("epoch/text") == 1


def test_settling_is_all_or_none(spark, store):
    index = DerivedIndex(store)
    index.seed(jobs_of(spark, (1, "pending"), (2, "pending"), (3, "completed")))
    token = index.claim(now())
    with pytest.raises(Stale, match="1 leases"):
        index.settle(update(spark, token, "failed", 1, 3))
    assert states(index)["1"] == ("processing", 0, token)
    index.settle(update(spark, token, "failed", 1).unionAll(update(spark, token, "waiting_for_auth", 2)))
    assert states(index) == {"1": ("failed", 1, None), "2": ("waiting_for_auth", 0, None), "3": ("completed", 0, None)}


def test_a_stale_generation_is_not_recorded(spark, store, monkeypatch):
    index = DerivedIndex(store)
    index.seed(jobs_of(spark, (1, "pending"), (2, "pending")), spark.createDataFrame([], JOB + ", vector array<double>"))
    token = index.claim(now())
    index.complete(vector(spark, token, 1.0, 1), subjects(spark, 1))
    record = index.publish("text")
    assert (record["n"], record["dims"], record["epoch"]) == (1, 2, 1)
    assert store.table("generation/text").count() == 1
    # While the next one is written, another worker completes a vector.
    stage = store.stage

    def slow(df, partition_by=()):
        monkeypatch.setattr(store, "stage", stage)
        out = stage(df, partition_by)
        DerivedIndex(Snapshots(spark, store.path)).complete(vector(spark, token, 2.0, 2), subjects(spark, 2))
        return out

    monkeypatch.setattr(store, "stage", slow)
    with pytest.raises(Stale):
        index.publish("text")
    assert store.table("generation/text").count() == 1 and store.table("generations").first()["epoch"] == 1
    assert index.publish("text")["n"] == 2


def test_pages_move_the_cursor_with_their_rows(spark, store):
    index = DerivedIndex(store)
    index.seed(jobs_of(spark, (1, "completed"), (2, "pending")), spark.createDataFrame([], JOB + ", vector array<double>"))
    page = vector(spark, 0, 3.0, 1, 2, 3).drop("token").withColumn("outcome", F.when(F.col("subject_key") == "3", "legacy_unverified").otherwise("migrated"))
    live = subjects(spark, 1, 2, 3)
    foreign = page.withColumn("index_kind", F.lit("image"))
    for bad, error in ((lambda: index.import_page("r", "text", page, live, 5, 9), Stale), (lambda: index.import_page("r", "text", page, live, 0, -1), ValueError), (lambda: index.import_page("r", "text", page, subjects(spark, 1, 2), 0, 3), ValueError), (lambda: index.import_page("r", "text", foreign, live, 0, 3), ValueError)):
        with pytest.raises(error):
            bad()
    assert index.vectors().count() == 0 and store.guard("cursor/r") == 0
    assert index.import_page("r", "text", page, live, 0, 3) == {"migrated": 1, "already_current": 1, "legacy_unverified": 1}
    assert store.guard("cursor/r") == 3 and {k: v[0] for k, v in states(index).items()} == {"1": "completed", "2": "completed", "3": "completed"}
    # The same page again, after a reply that was lost: the cursor has moved.
    with pytest.raises(Stale):
        index.import_page("r", "text", page, live, 0, 3)


def test_small_bitmaps_are_not_sorted_in_one_task(spark, tmp_path):
    """Bitmaps compress to nearly nothing, so partitions that look small would be joined to one of any number of bitmaps."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(2000)]
    index = BitmapIndex(Snapshots(spark, str(tmp_path)))
    index.add(spark.createDataFrame(rows, "id long, text string"))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    files = [len(list(f.glob("*.parquet"))) for f in tmp_path.glob("data/*/bucket=*")]
    names = {f.name.split("-")[1] for f in tmp_path.glob("data/*/bucket=*/*.parquet")}
    assert len(files) > 40 and set(files) == {1} and len(names) > 20
    assert {(r["token"], r["id"]) for r in unpacked(index.containers(), "token").collect()} == {(t, i) for i, t in rows}


def test_unlinked_by_turns_and_blocks(spark):
    rng = random.Random(3)
    size = 1 << BLOCK_BITS
    rows = [(turn, rng.choice("abc"), rng.randrange(3 * size)) for turn in (1, 3) for _ in range(400)]
    gone = [(2, i) for t, _, i in rows if t == 1 and i % 2] + [(4, i) for _, _, i in rows if i % 5 == 0] + [(9, None)]
    df = spark.createDataFrame(rows, "turn long, token string, id long")
    segments = [packed(df.filter(F.col("turn") == t)).withColumn("turn", F.lit(t).cast("long")) for t in (1, 3)]
    out = unlinked(segments[0].unionByName(segments[1]), spark.createDataFrame(gone, "turn long, id long"))
    got = sorted((r["token"], r["id"]) for r in unpacked(out, "token").collect())
    want = sorted({(t, k, i) for t, k, i in rows if not any(i == g and t < turn for turn, g in gone)})
    assert got == sorted((k, i) for _, k, i in want)
    assert all(r["low"] == min(i for k, i in got if k == r["token"] and i >> BLOCK_BITS == r["block"] and r["low"] <= i <= r["high"]) and r["n"] > 0 for r in out.collect())
