"""Windows are compared by their bytes, whatever the hashes say."""

import collections
import random

import numpy as np

from chronolake.llm import chunks, simhash, substring_dedup, suffix_dedup


def thue_morse(a, b, rounds=10):
    x, y = a, b
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_thue_morse_words_are_different(spark):
    x, y = thue_morse("a", "b")
    assert len(x) == 1024 and x != y
    shared = " ".join(f"s{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, f"{shared} {x}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_windows(docs).collect()} == {1: 0, 2: 0, 3: 20}
    tail = "".join(random.Random(1).choice("cdef") for _ in range(20))
    docs = spark.createDataFrame([(1, x + tail), (2, y + tail), (3, tail + x)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(docs).collect()}
    seen, want = {}, {}
    for k, t in ((1, x + tail), (2, y + tail), (3, tail + x)):
        cut = set()
        for i in range(len(t) - 49):
            if seen.setdefault(t[i : i + 50], k) < k:
                cut |= set(range(i, i + 50))
        want[k] = len(cut)
    assert got == want


def groups(use, tie):
    by = collections.defaultdict(list)
    for i, g in zip(use.tolist(), tie.tolist(), strict=True):
        by[g].append(i)
    return sorted(by.values())


def test_ties_with_forced_collisions():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 8, 9, 17)))) for _ in range(400)]
    for fixed in (False, True):
        parts = [w.ljust(9, "c")[:9] if fixed else w for w in words]
        text = np.frombuffer("".join(parts).encode(), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - np.array([len(p) for p in parts])
        by = collections.defaultdict(list)
        for i, p in enumerate(parts):
            by[p].append(i)
        want = sorted(v for v in by.values() if len(v) > 1)
        exact = substring_dedup.word_symbols(text, starts, ends)
        for mask in (0, 1, 7, (1 << 64) - 1):
            assert groups(*chunks.tied(text, starts, ends, exact & np.uint64(mask))) == want


def test_minima():
    h = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for size in (1, 2, 3, 18, 35, 65, 400):
        got = chunks.minima(h, size)
        assert all(got[i] == h[i : i + size].min() for i in range(max(len(h) - size + 1, 0)))


def test_many_small_buckets_and_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    pool = [" ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def both():
        return sorted(map(tuple, suffix_dedup.repeated_bytes(df).collect())), sorted(map(tuple, substring_dedup.repeated_windows(df).collect()))

    want = both()
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 5_000)
    assert both() == want


def test_hot_anchors_are_dealt_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    f = np.unique(np.concatenate([rng.integers(0, 1 << 6, 300) << 20, rng.integers(0, 1 << 62, 100)]).astype(np.int64))
    nodes = spark.createDataFrame([(int(x), bytearray(int(x).to_bytes(8, "little"))) for x in f], "node long, fp binary")

    def classes():
        p = {int(x): int(x) for x in f}
        links = simhash.near_links(nodes, 2).collect()
        for _ in range(60):
            for r in links:
                p[r["a"]] = p[r["b"]] = min(p[r["a"]], p[r["b"]])
        return p

    want = classes()
    monkeypatch.setattr(simhash, "HOT", 5)
    assert classes() == want and len(set(want.values())) < len(f)


def test_dealt_anchors_give_the_same_near_copies(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in range(rng.randrange(1, 30)):
            w[(rng.randrange(100) + i) % 100] = f"x{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    monkeypatch.setattr(simhash, "HOT", 7)
    monkeypatch.setattr(simhash, "CROWD", 4)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == want
