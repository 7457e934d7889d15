"""Near-copies of the pipeline: links by exact similarity, one row of each component."""

import itertools
import random

import corpus_pipeline
from chronolake.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], SCHEMA)


def kept(spark, pairs):
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table(spark, pairs), "").collect()]


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def with_tail(rng, name, share):
    """Two texts of 200 shingles of which ``share`` in all is common."""
    common = round(2 * 200 * share / (1 + share))
    head = [f"{name}h{rng.random()}" for _ in range(common + 4)]
    return [" ".join(head + [f"{name}t{rng.random()}" for _ in range(200 - common)]) for _ in range(2)]


def test_similarity_decides(spark):
    rng = random.Random(1)
    pairs = [(share, with_tail(rng, f"{share}-{i}", share)) for share in (0.74, 0.78, 0.805, 0.82, 0.85) for i in range(60)]
    docs = [(k, t) for k, t in enumerate(t for _, two in pairs for t in two)]
    stay = {i for i, _ in kept(spark, docs)}
    linked = {share: 0 for share, _ in pairs}
    for k, (share, (a, b)) in enumerate(pairs):
        if jaccard(a, b) < 0.8:
            assert {2 * k, 2 * k + 1} <= stay
        else:
            linked[share] += (2 * k + 1) not in stay
    assert min(linked[0.805], linked[0.82], linked[0.85]) >= 57


def test_shared_line_repeated(spark):
    line = "the same words of one line again "
    two = [line * 60 + " ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    assert len(kept(spark, enumerate(two))) == 2


def test_large_group_is_checked_until_nothing_is_left(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        w = list(base)
        at = rng.randrange(100)
        for i in range(rng.randrange(1, 22)):
            w[(at + i) % 100] = f"x{rng.random()}"
        texts.append(" ".join(w))
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert {i for i, _ in kept(spark, enumerate(texts))} == set(root)


def test_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (5, c), (3, a), (None, "alone without an id here")]
    assert sorted(kept(spark, rows), key=str) == sorted([(3, a), (7, b), (5, c), (None, "alone without an id here")], key=str)


def test_rows_by_bits(spark):
    docs = spark.range(100_000).selectExpr("id + if(id < 70000, 0, 8589934592) as _row", "cast(id as string) as text")
    rows = docs.filter("_row % 7 in (1, 3) or _row in (0, 32767, 32768, 69999)").select("_row")
    got = simhash.chosen(docs, simhash.row_bits(rows, "_row"), "_row")
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.select("_row").collect()) == sorted(r[0] for r in rows.collect())


def test_texts_stay_where_they_lie(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.random()}" for _ in range(2000)) for _ in range(100)]
    table(spark, enumerate(texts + [t + " tail" for t in texts[:50]])).repartition(4).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    was, limit = sent(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stay = corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id < 100"), "").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert stay == 100
    assert sent() - was < sum(map(len, texts)) / 4


def test_few_candidates_are_ranked(spark, monkeypatch):
    seen, real = [], simhash.measured
    monkeypatch.setattr(simhash, "measured", lambda pairs, sharp: seen.append(pairs.count()) or real(pairs, sharp))
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(100), 2):
            w[k] = f"x{i}-{k}"
        texts.append(" ".join(w))
    kept(spark, enumerate(texts))
    # The candidates of a node, and none of the pairs that are left.
    assert len(seen) == 1 and seen[0] <= 120 * simhash.FEW
