"""Operators 11 to 13 against brute force, on odd rows and at their edges."""

import collections
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolake.llm import moments, phrases, quality, whitening

SF = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- quality


def test_statistics_of_plain_texts():
    at = quality.STATISTICS.index
    empty, plain, noisy = (quality.statistics(t) for t in (b"", b"The cat sat on the mat.\nIt slept.", b"THE!! CAT### sat | on | mat%%% | x"))
    assert len(empty) == len(plain) == len(quality.STATISTICS) and np.isfinite(empty).all()
    assert plain[at("log_words")] == pytest.approx(np.log1p(8))
    assert plain[at("log_lines")] == pytest.approx(np.log1p(2))
    assert plain[at("symbol_words")] == pytest.approx(np.log(0.5 / 8.5))
    assert noisy[at("symbol_words")] > plain[at("symbol_words")]
    assert noisy[at("other_symbols")] > plain[at("other_symbols")]
    assert quality.statistics(b"a\na\nb")[at("repeated_lines")] == pytest.approx(np.log(1.5 / 2.5))
    assert quality.statistics("é".encode() * 3)[at("letters")] == pytest.approx(np.log(6.5 / 0.5))


def plain_model(x, y):
    """The discriminant by its definition, on rows held in memory."""
    p = x.shape[1]
    cov = {c: np.cov(x[y == c].T, bias=True) for c in (0, 1)}
    n = {c: int((y == c).sum()) for c in (0, 1)}
    pooled = sum(cov[c] * n[c] for c in (0, 1)) / len(y)
    out = {}
    for c in (0, 1):
        share = max(quality.POOL, quality.POOL_ROWS * p / (quality.POOL_ROWS * p + n[c]))
        s = (1 - share) * cov[c] + share * pooled
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(s)) + quality.LEAST_VARIANCE * np.eye(p)
        out[c] = (x[y == c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1])
    return out, np.log(n[1] / n[0])


def test_quality_is_the_discriminant_of_all_labelled_rows(spark):
    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    x = {d["doc_id"]: quality.statistics((d["text"] or "").encode()) for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in x}
    taught = [(x[r["doc_id"]], r["quality"]) for r in labels if r["doc_id"] in x and not held[r["doc_id"]]]
    model, prior = plain_model(np.array([t[0] for t in taught]), np.array([t[1] for t in taught]))
    got = {r["doc_id"]: r for r in rows(quality.op11_quality(spark, SF))}
    assert got.keys() == x.keys()
    for i, s in x.items():
        part = {c: -0.5 * (s - m) @ inv @ (s - m) - 0.5 * det for c, (m, inv, det) in model.items()}
        want = 1 / (1 + np.exp(-np.clip(quality.TEMPER * (part[1] - part[0]) + prior, -700, 700)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)
        assert got[i]["held_out"] == held[i] and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    unseen = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if held[r["doc_id"]]]
    assert sum(a == b for a, b in unseen) / len(unseen) >= 0.95


def test_quality_on_odd_rows(spark, odd):
    got = rows(quality.op11_quality(spark, odd))
    assert len(got) == pq.read_table(f"{odd}/documents.parquet").num_rows
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]


def test_quality_without_both_classes_is_the_share_of_ones(spark):
    docs = spark.createDataFrame([(0, "a"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (0, 7)], "doc_id long, quality int")
    assert not quality.held_out(docs.doc_id) is None
    taught = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (0,))
    assert {r["score"] for r in rows(quality.quality_scores(docs, labels))} == {(taught + 1) / (taught + 2)}
    assert {r["score"] for r in rows(quality.quality_scores(docs, labels.limit(0)))} == {0.5}


def test_a_small_class_leans_on_the_pooled_covariance(spark):
    rng = np.random.default_rng(0)
    p = len(quality.STATISTICS)
    data = [(1, rng.normal(0, 1, p).tolist()) for _ in range(200)] + [(0, rng.normal(4, 1, p).tolist())]
    df = spark.createDataFrame(data, "label int, s array<double>")
    model = quality.fit(df, "label", "s")
    scores = [r["score"] for r in quality.score(df, model, "s").collect()]
    assert np.isfinite(scores).all() and scores[-1] < 0.5 < np.mean(scores[:-1])


# -- whitening


def whole(v):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]


def check_whitened(got, vectors, most=16):
    """``got`` rows against the definition over ``vectors`` (id, whole numbers) of one length."""
    listed = np.array(sorted({tuple(x) for _, x in vectors}), dtype=object)
    n, s = len(listed), listed.sum(axis=0)
    centred = np.array([[float(a * n - b) / n for a, b in zip(x, s, strict=True)] for x in listed])
    v = centred.T @ centred / n
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == len(vectors) * min(most, len(s))
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    for i, x in vectors:
        for r in by[i, 1]:
            assert r["n"] == n
        assert sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) in [r["deviation"] for r in by[i, 1]]
    shares = {r["component"]: r["explained"] for r in got}
    for k, share in shares.items():
        assert share == pytest.approx(e[k - 1] / v.trace(), rel=1e-4, abs=1e-12)
    assert all(0 <= r["identity_error"] <= 1e-4 for r in got)
    # Whitened values are projections: their covariance over the fit list is the identity.
    where = {tuple(x): i for i, x in reversed(vectors)}
    use = [k for k in shares if shares[k] > 1e-12]
    z = np.array([[by[where[tuple(x)], k][0]["whitened"] for k in use] for x in listed])
    assert np.abs(z.T @ z / n - np.eye(len(use))).max() < 1e-4
    weights = np.linalg.lstsq(centred, z, rcond=None)[0]
    assert np.allclose(centred @ weights, z, atol=1e-6)


def test_whitening_is_the_eigenbasis(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    vectors = [(r["vec_id"], whole(r["embedding"])) for r in t]
    got = rows(whitening.op12_whitening(spark, "/root/testdata/sf0.001"))
    check_whitened(got, vectors)
    # Against the eigenvectors themselves, either sign.
    x = np.unique(np.array([v for _, v in vectors]), axis=0).astype(float)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    first = (np.array(vectors[0][1]) - x.mean(axis=0)) @ q[:, ::-1][:, :16] / np.sqrt(e[::-1][:16])
    mine = [r["whitened"] for r in sorted((r for r in got if r["vec_id"] == vectors[0][0]), key=lambda r: r["component"])]
    assert np.allclose(np.abs(first), np.abs(mine), atol=1e-6)


def test_whitening_on_odd_rows(spark, odd):
    t = pq.read_table(f"{odd}/embeddings.parquet").to_pylist()
    good = [(r["vec_id"], whole(r["embedding"])) for r in t if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = rows(whitening.op12_whitening(spark, odd))
    for length, most in ((16, 16), (2, 2)):
        own = [(i, x) for i, x in good if len(x) == length]
        part = [r for r in got if any(r["vec_id"] == i for i, _ in own)]
        if length == 16:
            check_whitened(part, own)
        else:
            # One distinct vector: nothing varies.
            assert len(part) == 2 * len(own)
            assert {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in part} == {(1, 0, None, None)}
    assert {r["vec_id"] for r in got} == {i for i, x in good if x}


def test_whitening_far_out_entries(spark):
    data = [(0, [1e10, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5]), (3, [1e17, 0.0]), (4, [3e15, 0.0])]
    got = {(r["vec_id"], r["component"]): r for r in rows(whitening.whitened_components(spark.createDataFrame(data, "vec_id long, embedding array<double>")))}
    assert {i for i, _ in got} == {0, 1, 2, 4}
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in data if i != 3}
    s = [sum(c) for c in zip(*x.values(), strict=True)]
    for i, v in x.items():
        want = sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert got[i, 1]["deviation"] == (want if want < 1 << 63 else None)


def test_pairs_dealt_over_several_aggregations(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(0, v.tolist()) for v in x], "k int, v array<double>")
    monkeypatch.setattr(moments, "PAIRS", 4)
    assert np.allclose(moments.products(df, "k", "v", 6)[0], x.T @ x)


# -- phrases

BREAK, BLANK = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def plain_collocations(docs, least, top=2000):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = collections.Counter(), collections.Counter()
    for d in docs:
        lang = d["lang"] or "und" if d["lang"] is None else d["lang"]
        for piece in BREAK.split((d["text"] or "").translate(fold)):
            w = tuple(BLANK.findall(piece))
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    inside = collections.Counter()
    for (lang, w), v in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], v)
    by = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if inside[lang, w] < a:
            s, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in by.items():
        for rank, (s, a, w, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, w.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 5, 100])
def test_phrases_on_odd_rows(spark, odd, docs, least):
    df = spark.read.parquet(f"{odd}/documents.parquet")
    assert sorted(map(tuple, phrases.collocations(df, least=least).collect())) == plain_collocations(docs, least)


def test_phrases_at_edges(spark, monkeypatch):
    texts = ["A a a a a a", "a\tb  c.a b c,a b\x0bc", " \x1f\x1f x\x00y x\x00y \x00", "é É 漢 字 é É 漢 字", "\n\n..", None, "", "b c! b c? b c", "a b c\ra b c", "New York new york NEW\tYORK"]
    data = [(i, t, lang) for i, t in enumerate(texts * 3) for lang in ("x", None, "und", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    want = plain_collocations([{"text": t, "lang": lang} for _, t, lang in data], 3, 5)
    assert sorted(map(tuple, phrases.collocations(df, least=3, top=5).collect())) == want
    # Shards, buckets and automata of a few bytes give the same.
    for name, value in (("SHARD", 20), ("BUCKET", 8), ("AUTOMATON", 10), ("BEGUN", 30)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.collocations(df, least=3, top=5).collect())) == want


def test_phrases_past_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("x", 10**13)], "lang string, n long")
    assert phrases.scored(counts, words).first()["score"] == 1000 * (big - 1) * 10**13 // (big * big)


def test_sketch_of_many_buckets_is_an_upper_bound(spark):
    body = b"\n".join(phrases.pieces(b"a b c d e f g. a b c " * 50))
    shard = phrases.Shard("x", body)
    counter, hits = shard.hits(10)
    want = collections.Counter(c for _, _, found in shard.hashes(10) for c in found.tolist())
    assert dict(zip(counter.tolist(), hits.tolist(), strict=True)) == want
    sent = phrases.cells(spark.createDataFrame([(1, "x", body), (2, "x", body)], "shard long, lang string, body binary"), 10, 3)
    total = collections.Counter()
    for r in sent.collect():
        inner, n = phrases._opened(r["cell"])
        for i, k in zip(inner.tolist(), n.tolist(), strict=True):
            total[r["bucket"] << 7 | i] += k
    assert total == {c: 2 * min(k, 255) for c, k in want.items()}


def test_matches_overlap_and_share_blanks(monkeypatch):
    text, want = " a a a \n b a ", {" a ": 4, " a a ": 2, " a a a ": 1, " b a ": 1, " a b ": 0}
    assert dict(phrases.matches(text, list(want) * 2)) == want
    monkeypatch.setattr(phrases, "AUTOMATON", 1)
    assert dict(phrases.matches(text, list(want))) == want


def test_a_shard_is_counted_some_phrases_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    body = b"\n".join(b" " + b" ".join(b"w%d" % i for i in row) + b" " for row in rng.integers(0, 3000, (1500, 30)))
    shard, bits, outer = phrases.Shard("x", body), 32, 8
    for name in ("SLICE", "AUTOMATON", "CHUNK"):
        monkeypatch.setattr(phrases, name, 1 << 14)
    masks = {b: b"\xff" * ((j - i + 7) // 8) for _, _, buckets in shard.slices(bits, outer) for b, i, j in buckets}
    assert max(len(c) for c, _, _ in shard.slices(bits, outer)) < 2 << 14
    tracemalloc.start()
    before, seen, most = tracemalloc.get_traced_memory()[0], 0, 0
    for some in phrases.candidates(shard, bits, outer, masks):
        assert sum(map(len, some)) < 2 << 14
        seen, most = seen + len(some), max(most, sum(map(sys.getsizeof, some)))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    want = {tuple(p.split()[i : i + k]) for p in body.split(b"\n") for k in range(1, 6) for i in range(len(p.split()) - k + 1)}
    assert seen == len(want)
    # Numbers of fixed size for each phrase, and strings of one automaton.
    assert peak < 64 * 8 * len(shard.codes) and most < 8 << 14


def test_shards_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 1 << 20)
    text = ("abc defg " * 128 + ".") * 1024
    docs = spark.createDataFrame([(text, "x")] * 24, "text string, lang string").coalesce(1)
    parts = phrases.materialize(phrases.shards(docs, "text", "lang"), wide=True)
    sizes = [f.metadata.row_group(i).num_rows for p in parts.inputFiles() for f in [pq.ParquetFile(p.removeprefix("file:"))] for i in range(f.metadata.num_row_groups)]
    assert sum(sizes) >= 24 and max(sizes) <= 2
