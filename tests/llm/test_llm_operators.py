"""The operators against brute force on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from chronolake.llm import embedding_dedup, entry, language_id, mixing, piecewise_hash, sentencepiece_viterbi, simhash, substring_dedup, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
Q = entry.queries()


def low(x):
    return (0, 0) if x is None else (1, x)


def rows(df):
    return [r.asDict() for r in df.collect()]


def bag(dicts, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in dicts)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).collect() == []


def test_warc(spark, odd):
    pages = pq.read_table(f"{odd}/pages.parquet").to_pylist()
    groups = collections.defaultdict(list)
    for p in pages:
        groups[(p["html"] or "").encode()].append(p["page_id"])
    want = []
    for p in pages:
        body = (p["html"] or "").encode()
        best = max((i for i in groups[body] if i is not None), default=None)
        ref = best if len(body) >= 1000 and best != p["page_id"] and len(groups[body]) > 1 else None
        want.append((p["page_id"], len(body), hashlib.sha1(body).hexdigest(), "response" if ref is None else "revisit", ref))
    got = rows(Q["op1_warc"](spark, odd))
    assert bag(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == collections.Counter(want)


def test_warc_segments_in_any_order_and_damage(spark):
    records = warc.page_records("7:0-0", 7, "u", b"x" * 100_000, None)
    assert len(records) > 3
    data = b"".join(r + warc.END for r in reversed(records))
    parsed = list(warc.parse(data))
    df = spark.createDataFrame(
        [(h.get("warc-segment-origin-id") or h["warc-record-id"], h["warc-type"], 7, None, h.get("warc-payload-digest"), int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, bytearray(b)) for h, b in parsed],
        warc.RECORD,
    )
    whole = warc.reassemble(df).collect()
    assert len(whole) == 1 and whole[0]["whole"]
    assert warc.payloads(warc.reassemble(df)).first()["payload_bytes"] == 100_000
    assert not warc.reassemble(df.filter("segment <> 2")).first()["whole"]
    with pytest.raises(ValueError):
        list(warc.parse(data[:-10]))
    assert warc.dechunked(warc.chunked(b"a\r\n0\r\n\r\n")) == b"a\r\n0\r\n\r\n"


def test_suffix_dedup(spark, odd, docs):
    first = {}
    bodies = [(d["doc_id"], (d["text"] or "").encode()) for d in docs]
    for i, b in bodies:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if w not in first or low(i) < first[w]:
                first[w] = low(i)
    want = []
    for i, b in bodies:
        cut = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < low(i):
                cut[k : k + 50] = True
        cut = cut[: len(b)]
        spans = int((cut[1:] & ~cut[:-1]).sum() + (len(b) and cut[0]))
        want.append((i, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    got = rows(Q["op2_suffix_dedup"](spark, odd))
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter(want)


def test_difference_cover():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in d for b in d} == set(range(suffix_dedup.PERIOD))


def test_mixing(spark, odd, docs):
    got = rows(Q["op3_mixing"](spark, odd))
    again = rows(Q["op3_mixing"](spark, odd))
    names = ("doc_id", "size", "source_size", "target", "taken")
    assert bag(got, *names) == bag(again, *names)
    size = collections.Counter()
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert len(got) == len(docs) and all(g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0) for g in got)
    by = collections.defaultdict(list)
    for g in got:
        by[(g["source_size"], round(g["target"], 6))].append(g)
    assert set(by) == {(size[s], round(target[s], 6)) for s in order}
    for (_, t), g in by.items():
        assert abs(sum(x["taken"] for x in g) - t) <= max(x["size"] for x in g) / 2 + 1


def test_mixed_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mix_documents(docs, odd)
    assert out.columns == docs.columns
    assert out.count() > 0


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, docs):
    fp = [brute_fingerprint(d["text"]) for d in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    comp = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            comp[label[i]] = min(comp.get(label[i], d["doc_id"]), d["doc_id"])
    want = collections.Counter((d["doc_id"], f"{fp[i]:016x}", comp.get(label[i])) for i, d in enumerate(docs))
    assert bag(rows(Q["op4_simhash"](spark, odd)), "doc_id", "fingerprint", "component_id") == want


def test_two_near_fingerprints_always_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    flips = np.array([(1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (2000, 2))], np.uint64)
    y = x ^ flips
    (ix, ax), (iy, ay) = simhash.replicas(x, 2), simhash.replicas(y, 2)
    mine = collections.defaultdict(set)
    for i, a in zip(ix.tolist(), ax.tolist(), strict=True):
        mine[i].add(a)
    met = {i for i, a in zip(iy.tolist(), ay.tolist(), strict=True) if a in mine[i]}
    assert met == set(range(2000))
    far = np.bitwise_count(x[ix] ^ ax)
    assert far.max() <= simhash.BLOCKS + 1


def test_large_anchor_links_like_brute_force():
    rng = np.random.default_rng(1)
    f = (rng.integers(0, 1 << 6, 700).astype(np.uint64) << np.uint64(20)).reshape(-1, 1)
    f = np.unique(np.concatenate([f, rng.integers(0, 1 << 62, (300, 1), dtype=np.uint64)]), axis=0)
    r, c = simhash._links(np.zeros(len(f), np.int64), np.full(len(f), simhash.WHOLE), f, 2)
    near = simhash._distance(f[:, None, :], f[None, :, :]) <= 2

    def classes(pairs):
        p = list(range(len(f)))
        for _ in range(40):
            for a, b in pairs:
                p[a] = p[b] = min(p[a], p[b])
        return p

    assert classes(list(zip(r.tolist(), c.tolist(), strict=True))) == classes(list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))


def test_keep_one_catches_similar_documents(spark, docs):
    rng = np.random.default_rng(2)
    base = [f"t{rng.integers(0, 5000)}" for _ in range(400)]
    copies = []
    for _ in range(20):
        c = list(base)
        for k in rng.integers(0, 400, 3):
            c[k] = "changed"
        copies.append(" ".join(c))
    other = [" ".join(f"t{rng.integers(0, 5000)}" for _ in range(400)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*copies, *other, copies[0]])], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == [0, *range(20, 40)]


def test_embeddings(spark, odd):
    t = pq.read_table(f"{odd}/embeddings.parquet").to_pylist()
    vec = []
    for r in t:
        v = r["embedding"]
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vec.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(t)
    link = [[i != j and vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= 0.95 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    comp = {k: min(t[i]["vec_id"] for i in range(n) if label[i] == k) for k in set(label)}
    want = collections.Counter((t[i]["vec_id"], sum(link[i]), comp[label[i]], t[i]["vec_id"] == comp[label[i]]) for i in range(n))
    assert bag(rows(Q["op5_embedding_dedup"](spark, odd)), "vec_id", "n_links", "component_id", "kept") == want


@pytest.mark.parametrize(("whole", "block"), [(1 << 30, 1024), (20, 1024), (20, 7)])
def test_embedding_lists_dealt_in_any_way_give_the_same(spark, whole, block):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 8))[rng.integers(5, size=160)] + 0.12 * rng.normal(size=(160, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, 1 + i % 2, v.tolist()) for i, v in enumerate(x)], "node long, copies long, vector array<double>")
    pivots = x[rng.permutation(160)[:12]]
    near = x @ pivots.T
    prefix = [set(r) for r in np.argpartition(-near, 7, axis=1)[:, :8]]
    want, linked = collections.Counter(), []
    for a in range(160):
        for b in range(a + 1, 160):
            if x[a] @ x[b] >= 0.95 and len(prefix[a] & prefix[b]) > 1:
                want[a] += 1 + b % 2
                want[b] += 1 + a % 2
                linked.append((a, b))
    got, root = collections.Counter(), list(range(160))
    for r in embedding_dedup.verified(embedding_dedup.postings(df, pivots), 0.95, whole, block).collect():
        if r["b"] is None:
            got[r["a"]] += r["n"]
        else:
            old, new = root[r["a"]], root[r["b"]]
            root = [new if k == old else k for k in root]
    assert got == want and len(linked) > 200
    assert all(root[a] == root[b] for a, b in linked)


@pytest.mark.parametrize(("size", "n"), [(64, 3000), (64, 9000), (384, 3000)])
def test_embedding_recall(spark, size, n):
    """Made vectors in clusters with cosines of 0.9 to 0.99 among them, most near the threshold."""
    rng = np.random.default_rng(size + n)
    centres = rng.normal(size=(n // 12, size))
    spread = rng.uniform(0.12, 0.28, len(centres))
    own = rng.integers(0, len(centres), n)
    x = centres[own] + spread[own][:, None] * rng.normal(size=(n, size))
    x[: n // 4] = rng.normal(size=(n // 4, size))
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T
    true = (near >= 0.95).sum(axis=1) - 1
    assert 0.2 < ((near > 0.95) & (near < 0.97)).sum() / max(true.sum(), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.zeros(n, int)
    for r in embedding_dedup.near_duplicates(df).select("vec_id", "n_links").collect():
        got[r["vec_id"]] = r["n_links"]
    print("recall", size, n, got.sum() / true.sum())
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum()


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = Q["op6_language_id"](spark, sf).toPandas().set_index("doc_id")
    d = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id").loc[got.index]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    assert (got.lang_pred == d.lang)[got.held_out].mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_id_odd_rows(spark, odd, docs):
    got = rows(Q["op6_language_id"](spark, odd))
    assert len(got) == len(docs)
    letters = {d["doc_id"]: any(c.isalpha() for c in d["text"] or "") for d in docs if d["doc_id"] not in (6, None)}
    for g in got:
        if g["doc_id"] in letters:
            assert (g["lang_pred"] != "und") == letters[g["doc_id"]]
            assert g["lang_pred"] in ("en", "fr", "und") and 0 <= g["score"] <= 1


def test_keep_known_leaves_other_columns_alone(spark, odd):
    from pyspark.sql.functions import lit

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = language_id.keep_known(docs)
    assert out.columns == docs.columns
    assert out.filter("score <> size").count() == 0  # both number the rows
    bare = docs.withColumn("lang", lit(None).cast("string"))
    assert language_id.keep_known(bare).count() == out.count()


def test_codewords():
    for k in (1, 2, 4, 5, 6, 40):
        c = language_id.codewords(k)
        assert len(np.unique(c, axis=0)) == k
        if k > 1:
            assert (c.min(axis=0) < c.max(axis=0)).all()


def test_substring_dedup(spark, odd, docs):
    order = sorted(docs, key=lambda d: low(d["doc_id"]))
    got = rows(Q["op7_substring_dedup"](spark, odd))
    # Rows that repeat an id stand in the order of a hash; take the order that the operator took.
    seen, want = set(), []
    tie = {r["text"]: r["h"] for r in spark.createDataFrame([(d["text"],) for d in docs], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    for d in sorted(order, key=lambda d: (low(d["doc_id"]), tie[d["text"]])):
        w = WORD.findall(d["text"] or "")
        cut = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                cut[i : i + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(a for a, c in zip(w, cut, strict=True) if not c)
        want.append((d["doc_id"], len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == collections.Counter(want)


def test_substring_dedup_keeps_spacing_and_columns(spark):
    p = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"a  b\n{p}", "x"), (2, f"c\t d {p}  e\nf", None), (3, "  whole \n text ", "y")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["kept"], r["source"]) for r in substring_dedup.repeated_windows(df, carry=("source",), spacing=True).collect()}
    assert got == {1: (f"a  b\n{p}", "x"), 2: ("c\t d e\nf", None), 3: ("  whole \n text ", "y")}


def test_recompression_names_equal_stretches_alike():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    s = np.concatenate([rng.integers(0, 1 << 63, 37, dtype=np.uint64), core, rng.integers(0, 1 << 63, 11, dtype=np.uint64), core])
    names, at, n = substring_dedup.recompress(s, np.zeros(len(s), np.int64), (6,))[0]
    a = {x for x, p, k in zip(names.tolist(), at.tolist(), n.tolist(), strict=True) if 37 <= p and p + k <= 437}
    b = {x for x, p in zip(names.tolist(), at.tolist(), strict=True) if p >= 448}
    assert len(a & b) >= 0.7 * len(a)


def test_piecewise_hash(spark, odd, docs):
    got = rows(Q["op8_piecewise_hash"](spark, odd))
    tie = {r["text"]: r["h"] for r in spark.createDataFrame([(d["text"] or "",) for d in docs], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(docs, key=lambda d: (low(d["doc_id"]), tie[d["text"] or ""]))
    want = []
    for i, d in enumerate(order):
        x, y = d["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        want.append((d["doc_id"], len(x), hashlib.sha256(edited.encode()).hexdigest(), piecewise_hash.fingerprint(x.encode())))
    assert bag(got, "doc_id", "n_chars", "edited_sha256", "fingerprint") == collections.Counter(want)
    assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)


def test_piecewise_likeness(spark):
    rng = np.random.default_rng(6)
    text = " ".join(f"w{rng.integers(0, 999)}" for _ in range(2000)).encode()
    edit = text[:5000] + b"INSERTED" + text[5000:]
    other = " ".join(f"v{rng.integers(0, 999)}" for _ in range(2000)).encode()
    f = [piecewise_hash.fingerprint(t) for t in (text, edit, other)]
    from pyspark.sql import functions as F

    near = spark.createDataFrame([(f[0], f[0]), (f[0], f[1]), (f[0], f[2])], "a string, b string").select(piecewise_hash.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert near[0]["x"] == 1.0 and near[1]["x"] > 0.85 and near[2]["x"] < 0.2


def test_sharding(spark, odd, docs):
    got = rows(Q["op9_sharding"](spark, odd))
    want = collections.Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert bag(got, "doc_id", "size", "text_crc32") == want
    by = collections.defaultdict(list)
    for g in got:
        assert 0 <= g["shard"] < 24 and g["law"] == "bytes" and g["grown_shard"] is None
        by[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_are_near_equal(spark):
    got = Q["op9_sharding"](spark, "/root/testdata/sf0.1").toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and (sums - sums.mean()).abs().max() <= 0.05 * sums.mean() + got["size"].max()


def test_pieces_round_trip_and_match_the_library(spark, odd, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    got = rows(Q["op10_sentencepiece"](spark, odd))
    assert all(g["round_trip"] for g in got) and len(got) == len(docs)
    m = sentencepiece_viterbi.model(sentencepiece_viterbi.MODEL)
    x = pb.ModelProto()
    x.ParseFromString(open(sentencepiece_viterbi.MODEL, "rb").read())
    x.trainer_spec.model_type = 1  # the same pieces and scores under the unigram rule
    for p in x.pieces:
        p.score = max(p.score, -1e5)
    library = sentencepiece.SentencePieceProcessor(model_proto=x.SerializeToString())
    words = sorted({w for d in docs for w in sentencepiece_viterbi.WORD.findall("▁" + (d["text"] or "").replace(" ", "▁")) if w[0] == "▁" and 1 < len(w) < 200})
    coded = sentencepiece_viterbi.encode_words(m, words)
    assert all(coded[w].tolist() == library.encode(w[1:]) for w in words)
