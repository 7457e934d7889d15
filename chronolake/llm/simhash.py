"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a product code: nine [7,4] Hamming codes and one free
bit. Each block is perfect with radius 1, so every 64-bit fingerprint lies
within 9 bits of an anchor, and its nearest anchor follows from nine table
lookups. Two fingerprints that differ in t bits have a point between them that
is within ceil(t/2) of both. So each fingerprint is replicated to the nearest
anchor of every point within ceil(t/2) of it (all of these lie within the
covering radius plus ceil(t/2)), and any two that must be linked meet at one
anchor. For t = 2 that is about 25 of the 65 points around a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import frugal, mix, utf8
from .common import connected_components, discard, materialize, partitions

BITS, BLOCKS = 64, 9
GOLDEN = 0x9E3779B97F4A7C15
THRESHOLD = 2
#: Rows of a group that are compared one place at a time, rows of a block of a hot anchor, and the side of rows that are compared with all of their group.
CROWD, HOT, WHOLE = 64, 2048, 2
#: Near-copies (keep_one): words of a shingle, words of a fingerprint, least set that can be similar to another.
SHINGLE, WIDE, LEAST = 5, 16, 4
#: Words of a fingerprint by which the nearest is looked for, bits that may differ in them, and in all words; small sets differ more.
SCREEN, LOOSE, FAR, SMALL, SMALL_FAR = 3, 54, 200, 8, 250
#: Words that are added to the fingerprints of what has candidates, and bits that may then differ: 468 of 3072 do at a similarity of 0.8, 20 being the standard deviation.
MORE, SHARP = 32, 545
#: Candidates of a node that are ranked by long fingerprints, rows of a bitmap.
FEW, SPAN = 8, 1 << 15


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z lower-cased first."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h, spans = xxhash.xxh64_intdigest, zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([h(line[a:b], seed) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of ``hashes``; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, seed: int = 42) -> DataFrame:
    """(``id_col``, fp binary, node long): ``words`` little-endian words of 64 bits.

    ``node`` is the fingerprint itself if it has one word, else a hash of it.

    Words of the text stand between ASCII white space. Shingles of ``shingle``
    words with repeats; fewer words: the whole sequence; no word or a null
    text: 0. Each word of the fingerprint after the first takes its own mix of
    the shingle hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, words), np.uint64)
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                h = shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed)
                out[i, 0] = majority(h)
                for k in range(1, words):
                    out[i, k] = majority(mix(h + np.uint64(k * GOLDEN % (1 << 64))))
            fps = [x.tobytes() for x in out]
            node = out[:, 0] if words == 1 else np.array([xxhash.xxh64_intdigest(x, seed) for x in fps], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(np.ascontiguousarray(node).view(np.int64))], names=["id", "fp", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), f"id {kind}, fp binary, node long").withColumnRenamed("id", id_col)


def _decoder() -> np.ndarray:
    """Nearest codeword of the [7,4] Hamming code for each 7-bit value."""
    out = np.arange(128)
    for x in range(128):
        syndrome = 0
        for i in range(7):
            if x >> i & 1:
                syndrome ^= i + 1
        if syndrome:
            out[x] = x ^ (1 << (syndrome - 1))
    return out.astype(np.uint64)


def anchors(fps: np.ndarray) -> np.ndarray:
    """The nearest anchor of each fingerprint."""
    table, out = _decoder(), fps & (np.uint64(1) << np.uint64(63))
    for k in range(BLOCKS):
        out |= table[((fps >> np.uint64(7 * k)) & np.uint64(127)).astype(np.int64)] << np.uint64(7 * k)
    return out


def replicas(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for each anchor that it must meet others at."""
    around = [np.uint64(0)]
    for _ in range((threshold + 1) // 2):
        around = list({int(x) ^ (1 << i) for x in around for i in range(BITS)} | {int(x) for x in around})
    points = np.array(sorted(map(int, around)), np.uint64)
    index, found = [], []
    for at in range(0, len(fps), 4096):
        part = fps[at : at + 4096]
        a = np.sort(anchors((part[:, None] ^ points[None, :]).ravel()).reshape(len(part), -1), axis=1)
        keep = np.ones(a.shape, bool)
        keep[:, 1:] = a[:, 1:] != a[:, :-1]
        index.append(np.nonzero(keep)[0] + at)
        found.append(a[keep])
    return (np.concatenate(index), np.concatenate(found)) if index else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def segments(nodes: int) -> tuple[int, int]:
    """(bits of a segment, number of segments) for so many wide fingerprints.

    A segment has 16 bits up to 2**20 fingerprints and then 4 more for every
    16 times as many, so that unlike fingerprints at an anchor stay few. Two
    that differ in 15.2 % of their bits (similarity 0.8) agree in some segment
    with a chance of 99.1 % at any width.
    """
    width = min(32, 16 + 4 * max(0, int(np.ceil((np.log2(max(nodes, 1)) - 20) / 4))))
    return width, int(np.ceil(np.log(0.009) / np.log(1 - 0.848**width)))


def segment_anchors(fps: np.ndarray, width: int = 16, count: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): each segment of a wide fingerprint is its own anchor.

    Segments take their bits in turn from fixed orders of all bits.
    """
    bits = fps.shape[1] * BITS
    rng = np.random.default_rng(bits)
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-width * count // bits))])[: width * count]
    own = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, order].reshape(len(fps), count, width)
    parts = np.zeros((len(fps), count), np.uint64)
    for k in range(width):
        parts |= own[:, :, k].astype(np.uint64) << np.uint64(k)
    return np.repeat(np.arange(len(fps)), count), (parts | (np.arange(count, dtype=np.uint64) << np.uint64(width))).ravel()


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _forest(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    keep = []
    for i, (r, c) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
        x, y = find(r), find(c)
        if x != y:
            parent[x] = y
            keep.append(i)
    return row[keep], col[keep]


def _links(group: np.ndarray, side: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked rows that share a group; rows are sorted by it.

    Rows of one group are compared with those k places on, for all rows at
    once. A group of over ``CROWD`` rows is compared a pair of blocks at a time,
    and a spanning forest stands for the links of each pair of blocks: the
    components are the same and links stay near linear.
    """
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _small_pairs(group):
        near = (_distance(fps[i], fps[j]) <= threshold) & _meet(side[i], side[j])
        rows.append(i[near])
        cols.append(j[near])
    block = 256
    for s, e in _large_groups(group):
        for i in range(s, e, block):
            a = np.arange(i, min(i + block, e))
            for j in range(s, i + 1, block):
                b = np.arange(j, min(j + block, e))
                near = (_distance(fps[a][:, None, :], fps[b][None, :, :]) <= threshold) & _meet(side[a][:, None], side[b][None, :])
                r, c = np.nonzero(np.tril(near, -1) if i == j else near)
                r, c = _forest(r + i, c + j)
                rows.append(r)
                cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of these sides are compared: not two of the same half of a dealt group."""
    return (a != b) | (a == WHOLE)


def _edges(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))


def _small_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of the groups of up to ``CROWD`` rows, by how far apart they stand."""
    edge = _edges(group)
    size = np.diff(edge)
    end = np.repeat(np.where(size > CROWD, 0, edge[1:]), size)
    k, live = 1, np.flatnonzero(np.arange(len(group)) + 1 < end)
    while len(live):
        yield live, live + k
        k += 1
        live = live[live + k < end[live]]


def _large_groups(group: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = _edges(group)
    big = np.flatnonzero(np.diff(edge) > CROWD)
    yield from zip(edge[big].tolist(), edge[big + 1].tolist(), strict=True)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a value of their first column ends; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if cut:
            yield from pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()
            held = []
        held.append(b.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words_of(column: pa.Array, words: int) -> np.ndarray:
    return utf8(column)[0].view("<u8").reshape(len(column), words)


def near_links(nodes: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all pairs within ``threshold`` (2 or less).

    ``nodes``: (node long, fp binary of one word), distinct. Anchors are dealt
    by key; a partition sorts its replicas and compares each anchor's own. An
    anchor of over ``HOT`` fingerprints is dealt in blocks, and each pair of
    blocks is a group of its own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = words_of(b.column(1), 1)
            for at in range(0, len(fps), 10_000):
                index, a = replicas(fps[at : at + 10_000, 0], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b.column(0).take(pa.array(index + at))], names=["anchor", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            group, side, node = (b.column(k).to_numpy() for k in range(3))
            r, c = _links(group, side, node.view(np.uint64).reshape(-1, 1), threshold)
            if len(r):
                pairs = np.unique(np.sort(np.stack([node[r], node[c]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    n = partitions(nodes.sparkSession)
    sent = nodes.select("node", "fp").mapInArrow(frugal(spread), "anchor long, node long")
    hot = sent.groupBy("anchor").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")).filter("blocks > 1")
    own = sent.join(hot, "anchor", "left").withColumn("own", F.expr("cast(pmod(xxhash64(node, 7), coalesce(blocks, 1)) as int)"))
    own = own.withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    group = F.when(F.col("blocks").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), WHOLE).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = own.select(group.alias("group"), side.cast("int").alias("side"), "node").repartition(n, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(frugal(compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(``id_col``, fp binary, node, component_id), one row per document.

    Documents with equal fingerprints are one node, so copies cost one row
    each. component_id is the smallest id reachable over links of
    ``threshold`` differing bits or fewer; null ids are passed over, and a
    component without any other id has null. Rows that repeat an id keep a
    row each. Null and empty texts have fingerprint 0 and link like others.
    No link within ``threshold`` (2 or less) is lost.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = fps.groupBy("node", "fp").agg(F.min(id_col).alias("low"))
    links = materialize(near_links(nodes, threshold))
    roots = connected_components(links)
    rooted = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select(F.col("node").alias("_node"), "component_id")
    return fps.join(classes, F.col("node") == F.col("_node"), "left").select(id_col, "fp", "node", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at 2 bits or fewer."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(h: np.ndarray, words: int, start: int = 0) -> np.ndarray:
    """``words`` words from ``start`` on, of 64 majority bits of distinct hashes; ties fall by the place of the bit."""
    out = np.zeros(words, np.uint64)
    for k in range(start, start + words):
        out[k - start] = majority(mix(h + np.uint64(k * GOLDEN % (1 << 64))))
        if len(h) % 2 == 0 and len(h) <= 64:
            bits = np.unpackbits(mix(h + np.uint64(k * GOLDEN % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            tie = np.packbits((2 * bits.sum(axis=0, dtype=np.int64) == len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]
            out[k - start] |= tie & np.uint64(0x5A96A5693C5AC396)
    return out


def _marks(docs: DataFrame, row_col: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, th, node, n, fp) of each row: node is a hash of the set of distinct five-word shingles, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fps = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), []
            for i, t in enumerate(b.column(3).cast(pa.binary())):
                h = np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", SHINGLE))
                node[i], size[i] = xxhash.xxh64_intdigest(h.tobytes()), len(h)
                fps.append(set_fingerprint(h, WIDE).tobytes() if len(h) >= LEAST else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(node.view(np.int64)), pa.array(size), pa.array(fps, pa.binary())], names=["row", "id", "th", "node", "n", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return read.mapInArrow(frugal(run), f"row long, id {kind}, th long, node long, n int, fp binary")


def _near(fps: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` may be similar: by set sizes and by the bits of whole fingerprints.

    At a similarity of 0.8 some 156 of 1024 bits differ, 12 being the standard
    deviation; in sets of up to ``SMALL`` shingles up to 192.
    """
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    return (_bits(fps, a, b) <= np.where(low <= SMALL, SMALL_FAR, FAR)) & (5 * low >= 4 * high)


def _bits(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(fps[a, 0] ^ fps[b, 0]).astype(np.uint16)
    for k in range(1, fps.shape[1]):
        d += np.bitwise_count(fps[a, k] ^ fps[b, k])
    return d


def _replicas(nodes: DataFrame, width: int, count: int, words: int, *more: str) -> DataFrame:
    """(anchor, node, n, head, ``more``) of ``nodes``: a row for each segment, ``head`` the ``words`` that are compared."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                fps = words_of(c.column(2), WIDE)
                index, a = segment_anchors(np.ascontiguousarray(fps), width, count)
                head = pa.array([x.tobytes() for x in fps[:, :words]], pa.binary())
                index = pa.array(index)
                beside = [c.column(k).take(index) for k in range(3, 3 + len(more))]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), c.column(0).take(index), c.column(1).take(index), head.take(index), *beside], names=["anchor", "node", "n", "head", *more])

    fields = "".join(f", {x} {nodes.schema[x].dataType.simpleString()}" for x in more)
    return nodes.select("node", "n", "fp", *more).mapInArrow(frugal(spread), f"anchor long, node long, n int, head binary{fields}")


def nearest(nodes: DataFrame, width: int, count: int) -> DataFrame:
    """(a, b, d): for each node b, at each anchor, the nearest of the nodes before it that may be similar.

    Rows of an anchor stand in the order of their nodes. A row is compared with
    the ``CROWD`` rows before it and the first ``CROWD`` of its anchor, so an
    anchor streams through its task however long it is. Where that is less
    than all before it, all nodes of the anchor are named with a null ``a``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [*(b.column(k).to_numpy() for k in range(3)), words_of(b.column(3), SCREEN)]
            old = 0
            if held is not None:
                old = len(held[0])
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            anchor, node, n, fps = now
            edge = _edges(anchor)
            place = np.arange(len(anchor)) - np.repeat(edge[:-1], np.diff(edge))
            best, who = np.full(len(anchor), LOOSE + 1, np.uint16), np.full(len(anchor), -1)

            def attempt(i: np.ndarray, j: np.ndarray) -> None:
                d = _bits(fps, i, j)
                win = (d < best[i]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
                best[i[win]], who[i[win]] = d[win], j[win]

            fresh = np.arange(old, len(anchor))
            for k in range(1, CROWD + 1):
                fresh = fresh[place[fresh] >= k]
                if not len(fresh):
                    break
                attempt(fresh, fresh - k)
            fresh = np.arange(old, len(anchor))
            for k in range(CROWD):
                fresh = fresh[place[fresh] > CROWD + k]
                if not len(fresh):
                    break
                attempt(fresh, fresh - place[fresh] + k)
            got = np.flatnonzero(who >= 0)
            crowd = np.flatnonzero(np.repeat(np.diff(edge) > 2 * CROWD, np.diff(edge)))
            a = pa.array(np.concatenate([node[who[got]], np.zeros(len(crowd), np.int64)]), mask=np.arange(len(got) + len(crowd)) >= len(got))
            yield pa.RecordBatch.from_arrays([a, pa.array(np.concatenate([node[got], node[crowd]])), pa.array(np.concatenate([best[got], np.zeros(len(crowd), np.uint16)]).astype(np.int32))], names=["a", "b", "d"])
            last = edge[-2]
            stay = np.arange(last, len(anchor))
            if len(stay) > 2 * CROWD:
                stay = np.concatenate([stay[:CROWD], stay[-CROWD:]])
                # Their places stay over 2 * CROWD by one held row more.
                stay = np.insert(stay, CROWD, last + CROWD)
            held = [x[stay].copy() for x in now]

    n = partitions(nodes.sparkSession)
    dealt = _replicas(nodes, width, count, SCREEN).repartition(n, "anchor").sortWithinPartitions("anchor", "node")
    return dealt.mapInArrow(frugal(compare), "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def pairs_between(nodes: DataFrame, sharp: DataFrame, width: int, count: int) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, n, fp, root) of different roots that meet and may be similar.

    An anchor of over ``HOT`` rows is dealt: rows of its commonest root in
    blocks, the others in blocks, and each pair of blocks with others in it is
    a group of its own. Rows of the commonest root are not compared with each other.
    What may be similar is dealt in tiles of some 64 rows by 64, whose rows get their long fingerprints
    (``sharp``) and say with which others they are compared, so that these join rows and not pairs.
    """

    def near(t: pa.RecordBatch, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, side, anchor, node, root, n = (t.column(k).to_numpy() for k in range(6))

        def out(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(i), 1 << 12):
                x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
                use = _near(fps, n, x, y)
                x, y = x[use], y[use]
                if len(x):
                    # A pair that meets at several anchors is named at the first.
                    own = [segment_anchors(np.ascontiguousarray(fps[k]), width, count)[1].reshape(-1, count) for k in (x, y)]
                    first = own[0][np.arange(len(x)), (own[0] == own[1]).argmax(axis=1)] == anchor[x].view(np.uint64)
                    yield x[first], y[first]

        for i, j in _small_pairs(group):
            use = (root[i] != root[j]) & _meet(side[i], side[j])
            yield from out(i[use], j[use])
        for s, e in _large_groups(group):
            for at in range(s, e, 64):
                a = np.arange(at, min(at + 64, e))
                for to in range(at, e, 64):
                    b = np.arange(to, min(to + 64, e))
                    use = (root[a][:, None] != root[b][None, :]) & _meet(side[a][:, None], side[b][None, :]) & (a[:, None] < b[None, :])
                    r, c = np.nonzero(use)
                    yield from out(a[r], b[c])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() << 33
        for t in whole_groups(batches):
            node, n = t.column(3).to_numpy(), t.column(5).to_numpy()
            for x, y in near(t, words_of(t.column(6), WIDE)):
                if len(x):
                    rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                    x, y = place[: len(x)], place[len(x) :]
                    edge = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(rows)))])
                    others = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(y[np.argsort(x, kind="stable")], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), deal)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(node[rows]), pa.array(n[rows]), others], names=["deal", "place", "node", "n", "others"])
                    deal += 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            deal, node, n, fps = t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), words_of(t.column(5), WIDE + MORE)
            edge = _edges(deal)
            x = np.repeat(np.arange(len(deal)), t.column(4).value_lengths().to_numpy())
            y = np.repeat(edge[:-1], np.diff(edge))[x] + t.column(4).flatten().to_numpy()
            for at in range(0, len(x), 1 << 12):
                i, j = x[at : at + (1 << 12)], y[at : at + (1 << 12)]
                use = (_distance(fps[i], fps[j]) <= SHARP) | (np.where(node[i] > node[j], n[i], n[j]) <= SMALL)
                i, j = node[i[use]], node[j[use]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    sent = _replicas(nodes, width, count, WIDE, "root")
    per_root = sent.groupBy("anchor", "root").agg(F.count("*").alias("c"))
    hot = per_root.groupBy("anchor").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main")).filter(F.col("all") > HOT)
    hot = hot.select("anchor", "main", F.expr(f"cast(ceil(most / {HOT}) as int)").alias("m"), F.expr(f"cast(ceil((all - most) / {HOT}) as int)").alias("o"))
    far = sent.join(hot, "anchor", "left").withColumn("is_main", F.expr("root = main"))
    own = far.withColumn("own", F.expr("cast(pmod(xxhash64(node, 7), greatest(if(is_main, m, o), 1)) as int)"))
    # (block of the others, block of the commonest root, or of the others from -1 down)
    groups = F.expr(f"""case when main is null then array(struct(0 as i, 0 as j, {WHOLE} as side))
        when o = 0 then cast(array() as array<struct<i: int, j: int, side: int>>)
        when is_main then transform(sequence(0, o - 1), x -> struct(x as i, own as j, 0 as side))
        else concat(transform(sequence(0, m - 1), x -> struct(own as i, x as j, 1 as side)),
                    transform(sequence(0, o - 1), x -> struct(least(own, x) as i, -1 - greatest(own, x) as j, case when own = x then {WHOLE} when own < x then 0 else 1 end as side))) end""")
    own = own.withColumn("g", F.explode(groups))
    group = F.when(F.col("main").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", "g.i", "g.j"))
    dealt = own.select(group.alias("group"), F.col("g.side").alias("side"), "anchor", "node", "root", "n", "head")
    n = partitions(nodes.sparkSession)
    dealt = dealt.repartition(n, "group").sortWithinPartitions("group")
    again = materialize(dealt.mapInArrow(frugal(screen), "deal long, place int, node long, n int, others array<int>"))
    again = again.join(sharp.select("node", "fp"), "node").select("deal", "place", "node", "n", "others", "fp")
    return again.repartition(n, "deal").sortWithinPartitions("deal", "place").mapInArrow(frugal(compare), "a long, b long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def measured(pairs: DataFrame, sharp: DataFrame) -> DataFrame:
    """(a, b, d): the bits that differ in the long fingerprints of each pair, where so few do that it may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            d = _distance(words_of(t.column(3), WIDE + MORE), words_of(t.column(4), WIDE + MORE))
            keep = pa.array((d <= SHARP) | (t.column(2).to_numpy() <= SMALL))
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (t.column(0), t.column(1), pa.array(d))], names=["a", "b", "d"])

    left = sharp.select(F.col("node").alias("a"), F.col("fp").alias("fp_a"))
    right = sharp.select(F.col("node").alias("b"), "n", F.col("fp").alias("fp_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "fp_a", "fp_b").mapInArrow(frugal(run), "a long, b long, d int")


def closest(found: DataFrame, sharp: DataFrame) -> DataFrame:
    """(a, b, next): for each b of ``found`` the a that differs least in long fingerprints, and the one after it or null.

    ``found`` (a, b, d) has at most one a for each b and anchor; of those the ``FEW`` that differ least by d are
    measured, which only says what is tried first. A b without an a that may be similar is left out.
    """
    few = found.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "a"))), 1, FEW).alias("near"))
    few = few.select(F.explode("near.a").alias("a"), "b")
    ranked = measured(few, sharp).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("d", "a"))).alias("near"))
    return ranked.select(F.col("near")[0]["a"].alias("a"), "b", F.get(F.col("near"), F.lit(1))["a"].alias("next"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, set binary, more binary) of (node, text): sorted distinct hashes of five-word shingles, and ``MORE`` words of fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), SHINGLE)) for t in c.column(1)]
                more = [set_fingerprint(h, MORE, WIDE).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(more, pa.binary())], names=["node", "set", "more"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(frugal(run), "node long, set binary, more binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes whose shingle sets (node, set) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield t.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(frugal(run), "a long, b long")


def row_bits(rows: DataFrame, row_col: str) -> DataFrame:
    """(block, bits): a bit for each row number of ``rows``, in bitmaps of ``SPAN``."""
    place = F.col(row_col)
    return materialize(rows.groupBy(F.floor(place / SPAN).alias("block")).agg(F.bitmap_construct_agg(place % SPAN).alias("bits")))


def chosen(docs: DataFrame, bits: DataFrame, row_col: str) -> DataFrame:
    """The rows of ``docs`` whose bit is set. A bit a document is broadcast, so texts stay where they lie."""
    named = F.broadcast(bits.toDF("_block", "_bits"))
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast({row_col} % {SPAN} as int) div 8 + 1, 1)), 16, 10) as int)")
    is_set = F.getbit(byte, (F.col(row_col) % 8).cast("int")) == 1
    return docs.join(named, F.floor(F.col(row_col) / SPAN) == F.col("_block")).filter(is_set).drop("_block", "_bits")


def similar_links(nodes: DataFrame, docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(node, root) of the components that verified links make.

    ``nodes``: (node, rep, n, fp), rep a row that has the node's set. First
    each node is checked with the nearest of those before it, or else the
    second nearest, which joins most of a group of copies by one link a node;
    then all pairs between what is still apart.
    """
    wide = nodes.filter(F.col("n") >= LEAST)
    width, count = segments(wide.count())
    found = materialize(nearest(wide, width, count))
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    live = materialize(wide.join(ends, "node", "left_semi").select("node", "rep", "n", "fp"))
    bits = row_bits(live, "rep")
    texts = chosen(docs.select(F.col(row_col).alias("rep"), F.col(text_col).alias("text")), bits, "rep").join(live.select("rep", "node"), "rep")
    sets = materialize(shingle_sets(texts), codec="none")
    sharp = materialize(live.join(sets.select("node", "more"), "node").select("node", "n", F.concat("fp", "more").alias("fp")))
    first = materialize(closest(found.filter("a is not null"), sharp))
    links = materialize(verified(first.select("a", "b"), sets))
    second = first.filter("next is not null").join(links, "b", "left_anti").select(F.col("next").alias("a"), "b")
    links = links.unionAll(materialize(verified(second, sets)))
    roots = materialize(connected_components(links))
    rooted = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialize(pairs_between(rooted, sharp, width, count))
    more = materialize(verified(rest, sets))
    out = connected_components(links.unionAll(more))
    for old in (found, live, bits, sets, sharp, roots, rest, first):
        discard(old)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-copies: sets of five-word shingles of Jaccard similarity 0.8 or more.

    Rows with equal sets are one node. Fingerprints of the sets find
    candidates only: those that agree in any segment (``segments``), in most
    bits and nearly in size. The sets themselves decide every link. A set of under ``LEAST`` shingles is similar to its equals alone.

    Of each component one row stays: the smallest id, null ids last, ties by
    a hash of the text and then by the place of the row.
    """
    docs = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    marks = materialize(_marks(docs, "_row", id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th", "row")
    nodes = materialize(marks.groupBy("node").agg(F.min("row").alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(order).alias("best")))
    roots = similar_links(nodes, docs, "_row", text_col)
    rooted = nodes.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    bits = row_bits(stay, "_row")
    return materialize(chosen(docs, bits, "_row").drop("_row"), docs, marks, nodes, bits)


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
