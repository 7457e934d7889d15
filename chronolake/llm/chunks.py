"""Documents packed into chunks, and an exact exchange of windows between them.

A chunk holds whole documents in doc_id order, at most ``CHUNK_BYTES`` of text
unless one document is longer. Chunk numbers rise with doc_id, so "occurs
before" is "in an earlier chunk, or earlier in this one". Rows that repeat an
id may span chunks and tasks; those chunks hold no other id, so "in a smaller
id" is "in an earlier chunk that begins with another id, or earlier in this one".

``earlier`` is the exchange. A window goes to the bucket of its minimizer, the
least hash of the grams in it, so equal windows meet, and neighbours, which
mostly have the same one, travel as one string of text. A bucket thus has the
windows' bytes and compares those: hashes only choose what is compared. A chunk
sends equal strings once, so a passage that a third of all rows share costs one
string for each chunk. Buckets are as many as the bytes of all chunks ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import frugal, mix, utf8
from .common import materialize, partitions

CHUNK_BYTES = 1 << 20
#: Bytes of strings that a bucket should get, and of strings for a byte of text at most.
BUCKET_BYTES, BLOW_UP = 8 << 20, 4
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_SCHEMA = "chunk long, n long, ids array<long>, sizes binary, body binary, extra binary"


def pack_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: ids, int64 text sizes in bytes, zstd of all texts.

    Null texts are empty; null ids come first. Rows that repeat an id stand in
    the order of a hash of their text, in one chunk or in several that have no
    other id: so do the first and the last id of each task, as they may go on
    in the next one. Columns named in
    ``carry`` travel beside the texts; ``carried`` gives them back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[bytes] = []
        extra: list[pa.RecordBatch] = []
        size = start = 0
        # Whether the chunk's id may have rows in the one before; ``start`` is where the last id's rows begin.
        alone, last = True, None

        def flush(k: int) -> pa.RecordBatch:
            """The first ``k`` documents as a chunk; the others stay."""
            nonlocal chunk, ids, parts, extra, size, start
            sink = pa.BufferOutputStream()
            if carry:
                table = pa.Table.from_batches(extra)
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(0, k))
                extra = table.slice(k).to_batches()
            sizes = np.array([len(p) for p in parts[:k]], np.int64)
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(parts[:k]))
            row = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([ids[:k]], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()), pa.array([body], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "n", "ids", "sizes", "body", "extra"])
            chunk, ids, parts, size, start = chunk + 1, ids[k:], parts[k:], size - int(sizes.sum()), 0
            return row

        for b in batches:
            data, at = utf8(b.column(1))
            at = at.tolist()
            beside = b.select(list(range(2, b.num_columns)))
            begun = 0
            for i, key in enumerate(b.column(0).to_pylist()):
                other, full = key != last, size + at[i + 1] - at[i] > chunk_bytes
                if parts and (full or (other and alone)):
                    if carry:
                        extra.append(beside.slice(begun, i - begun))
                        begun = i
                    if not other and start:
                        yield flush(start)
                        full = size + at[i + 1] - at[i] > chunk_bytes
                        alone = True
                    if other or full:
                        yield flush(len(parts))
                        alone = not other
                if other:
                    start = len(ids)
                ids.append(key)
                parts.append(data[at[i] : at[i + 1]].tobytes())
                size += at[i + 1] - at[i]
                last = key
            if carry:
                extra.append(beside.slice(begun))
        if start:
            yield flush(start)
        if parts:
            yield flush(len(parts))

    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *carry)
    # The last key deals copies that repeat an id, too.
    order = ("_id", F.xxhash64("_text"), "_place")
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_place")
    return materialize(rows.mapInArrow(frugal(run), CHUNK_SCHEMA), codec="none")


class Chunk:
    """One chunk's documents as arrays."""

    def __init__(self, ids: pa.Array, sizes: bytes, body: bytes):
        self.ids = ids
        self.sizes = np.frombuffer(sizes, np.int64)
        n = int(self.sizes.sum())
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(n, 1)), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        plain = ids.to_pylist()
        same = np.array([False] + [plain[i] == plain[i - 1] for i in range(1, len(plain))], bool)
        #: Number of each document's id among the chunk's; repeated ids share one.
        self.rank = np.cumsum(~same) - 1


def chunk_of(batch: pa.RecordBatch, i: int) -> Chunk:
    return Chunk(batch.column("ids")[i].values, batch.column("sizes")[i].as_py(), batch.column("body")[i].as_py())


def carried(batch: pa.RecordBatch, i: int) -> list[pa.Array]:
    """The carried columns of a chunk's documents."""
    table = pa.ipc.open_stream(batch.column("extra")[i].as_py()).read_all().combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(n, base, np.uint64)
            up[0] = 1
            down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have


class Rolling:
    """Hashes of any stretches of a sequence from one prefix sum.

    A stretch hashes to the sum of value * base**i over it, times base**-start,
    modulo 2**64, then mixed; equal stretches have equal hashes wherever they
    stand. Some different ones have too (Thue-Morse words, whatever the base):
    what must be exact compares the stretches as well.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.prefix[ends]
        h -= self.prefix[starts]
        h *= self.down[starts]
        return mix(h)

    def windows(self, size: int) -> np.ndarray:
        """Of each start that has ``size`` values after it."""
        n = max(len(self.prefix) - size, 0)
        h = self.prefix[size:] - self.prefix[:n] if n else np.zeros(0, np.uint64)
        h *= self.down[:n]
        return mix(h)


def byte_values() -> np.ndarray:
    """A fixed random value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


BLOCK = 1 << 15


def cover(flags: np.ndarray, size: int) -> np.ndarray:
    """Places within ``size`` places from a set flag on, itself included."""
    sums = np.cumsum(flags, dtype=np.int32)
    out = sums.copy()
    out[size:] -= sums[:-size] if size < len(sums) else 0
    return out > 0


def first_bits(n: int, flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags[:n]).tobytes())


def buckets(chunks: DataFrame) -> int:
    """The number of buckets that the bytes of all chunks ask for."""
    total = chunks.agg(F.sum("n")).first()[0] or 0
    return max(partitions(chunks.sparkSession), -(-total * BLOW_UP // BUCKET_BYTES))


def bytes8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, zeros after the end."""
    return np.ndarray((len(text),), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), 0, (1,))


def minima(h: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` values from each place; the last places take what there is."""
    out, have = h.copy(), 1
    while have < size:
        step = min(have, size - have)
        n = max(len(out) - step, 0)
        out[:n] = np.minimum(out[:n], out[step:])
        have += step
    return out


class Runs:
    """The windows of a chunk as strings for buckets.

    Windows are given in the order of their places: byte spans in ``text``
    (``ends`` may be one length for all), whether a window may follow the one
    before in a string, the minimizer (32 bits), and, by the number of the
    window, the document's rank and a tag that the receiver gets with each
    string.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray | int, rank: Callable, follows: np.ndarray, least: np.ndarray, total: int, tag: Callable | None = None):
        self.windows = len(starts)
        new = np.ones(len(starts), bool)
        new[1:] = ~follows[1:] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        bucket = ((mix(least[first] * np.uint64(BASE)) >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
        count = np.diff(np.append(first, len(starts)))
        order = np.argsort(bucket, kind="stable")
        self.first, self.count, self.bucket = first[order], count[order], bucket[order]
        last = self.first + self.count - 1
        begin, stop = starts[self.first], (starts[last] + ends if isinstance(ends, int) else ends[last])
        self.size, self.rank = stop - begin, rank(self.first)
        self.tag = np.zeros(len(order), np.uint8) if tag is None else tag(self.first).astype(np.uint8)
        body, seen = text.tobytes(), {}
        self.strings = [body[a:z] for a, z in zip(begin.tolist(), stop.tolist(), strict=True)]
        # For each string the first equal one. Those of different tags are cut into different windows.
        keys = self.strings if tag is None else zip(self.strings, self.tag.tolist(), strict=True)
        self.like = np.fromiter(map(seen.setdefault, keys, range(len(order))), np.int64, len(order))
        self.unique = np.flatnonzero(self.like == np.arange(len(order)))

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, strings, packed block) of each bucket that gets any."""
        if not len(self.unique):
            return
        u = self.unique
        edge = np.flatnonzero(np.diff(self.bucket[u], prepend=-1, append=-1)).tolist()
        press = zstandard.ZstdCompressor(level=1)
        size, rank, tag = self.size[u].astype("<i4"), self.rank[u].astype("<i4"), self.tag[u]
        strings = [self.strings[i] for i in u.tolist()]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            yield int(self.bucket[u[a]]), z - a, press.compress(b"".join([size[a:z].tobytes(), rank[a:z].tobytes(), tag[a:z].tobytes(), *strings[a:z]]))

    def hits(self, masks: list | None, strict: bool) -> np.ndarray:
        """For each window whether it occurs earlier, from the buckets' answers.

        With ``strict`` earlier means in a document of a lower rank, else
        anywhere before.
        """
        out = np.zeros(self.windows, bool)
        if not self.windows:
            return out
        n = self.count[self.unique]
        edge = np.concatenate(([0], np.cumsum(n)))
        own = self.bucket[self.unique]
        for m in masks or []:
            lo, hi = np.searchsorted(own, [m["bucket"], m["bucket"] + 1])
            if edge[hi] - edge[lo] != m["n"]:
                raise ValueError("a chunk's windows differ from those it sent")
            at = np.repeat(self.first[self.unique[lo:hi]] - (edge[lo:hi] - edge[lo]), n[lo:hi]) + np.arange(m["n"])
            out[at] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(m["bits"]), np.uint8), count=m["n"]).astype(bool)
        again = np.flatnonzero(self.like != np.arange(len(self.like)))
        for i, k in zip(again.tolist(), self.like[again].tolist(), strict=True):
            later = not strict or self.rank[i] > self.rank[k]
            out[self.first[i] : self.first[i] + self.count[i]] = True if later else out[self.first[k] : self.first[k] + self.count[k]]
        return out


def tied(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, group): windows that equal another one, by group and then place.

    ``h`` are hashes that agree where windows do. Windows of one length are
    sorted by their bytes; others by their hashes, each compared with the first of
    its hash, and where hashes agree and bytes do not, by their bytes.
    """
    s = np.sort(h)
    many = s[1:][s[1:] == s[:-1]]
    use = np.flatnonzero(member(h, many[np.concatenate(([True], many[1:] != many[:-1]))] if len(many) else many))
    none = np.zeros(0, np.int64)
    if not len(use):
        return none, none
    size = ends[use] - starts[use]
    if (size == size[0]).all() and size[0] <= 256:
        depth = int(size[0])
        rows = np.ndarray((len(text) - depth + 1,), f"S{depth}", np.ascontiguousarray(text), 0, (1,))[starts[use]]
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        new = np.concatenate(([True], rows[1:] != rows[:-1]))
        use = use[order]
    else:
        use = use[np.lexsort((use, h[use]))]
        new = np.concatenate(([True], h[use][1:] != h[use][:-1]))
        lead = use[np.flatnonzero(new)[np.cumsum(new) - 1]]
        wrong = ~same_bytes(text, starts[use], ends[use], starts[lead], ends[lead])
        if wrong.any():
            group = np.cumsum(new) - 1
            bad = np.isin(group, group[wrong])
            body = text.tobytes()
            names: dict = {}
            own = [names.setdefault((g, body[starts[i] : ends[i]]), len(names)) for g, i in zip(group[bad].tolist(), use[bad].tolist(), strict=True)]
            group[bad] = np.array(own) + len(use)
            order = np.argsort(group, kind="stable")
            use, group = use[order], group[order]
            new = np.concatenate(([True], group[1:] != group[:-1]))
    group = np.cumsum(new) - 1
    real = np.bincount(group)[group] > 1
    return use[real], group[real]


def same_bytes(text: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the stretches from ``a`` and from ``b`` have the same bytes."""
    size = a_end - a
    same = size == b_end - b
    eight = bytes8(text)
    live, k = np.flatnonzero(same & (a != b) & (size > 0)), 0
    while len(live):
        # The last step goes back so that it ends with the stretch; short ones are masked.
        left = size[live] - k
        back = np.where((left < 8) & (size[live] >= 8), 8 - left, 0)
        x = eight[a[live] + k - back] ^ eight[b[live] + k - back]
        short = size[live] < 8
        if short.any():
            x[short] &= (np.uint64(1) << (np.uint64(8) * size[live][short].astype(np.uint64))) - np.uint64(1)
        same[live[x != 0]] = False
        k += 8
        live = live[(x == 0) & (size[live] > k)]
    return same


def earlier(chunks: DataFrame, runs: Callable[[pa.RecordBatch, int], Runs], cut: Callable, strict: bool, total: int) -> DataFrame:
    """(chunk, masks): for each window that a chunk sends, whether it occurs earlier.

    ``runs(batch, row)`` gives a row's windows, the same on every call.
    ``cut(text, begins, ends, tags)`` gives the windows of a bucket's strings:
    starts, ends, hashes and the number of each one's string. With ``strict``
    a window occurs earlier if a document of a smaller id has it; chunks that
    begin with the same id are not earlier than each other. ``masks`` are
    (bucket, n, zstd of packed bits) for what ``Runs.hits`` reads.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(runs(b, i).blocks())
                if rows:
                    k, n, block = zip(*rows, strict=True)
                    head = b.column("ids")[i].values[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([b.column("chunk")[i].as_py()] * len(k), pa.int64()), pa.array([head] * len(k), pa.int64()), pa.array(n, pa.int32()), pa.array(block, pa.binary())], names=["bucket", "chunk", "head", "strings", "block"])

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        size, rank, tag, body, owner = [], [], [], [], []
        group, last = -1, ()
        press = zstandard.ZstdDecompressor()
        for i, (head, n, block) in enumerate(zip(t.column("head").to_pylist(), t.column("strings").to_pylist(), t.column("block"), strict=True)):
            data = np.frombuffer(press.decompress(block.as_buffer().to_pybytes()), np.uint8)
            if (head,) != last:
                group, last = group + 1, (head,)
            size.append(data[: 4 * n].view("<i4"))
            rank.append(data[4 * n : 8 * n].view("<i4").astype(np.int64) + (group << 32))
            tag.append(data[8 * n : 9 * n])
            body.append(data[9 * n :])
            owner.append(np.full(n, i))
        size, rank, tag, owner = (np.concatenate(x) for x in (size, rank, tag, owner))
        stop = np.cumsum(size, dtype=np.int64)
        text = np.concatenate(body)
        starts, ends, h, string = cut(text, stop - size, stop, tag)
        use, tie = tied(text, starts, ends, h)
        hit = np.zeros(len(starts), bool)
        if len(use):
            new = np.concatenate(([True], tie[1:] != tie[:-1]))
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            own = rank[string[use]]
            hit[use] = own > own[lead] if strict else ~new
        edge = np.searchsorted(owner[string], np.arange(t.num_rows + 1))
        mine = [i for i in range(t.num_rows) if hit[edge[i] : edge[i + 1]].any()]
        k = t.column("bucket")[0].as_py()
        return pa.table({"chunk": t.column("chunk").take(pa.array(mine, pa.int64())), "bucket": pa.array([k] * len(mine), pa.int32()), "n": pa.array([int(edge[i + 1] - edge[i]) for i in mine], pa.int32()), "bits": pa.array([first_bits(int(edge[i + 1] - edge[i]), hit[edge[i] : edge[i + 1]]) for i in mine], pa.binary())})

    sent = chunks.mapInArrow(frugal(send), "bucket int, chunk long, head long, strings int, block binary").repartition(max(partitions(chunks.sparkSession), total // 4), "bucket")
    masks = materialize(sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, n int, bits binary"), codec="none")
    return masks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("masks"))


def with_masks(chunks: DataFrame, masks: DataFrame) -> DataFrame:
    return chunks.join(masks.withColumnRenamed("chunk", "_chunk"), F.col("chunk") == F.col("_chunk"), "left").drop("_chunk")


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``h`` is in the sorted ``keys``; a bit table first."""
    out = np.zeros(len(h), bool)
    if not len(keys):
        return out
    bits = min(22, max(10, len(keys).bit_length() + 4))
    low = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[(keys >> low).astype(np.int64)] = True
    maybe = [np.flatnonzero(table[(h[at : at + BLOCK] >> low).view(np.int64)]) + at for at in range(0, len(h), BLOCK)]
    try_at = np.concatenate(maybe) if maybe else np.zeros(0, np.int64)
    at = np.searchsorted(keys, h[try_at])
    at[at == len(keys)] = 0
    out[try_at] = keys[at] == h[try_at]
    return out


def runs(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of maximal runs of set ``flags`` in each stretch."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    inside = starts[starts < ends]
    begin[inside] = flags[inside]
    total = np.concatenate(([0], np.cumsum(begin)))
    return total[ends] - total[starts]


def spread(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """A flag for each of n places that some stretch covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
