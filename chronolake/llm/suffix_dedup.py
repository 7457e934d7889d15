"""Exact substring dedup of bytes by difference-cover blockwise suffix sorting.

Suffixes matter to a depth of ``size`` bytes. They are sorted a block at a
time, as in blockwise suffix-array construction over a difference cover:

1. The cover sample holds the suffixes that start at a place p of their
   document with p modulo 31 in D = {0, 1, 3, 8, 12, 18}, a difference cover:
   any two places have a common shift below 31 that takes both into the
   sample. Sample suffixes are ranked first, by their first size + 30 bytes.
2. Long ties are resolved by those ranks alone. Where a text repeats a stretch
   of size + 60 bytes or more, each period of 31 places has a sample place at
   which both copies are in the sample. If an earlier document has one of the
   same rank, the 31 suffixes from there on are settled and never sorted.
3. The other suffixes are sorted by their first ``size`` bytes, a bucket at a
   time. A bucket holds the suffixes of some minimizers and is as large as
   ``chunks.BUCKET_BYTES`` says, so memory holds one bucket.

In a bucket, suffixes whose hash no other has are set apart first: they tie
with none. The rest are sorted by their bytes; equal ones have one rank. Dedup
asks which suffixes tie and which document of a tie is first, so ranks are not
numbered across buckets, and their order by minimizer is as good as any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import frugal, mix
from .chunks import CHUNK_SCHEMA, Chunk, Runs, buckets, bytes8, chunk_of, cover, earlier, minima, pack_chunks, runs, with_masks
from .common import materialize

SIZE = 50
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
#: Bytes of a gram, the least of a suffix's being its minimizer, and places that are hashed at once, so as to stay in cache.
GRAM, BLOCK = 16, 1 << 16


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place; the last places take zeros."""
    h = bytes8(data).copy()
    rest = h[8:].copy()
    h *= np.uint64(0x9E3779B97F4A7C15)
    h[: len(rest)] += rest
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def minimizers(data: np.ndarray, depth: int) -> np.ndarray:
    """The least gram of the ``depth`` bytes from each place."""
    out = np.empty(len(data), np.uint32)
    for at in range(0, len(data), BLOCK):
        part = (grams(data[at : at + BLOCK + depth]) >> np.uint64(32)).astype(np.uint32)
        out[at : at + BLOCK] = minima(part, depth - GRAM + 1)[: len(data[at : at + BLOCK])]
    return out


def suffixes(c: Chunk, depth: int, total: int, done: np.ndarray | None = None) -> tuple[Runs, np.ndarray]:
    """(runs, places): suffixes of ``depth`` bytes that are not ``done``; without ``done``, those of the cover sample."""
    spans = [(a, z - depth + 1) for a, z in zip(c.starts.tolist(), c.ends.tolist(), strict=True) if z - a >= depth]
    if done is None:
        at = [((np.arange(a, z, PERIOD)[:, None] + np.array(COVER)).ravel(), z) for a, z in spans]
        at = np.concatenate([x[x < z] for x, z in at]) if at else np.zeros(0, np.int64)
        step = max(COVER) - COVER[-2] + PERIOD
    else:
        live = np.zeros(len(c.bytes), bool)
        for a, z in spans:
            live[a:z] = True
        live &= ~done
        at, step = np.flatnonzero(live), 1
    # The last depth - 1 places of a document are no suffixes, so a step within ``step`` stays in one.
    follows = np.ones(len(at), bool)
    follows[1:] = at[1:] - at[:-1] <= min(step, depth - 1)
    least = minimizers(c.bytes, depth)[at]

    def doc(w: np.ndarray) -> np.ndarray:
        return np.searchsorted(c.ends, at[w], side="right")

    tag = (lambda w: (at[w] - c.starts[doc(w)]) % PERIOD) if done is None else None
    return Runs(c.bytes, at, depth, lambda w: c.rank[doc(w)], follows, least, total, tag), at


def cut_suffixes(depth: int, sample: bool) -> Callable:
    """The windows of a bucket's strings: every place, or those in the cover, counted from the tag."""

    def cut(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
        n, before = ends - begins - depth + 1, np.zeros(len(begins), np.int64)
        if sample:
            # The j-th place of the cover is PERIOD * (j // 6) + COVER[j % 6]; a string has those from its tag on.
            count = np.searchsorted(np.array(COVER), np.arange(PERIOD))
            place = len(COVER) * ((tags + n) // PERIOD) + count[(tags + n) % PERIOD]
            before = count[tags]
            n = place - before
        string = np.repeat(np.arange(len(n), dtype=np.int32), n)
        inside = np.arange(len(string)) + np.repeat(before - (np.cumsum(n) - n), n)
        if sample:
            inside = PERIOD * (inside // len(COVER)) + np.array(COVER)[inside % len(COVER)] - tags[string]
        at = begins[string] + inside
        gram, h = grams(text), np.zeros(len(at), np.uint64)
        # Some bytes in between may be left out: ties are decided by all of them.
        for k in np.linspace(0, depth - GRAM, 1 + depth // (GRAM + 1)).astype(int).tolist():
            h *= np.uint64(0x94D049BB133111EB)
            h += gram[at + k]
        return at, at + depth, mix(h), string

    return cut


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for each row of ``docs``.

    A byte goes if a string of ``size`` bytes (``GRAM`` at least) over it also
    starts in a text with a smaller id; strings are judged on the input, lie
    inside one text and are compared byte by byte. Null texts are empty; a null
    id is smaller than all others. Rows that repeat an id are not smaller than
    each other.
    """
    chunks = pack_chunks(docs, id_col, text_col)
    total, depth = buckets(chunks), size + PERIOD - 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for i in range(b.num_rows):
                c = chunk_of(b, i)
                sample, at = suffixes(c, depth, total)
                hit = np.zeros(len(c.bytes), bool)
                hit[at[sample.hits(b.column("masks")[i].as_py(), True)]] = True
                done.append(np.packbits(cover(hit, PERIOD)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k.split()[0]) for k in CHUNK_SCHEMA.split(", ")), pa.array(done, pa.binary())], names=[*(k.split()[0] for k in CHUNK_SCHEMA.split(", ")), "done"])

    sampled = with_masks(chunks, earlier(chunks, lambda b, i: suffixes(chunk_of(b, i), depth, total)[0], cut_suffixes(depth, True), True, total))
    chunks = materialize(sampled.mapInArrow(frugal(settle), f"{CHUNK_SCHEMA}, done binary"), chunks, codec="lz4")

    def unsettled(b: pa.RecordBatch, i: int) -> tuple[Chunk, Runs, np.ndarray, np.ndarray]:
        c = chunk_of(b, i)
        done = np.unpackbits(np.frombuffer(b.column("done")[i].as_py(), np.uint8), count=len(c.bytes)).astype(bool)
        return c, *suffixes(c, size, total, done), done

    masks = earlier(chunks, lambda b, i: unsettled(b, i)[1], cut_suffixes(size, False), True, total)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, rest, at, gone = unsettled(b, i)
                gone[at[rest.hits(b.column("masks")[i].as_py(), True)]] = True
                gone = cover(gone, size)
                sums = np.concatenate(([0], np.cumsum(gone)))
                kept, keep = [], ~gone
                for lo, hi in zip(c.starts.tolist(), c.ends.tolist(), strict=True):
                    kept.append(c.bytes[lo:hi][keep[lo:hi]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [c.ids, pa.array(c.sizes), pa.array(sums[c.ends] - sums[c.starts]), pa.array(runs(gone, c.starts, c.ends)), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    out = with_masks(chunks, masks).mapInArrow(frugal(finish), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after 50-byte strings of earlier documents."""
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}
