"""A stored inverted index of bigrams: bitmaps by token and block of ids.

A container is the bitmap of the 32,768 ids of one block that have a token.
Bitmaps are built, merged and intersected by Spark's own bitmap aggregates, and
the file codec takes the zeros out of sparse ones. Files lie in folders of token
buckets, sorted by token, so a search reads the folders of its tokens' buckets
and in them the row groups that may hold them.

The index grows by segments: each batch of texts adds one, and ids that go are
listed apart. Whoever reads merges the segments of its tokens; ``compact``
merges them all. Each step is one commit of the store (``sources.snapshots``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bigrams
from ..sources.checkpoints import written
from ..sources.snapshots import Snapshots, Stale

BLOCK_BITS = 15
BUCKETS = 64
#: Blocks that a written file spans, as a power of two, and the tasks that write a segment.
SPAN_BITS, PARTS = 4, 256


def token_bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def packed(postings: DataFrame) -> DataFrame:
    """(token, block, bits, n, low, high) of postings (token, id): a container a row, its ids counted and bounded.

    An id that comes several times with a token counts once; null ids have no place.
    """
    block, place = F.shiftright("id", BLOCK_BITS), F.col("id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    placed = postings.filter("id is not null").select("token", block.alias("block"), place.alias("place"), "id")
    out = placed.groupBy("token", "block").agg(F.bitmap_construct_agg("place").alias("bits"), F.min("id").alias("low"), F.max("id").alias("high"))
    return out.select("token", "block", "bits", F.bitmap_count("bits").alias("n"), "low", "high")


def segment(containers: DataFrame) -> DataFrame:
    """Containers dealt as a segment is written: files of a bucket and a span of blocks, sorted for the row groups' bounds."""
    rows = containers.withColumn("bucket", token_bucket(F.col("token")))
    # A stated number, as partitions that look small would be joined: bitmaps are sorted at 4 KB each, and exchanged at a few bytes.
    return rows.repartition(PARTS, "bucket", F.shiftright("block", SPAN_BITS)).sortWithinPartitions("bucket", "token", "block")


@contextmanager
def apart(spark: SparkSession) -> Iterator[None]:
    """Partitions of an exchange stay as they are while this lasts, for the same reason."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def places(bits: Column) -> Column:
    """The places of the bits that are set; bytes without one cost a comparison each."""
    byte = lambda i: F.conv(F.hex(F.substring(bits, i + 1, F.lit(1))), 16, 10).cast("int")
    used = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS - 3) - 1)), lambda i: F.substring(bits, i + 1, F.lit(1)) != F.lit(b"\0"))
    each = F.array(*map(F.lit, range(8)))
    return F.flatten(F.transform(used, lambda i: F.transform(F.filter(each, lambda j: F.getbit(byte(i), j) == 1), lambda j: i * 8 + j)))


def unpacked(containers: DataFrame, *keep: str) -> DataFrame:
    """A row for each id of containers (block, bits, ...), with the columns of ``keep``."""
    return containers.select(*keep, "block", F.explode(places(F.col("bits"))).alias("place")).select(*keep, (F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("id"))


def unlinked(containers: DataFrame, gone: DataFrame) -> DataFrame:
    """Containers without the ids that are gone (id); tokens that have none left vanish.

    If both sides have a ``turn``, an id has gone from containers of earlier
    turns only. The ids that are gone are bitmaps too, one a block and turn, and
    are taken out of the blocks' containers as they lie.
    """
    names, turns = ("token", "block", "bits", "n", "low", "high"), "turn" in containers.columns and "turn" in gone.columns
    c = containers if turns else containers.withColumn("turn", F.lit(0))
    g = gone.select(F.col("id").alias("_id"), (F.col("turn") if turns else F.lit(1)).alias("_turn")).filter("_id is not null")
    each = g.join(c.select("turn").distinct(), F.col("turn") < F.col("_turn"))
    masks = written(each.groupBy(F.shiftright("_id", BLOCK_BITS).alias("block"), "turn").agg(F.bitmap_construct_agg(F.col("_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))).alias("_mask")))
    j = c.join(masks, ["block", "turn"], "left").select(*names, "_mask")

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                bits, mask = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 6))
                left = bits & ~mask
                some = left.any(axis=1)
                left, block = left[some], b.column(1).to_numpy()[some]
                each = np.unpackbits(left, axis=1, bitorder="little")
                first, last = each.argmax(axis=1), each.shape[1] - 1 - each[:, ::-1].argmax(axis=1)
                body = pa.array([x.tobytes() for x in left], pa.binary())
                base = block.astype(np.int64) << BLOCK_BITS
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(block), body, pa.array(each.sum(axis=1, dtype=np.int64)), pa.array(base + first), pa.array(base + last)], names=list(names))

    hit = j.filter("_mask is not null")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hit.select(*names).schema)
    return j.filter("_mask is null").select(*names).unionByName(hit.mapInArrow(take_out, fields))


class BitmapIndex:
    """The index ``name`` of a store. Operators take it where they take postings."""

    def __init__(self, store: Snapshots, name: str = "postings"):
        self.store, self.name, self.gone = store, name, f"{name}-gone"

    # Writing

    def add(self, texts: DataFrame, batch: int | None = None, id_col: str = "id", text_col: str = "text") -> bool:
        """Add the bigrams of (id, text) as a segment; whether it was added.

        ``batch`` numbers the batches of a stream from 0: one that was
        committed already, and comes again after a failure, changes nothing.
        """
        seen = f"batches/{self.name}"
        if batch is not None and self.store.guard(seen) > batch:
            return False
        turn = self.store.claim(f"turn/{self.name}")
        tokens = texts.select(F.col(id_col).cast("long").alias("id"), F.explode(bigrams(F.col(text_col))).alias("token"))
        rows = segment(packed(tokens).withColumn("turn", F.lit(turn).cast("long")))
        with apart(self.store.spark):
            staged = self.store.stage(rows, ("bucket",))
        try:
            self.store.commit(add={self.name: staged}, **({} if batch is None else {"expect": {seen: batch}, "guards": {seen: batch + 1}}))
        except Stale:
            return False
        return True

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Unlink ids from all segments there are; a later segment may bring them back."""
        turn = self.store.claim(f"turn/{self.name}")
        rows = ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct().withColumn("turn", F.lit(turn).cast("long"))
        self.store.commit(add={self.gone: self.store.stage(rows)})

    def compact(self) -> None:
        """All segments as one, without the ids that are gone; ``Conflict`` if a writer came between."""
        base = self.store.read()
        turn = base["guards"].get(f"turn/{self.name}", 0)
        rows = segment(self.containers(manifest=base).withColumn("turn", F.lit(turn).cast("long")))
        with apart(self.store.spark):
            staged = self.store.stage(rows, ("bucket",))
        replace = {self.name: staged}
        if self.gone in base["tables"]:
            replace[self.gone] = {"parts": [], "schema": base["tables"][self.gone]["schema"]}
        self.store.commit(replace=replace, base=base)

    # Reading

    def containers(self, tokens: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """(token, block, bits, n, low, high), one row a token and block; of the given tokens alone, if any."""
        manifest = manifest or self.store.read()
        rows = self.store.table(self.name, manifest)
        names = ("token", "block", "bits", "n", "low", "high")
        if rows is None:
            return self.store.spark.createDataFrame([], "token string, block long, bits binary, n long, low long, high long")
        if tokens is not None:
            rows = rows.filter(F.col("bucket").isin(*[token_bucket(F.lit(t)) for t in tokens]) & F.col("token").isin(*tokens)) if tokens else rows.filter(F.lit(False))
        gone = manifest["tables"].get(self.gone, {"parts": []})["parts"]
        if gone:
            listed = self.store.table(self.gone, manifest)
            rows = unlinked(rows, listed)
        if gone or len(manifest["tables"][self.name]["parts"]) > 1:
            rows = rows.groupBy("token", "block").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("n", F.bitmap_count("bits"))
        return rows.select(*names)

    def matches(self, tokens: list[str], fuzzy: bool) -> DataFrame:
        """(id, hits): strict: all tokens, none of which may be missing; fuzzy: any, those missing from the index skipped."""
        found = self.containers(tokens)
        if fuzzy:
            return unpacked(found, "token").groupBy("id").agg(F.count("*").alias("hits"))
        both = found.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("hits"))
        return unpacked(both.filter(F.col("hits") == len(tokens)), "hits").select("id", "hits")

    def frequency(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, df); bitmaps are not read if the index is one segment."""
        return self.containers(tokens).groupBy("token").agg(F.sum("n").alias("df"))
