"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes ends a piece where it is -1 modulo the block
size, so an edit moves only the boundaries near it. A signature has one base-64
character for each piece; a fingerprint holds the signatures at its block size
and at twice it. Two fingerprints are compared at a block size they share, by
edit distance, and only if they share a run of seven characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Rolling, byte_values
from .common import materialize, partitions

REACH, LEAST, LENGTH, RUN = 7, 3, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
VALUES = byte_values()


def signature(roll: Rolling, trigger: np.ndarray, n: int, block: int) -> bytes:
    """One character for each piece; the last of ``LENGTH`` takes all the rest."""
    ends = np.flatnonzero(trigger % np.uint64(block) == np.uint64(block - 1)) + REACH
    ends = ends[ends < n][: LENGTH - 1]
    starts = np.concatenate(([0], ends))
    return ALPHABET[(roll.at(starts, np.append(ends, n)) & np.uint64(63)).astype(np.int64)].tobytes()


def fingerprint(text: bytes) -> str:
    """``block:signature:signature at twice the block``; empty text: ``3::``.

    The block size is the least 3 * 2**k at which the text would fill no more
    than a signature, halved while that leaves under half of one.
    """
    n = len(text)
    if not n:
        return f"{LEAST}::"
    with np.errstate(over="ignore"):
        roll = Rolling(VALUES[np.frombuffer(text, np.uint8)])
        trigger = roll.windows(REACH) >> np.uint64(16)
        block = LEAST
        while block * LENGTH < n:
            block *= 2
        first = signature(roll, trigger, n, block)
        second = signature(roll, trigger, n, 2 * block)
        while len(first) < LENGTH // 2 and block > LEAST:
            block //= 2
            first, second = signature(roll, trigger, n, block), first
    return f"{block}:{first.decode()}:{second.decode()}"


def _near(a: Column, b: Column) -> Column:
    """Likeness of two signatures, 0 without a common run of ``RUN`` characters."""
    def grams(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (RUN - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(RUN)))

    ratio = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 1.0).when((F.length(a) >= RUN) & (F.length(b) >= RUN) & F.arrays_overlap(grams(a), grams(b)), ratio).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: the best at a block size they share."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = x[0].cast("long"), y[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(size_a == size_b, F.greatest(_near(x[1], y[1]), _near(x[2], y[2])))
        .when(size_a == size_b * 2, _near(x[1], y[2]))
        .when(size_b == size_a * 2, _near(x[2], y[1]))
        .otherwise(0.0)
    )


PRINTS = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
EDGES = f"part int, last boolean, text string, {PRINTS}"


def edited(text: str, ahead: str) -> bytes:
    """``text`` with its last half, rounded down, replaced by as much of the start of ``ahead``."""
    half = len(text) // 2
    return (text[: len(text) - half] + ahead[:half]).encode()


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with fingerprints of it, its edited text and the next.

    The edited text keeps the first code points and takes the last
    floor(n_chars / 2) from the start of the next document's text, as many as
    it has. After the last document comes the first; a single document is its
    own next. Null texts are empty. Null ids come first; rows that repeat an id
    stand in the order of a hash of their text.

    Rows go to ranges of (id, hash of the text), so no id must fit a task. A
    range gives the rows of all but its last document, whose next one is in
    another range, and the texts of its first and last ones; a join of those,
    two for each range, gives the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mark = fingerprint(text.encode())
                if held is None:
                    out.append((part, False, text, None, None, None, mark, None, None))
                else:
                    change = edited(held[1], text)
                    out.append((None, None, None, held[0], len(held[1]), hashlib.sha256(change).hexdigest(), held[2], fingerprint(change), mark))
                held = (key, text, mark)
            yield table(out, EDGES)
        if held is not None:
            yield table([(part, True, held[1], held[0], len(held[1]), None, held[2], None, None)], EDGES)

    def table(rows: list[tuple], fields: str) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(cols, types, strict=True)], names=list(names))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, mark, ahead, ahead_mark in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                change = edited(text, ahead)
                out.append((key, len(text), hashlib.sha256(change).hexdigest(), mark, fingerprint(change), ahead_mark))
            yield table(out, PRINTS)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = (F.col("id").asc_nulls_first(), "tie", "place")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(ranged.select("id", "text").mapInArrow(run, EDGES))
    first = found.filter("not last").select(F.col("part").alias("to"), F.col("text").alias("ahead"), F.col("fingerprint").alias("ahead_mark"))
    # One row, without its text, for each range.
    near = Window.orderBy("to")
    after = first.select("to").withColumn("from", F.lag("to").over(near)).withColumn("from", F.coalesce("from", F.max("to").over(Window.partitionBy())))
    last = found.filter("last").select("part", "id", "text", "fingerprint")
    ends = last.join(after, F.col("part") == F.col("from")).join(first, "to").select("id", "text", "fingerprint", "ahead", "ahead_mark").mapInArrow(close, PRINTS)
    names = [f.split()[0] for f in PRINTS.split(", ")]
    return found.filter("part is null").select(*names).unionByName(ends).withColumnRenamed("id", id_col)


def op8_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    out = fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = out.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    return near.drop("next_fingerprint")


QUERIES = {"op8_piecewise_hash": op8_piecewise_hash}
SQL: dict[str, str] = {}
