"""Exact top-K over packed blocks of vectors.

Vectors that lie near each other are packed into blocks: their numbers as
contiguous 32-bit rows, with a centre, a radius (the largest angle to the centre)
and the largest length. No vector of a block has a score above that length times
the cosine of what is left of the query's angle to the centre. A scan takes its
blocks by that bound, and once it has k scores it passes over blocks that can't
reach the k-th. All queries of a set share one scan; a task sends k rows for
each, and the best of those are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .similarity import choose_pivots

ROWS, PIVOTS = 256, 64
#: What float rounding may take from a bound.
SLACK = 1e-9
BLOCK = "dims int, n int, centre array<double>, radius double, longest double, ids array<long>, body binary"
HIT = "query int, id long, score double, blocks long, passed long"


def packed(vectors: DataFrame, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Blocks of (id, vector): at most ``rows`` vectors of one width that share a nearest pivot.

    Pivots are a bounded sample and decide only what stands together. Vectors
    are dealt by (width, pivot) and sorted by their angle to it, and a task
    packs what comes, so it holds a block at a time. Null vectors and null ids
    are left out; a zero vector scores 0.
    """
    sound = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter("id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x))")
    one = sound.filter("exists(vector, x -> x <> 0)")
    width = one.agg(F.max(F.size("vector"))).first()[0]
    points = choose_pivots(one.filter(F.size("vector") == width), pivots) if width else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(1).value_lengths())
            cell, far = np.full(len(size), -1, np.int32), np.zeros(len(size))
            own = np.flatnonzero(size == points.shape[1]) if len(points) else np.zeros(0, int)
            if len(own):
                x = np.asarray(b.column(1).take(pa.array(own)).flatten(), np.float64).reshape(len(own), -1)
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                near = (x / np.where(length > 0, length, 1)) @ points.T
                cell[own], far[own] = near.argmax(axis=1), -near.max(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(cell), pa.array(far)], names=["id", "vector", "dims", "cell", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, body = None, [], []

        def block() -> pa.RecordBatch:
            x = np.concatenate(body).reshape(len(ids), -1).astype(np.float64)
            length = np.sqrt((x * x).sum(axis=1))
            unit = x / np.where(length > 0, length, 1)[:, None]
            centre = unit.sum(axis=0)
            size = np.sqrt((centre * centre).sum())
            centre = centre / size if size > 0 else unit[0]
            # A zero vector has no direction and scores 0: its block's bound must not fall below that.
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if (length > 0).all() else np.pi
            row = ([key[0]], [len(ids)], [centre.tolist()], [radius], [float(length.max())], [list(ids)], [np.concatenate(body).astype("<f4").tobytes()])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["dims", "n", "centre", "radius", "longest", "ids", "body"])

        for b in batches:
            for i, v, d, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if ids and (key != (d, c) or len(ids) == rows):
                    yield block()
                    ids, body = [], []
                key = (d, c)
                ids.append(i)
                body.append(np.asarray(v.values, np.float32))
        if ids:
            yield block()

    placed = sound.mapInArrow(place, "id long, vector array<float>, dims int, cell int, far double")
    # A salt of the angle splits a pivot that most vectors are near, and keeps neighbours together.
    dealt = placed.repartition("dims", "cell", F.floor(F.col("far") * 16)).sortWithinPartitions("dims", "cell", "far", "id")
    return dealt.mapInArrow(pack, BLOCK)


def scanned(blocks: DataFrame, queries: np.ndarray, k: int, floor: float | None = None, normalize: bool = True) -> DataFrame:
    """``HIT`` rows of one scan: each task's best ``k`` a query, and with a null id its blocks and how many it passed over.

    Scores are dot products in double precision, with the queries at length 1 or,
    without ``normalize``, as they come: a query rounded to floats is some 1e-8 off
    length 1. Blocks of another width than the queries' are an error.
    """
    if queries.ndim != 2 or not queries.shape[1]:
        raise ValueError("an empty query has no neighbours")
    length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    unit = queries / np.where(length > 0, length, 1)
    asked, reach = (unit, np.ones(len(unit))) if normalize else (queries, length[:, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in unit]
        seen, passed = 0, np.zeros(len(unit), np.int64)
        for b in batches:
            if set(b.column(0).to_pylist()) - {unit.shape[1]}:
                raise ValueError(f"a query has {unit.shape[1]} dimensions, the store {b.column(0).to_pylist()[0]}")
            centre = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
            away = np.maximum(np.arccos(np.clip(unit @ centre.T, -1, 1)) - np.asarray(b.column(3)), 0)
            bound = np.asarray(b.column(4)) * np.cos(away) * reach[:, None] + SLACK * np.maximum(reach, 1)[:, None]
            seen += b.num_rows
            opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for q in range(len(unit)):
                for i in np.argsort(-bound[q], kind="stable").tolist():
                    scores, ids = best[q]
                    least = scores[-1] if len(scores) == k else -np.inf
                    if bound[q, i] < max(least, -np.inf if floor is None else floor):
                        passed[q] += 1
                        continue
                    if i not in opened:
                        opened[i] = (np.frombuffer(b.column(6)[i].as_py(), "<f4").reshape(-1, unit.shape[1]).astype(np.float64), np.asarray(b.column(5)[i].values))
                    x, own = opened[i]
                    # Added up row by row in one order, so that equal vectors have equal scores.
                    new = np.add.reduce(x * asked[q], axis=1)
                    scores, ids = np.concatenate([scores, new]), np.concatenate([ids, own])
                    if floor is not None:
                        scores, ids = scores[scores >= floor], ids[scores >= floor]
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = scores[order], ids[order]
        each = [len(s) for s, _ in best]
        query = np.concatenate([np.repeat(np.arange(len(unit)), each), np.arange(len(unit))]).astype(np.int32)
        ids, scores = (np.concatenate([x[i] for x in best]) if best else np.zeros(0) for i in (1, 0))
        none = [None] * len(unit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids.tolist() + none, pa.int64()), pa.array(scores.tolist() + none, pa.float64()), pa.array([None] * len(ids) + [seen] * len(unit), pa.int64()), pa.array([None] * len(ids) + passed.tolist(), pa.int64())],
            names=["query", "id", "score", "blocks", "passed"],
        )

    return blocks.select("dims", "n", "centre", "radius", "longest", "ids", "body").mapInArrow(run, HIT)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the ``k`` best a query of ``scanned`` rows, ties by id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return hits.filter("id is not null").withColumn("_r", rank).filter(F.col("_r") <= k).select("query", "id", "score")


def blocks_read(hits: DataFrame) -> DataFrame:
    """(query, blocks, opened): how many blocks there were and how many a query's scan compared."""
    return hits.filter("id is null").groupBy("query").agg(F.sum("blocks").alias("blocks"), F.sum(F.col("blocks") - F.col("passed")).alias("opened"))


def top_k(blocks: DataFrame, queries: list[list[float]], k: int, floor: float | None = None, normalize: bool = True) -> DataFrame:
    """(query, id, score): the ``k`` best of each query by exact score, at least ``floor``, ties by id; one job.

    Without ``normalize`` queries are taken as they come (``scanned``).
    """
    if k < 1 or not queries:
        return blocks.sparkSession.createDataFrame([], "query int, id long, score double")
    return best_of(scanned(blocks, np.array(queries, np.float64), k, floor, normalize), k)
