"""Scoring of queued subjects against clusters, in batches that commit whole.

A batch takes the subjects that wait longest, keeps the pairs with a cluster
that is near enough, and assigns those whose score reaches the cluster's
threshold. Its assignments, the subjects that leave the queue and the cursor are
one commit, so a run that is cut short anywhere goes on where its last commit
left it, and two runs at once never apply a batch twice. Scores come from a
model and are an input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..sources.snapshots import Conflict, Snapshots, Stale

#: Fixed values of the scoring rule: least cosine of a pair that is scored, and days that a subject waits.
PREFILTER, KEEP_DAYS = 0.40, 30
CURSOR = "cursor/scoring"
ASSIGNMENT = "cluster_id long, id long, score double"


def enabled_pairs(subjects: DataFrame, clusters: DataFrame, least: float = PREFILTER) -> DataFrame:
    """(id, cluster_id, threshold) of subjects (id, vector) and enabled clusters (cluster_id, vector, threshold, enabled) that are near enough.

    Clusters are a stated query set: one array of them meets every subject in its row.
    """
    stated = clusters.filter("enabled").agg(F.collect_list(F.struct("cluster_id", "threshold", F.col("vector").alias("anchor"))).alias("_all"))
    each = subjects.join(stated).select("id", F.explode(F.filter("_all", lambda c: dot(F.col("vector"), c["anchor"]) >= least)).alias("c"))
    return each.select("id", "c.cluster_id", "c.threshold")


def assigned(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster_id, id, score) of the pairs whose score (id, cluster_id, score) reaches the threshold; an unscored pair is none."""
    return pairs.join(scores, ["id", "cluster_id"]).filter(F.col("score") >= F.col("threshold")).select("cluster_id", "id", "score")


class ScoringQueue:
    """Tables ``queue`` (id, queued_ms) and ``assignments`` of a store."""

    def __init__(self, store: Snapshots):
        self.store = store

    def put(self, rows: DataFrame) -> None:
        """Queue subjects (id, queued_ms); one that waits already keeps its first time."""
        self.store.commit(add={"queue": self.store.stage(rows.select(F.col("id").cast("long"), F.col("queued_ms").cast("long")))})

    def assignments(self) -> DataFrame:
        have = self.store.table("assignments")
        return have if have is not None else self.store.spark.createDataFrame([], ASSIGNMENT)

    def waiting(self, now_ms: int | None = None, manifest: dict | None = None) -> DataFrame:
        """(id, queued_ms) of the subjects that wait, none longer than ``KEEP_DAYS``."""
        rows = self.store.table("queue", manifest).groupBy("id").agg(F.min("queued_ms").alias("queued_ms"))
        return rows if now_ms is None else rows.filter(F.col("queued_ms") >= now_ms - KEEP_DAYS * 86_400_000)

    def step(self, subjects: DataFrame, clusters: DataFrame, scores: DataFrame, rows: int, now_ms: int | None = None) -> int:
        """Score and commit the next ``rows`` subjects; how many there were. ``Conflict`` or ``Stale`` if another run was faster.

        Without an enabled cluster the queue is emptied. A subject that is not
        among ``subjects`` leaves it unassigned.
        """
        base = self.store.read()
        cursor = base["guards"].get(CURSOR, 0)
        waiting = self.waiting(now_ms, base)
        if clusters.filter("enabled").isEmpty():
            n, taken = waiting.count(), waiting
        else:
            # One batch: its ids bound what follows.
            ids = [r["id"] for r in waiting.orderBy("queued_ms", "id").limit(rows).collect()]
            n, taken = len(ids), self.store.spark.createDataFrame([(i,) for i in ids], "id long")
        if not n:
            return 0
        new = assigned(enabled_pairs(subjects.join(taken.select("id"), "id", "left_semi"), clusters), scores)
        have = self.store.table("assignments", base)
        kept = new if have is None else have.join(taken.select("id"), "id", "left_anti").unionByName(new)
        left = waiting.join(taken.select("id"), "id", "left_anti").select("id", "queued_ms")
        self.store.commit(replace={"assignments": self.store.stage(kept.select("cluster_id", "id", "score")), "queue": self.store.stage(left)}, base=base, expect={CURSOR: cursor}, guards={CURSOR: cursor + 1})
        return n

    def run(self, subjects: DataFrame, clusters: DataFrame, scores: DataFrame, rows: int = 500, late: Callable[[], bool] = lambda: False, now_ms: int | None = None) -> int:
        """Batches until nothing waits or it is ``late``, which is asked before each; how many subjects were taken."""
        done = 0
        while not late():
            try:
                n = self.step(subjects, clusters, scores, rows, now_ms)
            except (Conflict, Stale):
                continue
            if not n:
                break
            done += n
        return done


def score_stream(queued: DataFrame, store: Snapshots, checkpoint: str, subjects: DataFrame, clusters: DataFrame, scores: DataFrame) -> None:
    """Score what arrives in a stream of subjects (id): each micro-batch merges its assignments by subject, once."""
    guard = "batches/scoring"

    def merge(rows: DataFrame, batch: int) -> None:
        base = store.read()
        if base["guards"].get(guard, 0) > batch:
            return
        ids = rows.select("id").distinct().persist()
        new = assigned(enabled_pairs(subjects.join(ids, "id", "left_semi"), clusters), scores)
        have = store.table("assignments", base)
        kept = new if have is None else have.join(ids, "id", "left_anti").unionByName(new)
        store.commit(replace={"assignments": store.stage(kept.select("cluster_id", "id", "score"))}, base=base, expect={guard: batch}, guards={guard: batch + 1})
        ids.unpersist()

    queued.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
