"""A table kept as signed changes, and what depends on it kept up by them.

Rows come and go as +1 and -1. What a batch of changes does to the live table
is worked out for the ids that it names; its effect on each dependent (rows by
image hash, rows by kind, epochs, what is to be cleaned up) follows from those
signed rows alone, and is added in the same commit. So a batch reads what it
touches, and nothing is recomputed from the whole table. Sums of signs are the
present state; ``compact`` folds them into one row each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import written
from ..sources.snapshots import Snapshots

TURN = "turn/changes"
#: Rows of all sides of a join that a task should get, where the sides are dealt by their number.
SHARE = 1_000_000
ROW = ["image_hash", "kind"]
EMPTY = {
    "rows": "id long, sign int, image_hash string, kind string, turn long",
    "hashes": "image_hash string, n long",
    "kinds": "kind string, n long",
    "cleanup": "what string, subject_key string, turn long",
}


class ChangeLog:
    """Tables ``rows``, ``hashes``, ``kinds`` and ``cleanup`` of a store."""

    def __init__(self, store: Snapshots):
        self.store = store

    def _table(self, name: str, manifest: dict | None = None) -> DataFrame:
        have = self.store.table(name, manifest)
        return have if have is not None else self.store.spark.createDataFrame([], EMPTY[name])

    def apply(self, changes: DataFrame) -> None:
        """Commit a batch of changes (id, seq, op, image_hash, kind); ``op`` is ``put`` or ``delete``.

        Of several changes of one id the last by ``seq`` counts. Putting a row
        as it is, and deleting one that isn't there, changes nothing. ``Stale``
        if another batch was committed meanwhile. Null ids are passed over.
        """
        base = self.store.read()
        turn = base["guards"].get(TURN, 0)
        last = changes.filter("id is not null").groupBy("id").agg(F.max_by(F.struct("op", *ROW), "seq").alias("c")).select("id", "c.*")
        last = written(last)
        now = self._live(self._table("rows", base).join(last.select("id"), "id", "left_semi")).select("id", F.struct(*ROW).alias("old"))
        both = last.select("id", "op", F.struct(*ROW).alias("new")).join(now, "id", "left")
        put, was = F.col("op") == "put", F.col("old").isNotNull()
        moved = was & (~put | ~F.col("old").eqNullSafe(F.col("new")))
        out = F.when(moved, F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")))
        into = F.when(put & (~was | moved), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
        delta = both.select("id", F.explode(F.array_compact(F.array(out, into))).alias("d")).select("id", "d.sign", "d.row.*", F.lit(turn + 1).cast("long").alias("turn"))
        delta = written(delta.select("id", "sign", *ROW, "turn"))
        hashes = written(delta.groupBy("image_hash").agg(F.sum("sign").cast("long").alias("n")).filter("n <> 0"))
        before = self._table("hashes", base).join(hashes.select("image_hash"), "image_hash", "left_semi").groupBy("image_hash").agg(F.sum("n").alias("had"))
        gone = hashes.join(before, "image_hash").filter("had > 0 AND had + n = 0").select(F.lit("image").alias("what"), F.col("image_hash").alias("subject_key"))
        dead = delta.groupBy("id").agg(F.sum("sign").alias("s")).filter("s < 0").select(F.lit("text").alias("what"), F.col("id").cast("string").alias("subject_key"))
        # One row a kind.
        kinds = [r["kind"] for r in delta.select("kind").distinct().collect()]
        epochs = {f"epoch/{k}": base["guards"].get(f"epoch/{k}", 0) + 1 for k in kinds}
        add = {
            "rows": delta,
            "hashes": hashes,
            "kinds": delta.groupBy("kind").agg(F.sum("sign").cast("long").alias("n")),
            "cleanup": dead.unionAll(gone).withColumn("turn", F.lit(turn + 1).cast("long")),
        }
        self.store.commit(add={k: self.store.stage(v) for k, v in add.items()}, expect={TURN: turn}, guards={TURN: turn + 1} | epochs)

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        """(id, image_hash, kind) of the ids whose signs add up to one, as they were put last."""
        each = rows.groupBy("id").agg(F.sum("sign").alias("s"), F.max_by(F.struct(*ROW), F.when(F.col("sign") > 0, F.col("turn"))).alias("r"))
        return each.filter("s > 0").select("id", "r.*")

    def live(self) -> DataFrame:
        return self._live(self._table("rows"))

    def hash_counts(self) -> DataFrame:
        """(image_hash, n) of the hashes that live rows have."""
        return self._table("hashes").groupBy("image_hash").agg(F.sum("n").alias("n")).filter("n <> 0")

    def kind_counts(self) -> DataFrame:
        return self._table("kinds").groupBy("kind").agg(F.sum("n").alias("n")).filter("n <> 0")

    def cleanup(self, after: int = 0) -> DataFrame:
        """(what, subject_key) that batches after a turn left to clean up, and that has not come back since."""
        rows = self._table("cleanup").filter(F.col("turn") > after).select("what", "subject_key").distinct()
        here = self.live().select(F.lit("text").alias("what"), F.col("id").cast("string").alias("subject_key")).unionAll(self.hash_counts().select(F.lit("image"), "image_hash"))
        return rows.join(here, ["what", "subject_key"], "left_anti")

    def epoch(self, kind: str) -> int:
        return self.store.guard(f"epoch/{kind}")

    def compact(self) -> None:
        """One row for each live id, hash and kind; ``Conflict`` if a batch came between."""
        base = self.store.read()
        turn = F.lit(base["guards"].get(TURN, 0)).cast("long")
        tables = {
            "rows": self._live(self._table("rows", base)).select("id", F.lit(1).alias("sign"), *ROW, turn.alias("turn")),
            "hashes": self.hash_counts(),
            "kinds": self.kind_counts(),
        }
        self.store.commit(replace={k: self.store.stage(v) for k, v in tables.items()}, base=base)


def deleted_range(parents: DataFrame, children: DataFrame, inside) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, counts) without the parents for which ``inside`` holds: one row of how many of both went."""
    gone = parents.filter(inside).select("id")
    lost = children.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    counts = gone.agg(F.count("*").alias("parents")).join(lost.agg(F.count("*").alias("children")))
    return parents.join(gone, "id", "left_anti"), children.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti"), counts


def dealt(key: str, *sides: DataFrame) -> list[DataFrame]:
    """The sides of joins by ``key`` in the same partitions, so many that each gets some ``SHARE`` rows.

    Adaptive execution puts partitions together by their compressed size. Keys
    that come in order take a few bytes there and seventy where a task sorts
    them, and joins that follow one another are sorted in one task. Up to
    ``SHARE`` rows are left to it.
    """
    rows = functools.reduce(DataFrame.unionAll, [s.select(F.lit(1)) for s in sides]).count()
    spark = sides[0].sparkSession
    n = max(rows // SHARE + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return [s.repartition(n, key) if rows > SHARE else s for s in sides]


def finalized(parents: DataFrame, children: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, queue) after the queued parents (id) that have no children left are deleted, with their queue entries."""
    parents, queue, live = dealt("id", parents, queue, children.select(F.col("parent_id").alias("id")))
    ready = queue.select("id").join(live, "id", "left_anti")
    return parents.join(ready, "id", "left_anti"), queue.join(ready, "id", "left_anti")
