"""Changes to tables as functions from one state to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet, the first by id of each key, added to the table."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter("_r = 1").drop("_r")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def commit_children(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one row: added and skipped)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.agg(F.count_if(ok).alias("added"), F.count_if(~ok).alias("skipped"))


def box_is_valid(box: Column, text: Column, most: int = 16_384) -> Column:
    """Four points of two finite numbers and a text of at most ``most`` characters."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size(box) == 4) & F.forall(box, lambda p: (F.size(p) == 2) & F.forall(p, finite)) & (F.length(text) <= most)


def soft_delete(parents: DataFrame, children: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, counts) with ``is_deleted`` set where ``doomed`` holds for the parent."""
    hit = parents.filter(doomed & ~F.col("is_deleted")).select(F.col("id").alias("_id"))
    p = parents.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(doomed, F.lit(False)))
    c = children.join(hit, children["parent_id"] == F.col("_id"), "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_id").isNotNull())
    counts = hit.agg(F.count("*").alias("parents")).crossJoin(c.agg(F.count_if(F.col("_id").isNotNull()).alias("children")))
    return p, c.drop("_id"), counts


def soft_delete_ids(parents: DataFrame, children: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``soft_delete`` of the given parents (id); the counts also say how many different ids were requested."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    p, c, counts = soft_delete(parents.join(asked, "id", "left"), children, F.coalesce("_asked", F.lit(False)))
    return p.drop("_asked"), c, asked.agg(F.count("*").alias("requested")).join(counts)


def hard_delete(parents: DataFrame, children: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents (id)."""
    return parents.join(ids, "id", "left_anti"), children.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")


def keep_referenced(lookup: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of a content-addressed table that something still refers to."""
    return lookup.join(rows.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def content_ids(rows: DataFrame, value: Column) -> DataFrame:
    """(content_hash, id): one id for each distinct content, the smallest row id."""
    return rows.withColumn("content_hash", F.sha2(value, 256)).groupBy("content_hash").agg(F.min("id").alias("id"))


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: the row with the highest version of each key, incoming before existing on ties."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(incoming.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_s"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_s")


def merge_tasks(assignments: DataFrame, target: int, sources: list[int]) -> DataFrame:
    """Assignments (task_id, screenshot_id) of ``sources`` moved to ``target``, duplicates dropped."""
    moved = assignments.withColumn("task_id", F.when(F.col("task_id").isin(sources), F.lit(target)).otherwise(F.col("task_id")))
    return moved.dropDuplicates(["task_id", "screenshot_id"])


def task_bounds(assignments: DataFrame, shots: DataFrame) -> DataFrame:
    """(task_id, n, start, end) from what is left; a task without members has no row."""
    j = assignments.join(shots.select(F.col("id").alias("screenshot_id"), "created_at"), "screenshot_id")
    return j.groupBy("task_id").agg(F.count("*").alias("n"), F.min("created_at").alias("start"), F.max("created_at").alias("end"))


def retry(attempts: Column) -> tuple[Column, Column]:
    """(status, seconds until the next try): 30, 60, 120, 300; at the fifth attempt failed."""
    delay = F.when(attempts == 0, 30).when(attempts == 1, 60).when(attempts == 2, 120).when(attempts == 3, 300)
    return F.when(attempts < 4, "pending").otherwise("failed"), delay


def ensured(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(subject_key, outcome): queued, requeued, current or processing, for each wanted subject (subject_key, fp)."""
    j = jobs.select("subject_key", F.col("fp").alias("_fp"), "status")
    same = F.col("fp") == F.col("_fp")
    outcome = (
        F.when(F.col("status").isNull(), "queued")
        .when(same & (F.col("status") == "completed"), "current")
        .when(same & (F.col("status") == "processing"), "processing")
        .otherwise("requeued")
    )
    return wanted.join(j, "subject_key", "left").select("subject_key", outcome.alias("outcome"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was processing is pending."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def invalidated(jobs: DataFrame, current: Column) -> DataFrame:
    """Jobs of another contract go back to pending; discarded ones stay."""
    return jobs.withColumn("status", F.when(~current & (F.col("status") != "discarded"), "pending").otherwise(F.col("status")))
