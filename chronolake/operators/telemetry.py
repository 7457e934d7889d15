"""Process trees and counters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): all that ``roots`` (id) lead to over ``edges`` (parent, id), cycles included once.

    A round joins only what the last one found; it ends when nothing is new,
    however deep the tree. What was found is kept as a few written tables, so
    plans stay short. A root counts only if an edge leads back to it.
    """
    from ..sources.checkpoints import written

    parts: list[DataFrame] = []
    front = roots.select("id")
    while True:
        found = edges.join(front.select(F.col("id").alias("_p")), F.col("parent") == F.col("_p")).select("id").distinct()
        for seen in parts:
            found = found.join(seen, "id", "left_anti")
        front = written(found)
        if front.isEmpty():
            return functools.reduce(DataFrame.unionAll, parts) if parts else front
        parts.append(front)
        if len(parts) == 8:
            parts = [written(functools.reduce(DataFrame.unionAll, parts))]


def counter_deltas(samples: DataFrame, key: str, ts: list[str], value: str) -> DataFrame:
    """``delta``: the rise of a counter since the sample before; none for the first; falls count 0."""
    w = Window.partitionBy(key).orderBy(*ts)
    return samples.withColumn("delta", F.greatest(F.col(value) - F.lag(value).over(w), F.lit(0.0)))


def roles(tree: DataFrame, rules: list[tuple[str, DataFrame]], default: str) -> DataFrame:
    """``role``: the name of the first rule whose ids (id) hold a row's id."""
    out = tree.withColumn("role", F.lit(None).cast("string"))
    for name, ids in rules:
        hit = ids.select(F.col("id").alias("_id")).distinct()
        out = out.join(hit, out["id"] == F.col("_id"), "left").withColumn("role", F.coalesce("role", F.when(F.col("_id").isNotNull(), name))).drop("_id")
    return out.withColumn("role", F.coalesce("role", F.lit(default)))
