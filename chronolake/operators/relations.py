"""Joins, set operations and aggregates over parents, children and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTRACT = ("model_id", "model_revision", "embedding_version", "source_fingerprint")
KEYS = ("index_kind", "subject_key")


def visible(embeddings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Vectors with a completed job of the same subject and contract."""
    done = jobs.filter("status = 'completed'").select(*KEYS, *CONTRACT)
    return embeddings.join(done, [*KEYS, *CONTRACT])


def enrich(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, inline: str, value: str) -> DataFrame:
    """``inline``, or where it is null the looked-up value, by left join."""
    looked = lookup.select(F.col(lookup_key).alias("_k"), F.col(value).alias("_v"))
    return df.join(looked, df[key] == F.col("_k"), "left").withColumn(inline, F.coalesce(inline, "_v")).drop("_k", "_v")


def nearest_in_time(df: DataFrame, group: str, ts: str, id_col: str, k: int) -> DataFrame:
    """(id, other, relation, seconds): the ``k`` rows of the same group nearest in time.

    Only the k rows before and the k after can be among the nearest, so one
    pass over each group in the order of time has them all in its rows.
    """
    w = Window.partitionBy(group).orderBy(ts, id_col)
    row = F.struct(F.col(id_col).alias("other"), F.col(ts).alias("ts"))
    beside = df.select(id_col, ts, F.array_compact(F.array(*[f(row, i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead)])).alias("_near"))

    def judged(x: Column) -> Column:
        gap = x["ts"].cast("double") - F.col(ts).cast("double")
        relation = F.when(gap < 0, "before").when(gap > 0, "after").otherwise("nearby")
        return F.struct(F.abs(gap).alias("gap"), (-x["ts"].cast("double")).alias("late"), x["other"].alias("other"), relation.alias("relation"))

    ranked = F.slice(F.sort_array(F.transform("_near", judged)), 1, k)
    out = beside.select(id_col, F.posexplode(ranked).alias("at", "n"))
    return out.select(id_col, "n.other", "n.relation", "n.gap", (F.col("at") + 1).alias("place"))


def compare_totals(a: DataFrame, b: DataFrame, keys: list[str], value: str, seconds_a: float, seconds_b: float) -> DataFrame:
    """Totals of two runs side by side; a missing side is 0, rates by duration."""
    x = a.groupBy(*keys).agg(F.sum(value).alias("baseline"))
    y = b.groupBy(*keys).agg(F.sum(value).alias("workload"))
    both = x.join(y, keys, "full_outer")
    return both.select(*keys, *metric_delta(F.coalesce("baseline", F.lit(0.0)), F.coalesce("workload", F.lit(0.0)), seconds_a, seconds_b))


def metric_delta(baseline: Column, workload: Column, seconds_a: float, seconds_b: float) -> list[Column]:
    """Rates a second and what the workload has beyond the baseline's rate."""
    rate_a, rate_b = baseline / seconds_a, workload / seconds_b
    excess = F.greatest(rate_b - rate_a, F.lit(0.0)) * min(seconds_a, seconds_b)
    return [baseline.alias("baseline"), workload.alias("workload"), F.round(rate_a, 6).alias("baseline_rate"), F.round(rate_b, 6).alias("workload_rate"), F.floor(excess).cast("long").alias("excess")]


def monotone_delta(before: Column, after: Column) -> Column:
    """after - before of a counter; null where it fell back or a side is missing."""
    return F.when(after >= before, after - before)


def claimable(attempts: int, status: str = "status") -> Column:
    """Pending or waiting, or failed with attempts left."""
    return F.col(status).isin("pending", "waiting") | ((F.col(status) == "failed") & (F.col("attempts") < attempts))


def backlog(jobs: DataFrame, attempts: int, now: Column) -> DataFrame:
    """(claimable, exhausted, oldest_age): rows in backoff count as claimable."""
    ready = claimable(attempts)
    spent = (F.col("status") == "failed") & (F.col("attempts") >= attempts)
    return jobs.agg(
        F.count_if(ready).alias("claimable"),
        F.count_if(spent).alias("exhausted"),
        (now - F.min(F.when(ready, F.unix_timestamp("updated_at")))).alias("oldest_age"),
    )


def claimable_jobs(jobs: DataFrame, attempts: int, now: Column, limit: int) -> DataFrame:
    """The oldest claimable jobs whose retry time is due."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return jobs.filter(claimable(attempts) & due).orderBy("updated_at", "subject_key").limit(limit)


def repair_candidates(parents: DataFrame, children: DataFrame, ledger: DataFrame, key: str, since=None) -> DataFrame:
    """Parents with a child, without a ledger row, and no older than ``since``."""
    p = parents if since is None else parents.filter(F.col("created_at") >= since)
    return p.join(children, p[key] == children["parent_id"], "left_semi").join(ledger, p[key].cast("string") == ledger["subject_key"], "left_anti")


def expired_subjects(subjects: DataFrame, parents: DataFrame, cutoff) -> DataFrame:
    """Subjects without a live parent, or whose parent is older than the cutoff."""
    p = parents.select(F.col("id").cast("string").alias("_id"), "created_at")
    s = subjects.distinct()
    return s.join(p, s["subject_key"] == F.col("_id"), "left").filter(F.col("_id").isNull() | (F.col("created_at") < cutoff)).select("subject_key")


def first_wins_mode(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, ties by first place."""
    c = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("_f"))
    return c.groupBy(group).agg(F.min(F.struct(-F.col("n"), "_f", value, "n")).alias("m")).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))
