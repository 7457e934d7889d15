"""Timeline operators: ranges, pages, density, statistics, reclaim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import written

PAGE_LIMIT = 10_000


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows that are not soft-deleted; a null flag counts as live."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp, rounded down."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def in_range(df: DataFrame, start: float, end: float, ts: str = "created_at") -> DataFrame:
    """Rows whose time lies between two epoch seconds, both included and cut to whole seconds."""
    return df.filter(F.col(ts).between(F.timestamp_seconds(F.lit(int(start))), F.timestamp_seconds(F.lit(int(end)))))


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of rows; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0))


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows after a key."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(limit)


def multi_get(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids`` (a column of the same name); missing ids vanish."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def newest_by(df: DataFrame, key: str, ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """(key, newest id, ids newest first) of each key."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(ts, id_col))))
    return df.groupBy(key).agg(ordered.alias("o")).select(key, F.col(f"o.{id_col}")[0].alias("newest"), F.col(f"o.{id_col}").alias("ids"))


def density(df: DataFrame, bucket_seconds: int, ts: str = "created_at") -> DataFrame:
    """(bucket, n): rows by start of bucket; empty buckets are absent; at least 1 s."""
    size = max(int(bucket_seconds), 1)
    return df.groupBy((F.floor(epoch(ts) / size) * size).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def process_counts(df: DataFrame, name: str = "process_name") -> DataFrame:
    """(name, n) of non-empty names."""
    return df.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").groupBy(name).agg(F.count("*").alias("n"))


def process_share(df: DataFrame, name: str = "process_name") -> DataFrame:
    """(name, n, percent of all); the window runs over one row per name."""
    c = process_counts(df, name)
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.select(name, "n", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(F.lit(0.0)).alias("percent"))


def top_and_others(df: DataFrame, name: str, n: str, k: int = 8) -> DataFrame:
    """The ``k`` largest groups and the sum of the rest as ``others``, if above 0."""
    best = df.orderBy(F.desc(n), name).limit(k).select(name, n)
    rest = df.join(best.select(name), name, "left_anti").agg(F.sum(n).alias(n)).filter(F.col(n) > 0)
    return best.unionByName(rest.select(F.lit("others").alias(name), n))


def monthly(df: DataFrame, ts: str = "created_at") -> Column:
    return F.date_format(F.col(ts), "yyyy-MM")


def evenly_spaced(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The rows at ``k`` evenly spaced places of an order, cut to whole places, once each.

    Places come from a global prefix count: rows are numbered within range
    partitions, and the partitions' totals give the offsets.
    """
    numbered = row_numbers(df, order)
    n = df.agg(F.count("*").alias("_n"))
    # One row: the number of rows.
    last = F.col("_n") - 1
    places = n.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * last / max(k - 1, 1))))).alias("_place"))
    return numbered.join(places, F.col("_row") == F.col("_place")).drop("_row", "_place")


def row_numbers(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Number all rows from 0 in ``order`` without one task that sees them all.

    Rows are written in range partitions first: the totals and the numbers must
    see the same ranges, and two exchanges would each sample their own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    totals = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return local.join(before, F.col("_p") == F.col("_q")).withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_p", "_q", "_i", "_o")


def reclaim_until(df: DataFrame, target: float, size: str, order: list[str], cap: int = 20_000) -> DataFrame:
    """The oldest rows whose sizes reach ``target``, the crossing row included.

    Rows without a size are set aside. At most ``cap`` rows are looked at,
    which is the operator's own limit and bounds the window's one task.
    """
    oldest = df.filter(F.col(size) > 0).orderBy(*order).limit(cap)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return oldest.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0.0))).filter(F.col("freed_before") < target)


def older_than(df: DataFrame, cutoff, cap: int, ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """Rows before a cutoff, oldest first, at most ``cap``."""
    return df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp")).orderBy(ts, id_col).limit(cap)


def merge_timelines(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of both, one for each key: new before old."""
    both = new.withColumn("_s", F.lit(0)).unionByName(old.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_s")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_s", "_r")


def relevance(count: Column, start: Column, end: Column, now: float) -> Column:
    """count * clamp(hours, 0, 720) / 720 / (idle hours + 1); no end: idle for 720 hours."""
    hours = F.least(F.greatest((end - start) / 3600.0, F.lit(0.0)), F.lit(720.0))
    idle = F.when(end.isNull(), F.lit(720.0)).otherwise(F.greatest((F.lit(now) - end) / 3600.0, F.lit(0.0)))
    return count * F.coalesce(hours, F.lit(0.0)) / 720.0 / (idle + 1.0)


def any_of(**filters: Column | None) -> Column:
    """AND of the filters that are given."""
    out = F.lit(True)
    for f in filters.values():
        if f is not None:
            out = out & f
    return out


def not_in(c: Column, values: list[str]) -> Column:
    """Null-safe exclusion: null stays."""
    return c.isNull() | ~c.isin(values)


def known_in_range(ts: Column, start: float | None, end: float | None) -> Column:
    """Closed range on epoch seconds; unknown times stay."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= start)
    if end is not None:
        out = out & (ts <= end)
    return ts.isNull() | out
