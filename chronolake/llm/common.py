"""Plumbing shared by the operators of this subpackage.

* ``materialize`` cuts lineage with a written table in the folder that the
  session names in ``spark.checkpoint.dir``, so a lost executor costs a re-read
  and never a recomputation of the whole job.
* ``running_sum`` is a global prefix sum: range partitions, a total for each,
  and offsets from those totals.
* ``connected_components`` labels a graph by alternating large-star and
  small-star rounds, all of it joins and partial aggregates.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is ``spark.checkpoint.dir`` where the session has one. Where it is
    unset, a local master, as in tests, gets a temporary folder; on a cluster
    that is an error, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(work_dir, "own", None) or tempfile.mkdtemp(prefix="chronolake-")
        work_dir.own = named
    return named.rstrip("/")


@contextlib.contextmanager
def _conf(spark: SparkSession, **pairs: str):
    before = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, *replaces: DataFrame, codec: str = "zstd", wide: bool = False) -> DataFrame:
    """Write ``df`` under ``work_dir`` and read it back.

    The shuffle files of the write are dropped when it ends, and the tables of
    ``replaces`` (results of earlier calls that nothing reads any more) with
    them, so that disk holds one step and not the history. ``wide``: rows are
    of megabytes, and a row group has two of them; else its size is looked at
    after some 100, which a reader would take into memory at once.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/table-{uuid.uuid4().hex}"
    with _conf(spark, **{CLEANUP: "true"}, **BATCH):
        # Small row groups: a writer holds one in memory, and a reader one of long binary values.
        to = df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP)
        if wide:
            to = to.option("parquet.block.row.count.limit", 2)
        to.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for made in _recording:
        made.append(out)
    for old in replaces:
        discard(old)
    return out


_recording: list[list[DataFrame]] = []


@contextlib.contextmanager
def recording():
    """A list that gets the tables that ``materialize`` writes meanwhile."""
    made: list[DataFrame] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording.remove(made)


def discard_unread(tables: list[DataFrame], reader: DataFrame) -> None:
    """Delete the written tables but those that ``reader`` reads, however indirectly."""
    read = " ".join(reader.inputFiles())
    for t in tables:
        if t._written_to not in read:
            discard(t)


def discard(df: DataFrame) -> None:
    """Delete the written table behind a result of ``materialize``."""
    if path := getattr(df, "_written_to", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: list, sums: dict[str, str], within: str | None = None) -> DataFrame:
    """Add, for each ``sums`` item, a column with the sum of all rows before.

    ``sums`` maps the new column to the summed one. Rows are ordered by
    ``order`` (columns that order all rows) and, with ``within``, summed apart
    for each value of that column. Every row goes to a range partition; a
    total for each (partition, ``within``) gives the offsets, one row each, so
    one value that holds most rows is spread over many tasks. Other columns
    of ``df`` stay as they are, whatever their names.
    """
    spark = df.sparkSession
    part, opart, inside = own_names(df, "part", "opart", "within")
    keys = ([F.col(within)] if within else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    n = partitions(spark)
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()))
    group = [part] + ([within] if within else [])
    total, offset = ([f"{part}_{k}_{i}" for i in range(len(sums))] for k in ("t", "o"))
    totals = ranged.groupBy(*group).agg(*[F.sum(c).alias(t) for t, c in zip(total, sums.values(), strict=True)])
    before = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, and with ``within`` for each value in it.
    offsets = totals.select(F.col(part).alias(opart), *([F.col(within).alias(inside)] if within else []), *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o) for t, o in zip(total, offset, strict=True)])
    same = F.col(part) == F.col(opart)
    if within:
        same = same & F.col(within).eqNullSafe(F.col(inside))
    joined = ranged.join(offsets, same, "left")
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for o, (name, c) in zip(offset, sums.items(), strict=True):
        joined = joined.withColumn(name, F.col(o) + F.coalesce(F.sum(c).over(local), F.lit(0)))
    return joined.drop(part, opart, inside, *offset)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` has no column of, whatever the case."""
    have = {c.lower() for c in df.columns}
    tail = 0
    while any(f"_{n}_{tail}" in have or any(c.startswith(f"_{n}_{tail}_") for c in have) for n in names):
        tail += 1
    return [f"_{n}_{tail}" for n in names]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b), root the
    smallest node of its component.

    Large-star and small-star rounds alternate until a round changes nothing,
    however many that takes.
    Each is a minimum by node (partial aggregates, so a hub costs a row per
    task) and a join back, which adaptive execution splits where a hub is hot.
    Every round is written, so lineage stays one round long. No edges: no rows.
    """
    star = materialize(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct()
    )
    seen = None
    while True:
        both = star.unionAll(star.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("u", "low").alias("low"))
        large = both.filter("m > v").select(F.col("v").alias("u"), F.col("m").alias("w")).join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m"))
        large = large.filter("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "u")
        small = large.withColumnRenamed("v", "u").join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct(F.col("u").alias("v"), F.col("low").alias("m")))).alias("e"))
        star = materialize(small.select("e.v", "e.m").filter("v <> m").distinct(), star)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return star.select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(star.select(F.col("m"), F.col("m")).distinct())
