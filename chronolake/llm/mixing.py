"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, own_names, running_sum

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): one row for each source, null included.

    Sources by code point, null last, take ``weights`` in turn. The total size
    is shared by weight; no target exceeds ``max_epochs`` times its source,
    and what is above is shared again by weight. That is one level L with
    target = min(max_epochs * size, L * weight): with sources in order of
    max_epochs * size / weight, the first ones are at their cap, and L follows
    from what the caps leave. The windows run over one row for each source.
    """
    totals = sized.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    # Binary string order is code-point order in Spark.
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    t = t.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / F.sum("_w").over(rest))
    # The first source whose cap is not below its level sets the level of all after it.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("o"), F.col("_level").alias("l")))).over(everything)
    t = t.withColumn("_l", F.coalesce(level["l"], F.lit(float("inf"))))
    return t.select(source, "source_size", F.least(F.col("_cap"), F.col("_l") * F.col("_w")).alias("target"))


def sample_to_targets(sized: DataFrame, targets: DataFrame, order: list[str], weight: str, source: str = "source", size: str = "size", seed: int = 42) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken``.

    A source whose target is e whole times its size and a rest takes every
    document e times; the rest goes to documents in the order of
    -ln(u) / weight, u a hash of ``order`` and ``seed``, so reruns agree. With
    the sizes of a source summed in that order, a document is taken once more
    while the middle of its words lies below the rest. What a source takes
    then differs from its target by at most half a document. Weights that are
    null or not above 0 count as 1. u is drawn from a hash of ``order`` and of
    the row, so rows that repeat an id, or have none, have keys of their own;
    rows that agree in everything have one key and stand side by side.
    """
    key, tie, before, src, e, left = own_names(sized, "key", "tie", "before", "src", "epochs", "left")
    t = targets.withColumnRenamed(source, src)
    keyed = sized.withColumn(tie, F.xxhash64(*[F.col(c) for c in sized.columns]))
    u = (F.pmod(F.xxhash64(*[F.col(c) for c in order], F.col(tie), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0))
    summed = running_sum(keyed.withColumn(key, -F.log(u) / w), [key, *order, tie], {before: size}, within=source)
    out = summed.join(t, F.col(source).eqNullSafe(F.col(src)), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn(e, epochs).withColumn(left, F.col("target") - F.col(e) * F.col("source_size"))
    once = (F.col(before) + F.col(size) / 2.0 < F.col(left)).cast("long")
    return out.withColumn("times", F.col(e) + once).withColumn("taken", F.col(size) * F.col("times")).drop(key, tie, before, src, e, left)


def with_quality(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``_weight``: 0.5 plus the mean quality label, 1 without a label."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    mean = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg((F.avg("quality") + 0.5).alias("_q"))
    return docs.join(mean, F.col("doc_id") == F.col("_labelled"), "left").withColumn("_weight", F.coalesce("_q", F.lit(1.0))).drop("_labelled", "_q")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to source weights 1, 2, 3, repeating.

    The size of a document is its number of words (null text: 0). Documents
    with a null source are a source of their own, last in order. Taken words
    are whole documents, repeats counted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    out = sample_to_targets(with_quality(docs, sf_dir), source_targets(docs), ["doc_id"], "_weight")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as many times as it is taken.

    Rows that agree in doc_id, source and text are drawn as one; only ids,
    sources, sizes and a hash of the text are ordered and summed.
    """
    names = docs.columns
    tag = F.xxhash64("text")
    units = docs.groupBy("doc_id", "source", tag.alias("tag"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("one")).agg(F.count("*").alias("n"))
    units = materialize(units.withColumn("size", F.col("one") * F.col("n")))
    drawn = sample_to_targets(with_quality(units, sf_dir), source_targets(units), ["doc_id", "tag"], "_weight").filter("times > 0")
    drawn = materialize(drawn.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("tag").alias("_tag"), F.col("times").cast("int").alias("_times")))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_src")) & (tag == F.col("_tag"))
    out = docs.join(drawn, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*names)


QUERIES = {"op3_mixing": op3_mixing}
SQL: dict[str, str] = {}
