"""Sharding: contiguous shards of near equal bytes from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, running_sum


def shard_by_bytes(df: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Rows stand in the order of ``order``, the first of which keeps alike rows
    side by side. Each range partition's total gives the offset of its rows; a
    row whose middle byte lies in the k-th of ``shards`` equal parts of the
    total goes to shard k, so shards are contiguous and differ by about one
    row. Equal rows may lie on both sides of a cut, and of no more than the
    cuts there are. Sizes count as they are (null: 0); rows that agree in all
    of ``order`` are ordered by a hash of the row. Columns of ``df`` stay
    (``shard`` and ``slot`` are replaced). An empty table gives no rows.
    """
    df = df.drop("shard", "slot")
    bytes_, one, tie, before, row, total, first, own = own_names(df, "size", "one", "tie", "before", "row", "total", "first", "shard")
    sized = df.withColumn(bytes_, F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn(one, F.lit(1).cast("long")).withColumn(tie, F.xxhash64(*[F.col(c) for c in df.columns]))
    ranked = running_sum(sized, [*order, tie], {before: bytes_, row: one})
    # One row: the sum of all sizes.
    whole = sized.agg(F.coalesce(F.sum(bytes_), F.lit(0)).alias(total))
    placed = ranked.crossJoin(F.broadcast(whole)).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"({before} * 2 + {bytes_}) * {shards} div greatest({total} * 2, 1)")).cast("int"))
    # At most ``shards`` rows, a parameter.
    starts = placed.groupBy(F.col("shard").alias(own)).agg(F.min(row).alias(first))
    out = placed.join(F.broadcast(starts), F.col("shard") == F.col(own)).withColumn("slot", F.col(row) - F.col(first))
    return out.select(*df.columns, "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes (law ``bytes``).

    Documents stand in the order of a hash of their text, equal texts side by
    side unless a cut falls among them, then of doc_id. A null text has size 8 and CRC-32 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_group"),
    )
    out = shard_by_bytes(docs, "size", ["text_group", "doc_id"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
