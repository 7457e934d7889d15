"""Index building that picks up what is new since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bitmap_index import BitmapIndex, unpacked
from ..sources.snapshots import Snapshots


def build_index(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, files_a_batch: int | None = None) -> None:
    """Add the bigrams of the rows (id, text) that arrived in ``source`` to the stored index.

    A run takes all there is, in batches, and stops; the checkpoint remembers
    what was read. A batch is a segment of the index, and its number is
    committed with it: one that is run again after a failure adds nothing.
    ``files_a_batch`` is the number of files a batch takes, all if unset.
    """
    stored = BitmapIndex(Snapshots(spark, index))
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    stream = reader.parquet(source).writeStream.foreachBatch(lambda rows, batch: stored.add(rows, batch) and None)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """(token, id) of all batches; an id that came twice counts once."""
    return unpacked(BitmapIndex(Snapshots(spark, index)).containers(), "token")
