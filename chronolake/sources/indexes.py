"""What is stored of a data folder: the index of its documents and the blocks of its vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bitmap_index import BitmapIndex
from ..operators.vector_blocks import packed
from . import checkpoints
from .roles import Roles
from .snapshots import Snapshots, Stale

#: Changes with the layout of what is stored, so that nothing reads what other code wrote.
FORMAT = 1


def stored_index(r: Roles) -> BitmapIndex:
    """The bitmap index of the documents as their files are now, in the shared folder.

    It is built by the first query that asks for it, as batch 0, and read by
    all after; of two that build it at once one commits and the other reads.
    """
    documents = f"{r.path}/documents.parquet"
    store = Snapshots(r.spark, f"{checkpoints.folder(r.spark)}/index-{FORMAT}-{checkpoints.fingerprint(r.spark, documents)}")
    index = BitmapIndex(store)
    if not store.guard(f"batches/{index.name}"):
        index.add(r.texts(), batch=0)
    return index


def stored_blocks(r: Roles) -> DataFrame:
    """The packed blocks of the embeddings as their files are now, built by the first query that asks for them."""
    embeddings = f"{r.path}/embeddings.parquet"
    store = Snapshots(r.spark, f"{checkpoints.folder(r.spark)}/blocks-{FORMAT}-{checkpoints.fingerprint(r.spark, embeddings)}")
    if not store.guard("built"):
        try:
            store.commit(add={"blocks": store.stage(packed(r.vectors()))}, expect={"built": 0}, guards={"built": 1})
        except Stale:
            pass
    return store.table("blocks")
