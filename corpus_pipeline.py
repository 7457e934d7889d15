"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. Tables that a stage wrote for itself are deleted
when the next one begins, as its result is a table of its own by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import language_id, mixing, sentencepiece_viterbi, simhash, substring_dedup
from chronolake.llm.common import discard_unread, materialize, recording

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_left: list[DataFrame] = []


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before has left, but for what ``docs`` reads."""

    @functools.wraps(run)
    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(_left, docs)
        with recording() as made:
            out = run(spark, docs, sf_dir)
        _left[:] = made
        return out

    return cleaned


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language_id.keep_known(docs).select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id."""
    return simhash.keep_one(docs).select(*COLUMNS)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier.

    ``n_chars`` is that of the text that is left. A document of which nothing
    is left stays, with an empty text.
    """
    out = substring_dedup.repeated_windows(docs, carry=("lang", "source"), spacing=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighing 1, 2, 3 in turn."""
    return mixing.mix_documents(docs, sf_dir).select(*COLUMNS)


@stage
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's whole text."""
    out = sentencepiece_viterbi.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifier, the fingerprints and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
