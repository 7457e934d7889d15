"""Texts put together from ordered boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def joined_text(boxes: DataFrame, parent: str, order: list[str], text: str = "text", sep: str = " ") -> DataFrame:
    """(parent, body): non-empty texts of each parent joined in ``order``."""
    kept = boxes.filter(F.coalesce(F.col(text), F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return kept.groupBy(parent).agg(ordered.alias("o")).select(parent, F.array_join(F.col("o")[text], sep).alias("body"))


def text_prefix(boxes: DataFrame, parent: str, order: list[str], min_chars: int, text: str = "text", sep: str = " ") -> DataFrame:
    """(parent, body): boxes joined in ``order`` until there are ``min_chars`` characters.

    A box is taken while what stands before it is shorter; so the result is a
    prefix, in whole boxes, of the full join.
    """
    kept = boxes.filter(F.coalesce(F.col(text), F.lit("")) != "")
    w = Window.partitionBy(parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + len(sep)).over(w), F.lit(0))
    return joined_text(kept.withColumn("_before", before).filter(F.col("_before") < min_chars), parent, order, text, sep)


def first_texts(samples: DataFrame, position: str, title: str, body: str, chars: int = 200) -> DataFrame:
    """(text): each row's title, then its first ``chars`` of body, blanks skipped, first of each kept in order."""
    each = samples.select(position, F.posexplode(F.array(F.trim(title), F.substring(F.col(body), 1, chars))).alias("n", "text"))
    firsts = each.filter(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("text").agg(F.min(F.struct(position, "n")).alias("at"))
    return firsts.orderBy("at").select("text", F.col(f"at.{position}").alias("first_row"))
