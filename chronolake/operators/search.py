"""Keyword search over a bigram inverted index, and link scoring."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams, entropy_penalty

if TYPE_CHECKING:
    from .bitmap_index import BitmapIndex


def postings(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(token, id): one row for each distinct bigram of each text; partition it by token to keep it."""
    return texts.select(F.col(id_col).alias("id"), F.explode(bigrams(F.col(text_col))).alias("token"))


def keyword_tokens(query: str) -> list[list[str]]:
    """The distinct bigrams of each keyword of a query; keywords without one are left out."""
    out = []
    for word in query.split():
        w = "".join(c for c in word if c.isalnum())
        if len(w) >= 2:
            out.append(list(dict.fromkeys(w[i : i + 2] for i in range(len(w) - 1))))
    return out


def matches(index: DataFrame | BitmapIndex, tokens: list[str], fuzzy: bool) -> DataFrame:
    """(id, hits): strict: all tokens; fuzzy: any, those missing from the index skipped.

    A stored index reads its tokens' bitmaps; postings (token, id) are filtered.
    """
    if not isinstance(index, DataFrame):
        return index.matches(tokens, fuzzy)
    hits = index.filter(F.col("token").isin(tokens)).groupBy("id").agg(F.count("*").alias("hits"))
    return hits if fuzzy else hits.filter(F.col("hits") == len(tokens))


def search(texts: DataFrame, index: DataFrame | BitmapIndex, query: str, fuzzy: bool = False, categories: list[str] | None = None, processes: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Keyword search over ``texts`` (id, parent_id, text, category, process_name, created_at).

    One keyword gives a row for each text: pages run by id down (strict) or by
    hits and id down (fuzzy). Several give the last text of each parent that
    has all of them, pages by parent down. Categories are filtered before the
    page, processes after it, so a page may come out short. A query without a
    bigram finds nothing; an empty one lists texts by time.
    """
    words = keyword_tokens(query)
    inside = texts if not categories else texts.filter(F.col("category").isin(categories))
    if not words:
        bare = "".join(c for c in query if c.isalnum())
        page = inside.filter(F.lit(not bare)).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit).withColumn("hits", F.lit(0).cast("long"))
    elif len(words) == 1:
        order = [F.desc("hits"), F.desc("id")] if fuzzy else [F.desc("id")]
        page = inside.join(matches(index, words[0], fuzzy), "id").orderBy(*order).offset(offset).limit(limit)
    else:
        parents = None
        for tokens in words:
            found = texts.join(matches(index, tokens, fuzzy), "id", "left_semi").select("parent_id").distinct()
            parents = found if parents is None else parents.join(found, "parent_id", "left_semi")
        last = inside.join(parents, "parent_id", "left_semi").groupBy("parent_id").agg(F.max("id").alias("id"))
        page = inside.drop("parent_id").join(last, "id").orderBy(F.desc("parent_id")).offset(offset).limit(limit).withColumn("hits", F.lit(0).cast("long"))
    return page if not processes else page.filter(F.col("process_name").isin(processes))


def document_frequency(index: DataFrame) -> DataFrame:
    """(token, df)."""
    return index.groupBy("token").agg(F.count("*").alias("df"))


def score_links(links: DataFrame, df: DataFrame, total: DataFrame) -> DataFrame:
    """``links`` (link_id, text) with ``score``; ``total`` is one row, ``n``.

    Sum over the text's bigrams of ln(1 + n / (1 + df)), times ln(1 + length),
    times the entropy penalty, over ln(e + length); a raw URL scores 0.
    """
    tokens = links.select("link_id", F.explode(bigrams(F.col("text"))).alias("token")).join(df, "token", "left").crossJoin(F.broadcast(total))
    idf = tokens.groupBy("link_id").agg(F.sum(F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0))))).alias("idf"))
    size = F.length("text").cast("double")
    score = F.coalesce("idf", F.lit(0.0)) * F.log1p(size) * entropy_penalty(F.col("text")) / F.log(F.lit(2.718281828459045) + size)
    return links.join(idf, "link_id", "left").select("link_id", "text", F.when(F.lower("text").rlike("^https?://"), 0.0).otherwise(score).alias("score"))


