"""Sums, means and covariances of array columns by upper-triangle aggregates.

Every pair of dimensions i <= j is one generated SQL sum, and all pairs of a
table are summed in one aggregation: a partial one in each task, then one row
for each group. What comes to the driver is that row: a number for each pair.
Above ``PAIRS`` pairs (some 100 dimensions) the pairs are dealt over several
aggregations of at most that many, as plans of more expressions take the
driver longer than another pass over the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = 5_000


def aggregated(df: DataFrame, key: str, vector: str, terms: list[str]) -> dict:
    """key -> (rows, the sum of each of the SQL ``terms`` over the group's vectors ``v``), one aggregation."""
    named = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    row = ", ".join(f"sum({t})" for t in terms)
    found = df.sparkSession.sql(f"SELECT key, count(*) AS n, array({row}) AS s FROM {{named}} GROUP BY key", named=named)
    return {r["key"]: (r["n"], r["s"]) for r in found.collect()}


def sums(df: DataFrame, key: str, vector: str, width: int) -> dict:
    """key -> (n, list of sums): rows of each group and the sum of each dimension.

    Sums of long vectors are exact Python integers, of double ones floats. A
    vector shorter than ``width`` adds nothing to the dimensions it has not
    got; their sum is 0 where no vector of the group has them.
    """
    if not width:
        return {}
    long = df.schema[vector].dataType.simpleString() == "array<bigint>"
    terms = [f"cast(get(v, {i}) AS decimal(20,0))" if long else f"get(v, {i})" for i in range(width)]
    return {k: (n, [(int if long else float)(x or 0) for x in s]) for k, (n, s) in aggregated(df, key, vector, terms).items()}


def products(df: DataFrame, key: str, vector: str, width: int) -> dict:
    """key -> symmetric matrix of the summed products of every pair of dimensions of double vectors."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    out: dict = {}
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        for k, (_, s) in aggregated(df, key, vector, [f"get(v, {i}) * get(v, {j})" for i, j in part]).items():
            m = out.setdefault(k, np.zeros((width, width)))
            for (i, j), x in zip(part, s, strict=True):
                m[i, j] = m[j, i] = x or 0.0
    return out


def by_key(key: Column, values: dict) -> Column:
    """The array that a small dict of the driver has for ``key``, as a literal of the plan."""
    items = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.element_at(F.create_map(*items), key)
