"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are taken from the data. A vector is described by its
``PREFIX`` nearest pivots in order. Two vectors are candidates if they share at
least two of them. A vector stands in the inverted lists of its pivots but the
last, and a list is read by second pivots: those of its rows that share one more
are compared. A candidate pair is verified by its cosine in double precision,
under the first two pivots it shares, so it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .simhash import _forest

COSINE = 0.95
#: Vectors sampled as pivots: this many times the root of their number, within the bounds of the sample, and none near another.
PIVOT_RATE, MIN_PIVOTS, MAX_PIVOTS, APART = 4.0, 64, 4096, 0.8
PREFIX = 8
#: Bytes of the vectors of a list that one task takes whole; rows of a block of a longer list; rows that are compared all with all.
LIST, BLOCK, SMALL = 32 << 20, 1024, 512


def _units(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(vectors: DataFrame) -> np.ndarray:
    """Unit pivots: a sample by hash of the distinct vectors, none within ``APART``.

    The sample that the index is fitted on is bounded: at most ``MAX_PIVOTS``
    vectors come to the driver. Lists stay short where many vectors are alike,
    as their pivots would be alike too.
    """
    n = vectors.count()
    take = int(min(MAX_PIVOTS, max(MIN_PIVOTS, np.ceil(PIVOT_RATE * np.sqrt(n)))))
    rows = vectors.orderBy("hash", "vector").select("vector").limit(take).collect()
    if not rows:
        return np.zeros((0, 1))
    x = np.array([r["vector"] for r in rows], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    keep: list[int] = []
    for i in range(len(x)):
        if not keep or (x[keep] @ x[i]).max() < APART:
            keep.append(i)
    return x[keep]


def postings(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The inverted lists (low, node, copies, vector, prefix): a row for each vector and pivot of its prefix but the last.

    A single pivot is a list by itself. Prefixes are sorted, as a pair is
    counted under the two least pivots it shares.
    """
    size = min(PREFIX, len(pivots))
    each = max(size - 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                near = _units(part.column(2)) @ pivots.T
                top = np.sort(np.argpartition(-near, size - 1, axis=1)[:, :size], axis=1).astype(np.int32)
                row = pa.array(np.repeat(np.arange(part.num_rows), each))
                prefix = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, size, dtype=np.int32)), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(top[:, :each].ravel()), *(c.take(row) for c in (*part.columns, prefix))], names=["low", "node", "copies", "vector", "prefix"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("node", "copies", "vector").mapInArrow(run, f"low int, node long, copies long, vector {kind}, prefix array<int>")


def verified(lists: DataFrame, threshold: float, whole: int, block: int = BLOCK) -> DataFrame:
    """(a, b, n): a link of a forest where b is set, else n more links of a.

    A list of at most ``whole`` rows is one group. A longer one is dealt by
    second pivots, and what of these has over ``block`` rows into blocks, each
    pair of which is a group of its own; a task never holds a whole long list.
    """
    # Pivots are a bounded sample, and so are their lists that are too long.
    long = [r["low"] for r in lists.groupBy("low").agg(F.count("*").alias("rows")).filter(F.col("rows") > whole).collect()]
    names = ["low", "high", "from", "to", "own", "node", "copies", "vector", "prefix"]
    groups = lists.filter(~F.col("low").isin(long)).withColumns({"high": F.lit(-1), "own": F.lit(0), "from": F.lit(0), "to": F.lit(0)}).select(*names)
    if long:
        # A pivot alone in its prefix is its own second one.
        seconds = F.expr("if(size(prefix) > 1, filter(prefix, x -> x > low), prefix)")
        second = lists.filter(F.col("low").isin(long)).withColumn("high", F.explode(seconds))
        hot = second.groupBy("low", "high").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
        dealt = second.join(hot, ["low", "high"], "left").withColumn("own", F.expr("cast(pmod(xxhash64(node, 1), coalesce(blocks, 1)) as int)"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
        dealt = dealt.withColumn("from", F.least("own", "other")).withColumn("to", F.greatest("own", "other"))
        groups = groups.unionAll(dealt.select(*names))

    def verify(t: pa.Table) -> pa.Table:
        low, high, same = t.column("low")[0].as_py(), t.column("high")[0].as_py(), t.column("from")[0].as_py() == t.column("to")[0].as_py()
        if t.num_rows < 2:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        t = t.combine_chunks()
        node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
        x = _units(t.column("vector").chunk(0))
        prefix = np.asarray(t.column("prefix").chunk(0).flatten()).reshape(len(node), -1)
        alone = prefix.shape[1] == 1
        counts = np.zeros(len(node), np.int64)
        forest = np.zeros((2, 0), np.int64)

        def compare(left: np.ndarray, right: np.ndarray, second: int) -> None:
            """Count and join the links between rows whose second shared pivot is ``second``, or any if negative."""
            nonlocal forest
            among = right is left
            for at in range(0, len(left), 256):
                i = left[at : at + 256]
                r, c = np.nonzero(x[i] @ x[right].T >= threshold)
                r, c = i[r], right[c]
                if among:
                    r, c = r[r < c], c[r < c]
                for part in range(0, len(r), 1 << 16):
                    u, v = r[part : part + (1 << 16)], c[part : part + (1 << 16)]
                    if not alone:
                        both = (prefix[u][:, :, None] == prefix[v][:, None, :]).any(axis=2)
                        # Prefixes are sorted: this list and second pivot are the least two shared, if any second will do the list the least.
                        first = ~(both & (prefix[u] < low)).any(axis=1)
                        use = first & (both.sum(axis=1) > 1 if second < 0 else ~(both & (prefix[u] > low) & (prefix[u] < second)).any(axis=1))
                        u, v = u[use], v[use]
                    np.add.at(counts, u, copies[v])
                    np.add.at(counts, v, copies[u])
                    forest = np.stack(_forest(*np.concatenate([forest, np.stack([u, v])], axis=1)))

        everyone = np.arange(len(node))
        if not same:
            compare(np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max()), high)
        elif high >= 0 or alone or len(node) <= SMALL:
            compare(everyone, everyone, -1 if high < 0 or alone else high)
        else:
            row, column = np.nonzero(prefix > low)
            seconds = prefix[row, column]
            order = np.argsort(seconds, kind="stable")
            ends = np.flatnonzero(np.diff(seconds[order], append=-1)) + 1
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                rows = row[order[begin:end]]
                if len(rows) > 1:
                    compare(rows, rows, int(seconds[order[begin]]))
        has = np.flatnonzero(counts)
        a = np.concatenate([node[has], node[forest[0]]]).astype(np.int64)
        b = pa.array([None] * len(has) + node[forest[1]].tolist(), pa.int64())
        n = pa.array(np.concatenate([counts[has], np.zeros(forest.shape[1], np.int64)]))
        return pa.table({"a": pa.array(a), "b": b, "n": n})

    return groups.groupBy("low", "high", "from", "to").applyInArrow(verify, "a long, b long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``df``.

    Equal vectors are one node with a count of copies. Vectors that are null, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths. Rows that repeat an id count as vectors of their own; null ids
    are passed over in component_id. Pairs below ``threshold`` are never
    linked; those at or above are if they share two of their nearest pivots.
    """
    # Negative zero is zero, so that equal vectors have equal hashes.
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = df.schema[vector_col].dataType.simpleString()
    vector = v.cast(kind) if kind == "array<float>" else v
    rows = materialize(df.select(F.col(id_col).alias("id"), vector.alias("vector"), sound.alias("sound")).withColumn("hash", F.when(F.col("sound"), F.xxhash64("vector"))))
    # The hash deals vectors out, and the vectors themselves tell whether they are equal.
    nodes = rows.filter("sound").groupBy("hash", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = None
    # Lengths of vectors: one in any one table of embeddings, a few at most.
    for size in sorted(r["n"] for r in nodes.select(F.size("vector").alias("n")).distinct().collect()):
        own = nodes.filter(F.size("vector") == size)
        pivots = choose_pivots(own)
        part = materialize(verified(postings(own, pivots), threshold, max(BLOCK, LIST // (8 * max(size, 1)))))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    whole = nodes.select("node", "low", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component"))
    classes = whole.join(lowest, "root").select(F.col("node").alias("_node"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    named = rows.join(nodes.select("hash", "vector", "node"), ["hash", "vector"], "left").select("id", "node")
    out = named.join(classes, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
SQL: dict[str, str] = {
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n
        ), r AS (
            SELECT vec_id, vec_id AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.vec_id WHERE r.m < l.b
        ), c AS (
            SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1
        )
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
    """,
}
