"""Exact similarity pairs within groups, by cells around pivots, and what is built from them.

Angles between vectors are a metric. A vector's home is the cell of its nearest
pivot. If two vectors are within an angle t, the one with the later home lies
within (angle to its own pivot) + 2 t of the other's pivot, so it visits the
cells of earlier pivots up to that angle, and every pair meets in exactly one
cell. Pivots are a bounded sample; they decide how many cells there are and
never which pairs are found. Cells with many rows are dealt in pairs of blocks.
Where the bound is so wide that rows would visit most cells, a whole group is one
cell: a count of the copies that either way sends decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, normalized
from ..sources.checkpoints import written

#: Rows of a block at most: a task holds two. Cells of fewer rows are dealt too, in up to ``SIDES`` blocks of ``LEAST`` rows or more, so that there are tasks for all cores.
PIVOTS, BLOCK = 256, 32768
LEAST, SIDES = 4096, 8
#: Partitions of pairs of blocks at most.
MOST = 4096
SLACK = 1e-7
#: What is compared in one task.
GROUP = ("grp", "cell", "low", "high")


def _units(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Unit pivots: at most ``most`` vectors, by hash."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector")).limit(most).collect()
    x = np.unique(np.array([r["vector"] for r in rows], np.float64), axis=0) if rows else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _visited(part: pa.Array, pivots: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each vector, which cells it stands in)."""
    far = np.arccos(np.clip(_units(part) @ pivots.T, -1, 1))
    home = far.argmin(axis=1)
    goes = far <= far[np.arange(len(home)), home][:, None] + 2 * angle + SLACK
    return home, goes & (np.arange(len(pivots)) <= home[:, None])


def visits(vectors: DataFrame, pivots: np.ndarray, angle: float) -> DataFrame:
    """(grp, cell, id, vector, home, ...): a row at home and one in each cell visited, other columns with it."""
    rest = [c for c in vectors.columns if c not in ("grp", "id", "vector")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                home, goes = _visited(part.column(2), pivots, angle)
                row, cell = np.nonzero(goes)
                for i in range(0, len(row), 4096):
                    r, c = row[i : i + 4096], cell[i : i + 4096]
                    moved = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(c.astype(np.int32)), pa.array(home[r] == c)], names=[*moved.schema.names, "cell", "home"])

    sent = vectors.select("grp", "id", "vector", *rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema)
    return sent.mapInArrow(run, f"{fields}, cell int, home boolean")


def cell_sizes(vectors: DataFrame, pivots: np.ndarray, angle: float) -> DataFrame:
    """(grp, cell, n): the rows of ``visits`` by cell, counted where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).dictionary_encode(null_encoding="encode")
            names, which = of.dictionary, of.indices.to_numpy()
            count = np.zeros((len(names), len(pivots)), np.int64)
            for at in range(0, b.num_rows, 1024):
                np.add.at(count, which[at : at + 1024], _visited(b.column(1).slice(at, 1024), pivots, angle)[1])
            g, c = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(g)), pa.array(c.astype(np.int32)), pa.array(count[g, c])], names=["grp", "cell", "n"])

    return vectors.select("grp", "vector").mapInArrow(run, "grp string, cell int, n long").groupBy("grp", "cell").agg(F.sum("n").alias("n"))


def dealt(vectors: DataFrame, above: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Rows (grp, id, vector, ...) by (grp, cell, low, high): each pair with a cosine above the bound meets in one such group, in ``pairs_of``."""
    if above <= -1:
        raise ValueError("every pair is above -1")
    angle = float(np.arccos(np.clip(above, -1, 1)))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.lit(SIDES), F.ceil(F.col("n") / LEAST))).cast("int")
    whole = vectors.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit(0).alias("cell"), "n", blocks.alias("blocks"))

    def counted(sizes: DataFrame) -> tuple[int, int]:
        """(copies that are sent, pairs of blocks of the cells that are dealt)."""
        copies, dealt_in = F.sum(F.col("n") * F.col("blocks")), F.sum(F.expr("if(blocks > 1, blocks * (blocks + 1) div 2, 0)"))
        return tuple(x or 0 for x in sizes.agg(copies, dealt_in).first())

    points = choose_pivots(vectors, pivots)
    rows, sizes = vectors.withColumns({"cell": F.lit(0), "home": F.lit(True)}), whole
    if len(points) > 1:
        cells = cell_sizes(vectors, points, angle).select("grp", "cell", "n", blocks.alias("blocks"))
        of_cells, of_whole = counted(cells), counted(whole)
        pairs = of_whole[1]
        if of_cells[0] < of_whole[0]:
            rows, sizes, pairs = visits(vectors, points, angle), cells, of_cells[1]
    else:
        pairs = counted(whole)[1]
    # A row for each cell that is too long for one task, so one for thousands of rows.
    hot = sizes.filter("blocks > 1").select("grp", "cell", "blocks")
    out = rows.join(F.broadcast(hot), ["grp", "cell"], "left").withColumn("own", F.expr("cast(pmod(xxhash64(id), coalesce(blocks, 1)) as int)"))
    out = out.withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    out = out.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")
    # By all four: a join's exchange by the cell would do for Spark, and one task would have all pairs of its blocks. As many
    # partitions as there are such pairs, which are not put together by their bytes: it is the comparisons that are many.
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(min(max(least, 2 * pairs), MOST), *GROUP) if pairs else out.repartition(*GROUP)


def sides_of(t: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Unit vectors of a group of ``dealt``, and what is to be compared: (rows, rows) sets; within one set each pair twice.

    Two rows are compared where one of them is at home.
    """
    own, home = t.column("own").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    at = lambda side, h: np.flatnonzero((own == side) & (home == h))
    if low == high:
        sides = [(at(low, True), at(low, True)), (at(low, True), at(low, False))]
    else:
        sides = [(at(low, True), np.flatnonzero(own == high)), (at(low, False), at(high, True))]
    return _units(t.column("vector")), [(a, b) for a, b in sides if len(a) and len(b)]


#: Cosines of one step of a task.
STEP = 1 << 21


def pairs_of(t: pa.Table, above: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of the pairs that a group of ``dealt`` is to compare, some rows at a time."""
    x, sides = sides_of(t)
    for left, right in sides:
        same = left[0] == right[0]
        y = x[right].T
        step = max(1, STEP // len(right))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            c = x[i] @ y
            r, k = np.nonzero(c > above)
            if same:
                use = at + r < k
                r, k = r[use], k[use]
            yield i[r], right[k], c[r, k]


def near_pairs(vectors: DataFrame, above: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(grp, a, b, cos), a < b: all pairs of rows (grp, id, vector) of one group with a cosine above the bound.

    Vectors are of one length and not zero; ids differ. A bound of -1 or less
    would be every pair, and is refused.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, grp = t.column("id").to_numpy(), t.column("grp")[0].as_py()
        for u, v, w in pairs_of(t, above):
            a, b = ids[u], ids[v]
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(a), pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(w)], names=["grp", "a", "b", "cos"])

    return dealt(vectors.select("grp", "id", "vector"), above, pivots, block).groupBy("grp", "cell", "low", "high").applyInArrow(compare, "grp string, a long, b long, cos double")


def first_come(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that a loop in the order of ids keeps: those with no earlier kept neighbour in ``edges`` (a < b).

    By rounds: a node without an earlier undecided neighbour is kept, and its
    later neighbours go. Each round decides at least the first node of every
    component; a path whose ids rise along it takes half its length of rounds.
    Rounds are written, so none is computed twice.
    """
    left, edges = written(nodes.select("id").distinct()), written(edges.select("a", "b").distinct())
    kept = []
    while not edges.isEmpty():
        now = written(left.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        kept.append(now)
        gone = written(edges.join(now.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        decided = now.unionAll(gone)
        left = written(left.join(decided, "id", "left_anti"))
        for end in ("a", "b"):
            edges = edges.join(decided.select(F.col("id").alias(end)), end, "left_anti")
        edges = written(edges)
    out = left
    for k in kept:
        out = out.unionAll(k)
    return out


# Anchor learning

#: Fixed values of the learning rule: cosines of a duplicate and of a text that says the same as its title, its least length, and weights.
DUPLICATE, SAME_AS_TITLE, LEAST_OCR, USER_WEIGHT, OCR_WEIGHT = 0.95, 0.7, 20, 2.0, 1.5


def anchor_candidates(feedback: DataFrame) -> DataFrame:
    """The anchors that feedback asks for: (id, category, scope, process_name, text, weight, source, vector).

    ``feedback``: seq, category, title, clean_title, informative, ocr_text,
    process_name and the vectors title_vector, clean_vector and ocr_vector. A
    row gives a local title if it has a process, a global one of the cleaned
    title if that is informative, and a local text if it is long enough and
    its vector differs from the title's. A blank title gives none. ``id`` is in
    the order in which a loop would add them.
    """
    process = F.lower(F.trim(F.coalesce("process_name", F.lit(""))))
    local = process != ""
    unlike = dot(normalized(F.col("title_vector")), normalized(F.col("ocr_vector"))) < SAME_AS_TITLE
    asks = [
        (local, "local", "title", USER_WEIGHT, "user_feedback", "title_vector"),
        (F.col("informative"), "global", "clean_title", USER_WEIGHT, "user_feedback", "clean_vector"),
        (local & (F.length(F.trim("ocr_text")) >= LEAST_OCR) & unlike, "local", "ocr_text", OCR_WEIGHT, "ocr_feedback", "ocr_vector"),
    ]
    each = F.array(*[
        F.when(F.coalesce(when, F.lit(False)), F.struct(
            (F.col("seq") * 3 + k).alias("id"), F.lit(scope).alias("scope"), F.when(F.lit(scope == "local"), process).otherwise("").alias("process_name"),
            F.col(text).alias("text"), F.lit(weight).alias("weight"), F.lit(source).alias("source"), F.col(vector).alias("vector")))
        for k, (when, scope, text, weight, source, vector) in enumerate(asks)
    ])
    rows = feedback.filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    return rows.select("category", F.explode(F.array_compact(each)).alias("c")).select("c.id", "category", "c.scope", "c.process_name", "c.text", "c.weight", "c.source", "c.vector")


def learned_anchors(existing: DataFrame, candidates: DataFrame, above: float = DUPLICATE) -> DataFrame:
    """The candidates that are learned: none like an anchor there is, or an earlier learned one, of their category, scope and process.

    Both sides have id, category, scope, process_name and vector; ids of
    ``existing`` are below all of the candidates'. Equals the loop that looks
    at the candidates in the order of ids. Vectors that are null or zero are
    like none.
    """
    names = ["id", "category", "scope", "process_name", "vector"]
    both = existing.select(*names, F.lit(True).alias("old")).unionByName(candidates.select(*names, F.lit(False).alias("old")))
    grp = F.to_json(F.struct("category", "scope", F.lower(F.trim("process_name")).alias("process_name")))
    both = written(both.select("id", "old", grp.alias("grp"), normalized(F.col("vector").cast("array<double>")).alias("vector")))
    sound = both.filter("exists(vector, x -> x <> 0)")
    # Of equal vectors of a group only the first can stay: what an earlier copy is like, a later one is.
    first = written(sound.groupBy("grp", "vector").agg(F.min("id").alias("id")))
    again = sound.join(first.select(F.col("id").alias("_first")), F.col("id") == F.col("_first"), "left_anti").filter("NOT old").select("id")
    pairs = near_pairs(first, above)
    old = both.filter("old").select("id")
    # Anchors there are stay, whatever they are like among themselves.
    pairs = pairs.join(old.select(F.col("id").alias("b")), "b", "left_anti")
    like_old = pairs.join(old.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    fresh = first.select("id").join(old, "id", "left_anti").join(like_old, "id", "left_anti")
    edges = pairs
    for end in ("a", "b"):
        edges = edges.join(fresh.select(F.col("id").alias(end)), end, "left_semi")
    zero = both.filter("NOT old AND NOT coalesce(exists(vector, x -> x <> 0), false)").select("id")
    kept = first_come(fresh, edges).unionAll(zero)
    return candidates.join(kept, "id", "left_semi").join(again, "id", "left_anti")
