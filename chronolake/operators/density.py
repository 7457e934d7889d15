"""Density clustering: core distances, a spanning forest, and clusters by stability.

Distances are those of unit vectors, up to a reach beyond which nothing merges.
A point's core distance is that to its k-th neighbour; two points merge at the
largest of their core distances and their own. What merges at which distance
is held by a minimum spanning forest: each group of compared rows sends the
forest of its own pairs, which changes no component at any distance, and
Boruvka's rounds over their union leave the forest of all.

Clusters are read off at levels of distance. A component of enough points is a
cluster; going to smaller distances it goes on while one component of enough
points is left of it, and splits where there are several. A cluster's
stability is the sum, over its levels, of its points times the gain in
1 / distance, and clusters are chosen so that the sum of stabilities is largest.
With a level for each distance of the forest that is the exact condensed tree.
Equal vectors are one node that counts as many points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import length, normalized
from ..sources.checkpoints import written
from .similarity import GROUP, PIVOTS, dealt, sides_of

#: Rows of a block at most: a task holds two, in double and in single precision.
BLOCK = 65536
#: Rows and columns of cosines that are looked at together, rows that a first bound is taken from, and pairs whose exact cosines are taken together.
ROWS, COLUMNS, PROBE, HELD = 512, 1024, 1024, 1 << 15
#: Distances under this count as it.
LEAST = 1e-3


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.maximum(2 - 2 * cos, 0)), LEAST)


def _slack(x: np.ndarray) -> float:
    """What a cosine of unit vectors may be off in single precision."""
    return (x.shape[1] + 4) * float(np.finfo(np.float32).eps)


def _close(x: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of the pairs to compare whose cosine, in single precision, is above the bound of either; within one set each pair once.

    Bounds may rise meanwhile.
    """
    for left, right in sides:
        same, y = left[0] == right[0], x[right]
        for a in range(0, len(left), ROWS):
            i = left[a : a + ROWS]
            z = x[i]
            for b in range(a // COLUMNS * COLUMNS if same else 0, len(right), COLUMNS):
                j = right[b : b + COLUMNS]
                c = z @ y[b : b + COLUMNS].T
                good = c > bound[i][:, None]
                good |= c > bound[j][None, :]
                if same and b < a + len(i):
                    good &= b + np.arange(len(j)) > a + np.arange(len(i))[:, None]
                flat = good.ravel()
                if len(flat) % 8:
                    at = np.flatnonzero(flat)
                else:
                    # Eight at a time, as few are.
                    some = np.flatnonzero(flat.view(np.uint64))
                    r, q = np.nonzero(flat.reshape(-1, 8)[some])
                    at = some[r] * 8 + q
                if len(at):
                    r, q = np.divmod(at, len(j))
                    yield i[r], j[q]


def _in_steps(pairs: Iterator[tuple[np.ndarray, np.ndarray]], x: np.ndarray, above: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of the pairs above the bound, in double precision, ``HELD`` or more at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def exact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v = (np.concatenate(z) for z in zip(*held, strict=True))
        c = np.concatenate([np.einsum("ij,ij->i", x[u[at : at + HELD]], x[v[at : at + HELD]]) for at in range(0, len(u), HELD)])
        use = c > above
        return u[use], v[use], c[use]

    for pair in pairs:
        held.append(pair)
        if sum(len(u) for u, _ in held) >= HELD:
            yield exact()
            held = []
    if held:
        yield exact()


def _probes(x: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, others, cosines in single precision): each row with some of those it is compared with; its own is minus infinity."""
    for left, right in sides:
        same = left[0] == right[0]
        for rows, others in ((left, right),) if same else ((left, right), (right, left)):
            some = others[:PROBE]
            y = x[some].T
            for at in range(0, len(rows), COLUMNS):
                i = rows[at : at + COLUMNS]
                c = x[i] @ y
                if same and at < len(some):
                    n = min(len(i), len(some) - at)
                    c[np.arange(n), at + np.arange(n)] = -np.inf
                yield i, some, c


def _first_bounds(x: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], k: int, above: float) -> np.ndarray:
    """A number no larger than each row's k-th best cosine: the k-th best of some of the rows it is compared with."""
    slack = _slack(x)
    bound = np.full(len(x), above - slack, np.float32)
    for i, some, c in _probes(x, sides):
        if len(some) > k:
            bound[i] = np.maximum(bound[i], np.partition(c, len(some) - k, axis=1)[:, -k] - 2 * slack)
    return bound


def _first_pairs(x: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], above: float, k: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row): each row with the nearest of some of the rows it is compared with."""
    for i, some, c in _probes(x, sides):
        few = np.argpartition(c, -min(k, len(some)), axis=1)[:, -min(k, len(some)) :]
        r, q = np.nonzero(np.take_along_axis(c, few, 1) > above)
        if len(r):
            yield i[r], some[few[r, q]]


def core_distances(cells: DataFrame, nodes: DataFrame, k: int, above: float) -> DataFrame:
    """(id, core): distance to the k-th other point; nodes that have fewer within the reach are left out.

    A group sends each row's k nearest; copies of a node are neighbours at the least distance.
    """

    def nearest(t: pa.Table) -> pa.Table:
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        x, sides = sides_of(t)
        small = x.astype(np.float32)
        slack, bound = _slack(small), _first_bounds(small, sides, k, above)
        best, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), int)

        def take(rows: np.ndarray, others: np.ndarray, cos: np.ndarray) -> None:
            """Those of a row and what it has: the k best."""
            own = np.unique(rows)
            a, b, c = np.concatenate([np.repeat(own, k), rows]), np.concatenate([who[own].ravel(), others]), np.concatenate([best[own].ravel(), cos])
            order = np.lexsort((-c, a))
            a, b, c = a[order], b[order], c[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            use = place < k
            best[a[use], place[use]], who[a[use], place[use]] = c[use], b[use]
            bound[own] = np.maximum(bound[own], best[own, -1] - slack)

        for u, v, c in _in_steps(_close(small, sides, bound), x, above):
            for rows, others in ((u, v), (v, u)):
                good = c > best[rows, -1]
                take(rows[good], others[good], c[good])
        r, q = np.nonzero(best > -np.inf)
        return pa.table({"id": pa.array(ids[r]), "d": pa.array(_distance(best[r, q])), "n": pa.array(copies[who[r, q]])})

    near = cells.groupBy(*GROUP).applyInArrow(nearest, "id long, d double, n long")
    own = nodes.filter("copies > 1").select("id", F.lit(LEAST).alias("d"), (F.col("copies") - 1).alias("n"))
    both = near.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("near"))
    # The first distance at which k points are reached; a row has k numbers for each group it is in.
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when((acc["n"] < k) & (acc["n"] + x["n"] >= k), x["d"]).otherwise(acc["core"]).alias("core"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("core"))
    return both.select("id", F.aggregate("near", start, step, lambda acc: acc["core"]).alias("core")).filter("core is not null")


#: Distances at which a forest under way knows its components.
KNOWN = 64


def lightest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which edges of ``n`` nodes make a minimum spanning forest, distances, the component of every node at each of those)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(w, kind="stable")
    used, levels, labels = [], [], []
    p, lower, upper = np.arange(n, dtype=np.int32), [], []

    def know(weight: float) -> None:
        nonlocal p
        p = p.copy()
        # Roots that were put below others since.
        p[lower] = upper
        lower.clear()
        upper.clear()
        while (p != (up := p[p])).any():
            p = up
        levels.append(weight)
        labels.append(p)

    every = max(1, min(n, len(w)) // KNOWN)
    for e, u, v in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = root(u), root(v)
        if x != y:
            parent[x] = y
            lower.append(x)
            upper.append(y)
            used.append(e)
            if len(used) % every == 0:
                know(float(w[e]))
    if used:
        know(float(w[used[-1]]))
    return np.array(used, int), np.array(levels), np.array(labels, np.int32).reshape(len(levels), n)


def reach_forests(cells: DataFrame, above: float) -> DataFrame:
    """(a, b, w): the spanning forests of the groups, weighted by mutual reachability; rows have their ``core``.

    Pairs that lighter ones connect already go as they come, so a task holds
    its rows, the forest so far and a few pairs a row. A row that is in the
    large component at some distance asks only for nearer ones.
    """

    def joined(levels: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The distance from which on each row is in the component that is the first to hold half of all; infinite if it never is."""
        n = labels.shape[1]
        for row in labels:
            size = np.bincount(row, minlength=n)
            if 2 * size.max() >= n:
                node = int((row == size.argmax()).argmax())
                there = labels == labels[:, node][:, None]
                return np.where(there[-1], levels[there.argmax(axis=0)], np.inf)
        return np.full(n, np.inf)

    def settled(n: int, edges: list, bound: np.ndarray, slack: float) -> tuple:
        """(ends, ends and distances of the forest of these, the levels and components that it knows); bounds rise by it."""
        a, b, w = (np.concatenate(z) for z in zip(*edges, strict=True))
        used, levels, labels = lightest(n, a, b, w)
        bound[:] = np.maximum(above, 1 - np.minimum(joined(levels, labels), 2) ** 2 / 2) - slack
        return a[used], b[used], w[used], levels, labels

    def forest(t: pa.Table) -> pa.Table:
        ids, core = t.column("id").to_numpy(), t.column("core").to_numpy()
        n = len(ids)
        x, sides = sides_of(t)
        small = x.astype(np.float32)
        slack = _slack(small)
        bound = np.full(n, above - slack, np.float32)
        a, b, w = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        levels, labels = np.zeros(0), np.zeros((0, n), np.int32)
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first, pairs in ((True, _first_pairs(small, sides, above)), (False, _close(small, sides, bound))):
            for u, v, c in _in_steps(pairs, x, above):
                d = np.maximum(np.maximum(core[u], core[v]), _distance(c))
                if len(levels):
                    at = np.searchsorted(levels, d, "right") - 1
                    open_ = (at < 0) | (labels[at, u] != labels[at, v])
                    u, v, d = u[open_], v[open_], d[open_]
                fresh.append((u, v, d))
                if not first and sum(len(f[0]) for f in fresh) > 2 * n:
                    a, b, w, levels, labels = settled(n, [(a, b, w), *fresh], bound, slack)
                    fresh = []
            if first:
                a, b, w, levels, labels = settled(n, [(a, b, w), *fresh], bound, slack)
                fresh = []
        a, b, w = (np.concatenate(z) for z in zip((a, b, w), *fresh, strict=True))
        used, _, _ = lightest(n, a, b, w)
        return pa.table({"a": pa.array(ids[a[used]]), "b": pa.array(ids[b[used]]), "w": pa.array(w[used])})

    return cells.groupBy(*GROUP).applyInArrow(forest, "a long, b long, w double")


#: Edges that are left of Boruvka's rounds from which on one task goes through the others.
FEW = 1 << 16


def _last_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, w, x, y) edges to (a, b, w) of their forest and (id, root) of their components x and y, by the rules of ``spanning_forest``."""
    t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("x", pa.int64()), ("y", pa.int64())]))
    a, b, w, x, y = (t.column(c).to_numpy() for c in "abwxy")
    order = np.lexsort((b, a, w))
    ids, place = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    x, y = place[: len(order)], place[len(order) :]
    taken, label, left = np.zeros(len(order), bool), np.arange(len(ids)), np.arange(len(order))
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            break
        best = np.full(len(ids), len(order))
        for end in (x, y):
            np.minimum.at(best, label[end[left]], left)
        own = np.flatnonzero(best < len(order))
        edge = best[own]
        taken[edge] = True
        up = np.arange(len(ids))
        up[own] = label[x[edge]] + label[y[edge]] - own
        first = own[(up[up[own]] == own) & (own < up[own])]
        up[first] = first
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
    use, n = order[taken], len(ids)
    yield pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use]), pa.array(w[use]), pa.nulls(len(use), pa.int64()), pa.nulls(len(use), pa.int64())], names=["a", "b", "w", "id", "root"])
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(ids), pa.array(ids[label])], names=["a", "b", "w", "id", "root"])


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, w) of a minimum spanning forest of ``edges``, (id, root) of every node), by Boruvka's rounds.

    In a round each component takes its lightest edge out, ties by (a, b), and
    joins the component beyond; so the number of components that can still
    grow halves at least. Joined components find their root by doubling.
    Edges within a component are dropped. Every round is written. The last
    ``FEW`` edges are few enough for one task, and cost no rounds of jobs.
    """
    left = written(edges.filter("a <> b").select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    label = written(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    taken = left.select("a", "b", "w").limit(0)
    while n := left.count():
        if n <= FEW:
            rest = written(left.coalesce(1).mapInArrow(_last_rounds, "a long, b long, w double, id long, root long"))
            taken = taken.unionByName(rest.filter("id is null").select("a", "b", "w"))
            new = rest.filter("id is not null").select(F.col("id").alias("root"), F.col("root").alias("_new"))
            label = written(label.join(new, "root", "left").select("id", F.coalesce("_new", "root").alias("root")))
            break
        ends = left.select("x", "y", "a", "b", "w").unionAll(left.select("y", "x", "a", "b", "w"))
        best = written(ends.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.*"))
        taken = written(taken.unionByName(best.select("a", "b", "w").distinct()))
        # Two that chose each other: the smaller one is the root.
        hook = best.select("x", F.col("y").alias("up"))
        back = hook.select(F.col("x").alias("up"), F.col("up").alias("_back"))
        up = written(hook.join(back, "up", "left").select("x", F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up")).alias("up")))
        while True:
            top = up.select(F.col("x").alias("up"), F.col("up").alias("_top"))
            far = written(up.join(top, "up").select("x", F.col("_top").alias("up"), (F.col("_top") != F.col("up")).alias("moved")))
            up = far.select("x", "up")
            if far.filter("moved").isEmpty():
                break
        new = up.select(F.col("x").alias("root"), F.col("up").alias("_new"))
        label = written(label.join(new, "root", "left").select("id", F.coalesce("_new", "root").alias("root")))
        for end in ("x", "y"):
            left = left.join(up.select(F.col("x").alias(end), F.col("up").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        left = written(left.filter("x <> y").select("a", "b", "w", "x", "y"))
    return taken, label


def level_components(forest: DataFrame, points: DataFrame, levels: list[float]) -> list[DataFrame]:
    """For each level, rising: (id, comp) of every point, its component of edges up to that distance; ``comp`` is a point of it."""
    now, below, out = points.select("id", F.col("id").alias("comp")), 0.0, []
    for t in levels:
        edges = forest.filter((F.col("w") <= t) & (F.col("w") > below))
        name = lambda end: now.select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))  # noqa: E731, B023
        between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w")
        _, label = spanning_forest(between)
        now = written(now.join(label.select(F.col("id").alias("comp"), "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
        below = t
        out.append(now)
    return out


def condensed(components: list[DataFrame], copies: DataFrame, levels: list[float], least: int) -> DataFrame:
    """(level, comp, size, cluster, birth, parent): components of ``least`` points or more, and the cluster each belongs to."""
    sized = [c.join(copies, "id").groupBy("comp").agg(F.sum("copies").alias("size")).filter(F.col("size") >= least) for c in components]
    top = len(levels) - 1
    fresh = lambda level: F.concat(F.lit(f"{level}:"), F.col("comp"))
    now = written(sized[top].select("comp", "size", fresh(top).alias("cluster"), F.lit(top).alias("birth"), F.lit(None).cast("string").alias("parent")))
    out = now.withColumn("level", F.lit(top))
    for level in range(top - 1, -1, -1):
        # A component's name is one of its points, so its parent is that point's component one level up.
        up = components[level + 1].select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
        above = now.select(F.col("comp").alias("_up"), F.col("cluster").alias("_cluster"), F.col("birth").alias("_birth"), F.col("parent").alias("_parent"))
        kids = sized[level].join(up, "comp").join(above, "_up")
        several = kids.join(kids.groupBy("_up").agg(F.count("*").alias("_n")), "_up")
        one = F.col("_n") == 1
        now = written(several.select(
            "comp", "size", F.when(one, F.col("_cluster")).otherwise(fresh(level)).alias("cluster"),
            F.when(one, F.col("_birth")).otherwise(level).alias("birth"), F.when(one, F.col("_parent")).otherwise(F.col("_cluster")).alias("parent")))
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return written(out)


def chosen(nodes: DataFrame, levels: list[float]) -> DataFrame:
    """(cluster, birth, stability) of the clusters whose stabilities add up to most, none inside another.

    A cluster is chosen if it is as stable as the best of all below it, and
    no cluster above is.
    """
    gain = F.element_at(F.array(*[F.lit(1 / t - 1 / u) for t, u in zip(levels, [*levels[1:], levels[-1]], strict=True)]), F.col("level") + 1)
    left = written(nodes.groupBy("cluster", "birth", "parent").agg(F.sum(F.col("size") * gain).alias("stability")))
    # Children are born at lower levels, so one pass over the levels from below adds up all subtrees.
    done = left.limit(0).withColumns({"best": F.lit(0.0), "own": F.lit(True)})
    for level in range(len(levels)):
        below = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("_below"))
        now = left.filter(F.col("birth") == level).join(below, "cluster", "left").withColumn("_below", F.coalesce("_below", F.lit(0.0)))
        own = F.col("stability") >= F.col("_below")
        done = written(done.unionByName(now.select("cluster", "birth", "parent", "stability", F.greatest("stability", "_below").alias("best"), own.alias("own"))))
    out, inside = None, None
    for level in range(len(levels) - 1, -1, -1):
        now = done.filter(F.col("birth") == level)
        if inside is not None:
            now = now.join(inside.select(F.col("cluster").alias("parent"), F.lit(True).alias("_in")), "parent", "left")
        else:
            now = now.withColumn("_in", F.lit(None).cast("boolean"))
        now = now.select("cluster", "birth", "stability", F.coalesce("_in", F.lit(False)).alias("_in"), "own")
        taken = now.filter("own AND NOT _in").select("cluster", "birth", "stability")
        covered = now.filter("own OR _in").select("cluster")
        out = taken if out is None else out.unionAll(taken)
        inside = written(covered if inside is None else inside.unionAll(covered))
    return written(out)


def clusters(vectors: DataFrame, least: int = 5, k: int = 5, above: float = 0.3, levels: list[float] | None = None, steps: int = 12, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, cluster, stability) of every row (id, vector): its cluster, null if it is noise.

    ``above``: cosine that two points must exceed to merge; ``least``: points of
    a cluster; ``k``: neighbours of the core distance. ``levels``: distances to
    read the tree at, rising; else ``steps`` equal shares of the forest's
    distances. Null and zero vectors are noise. Vectors are of one length.
    """
    # Floats are sent as they come, which is half the bytes: tasks bring them to length 1.
    short = vectors.schema["vector"].dataType == T.ArrayType(T.FloatType(), vectors.schema["vector"].dataType.containsNull)
    keep = ["raw"] if short else []
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), *[F.col("vector").alias(c) for c in keep])
    # The length is a column of its own, as a lambda would take it anew for each number.
    rows = rows.withColumn("length", length(F.col("vector"))).select("id", normalized(F.col("vector"), F.col("length")).alias("vector"), *keep)
    rows = written(rows.withColumn("sound", F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))))
    raw = [F.min_by("raw", "id").alias("raw")] if short else []
    nodes = written(rows.filter("sound").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *raw).withColumn("grp", F.lit("")))
    sent = nodes.select("grp", "id", F.col("raw" if short else "vector").alias("vector"), "copies")
    cores = written(core_distances(dealt(sent, above, pivots, block), nodes, k, above), clean=True)
    # The vectors meet their cores before they are dealt: it is the copies that are many.
    reached = written(sent.drop("copies").join(cores, "id"))
    forest, _ = spanning_forest(written(reach_forests(dealt(reached, above, pivots, block), above), clean=True))
    if levels is None:
        # That many numbers.
        q = forest.agg(F.percentile_approx("w", [i / steps for i in range(1, steps + 1)], 10_000)).first()[0]
        levels = sorted(set(q or [1.0]))
    copies = nodes.select("id", "copies")
    points = cores.select("id")
    components = level_components(forest, points, levels)
    tree = condensed(components, copies, levels, least)
    best = chosen(tree, levels)
    first = tree.join(best.select("cluster", "birth", "stability"), ["cluster", "birth"]).filter(F.col("level") == F.col("birth"))
    parts = [first.filter(F.col("level") == i).select("comp", "cluster", "stability").join(c, "comp").select("id", "cluster", "stability") for i, c in enumerate(components)]
    member = functools.reduce(DataFrame.unionAll, parts)
    named = nodes.join(member, "id", "left").select("vector", "cluster", "stability")
    return rows.filter("sound").select("id", "vector").join(named, "vector").select("id", "cluster", "stability").unionByName(rows.filter("NOT sound").select("id"), allowMissingColumns=True)
