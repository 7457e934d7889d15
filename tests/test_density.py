"""Density clusters against the tree by brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.operators import density


def test_spanning_forest(spark):
    rng = random.Random(1)
    edges = [(a, b, round(rng.random(), 2)) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.15 and (a < 18) == (b < 18)] + [(30, 30, 0.1)]
    forest, label = density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
    parent = list(range(31))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            weight += w
    got = [tuple(r) for r in forest.collect()]
    assert sum(w for _, _, w in got) == pytest.approx(weight) and len(got) == len({(a, b) for a, b, _ in got})
    roots = {r["id"]: r["root"] for r in label.collect()}
    nodes = {x for a, b, _ in edges for x in (a, b) if a != b}
    assert roots.keys() == nodes
    assert all((roots[x] == roots[y]) == (root(x) == root(y)) for x in nodes for y in nodes)


def plain_clusters(rows, least, k, above, levels=None):
    """ids -> members' frozenset or None, by the definition, on points held in memory."""
    ids = [i for i, v in rows if v is not None and any(v)]
    x = np.array([np.array(v) / np.linalg.norm(v) for i, v in rows if i in set(ids)])
    cos = x @ x.T
    d = np.maximum(np.sqrt(np.maximum(2 - 2 * cos, 0)), density.LEAST)
    same = (np.abs(x[:, None] - x[None]).max(axis=2) == 0)
    d[same] = density.LEAST
    d[~same & (cos <= above)] = np.inf
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    ok = np.isfinite(core)

    def parts(t):
        label = list(range(len(ids)))
        for a in range(len(ids)):
            stack = [a]
            while stack:
                u = stack.pop()
                for v in np.flatnonzero((m[u] <= t) & ok & ok[u]):
                    if label[v] != label[a] and label[v] == v and v > a:
                        label[v] = label[a]
                        stack.append(v)
        groups = {}
        for i, g in enumerate(label):
            if ok[i]:
                groups.setdefault(g, set()).add(i)
        return [frozenset(g) for g in groups.values() if len(g) >= least]

    if levels is None:
        levels = sorted({w for w in m[np.ix_(ok, ok)].ravel() if np.isfinite(w)})
    gains = {t: 1 / t - 1 / u for t, u in zip(levels, [*levels[1:], levels[-1]], strict=True)}

    def walk(comp, level):
        """(best sum, chosen) of the cluster that begins with ``comp`` at ``level``."""
        own, born, best = 0.0, comp, None
        while True:
            own += len(comp) * gains[levels[level]]
            if level == 0:
                kids = []
            else:
                kids = [c for c in parts(levels[level - 1]) if c <= comp]
            if len(kids) == 1:
                comp, level = kids[0], level - 1
                continue
            below = [walk(c, level - 1) for c in kids]
            total = sum(b for b, _ in below)
            return (own, [born]) if own >= total else (total, [c for _, chosen in below for c in chosen])

    out = {i: None for i, _ in rows}
    for top in parts(levels[-1]) if levels else []:
        for c in walk(top, len(levels) - 1)[1]:
            for p in c:
                out[ids[p]] = frozenset(ids[q] for q in c)
    return out, levels


def as_sets(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    return {i: frozenset(s) if c is not None else None for c, s in got.items() for i in s}


def blobs(seed, n=70):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 5))
    rows = [(i, (centres[i % 4] + (0.05, 0.1, 0.3, 0.3)[i % 4] * rng.normal(size=5)).tolist()) for i in range(n - 15)]
    rows += [(100 + i, rng.normal(size=5).tolist()) for i in range(8)]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(300, None), (301, [0.0] * 5)]
    return rows


@pytest.mark.parametrize(("seed", "least", "k", "above", "pivots", "block"), [(1, 5, 3, 0.3, 9, 1024), (2, 4, 2, 0.6, 3, 16)])
def test_clusters_equal_the_tree(spark, seed, least, k, above, pivots, block):
    rows = blobs(seed)
    want, weights = plain_clusters(rows, least, k, above)
    # A dozen levels of the tree's own distances; both sides read it there.
    levels = weights[:: max(1, len(weights) // 8)] + [weights[-1]]
    want, _ = plain_clusters(rows, least, k, above, sorted({t * (1 + 1e-9) for t in levels}))
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = as_sets(density.clusters(df, least, k, above, sorted({t * (1 + 1e-9) for t in levels}), pivots=pivots, block=block))
    assert got == want and len({s for s in got.values() if s}) > 1


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    assert as_sets(density.clusters(df)) == {1: None, 2: None}
    assert density.clusters(df.limit(0)).count() == 0


def test_dense_groups_keep_their_forest_small(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 3)) + [2.0, 0, 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    core = rng.uniform(0, 0.05, size=len(x))
    df = spark.createDataFrame([("", i, v, c) for i, (v, c) in enumerate(zip(x.tolist(), core.tolist(), strict=True))], "grp string, id long, vector array<double>, core double")
    # No more copies than there are blocks, however wide the reach.
    assert density.dealt(df, 0.1, 50, 1000).count() <= 3 * len(x)
    d = np.maximum(np.maximum(core[:, None], core[None]), density._distance(x @ x.T))
    d[x @ x.T <= 0.1] = np.inf
    far, done, weight = d[0].copy(), np.zeros(len(x), bool), 0.0
    done[0] = True
    for _ in range(len(x) - 1):
        i = int(np.where(done, np.inf, far).argmin())
        weight, done[i] = weight + far[i], True
        far = np.minimum(far, d[i])
    for block in (10_000, 1000):
        edges = density.reach_forests(density.dealt(df, 0.1, 50, block), 0.1)
        forest, _ = density.spanning_forest(edges)
        got = forest.collect()
        assert len(got) == len(x) - 1 and sum(r["w"] for r in got) == pytest.approx(weight)
    nodes = df.withColumn("copies", F.lit(1).cast("long"))
    want = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, density._distance(x @ x.T)), axis=1)[:, 3]
    got = {r["id"]: r["core"] for r in density.core_distances(density.dealt(nodes, 0.1, 50, 1000), nodes, 4, 0.1).collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want)


def test_pairs_of_blocks_are_dealt_over_tasks(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("", i, v) for i, v in enumerate((rng.normal(size=(3000, 4)) + [2.0, 0, 0, 0]).tolist())], "grp string, id long, vector array<double>")

    def where(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        return pa.table({"low": t.column("low")[:1], "high": t.column("high")[:1], "task": pa.array([TaskContext.get().partitionId()])})

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # Joins by exchange, as where sizes are not known before they run.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = density.dealt(df, 0.1, 50, 500).groupBy(*density.GROUP).applyInArrow(where, "low int, high int, task long").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 21 and len({r["task"] for r in rows}) >= 7


def test_few_pairs_of_a_group_are_compared_exactly():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, sides, k, above = x.astype(np.float32), [(np.arange(1700), np.arange(1700)), (np.arange(1700), np.arange(1700, 3000))], 3, 0.3
    asked = np.zeros((3000, 3000), bool)
    asked[:1700] = True
    asked |= asked.T
    asked[1700:, 1700:] = False
    c = np.where(asked & ~np.eye(3000, dtype=bool), x @ x.T, -np.inf)
    bound = density._first_bounds(small, sides, k, above)
    kth = np.sort(c, axis=1)[:, -k]
    assert (bound <= np.maximum(kth, above)).all()
    u, v, got = (np.concatenate(z) for z in zip(*density._in_steps(density._close(small, sides, bound), x, above), strict=True))
    found = set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
    want = {(min(i, j), max(i, j)) for i, j in np.argwhere(c > np.maximum(above, np.minimum(kth[:, None], kth[None]) - 1e-12)).tolist()}
    assert want <= found and len(found) == len(u) < asked.sum() / 20
    assert np.allclose(got, c[u, v], atol=1e-12)


def test_few_edges_in_one_task_are_the_same_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), round(float(w), 1)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.random(150), strict=True)]
    df = spark.createDataFrame(edges + [(100, 101, 0.5)], "a long, b long, w double")
    got = []
    for few in (0, 40, 1000):
        monkeypatch.setattr(density, "FEW", few)
        forest, label = density.spanning_forest(df)
        got.append((sorted(map(tuple, forest.collect())), sorted(map(tuple, label.collect()))))
    assert got[0] == got[1] == got[2] and len(got[0][1]) > 50
