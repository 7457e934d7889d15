"""Exact pairs by cells, and loops in order as rounds."""

import random

import numpy as np
import pytest

from chronolake.operators import similarity as si


def vectors(rng, n, dims=6, groups=2, spread=0.25):
    centres = rng.normal(size=(5, dims))
    return [(f"g{i % groups}", i, (centres[rng.integers(5)] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def plain_pairs(rows, above):
    out = {}
    x = {i: np.array(v) / np.linalg.norm(v) for _, i, v in rows}
    for g, i, _ in rows:
        for h, j, _ in rows:
            if g == h and i < j and (c := float(x[i] @ x[j])) > above:
                out[i, j] = c
    return out


@pytest.mark.parametrize(("above", "pivots", "block"), [(0.95, 40, 1024), (0.8, 7, 16), (0.0, 3, 1024), (0.999, 1, 10)])
def test_all_pairs_once(spark, above, pivots, block):
    rows = vectors(np.random.default_rng(3), 300)
    df = spark.createDataFrame(rows, "grp string, id long, vector array<double>")
    got = [tuple(r) for r in si.near_pairs(df, above, pivots, block).select("a", "b", "cos").collect()]
    want = plain_pairs(rows, above)
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} == set(want)
    assert all(c == pytest.approx(want[a, b]) for a, b, c in got)


def test_no_rows_no_pairs(spark):
    df = spark.createDataFrame([], "grp string, id long, vector array<double>")
    assert si.near_pairs(df, 0.9).count() == 0
    with pytest.raises(ValueError):
        si.near_pairs(df, -1.0)


def plain_first_come(nodes, edges):
    kept = set()
    for i in sorted(nodes):
        if not any((a == i and b in kept) or (b == i and a in kept) for a, b in edges):
            kept.add(i)
    return kept


def test_first_come_equals_the_loop(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(12)]
    star = [(20, 20 + k) for k in range(1, 6)]
    crown = [(30 + k, 40) for k in range(5)] + [(30, 31)]
    noise = [(a, b) for a, b in ((rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(70)) if a < b]
    edges = chain + star + crown + noise
    nodes = set(range(95))
    got = si.first_come(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(r[0] for r in got.collect()) == sorted(plain_first_come(nodes, edges))


def turned(angle, dims=4):
    return [float(np.cos(angle)), float(np.sin(angle))] + [0.0] * (dims - 2)


def plain_learned(existing, candidates, above):
    have = [(c, s, p.strip().lower(), np.array(v)) for _, c, s, p, v in existing]
    out = []
    for i, c, s, p, v in sorted(candidates):
        v = np.array(v)
        n = np.linalg.norm(v)
        v = v / n if n else v
        p = p.strip().lower()
        if not any((c, s, p) == x[:3] and float(x[3] @ v) / max(np.linalg.norm(x[3]), 1e-300) > above for x in have):
            have.append((c, s, p, v))
            out.append(i)
    return out


def test_learning_equals_the_loop_on_chains(spark):
    step = 0.2  # cos(0.2) = 0.98, cos(0.4) = 0.92: neighbours are duplicates, every second one is not
    existing = [(0, "a", "global", "", turned(-0.1)), (1, "a", "global", "", turned(-0.15)), (2, "b", "local", "P1 ", turned(0))]
    rows = [(10 + k, "a", "global", "", turned(step * k)) for k in range(15)]
    rows += [(40 + k, "b", "local", ("p1", "p2")[k % 2], turned(0.05 * k)) for k in range(20)]
    rows += [(70, "c", "global", "", turned(1.0)), (71, "c", "global", "", [2 * x for x in turned(1.0)]), (72, "c", "global", "", turned(1.0)), (73, "c", "local", "p1", turned(1.0)), (74, "c", "global", "", [0.0] * 4), (75, "c", "global", "", [0.0] * 4)]
    rng = np.random.default_rng(4)
    rows += [(100 + k, "d", "global", "", (turned(0.4)[0] + 0.3 * rng.normal(size=4)).tolist()) for k in range(40)]
    cols = "id long, category string, scope string, process_name string, vector array<double>"
    got = si.learned_anchors(spark.createDataFrame(existing, cols), spark.createDataFrame(rows, cols))
    assert sorted(r["id"] for r in got.collect()) == plain_learned(existing, rows, si.DUPLICATE)


def test_candidates_by_the_rule(spark):
    cols = "seq long, category string, title string, clean_title string, informative boolean, ocr_text string, process_name string, title_vector array<double>, clean_vector array<double>, ocr_vector array<double>"
    long = "x" * 20
    rows = [(1, "a", "t", "c", True, long, " P ", [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), (2, "a", "t", "c", False, long, "p", [1.0, 0.0], [1.0, 0.0], [1.0, 0.1]),
            (3, "a", " ", "c", True, long, "p", [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), (4, "a", "t", "c", True, long, None, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]),
            (5, "a", "t", "c", None, "short", "p", [1.0, 0.0], [1.0, 0.0], [0.0, 1.0])]
    got = sorted((r["id"], r["scope"], r["process_name"], r["source"], r["weight"]) for r in si.anchor_candidates(spark.createDataFrame(rows, cols)).collect())
    u, o = ("user_feedback", 2.0), ("ocr_feedback", 1.5)
    assert got == [(3, "local", "p", *u), (4, "global", "", *u), (5, "local", "p", *o), (6, "local", "p", *u), (13, "global", "", *u), (15, "local", "p", *u)]


def test_learning_query_equals_the_loop(spark):
    from chronolake.plans.catalog import QUERIES
    from chronolake.plans.vectors import feedback, stated
    from chronolake.sources.roles import Roles

    r = Roles(spark, "/root/testdata/sf0.001")
    old = [(-1, str(x["label"]), "global", "", list(x["vector"])) for x in stated(r).collect()]
    asked = [(x["id"], x["category"], x["scope"], x["process_name"], list(x["vector"])) for x in si.anchor_candidates(feedback(r)).collect()]
    got = sorted(x["id"] for x in QUERIES["clu8_anchor_learning"](spark, r.path).collect())
    assert got == plain_learned(old, asked, si.DUPLICATE) and len(got) < len(asked)


def test_wide_bounds_send_few_copies(spark):
    rng = np.random.default_rng(6)
    rows = [("g", i, rng.normal(size=16).tolist()) for i in range(600)] + [(None, 1000 + i, [1.0] * 15 + [i / 10]) for i in range(4)]
    df = spark.createDataFrame(rows, "grp string, id long, vector array<double>")
    # Every pair may be within the bound: rows that visited cells went to most of them.
    assert si.dealt(df, 0.3, 100).count() == len(rows)
    assert si.dealt(df, 0.3, 100, 100).count() <= 7 * len(rows)
    want = plain_pairs(rows[:600], 0.3) | plain_pairs(rows[600:], 0.3)
    assert {(r["a"], r["b"]) for r in si.near_pairs(df, 0.3, 100, 100).collect()} == set(want)


def test_semantic_duplicates_by_brute_force(spark):
    from chronolake.operators.ledger import semantic_duplicates

    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 5))
    rows = [(i, "ab"[i % 2], i % 3, (base[rng.integers(6)] + 0.2 * rng.normal(size=5)).tolist()) for i in range(120)]
    rows += [(200, "a", 0, [1.0, 0.0]), (201, "a", 0, [1.0, 0.01]), (202, "a", 0, [0.0] * 5), (203, "a", 0, None), (204, None, 0, rows[0][3]), (205, "a", 0, rows[0][3])]
    known = [r for r in rows if r[0] % 4 == 0 or r[0] == 201] + [(300, "b", 1, rows[1][3])]
    cols = "id long, category string, scope int, vector array<double>"
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if a and b and len(a) == len(b) and any(a) and any(b) else -1.0
    want = {r[0]: any(r[1] and r[1:3] == k[1:3] and r[0] != k[0] and cos(r[3], k[3]) > 0.95 for k in known) for r in rows}
    got = {r["id"]: r["duplicate"] for r in semantic_duplicates(spark.createDataFrame(rows, cols), spark.createDataFrame(known, cols)).collect()}
    assert got == want and 5 < sum(want.values()) < 120 and want[200] and want[1]
