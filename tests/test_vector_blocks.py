"""Packed blocks against all scores."""

import numpy as np
import pytest

from chronolake.operators import vector_blocks as vb

KIND = "id long, vector array<float>"


def data(seed=1, n=600, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = (centres[rng.integers(12, size=n)] + 0.15 * rng.normal(size=(n, dims))) * rng.uniform(0.5, 2, size=(n, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(1000 + i, rows[5][1]) for i in range(6)] + [(2000, [0.0] * dims), (2001, [0.0] * dims), (2002, None), (None, rows[0][1]), (2003, [None] * dims), (2004, [float("nan")] * dims)]
    return rows


def plain(rows, q, k, floor=None):
    q = np.array(q) / np.linalg.norm(q) if np.linalg.norm(q) else np.array(q)
    out = []
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or np.isnan(x) for x in v):
            s = float(np.add.reduce(np.array(v, np.float32).astype(float) * q))
            if floor is None or s >= floor:
                out.append((-s, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize(("rows_a_block", "pivots"), [(16, 20), (7, 1), (10_000, 3)])
def test_equal_to_all_scores(spark, rows_a_block, pivots):
    rows = data()
    blocks = vb.packed(spark.createDataFrame(rows, KIND), rows_a_block, pivots).cache()
    assert blocks.agg({"n": "sum"}).first()[0] == len(rows) - 4
    rng = np.random.default_rng(2)
    queries = [rows[5][1], rows[40][1], *rng.normal(size=(4, 8)).tolist(), [0.0] * 8, [-x for x in rows[7][1]]]
    for k, floor in ((1, None), (10, None), (9, 0.4), (2000, None)):
        got = {}
        for r in vb.top_k(blocks, queries, k, floor).collect():
            got.setdefault(r["query"], []).append((r["id"], r["score"]))
        for q, v in enumerate(queries):
            mine, want = sorted(got.get(q, []), key=lambda x: (-x[1], x[0])), plain(rows, v, k, floor)
            assert [i for i, _ in mine] == [i for i, _ in want], (q, k)
            assert np.allclose([s for _, s in mine], [s for _, s in want])
    blocks.unpersist()


def test_most_blocks_are_passed_over(spark):
    rows = data(3, 4000, 8)
    blocks = vb.packed(spark.createDataFrame(rows, KIND), 32, 40).coalesce(1)
    r = vb.blocks_read(vb.scanned(blocks, np.array([rows[9][1]]), 5)).first()
    assert r["blocks"] > 100 and r["opened"] < r["blocks"] / 3


def test_other_widths_are_refused(spark):
    blocks = vb.packed(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], KIND))
    with pytest.raises(Exception, match="dimensions"):
        vb.top_k(blocks, [[1.0, 0.0, 0.0]], 1).collect()
    with pytest.raises(ValueError, match="empty"):
        vb.top_k(blocks, [[]], 1)
    assert vb.top_k(blocks, [], 3).count() == 0
    none = vb.packed(spark.createDataFrame([], KIND))
    assert vb.top_k(none, [[1.0]], 3).count() == 0


def test_queries_as_they_come(spark):
    rows = data(5)
    blocks = vb.packed(spark.createDataFrame(rows, KIND), 16, 20)
    q = [x * 3 for x in rows[9][1]]
    want = sorted((-float(np.add.reduce(np.array(v, np.float32).astype(float) * np.array(q))), i) for i, v in rows if i is not None and v is not None and not any(x is None or np.isnan(x) for x in v))
    want = [(i, -s) for s, i in want if -s >= 2.0][:30]
    got = sorted(((r["id"], r["score"]) for r in vb.top_k(blocks, [q], 30, 2.0, normalize=False).collect()), key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-13)
