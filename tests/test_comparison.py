"""Exact quantiles by counts."""

import numpy as np

from chronolake.operators.comparison import quantiles


def test_quantiles_by_counts(spark):
    rng = np.random.default_rng(1)
    groups = {("a", 1): rng.normal(size=501) * 10.0 ** rng.integers(-5, 6, 501), ("a", 2): rng.integers(-3, 4, 200).astype(float), ("b", 1): np.array([2.5]), (None, 1): np.array([-0.0, 0.0, 1e300, -1e300])}
    rows = [(*k, float(x)) for k, xs in groups.items() for x in xs] + [("a", 2, None), ("c", 1, None)]
    out = quantiles(spark.createDataFrame(rows, "g string, h int, x double"), ["g", "h"], "x", [0.0, 0.5, 0.95])
    got = {(r["g"], r["h"]): r for r in out.collect()}
    assert got.keys() == groups.keys() | {("c", 1)} and got["c", 1]["q1"] is None and got["a", 2]["n"] == 201
    for k, xs in groups.items():
        assert np.allclose([got[k][c] for c in ("most", "q0", "q1", "q2")], [xs.max(), *np.quantile(xs, [0, 0.5, 0.95])], rtol=1e-12)
    # No buffer that holds all values of a group.
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
