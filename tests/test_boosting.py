"""Boosting: trees by hand, the grid's choice by validation rank correlation, the refit for test rows."""

import numpy as np

from signalpanel.operators import models as M


def test_one_stump():
    x, y = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([0.0, 0.0, 10.0, 10.0])
    # mean 5, gradients 5, 5, -5, -5: leaves -10 / (2 + 1) and 10 / (2 + 1) times the rate
    got = M.boosted_trees(x, y, [np.array([[0.0], [2.5], [3.0], [9.0]])], 1, 1, 0.3)[0]
    np.testing.assert_allclose(got, [4.0, 4.0, 6.0, 6.0])


def test_grid_and_refit(spark):
    rng = np.random.default_rng(5)
    n = 240
    x = rng.random((n, 2))
    y = np.where(x[:, 0] > 0.5, x[:, 1], -x[:, 1]) + rng.normal(0, 0.3, n)
    role = np.repeat(["train", "validation", "test"], [120, 60, 60])
    df = spark.createDataFrame([("s", i, str(role[i]), float(y[i]), [float(v) for v in x[i]]) for i in range(n)], "split_id string, doc_id long, role string, y double, x array<double>")
    got = {r.doc_id: r for r in M.boosting(df, ["split_id"]).collect()}
    assert set(got) == set(range(120, n))
    tr, va, te = (role == r for r in ("train", "validation", "test"))
    fits = [M.boosted_trees(x[tr], y[tr], [x[va]], *p)[0] for p in M.TREES]
    k = int(np.argmax([M._rank_ic(y[va], f) for f in fits]))
    assert {(r.trees, r.depth, r.rate) for r in got.values()} == {M.TREES[k]}
    np.testing.assert_allclose([got[i].yhat for i in np.flatnonzero(va)], fits[k])
    np.testing.assert_allclose([got[i].yhat for i in np.flatnonzero(te)], M.boosted_trees(x[tr | va], y[tr | va], [x[te]], *M.TREES[k])[0])
    assert not np.allclose([got[i].yhat for i in np.flatnonzero(te)], M.boosted_trees(x[tr], y[tr], [x[te]], *M.TREES[k])[0])
