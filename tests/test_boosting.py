"""Boosted trees against a version that looks at all rows for each split of each leaf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import boosting as B, model


def _gain(g, h, rows, p):
    return g[rows].sum() ** 2 / (h[rows].sum() + p.l2)


def _plain(x, y, w, p):
    """Scores (log-odds) of the rows, and for each tree its splits in the order of opening, as (feature, rows left, rows right)."""
    f = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    trees = []
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = w * (q - y), w * q * (1 - q)

        def best(rows):
            found = None
            for j in range(x.shape[1]):
                given = rows[np.isfinite(x[rows, j])]
                lost = rows[~np.isfinite(x[rows, j])]
                for missing_left in (False, True) if len(lost) else (False,):
                    for value in np.unique(x[given, j]):
                        left = given[x[given, j] <= value]
                        left = np.r_[left, lost] if missing_left else left
                        right = np.setdiff1d(rows, left)
                        if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                            continue
                        gain = _gain(g, h, left, p) + _gain(g, h, right, p) - _gain(g, h, rows, p)
                        if gain > 0 and (found is None or gain > found[0] + 1e-12):
                            found = (gain, j, left, right)
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        splits = []
        while len(leaves) < p.leaves and any(s for _, s in leaves):
            at = max((i for i, (_, s) in enumerate(leaves) if s), key=lambda i: leaves[i][1][0])
            _, j, left, right = leaves[at][1]
            splits.append((j, len(left), len(right)))
            leaves[at : at + 1] = [(left, best(left)), (right, best(right))]
        for rows, _ in leaves:
            f[rows] += -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
        trees.append(splits)
    return f, trees


def _table(spark, x, y, w):
    rows = [([None if np.isnan(v) else float(v) for v in r], float(a), float(b), i) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "features array<double>, y double, weight double, i int").repartition(3)


def _data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.normal(size=n)]
    y = (x[:, 0] * (x[:, 1] - 1.5) + 0.5 * (x[:, 2] > 0) + 0.3 * rng.normal(size=n) > 0).astype(float)
    x[rng.random(n) < 0.15, 0] = np.nan
    return x, y, rng.uniform(0.2, 2.0, n)


def test_equals_plain(spark):
    x, y, w = _data(220, 1)
    p = B.BoostParams(rounds=4, leaves=6, min_rows=8, rate=0.3, rewrite=2)
    fitted = B.fit_boosted(_table(spark, x, y, w), p=p)
    want, trees = _plain(x, y, w, p)
    assert np.allclose(fitted.raw(fitted.bin(x)), want, atol=1e-9)
    for tree, splits in zip(fitted.trees, trees):
        assert sorted(tree.feature[tree.feature >= 0]) == sorted(j for j, *_ in splits) and (tree.feature < 0).sum() == len(splits) + 1
    got = {r["i"]: r["p"] for r in fitted.score(_table(spark, x, y, w), "p").collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-want)))


def test_few_bins_follow_weights(spark):
    x = np.arange(1000.0)[:, None]
    w = np.where(x[:, 0] < 500, 9.0, 1.0)
    edges = B.bin_edges(_table(spark, x, w * 0, w), "features", "weight", 1, B.BoostParams(bins=10))[0]
    assert len(edges) == 9 and (edges < 500).sum() >= 8
    mass = [w[(x[:, 0] > a) & (x[:, 0] <= b)].sum() for a, b in zip([-1, *edges], [*edges, 1e9])]
    assert max(mass) <= 1.05 * w.sum() / 10 + 9


def test_model_learns_and_edges(spark):
    x, y, w = _data(600, 2)
    fitted = B.fit_boosted(_table(spark, x, y, w), p=B.BoostParams(rounds=12, rate=0.2, bins=32))
    assert all((t.feature < 0).sum() <= 15 for t in fitted.trees)
    q = 1 / (1 + np.exp(-fitted.raw(fitted.bin(x))))
    assert ((q > 0.5) == y).mean() > 0.85
    # Too few rows for any split: every tree is a leaf and the score is the share of ones.
    small = B.fit_boosted(_table(spark, x[:12], y[:12], np.ones(12)), p=B.BoostParams(rounds=2))
    assert np.allclose(1 / (1 + np.exp(-small.raw(small.bin(x)))), y[:12].mean(), atol=1e-9)
    with pytest.raises(ValueError, match="both classes"):
        B.fit_boosted(_table(spark, x, np.ones(600), w))


def test_in_the_model_path(spark, monkeypatch):
    assert B.BoostParams() == B.BoostParams(rounds=250, leaves=15, rate=0.05, l2=1.0, min_rows=10)
    monkeypatch.setattr(model, "BOOSTING", B.BoostParams(rounds=20))
    x, y, w = _data(200, 3)
    rows = [(float(a) if np.isfinite(a) else None, float(b), float(t), float(v)) for (a, b, _), t, v in zip(x, y, w)]
    df = spark.createDataFrame(rows, "a double, b double, y double, weight double")
    scored = model._fit(df, ["a", "b"], "boosted_trees").score(df, "score")
    assert "features" not in scored.columns
    got = scored.groupBy("y").agg(F.avg("score").alias("s")).collect()
    s = {r["y"]: r["s"] for r in got}
    assert s[1.0] > s[0.0] + 0.1
