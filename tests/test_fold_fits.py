"""All folds' fits in one scan against single fits and plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import fold_fits, model

from test_model_path import _candidates


def _plain_fit(x, y, w):
    """``(median, mean, scale, beta)`` of one ridge-penalized fit."""
    med = []
    for column in x.T:
        ok = np.isfinite(column)
        order = np.argsort(column[ok], kind="stable")
        c = np.cumsum(w[ok][order])
        med.append(column[ok][order][np.searchsorted(c, c[-1] / 2)] if ok.any() else 0.0)
    lost = ~np.isfinite(x)
    z = np.c_[np.where(lost, med, x), lost]
    mean = w @ z / w.sum()
    scale = np.sqrt(w @ (z - mean) ** 2 / w.sum())
    scale[scale < 1e-12] = 1
    d = np.c_[np.ones(len(z)), (z - mean) / scale]
    b, ridge = np.zeros(d.shape[1]), np.r_[0, np.ones(d.shape[1] - 1)]
    for _ in range(60):
        q = 1 / (1 + np.exp(-d @ b))
        b -= np.linalg.solve((d.T * (w * q * (1 - q))) @ d + np.diag(ridge) + 1e-12 * np.eye(len(b)), d.T @ (w * (q - y)) + ridge * b)
    return np.array(med), mean, scale, b


def test_fits_equal_plain(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = np.c_[rng.normal(size=n) * 50 + 1000, rng.integers(0, 3, n), np.full(n, 7.0), rng.exponential(size=n)]
    x[rng.random(n) < 0.2, 0] = np.nan
    x[:, 3][rng.random(n) < 0.1] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 1] - 1)))).astype(float)
    t = rng.integers(0, 2, n).astype(float)
    w = np.c_[rng.uniform(0, 2, n), (rng.random(n) < 0.5) * 1.0, np.where(np.arange(n) < 40, 3.0, 0.0)]
    targets = ["y", "t", "y"]
    rows = [([float(v) for v in a], [float(v) for v in b], float(c), float(d)) for a, b, c, d in zip(x, w, y, t)]
    df = spark.createDataFrame(rows, "x array<double>, w array<double>, y double, t double").repartition(3)
    got = fold_fits.fit_all(df, 4, targets, ["a", "b", "c"])
    for m, target in enumerate((y, t, y)):
        own = w[:, m] > 0
        med, mean, scale, beta = _plain_fit(x[own], target[own], w[own, m])
        assert np.allclose(got.median[m], med) and np.allclose(got.mean[m], mean) and np.allclose(got.scale[m], scale) and np.allclose(got.beta[m], beta, atol=1e-6)
    with pytest.raises(ValueError, match="only ones"):
        fold_fits.fit_all(df.where("y = 1"), 4, targets, ["only ones", "b", "c"])


def test_out_of_fold_equals_single_fits(spark):
    df = _candidates(spark, 160).withColumn("z", F.when(F.col("x") > 0.3, F.col("x") * F.col("x")))
    scored, notes = model.out_of_fold(df, ["x", "z"], n_splits=3)
    rows = scored.toPandas()
    assert sorted(scored.columns) == sorted([*df.columns, "group_used", "fold", "y", "tested", "score", "ipw_score"])
    each = []
    for f in sorted(rows["fold"].unique()):
        train = spark.createDataFrame(rows[rows["fold"] != f].drop(columns=["score", "ipw_score"]).astype({"tested": "Int64"}).astype(object).where(lambda d: d.notna(), None), scored.drop("score", "ipw_score").schema)
        test = spark.createDataFrame(rows[rows["fold"] == f][["gene_symbol", "x", "z"]].astype(object).where(lambda d: d.notna(), None), "gene_symbol string, x double, z double")
        fitted, _ = model.fit_success(train, ["x", "z"], "logistic", "group_used", False)
        weighted, stats = model.fit_success(model.fit_propensity(train, ["x", "z"], "group_used"), ["x", "z"], "logistic", "group_used", True)
        each.append(stats)
        one = {r["gene_symbol"]: (r["score"], r["ipw"]) for r in weighted.score(fitted.score(test, "score"), "ipw").collect()}
        for r in rows[rows["fold"] == f].itertuples():
            assert (r.score, r.ipw_score) == pytest.approx(one[r.gene_symbol], abs=2e-4)
    for k in each[0]:
        assert notes[f"ipw_mean_{k}"] == pytest.approx(np.mean([s[k] for s in each]), abs=1e-3)


def test_two_groups_have_no_weighted_scores(spark):
    df = _candidates(spark, 80, groups=4)
    scored, notes = model.out_of_fold(df, ["x"], n_splits=2)
    assert notes == {} and scored.where("score is null").count() == 0 and scored.where("ipw_score is not null").count() == 0


def test_inner_folds():
    row = lambda g, fold, n, ones: {"g": g, "fold": fold, "n": n, "ones": ones}
    counts = [row("a", 0, 9, 4), row("b", 1, 8, 4), row("c", 1, 5, 2), row("d", 0, 3, 1)]
    inner, parts = model._inner_folds(counts, [0, 1], 2)
    assert parts == {0: 2, 1: 2} and inner == {"a": [-1, 0], "b": [0, -1], "c": [1, -1], "d": [-1, 1]}
    with pytest.raises(ValueError, match="both classes"):
        model._inner_folds([row("a", 0, 5, 5), row("b", 0, 4, 0), row("c", 1, 2, 1)], [1], 5)
    assert model._inner_folds([row("a", 0, 5, 5), row("b", 0, 4, 4), row("c", 1, 2, 1), row("d", 1, 2, 1)], [1], 5)[1] == {0: 0}
