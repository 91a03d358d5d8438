"""Many weighted logistic fits on one table, each step of all of them in one scan.

A fit is a column of weights (zero: not its row) and a target. Medians come from weights summed by value, moments
and Newton steps from sums that a task adds up before they are shuffled: what is shuffled, and what the driver
gets, is a gradient and a cross-product a fit, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.positions import running_sums
from ..functions.scratch import written


@dataclass
class FoldFits:
    """For each fit: medians, means and deviations of values and missing-indicators, the intercept and the coefficients."""

    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def design(self, x: np.ndarray, m: int) -> np.ndarray:
        lost = ~np.isfinite(x)
        z = (np.c_[np.where(lost, self.median[m], x), lost] - self.mean[m]) / self.scale[m]
        return np.c_[np.ones(len(z)), z]

    def score(self, features: Column, fit: Column) -> Column:
        """The probability by the fit of each row's number; null where that is null."""
        fits = self

        @F.pandas_udf("double")
        def scored(column: pd.Series, number: pd.Series) -> pd.Series:
            x = np.array(column.tolist(), float).reshape(len(column), -1)
            out = np.full(len(x), np.nan)
            which = number.to_numpy(float, na_value=np.nan)
            for m in np.unique(which[np.isfinite(which)]).astype(int):
                own = which == m
                out[own] = _sigmoid(fits.design(x[own], m) @ fits.beta[m])
            return pd.Series(out).where(np.isfinite(out), None)

        return scored(features, fit)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _summed(table: DataFrame, n_x: int, targets: list[str], fits: list[int], length: int, of_fit: Callable[..., np.ndarray]) -> np.ndarray:
    """For each of ``fits`` the sum over batches of ``of_fit(m, x, target, weights)`` on its own rows, as rows of ``length`` numbers."""
    n_fits = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), length))
        for batch in batches:
            if not len(batch):
                continue
            x, w = _matrix(batch.column("x"), n_x), _matrix(batch.column("w"), n_fits)
            for k, m in enumerate(fits):
                own = np.flatnonzero(w[:, m] > 0)
                if len(own):
                    target = batch.column(targets[m]).to_numpy(zero_copy_only=False)[own].astype(float)
                    total[k] += of_fit(m, x[own], target, w[own, m])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": group["k"].iloc[:1].to_numpy(), "sums": [np.sum(np.stack(group["sums"].tolist()), axis=0)]})

    parts = table.mapInArrow(run, "k int, sums array<double>").groupBy("k").applyInPandas(add, "k int, sums array<double>")
    out = np.zeros((len(fits), length))
    for r in parts.collect():
        out[r["k"]] = r["sums"]
    return out


def fold_medians(table: DataFrame, n_x: int, n_fits: int) -> np.ndarray:
    """Each fit's weighted medians; 0 where a feature has no value."""
    long = table.select("w", F.posexplode("x").alias("feature", "value"))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    steps = long.where(finite).groupBy("feature", "value").agg(*[F.sum(F.col("w")[m]).alias(f"w{m}") for m in range(n_fits)])
    steps = written(steps, "steps")
    totals = steps.groupBy("feature").agg(*[F.sum(f"w{m}").alias(f"t{m}") for m in range(n_fits)])
    reached = running_sums(steps, ["feature"], "value", {f"c{m}": f"w{m}" for m in range(n_fits)}).join(totals, "feature")
    half = [F.min(F.when((F.col(f"t{m}") > 0) & (F.col(f"c{m}") >= F.col(f"t{m}") / 2), F.col("value"))).alias(f"m{m}") for m in range(n_fits)]
    out = np.zeros((n_fits, n_x))
    for r in reached.groupBy("feature").agg(*half).collect():
        out[:, r["feature"]] = [r[f"m{m}"] or 0.0 for m in range(n_fits)]
    return out


def fit_all(table: DataFrame, n_x: int, targets: list[str], what: list[str], tolerance: float = 1e-8, max_steps: int = 60) -> FoldFits:
    """Ridge-penalized (with factor 1) logistic fits of ``table(x array, w array, and the columns of targets)``.

    ``targets[m]`` is fit m's column, ``w[m]`` its weights. Weights count as they are, so a fit whose weights average 1
    is penalized as one of that many rows. A fit without both classes is an error that names ``what[m]``.
    Newton's steps are halved while they make a fit worse. Scans: one for medians, one for moments, and one a
    step, of all fits that haven't settled.
    """
    n_fits, p = len(targets), 2 * n_x + 1
    median = fold_medians(table, n_x, n_fits)

    def moments(m: int, x: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
        lost = ~np.isfinite(x)
        off = np.c_[np.where(lost, 0.0, x - median[m]), lost]
        return np.r_[w.sum(), w @ target, w @ off, w @ (off * off)]

    sums = _summed(table, n_x, targets, list(range(n_fits)), 2 + 4 * n_x, moments)
    stuck = [what[m] for m in range(n_fits) if not 0 < sums[m, 1] < sums[m, 0]]
    if stuck:
        raise ValueError(f"not both classes to fit: {', '.join(stuck[:5])}")
    first = sums[:, 2 : 2 + 2 * n_x] / sums[:, :1]
    spread = np.sqrt(np.maximum(sums[:, 2 + 2 * n_x :] / sums[:, :1] - first**2, 0.0))
    # What rounding leaves of a constant's deviation isn't one.
    constant = spread <= 1e-9 * (1 + np.abs(first))
    fits = FoldFits(median, first + np.c_[median, np.zeros((n_fits, n_x))], np.where(constant, 1.0, spread), np.zeros((n_fits, p)))

    best, step, loss = fits.beta.copy(), np.zeros((n_fits, p)), np.full(n_fits, np.inf)
    open_ = list(range(n_fits))
    ridge = np.r_[0.0, np.ones(p - 1)]

    for _ in range(max_steps):
        trial = fits.beta

        def newton(m: int, x: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
            z = fits.design(x, m)
            eta = z @ trial[m]
            q = _sigmoid(eta)
            return np.r_[w @ (np.logaddexp(0.0, eta) - target * eta), z.T @ (w * (q - target)), ((z.T * (w * q * (1 - q))) @ z).ravel()]

        for m, s in zip(open_, _summed(table, n_x, targets, open_, 1 + p + p * p, newton)):
            now = s[0] + 0.5 * (ridge * trial[m]) @ trial[m]
            if now > loss[m] + 1e-10 * (1 + abs(loss[m])):
                step[m] /= 2
            else:
                best[m], loss[m] = trial[m], now
                step[m] = -np.linalg.solve(s[1 + p :].reshape(p, p) + np.diag(ridge) + 1e-12 * np.eye(p), s[1 : 1 + p] + ridge * trial[m])
        open_ = [m for m in open_ if np.abs(step[m]).max() > tolerance]
        fits.beta = best + step
        if not open_:
            return fits
    raise RuntimeError(f"logistic fits did not settle: {[what[m] for m in open_][:5]}")
