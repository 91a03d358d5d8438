"""Intervals of ranking metrics over clusters drawn with replacement.

No table of draws exists: how often each draw holds a cluster follows from a seed and the
cluster's number, so each task finds it for the clusters that it meets. Rows are never multiplied by draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.positions import places
from ..functions.scratch import written
from .evaluation import KS, named_means, per_query_metrics, query_metrics

_ROWS = 512  # rows weighed in one step: with 1000 draws, 4 MB of counts
_KEPT = 32 << 20  # bytes of counts that a task keeps


def times_held(wanted: np.ndarray, clusters: int, draws: int, seed: tuple[int, ...]) -> np.ndarray:
    """How often each draw holds each cluster of ``wanted`` (ascending numbers below ``clusters``): a row a cluster, a column a draw.

    A draw takes ``clusters`` clusters with replacement, so counts are multinomial. Numbers are halved again and again; what
    falls to the lower half is binomial, from a generator seeded with the range, hence the same wherever it is asked for.
    """
    out = np.zeros((len(wanted), draws), np.int32)
    todo = [(0, clusters, 0, len(wanted), np.full(draws, clusters))]
    while todo:
        lo, hi, a, b, counts = todo.pop()
        if a == b:
            continue
        if hi - lo == 1:
            out[a:b] = counts
            continue
        middle = (lo + hi) // 2
        lower = np.random.default_rng((*seed, lo, hi)).binomial(counts, (middle - lo) / (hi - lo))
        split = a + int(np.searchsorted(wanted[a:b], middle))
        todo += [(lo, middle, a, split, lower), (middle, hi, split, b, counts - lower)]
    return out


@dataclass(frozen=True)
class Draws:
    """Draws in use: ``used[r]`` are places among the ``size`` attempts of round r."""

    clusters: int
    size: int
    seed: int
    used: dict[int, list[int]]

    def __len__(self) -> int:
        return sum(len(u) for u in self.used.values())

    def times(self, wanted: np.ndarray) -> np.ndarray:
        return np.concatenate([times_held(wanted, self.clusters, self.size, (self.seed, r))[:, u] for r, u in self.used.items()], axis=1)


class _Times:
    """Counts of the clusters that a task met, with a bound on how many it keeps."""

    def __init__(self, draws: Draws):
        self.draws, self.rows = draws, {}
        self.most = max(_ROWS, _KEPT // (4 * max(1, len(draws))))

    def of(self, clusters: np.ndarray) -> np.ndarray:
        wanted, at = np.unique(clusters, return_inverse=True)
        new = [c for c in wanted if c not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows, new = {}, list(wanted)
        if new:
            self.rows.update(zip(new, self.draws.times(np.array(new)), strict=True))
        return np.stack([self.rows[c] for c in wanted])[at]


def summed_by_draw(df: DataFrame, key: str, values: list[str], draws: Draws) -> DataFrame:
    """``(key, draw, *values)``: per draw, sums of the values weighed by how often the draw holds the row's ``cluster``.

    A task gives a row for each of its keys and draws; keys are few (metrics or ranges).
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, sums = _Times(draws), {}
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.iloc[i : i + _ROWS]
                held, numbers, keys = times.of(part["cluster"].to_numpy()), part[values].to_numpy(float), part[key].to_numpy()
                for k in np.unique(keys):
                    own = keys == k
                    sums[k] = sums.get(k, 0.0) + numbers[own].T @ held[own]
        for k, found in sums.items():
            yield pd.DataFrame({key: k, "draw": np.arange(len(draws), dtype=np.int32), **dict(zip(values, found, strict=True))})

    schema = ", ".join([f"{key} {kind}", "draw int", *[f"{v} double" for v in values]])
    parts = df.select(key, "cluster", *[F.col(v).cast("double").alias(v) for v in values]).mapInPandas(run, schema)
    return parts.groupBy(key, "draw").agg(*[F.sum(v).alias(v) for v in values])


def average_precision_by_draw(steps: DataFrame, draws: Draws) -> DataFrame:
    """``(draw, value)``: average precision of each draw, from ``(score, cluster, tp, n)``, null where a draw has no success.

    Scores are cut into ranges, best first. What lies before a range is summed up per draw, then each range is
    run through once from there, in slices; equal scores are one place.
    """
    down = F.col("score").desc()
    ranged = written(steps.repartitionByRange(down).sortWithinPartitions(down).withColumn("cell", F.spark_partition_id()), "ranged")
    cells = written(summed_by_draw(ranged, "cell", ["tp", "n"], draws), "cells")
    before = W.partitionBy("draw").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("cell", F.struct("draw", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("tp", "n")]).alias("s"))
    starts = starts.groupBy("cell").agg(F.array_sort(F.collect_list("s")).alias("s")).select("cell", F.col("s.tp").alias("tp0"), F.col("s.n").alias("n0"))
    # A range's start stands before its rows.
    both = ranged.unionByName(starts, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", F.col("tp0").isNull(), down)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(draws)
        times, gained = _Times(draws), np.zeros(size)
        passed = open_ = np.zeros((2, size))  # successes and rows: of closed scores, and of the score that may go on
        at = None

        def close(sums: np.ndarray) -> None:
            """Adds whole scores, ``(2, scores, draws)``."""
            nonlocal passed, gained
            upto = passed[:, None, :] + np.cumsum(sums, axis=1)
            gained = gained + (sums[0] * upto[0] / np.maximum(upto[1], 1.0)).sum(axis=0)
            passed = upto[:, -1]

        for batch in batches:
            marks = np.flatnonzero(batch["tp0"].notna().to_numpy())
            bounds = sorted({0, *marks.tolist(), *(marks + 1).tolist(), *range(0, len(batch), _ROWS), len(batch)})
            for a, b in zip(bounds, bounds[1:]):
                part = batch.iloc[a:b]
                first = part.iloc[0]
                if first["tp0"] is not None:
                    close(open_[:, None, :])
                    passed, open_, at = np.array([first["tp0"], first["n0"]], float), np.zeros((2, size)), None
                    continue
                held, scores = times.of(part["cluster"].to_numpy(np.int64)), part["score"].to_numpy()
                new = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
                sums = np.stack([np.add.reduceat(held * part[c].to_numpy(float)[:, None], new, axis=0) for c in ("tp", "n")])
                if at is not None and scores[0] == at:
                    sums[:, 0] += open_
                else:
                    close(open_[:, None, :])
                if sums.shape[1] > 1:
                    close(sums[:, :-1])
                open_, at = sums[:, -1], scores[-1]
        close(open_[:, None, :])
        yield pd.DataFrame({"draw": np.arange(size, dtype=np.int32), "gained": gained})

    found = both.select("tp0", "n0", "score", "cluster", "tp", "n").mapInPandas(run, "draw int, gained double")
    totals = cells.groupBy("draw").agg(F.sum("tp").alias("tp"))
    return found.groupBy("draw").agg(F.sum("gained").alias("gained")).join(totals, "draw").select("draw", F.try_divide("gained", "tp").alias("value"))


def _use_draws(held: DataFrame, clusters: int, n_bootstrap: int, seed: int) -> tuple[Draws, int]:
    """The first ``n_bootstrap`` attempts whose clusters hold both classes, and how many attempts that took.

    ``held(cluster, zero, one)`` tells which classes a cluster has. Attempts come in rounds; the driver sees two numbers an attempt.
    """
    most, size = max(20 * n_bootstrap, n_bootstrap + 100), max(n_bootstrap, 100)
    used, attempts = {}, 0
    while attempts < most and sum(map(len, used.values())) < n_bootstrap:
        turn = Draws(clusters, size, seed, {len(used): list(range(size))})
        sums = summed_by_draw(held.withColumn("all", F.lit(0)), "all", ["zero", "one"], turn)
        good = {r["draw"] for r in sums.where("zero > 0 and one > 0").select("draw").collect()}
        mine = used[len(used)] = []
        for i in range(min(size, most - attempts)):
            attempts += 1
            if i in good:
                mine.append(i)
                if sum(map(len, used.values())) == n_bootstrap:
                    break
    return Draws(clusters, size, seed, used), attempts


def draw_values(
    df: DataFrame, study: str, query: list[str], target: str = "target", score: str = "score", *, n_bootstrap: int = 1000, seed: int = 17,
    ks: tuple[int, ...] = KS, tie: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, Draws, int]:
    """``(metric, draw, value)`` of every metric in every draw; the numbers of studies; the draws; the attempts they took.

    Rows without a study are in no draw. Members of a query may be null; a query that
    two studies share is a query in each. Rows with a null query member don't count for the check of classes, as with null
    targets or scores. A draw without a value for a metric has a null or no row.
    """
    if n_bootstrap < 1 or seed < 0:
        raise ValueError("n_bootstrap is at least 1, the seed at least 0")
    names = df.where(F.col(study).isNotNull()).select(F.col(study).alias("study")).distinct()
    numbers = written(places(names, [], ["study"], "cluster"), "clusters")
    clusters = numbers.count()
    if clusters < 2:
        raise ValueError("drawing studies takes two studies or more")
    used = list(dict.fromkeys(c for c in [*query, target, score, *tie] if c != study))
    rows = df.where(F.col(study).isNotNull() & F.col(score).isNotNull()).select(*used, F.col(study).alias("_study"))
    rows, query, study = written(rows, "eligible"), [c for c in query if c != study], "_study"
    known = rows.where(F.col(target).isNotNull())
    whole = F.lit(True)
    for c in query:
        whole &= F.col(c).isNotNull()
    y = F.col(target).cast("double")
    classes = {r[0] for r in known.where(whole).select(y).distinct().limit(3).collect()}
    if classes != {0.0, 1.0}:
        raise ValueError("targets have to be binary, with both 0 and 1 among all rows")

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(numbers, "study").drop("study")

    off = y - F.col(score)
    flag = lambda value: F.max((y == value).cast("double"))
    per_study = numbered(known.groupBy(F.col(study).alias("study")).agg(
        flag(0.0).alias("zero"), flag(1.0).alias("one"), F.sum(off * off).alias("s"), F.count("*").alias("n")
    ))
    per_study = written(per_study, "studies")
    draws, attempts = _use_draws(per_study, clusters, n_bootstrap, seed)
    if not len(draws):
        raise ValueError("no draw held targets of both classes")
    each = per_query_metrics(rows, [*query, study], study, target, score, ks, tie).groupBy("metric", "study").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    sums = numbered(each).unionByName(per_study.select(F.lit("_loss").alias("metric"), "cluster", "s", "n"))
    sums = sums.select("metric", "cluster", "s", "n", (F.col("s") / F.col("n")).alias("mean"), F.lit(1.0).alias("one"))
    sums = written(summed_by_draw(sums.repartition("cluster").sortWithinPartitions("cluster"), "metric", ["s", "n", "mean", "one"], draws), "sums")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    means = sums.where("metric <> '_loss'").select("draw", "metric", ratio("s", "n").alias("q"), ratio("mean", "one").alias("st"))
    loss = sums.where("metric = '_loss'").select("draw", F.lit("uncalibrated_brier_score").alias("metric"), ratio("s", "n").alias("value"))
    steps = known.groupBy(F.col(study).alias("study"), F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("tp"), F.count("*").cast("double").alias("n"))
    over_all = average_precision_by_draw(numbered(steps), draws)
    over_all = over_all.select("draw", F.explode(F.array(F.lit("average_precision"), F.lit("global_average_precision"))).alias("metric"), "value")
    return named_means(means, "draw").unionByName(loss).unionByName(over_all), numbers, draws, attempts


def cluster_bootstrap(
    df: DataFrame, study: str, query: list[str], target: str = "target", score: str = "score", *, n_bootstrap: int = 1000,
    confidence: float = 0.95, min_effective_fraction: float = 0.8, seed: int = 17, ks: tuple[int, ...] = KS, tie: tuple[str, ...] = (),
) -> DataFrame:
    """Percentile intervals of every name that ``ranking_metrics`` gives but its counts, over studies drawn with replacement.

    Returns ``(metric, effective_draws, interval_available, median, lower, upper)``: draws in which the metric has a
    value, and the interval where these are enough. A metric without a value in any draw has a row with 0. Rows ``_requested_draws,
    _valid_draws, _skipped_draws, _attempts, _minimum_effective_draws`` hold counts in effective_draws.
    """
    if not 0 < confidence < 1 or not 0 < min_effective_fraction <= 1:
        raise ValueError("confidence or min_effective_fraction is out of range")
    spark = df.sparkSession
    values, _, draws, attempts = draw_values(df, study, query, target, score, n_bootstrap=n_bootstrap, seed=seed, ks=ks, tie=tie)
    names = named_means(spark.createDataFrame([(m,) for m in query_metrics(ks)], "metric string").select("metric", F.lit(0.0).alias("q"), F.lit(0.0).alias("st")))
    more = spark.createDataFrame([(m,) for m in ("average_precision", "global_average_precision", "uncalibrated_brier_score")], "metric string")
    names = names.select("metric").unionByName(more)
    alpha = (1 - confidence) / 2
    need = max(2, math.ceil(n_bootstrap * min_effective_fraction))
    cuts = values.groupBy("metric").agg(F.count("value").alias("found"), F.expr(f"percentile(value, array(0.5, {alpha}, {1 - alpha}))").alias("p"))
    effective = F.coalesce("found", F.lit(0))
    enough: Column = effective >= need
    out = names.join(cuts, "metric", "left").select(
        "metric", effective.cast("double").alias("effective_draws"), enough.cast("double").alias("interval_available"),
        *[F.when(enough, F.get("p", F.lit(i))).alias(c) for i, c in enumerate(("median", "lower", "upper"))],
    )
    valid = len(draws)
    facts = {"_requested_draws": n_bootstrap, "_valid_draws": valid, "_skipped_draws": attempts - valid, "_attempts": attempts, "_minimum_effective_draws": need}
    notes = spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "metric string, effective_draws double")
    return out.unionByName(notes, allowMissingColumns=True)
