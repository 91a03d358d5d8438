"""Every draw of the bootstrap against plain Python that copies the drawn studies' rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from assayline.operators.resampling import cluster_bootstrap, draw_values, times_held

Q = ["screen_id", "contrast_id"]
SCHEMA = "study_id string, screen_id string, contrast_id string, gene_symbol string, target double, score double"


def _ap(pairs):
    by = defaultdict(lambda: [0.0, 0])
    for y, s in pairs:
        by[s][0] += y
        by[s][1] += 1
    hits = seen = gained = 0.0
    for s in sorted(by, reverse=True):
        hits, seen = hits + by[s][0], seen + by[s][1]
        gained += by[s][0] * hits / seen
    return gained / hits


def _ndcg(pairs, k):
    mean = defaultdict(list)
    for y, s in pairs:
        mean[s].append(y)
    down = sorted((s for _, s in pairs), reverse=True)[:k]
    best = sorted((y for y, _ in pairs), reverse=True)[:k]
    gain = lambda ys: sum(y / math.log2(i + 2) for i, y in enumerate(ys))
    return gain([sum(mean[s]) / len(mean[s]) for s in down]) / gain(best)


def _plain(copies, ks=(5, 10, 20)):
    """All metrics of a list of drawn studies, each a list of rows."""
    values = defaultdict(list)  # metric -> a list of values a drawn study
    known = [(r[4], r[5]) for rows in copies for r in rows if r[4] is not None and r[5] is not None]
    for rows in copies:
        queries, mine = defaultdict(list), defaultdict(list)
        for r in rows:
            if r[5] is not None:
                queries[r[1], r[2]].append(r)
        for rs in queries.values():
            rs = sorted(rs, key=lambda r: (-r[5], r[3]))
            judged = [(r[4], r[5]) for r in rs if r[4] is not None]
            seen = [(r[4] or 0.0, r[5]) for r in rs]
            if len({y for y, _ in judged}) == 2:
                mine["average_precision"].append(_ap(judged))
            for k in ks:
                some = sum(y for y, _ in seen)
                if judged:
                    mine[f"adjudicated_precision_at_{k}"].append(sum(y for y, _ in judged[:k]) / min(k, len(judged)))
                mine[f"observed_success_yield_at_{k}"].append(sum(y for y, _ in seen[:k]) / min(k, len(seen)))
                if some:
                    mine[f"adjudicated_ndcg_at_{k}"].append(_ndcg(judged, k))
                    mine[f"observed_recall_at_{k}"].append(sum(y for y, _ in seen[:k]) / some)
                    mine[f"observed_ndcg_at_{k}"].append(_ndcg(seen, k))
        for m, v in mine.items():
            values[m].append(v)
    out = {m: _ap(known) for m in ("average_precision", "global_average_precision")}
    out["uncalibrated_brier_score"] = sum((y - s) ** 2 for y, s in known) / len(known)
    for m, v in values.items():
        macro = sum(sum(x) / len(x) for x in v) / len(v)
        out[f"query_macro_{m}"] = sum(map(sum, v)) / sum(map(len, v))
        out[f"study_macro_{m}"] = out["macro_average_precision" if m == "average_precision" else m] = macro
        if m.startswith("adjudicated_"):
            out[m.removeprefix("adjudicated_")] = macro
    # The bare name of average precision is the one over all rows.
    out["average_precision"] = out["global_average_precision"]
    return out


def _rows(seed, studies=6, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A query's members may be null, and two studies share names of screens; study 0 has one class, study 1 no label.
        study = min(rng.randrange(studies), rng.randrange(studies))
        target = 0.0 if study == 0 else None if study == 1 else rng.choice([0.0, 1.0, None])
        rows.append((f"S{study}", f"sc{rng.randrange(2)}", rng.choice(["c", "d", None]), f"g{i}", target, rng.choice([None, *[x / 20 for x in range(21)]])))
    return [*rows, *rows[:5], (None, "sc0", "c", "gx", 1.0, 0.9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_draw(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    values, numbers, draws, attempts = draw_values(df, "study_id", Q, n_bootstrap=40, seed=seed, tie=("gene_symbol",))
    names = {r["cluster"]: r["study"] for r in numbers.collect()}
    assert sorted(names) == list(range(6)) and len(draws) == 40 <= attempts
    held = draws.times(np.arange(6))
    assert (held.sum(axis=0) == 6).all()
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    got = defaultdict(dict)
    for r in values.where("value is not null").collect():
        assert r["metric"] not in got[r["draw"]]
        got[r["draw"]][r["metric"]] = r["value"]
    for d in range(40):
        copies = [of[names[c]] for c in range(6) for _ in range(held[c, d])]
        assert got[d] == pytest.approx(_plain(copies), abs=1e-12)
    out = {r["metric"]: r for r in cluster_bootstrap(df, "study_id", Q, n_bootstrap=40, seed=seed, tie=("gene_symbol",)).collect()}
    assert len([m for m in out if not m.startswith("_")]) == 57 and out["_attempts"]["effective_draws"] == attempts
    for m, r in out.items():
        if not m.startswith("_"):
            mine = [got[d][m] for d in range(40) if m in got[d]]
            assert r["effective_draws"] == len(mine)
            assert [r["median"], r["lower"], r["upper"]] == pytest.approx(np.quantile(mine, [0.5, 0.025, 0.975]).tolist())


def test_metric_without_values_has_a_row(spark):
    """Each query has one class: their average precision has no value in any draw, the one over all rows has."""
    rows = [(f"S{i}", "s", "c", f"g{i}{j}", float(i % 2), 0.1 * i + 0.01 * j) for i in range(4) for j in range(3)]
    out = {r["metric"]: r for r in cluster_bootstrap(spark.createDataFrame(rows, SCHEMA), "study_id", Q, n_bootstrap=30).collect()}
    assert out["macro_average_precision"]["effective_draws"] == out["macro_average_precision"]["interval_available"] == 0
    assert out["macro_average_precision"]["median"] is None and out["global_average_precision"]["effective_draws"] == 30
    assert out["_skipped_draws"]["effective_draws"] == out["_attempts"]["effective_draws"] - 30


def test_sparse_metrics_are_withheld(spark):
    """Only one of three studies has a query of both classes: its draws are too few for an interval."""
    rows = [(s, s, "c", f"g{i}", t, x) for i, (s, t, x) in enumerate([("A", 0.0, 0.1), ("A", 0.0, 0.2), ("B", 1.0, 0.8), ("B", 1.0, 0.9), ("C", 0.0, 0.3), ("C", 1.0, 0.7)])]
    out = {r["metric"]: r for r in cluster_bootstrap(spark.createDataFrame(rows, SCHEMA), "study_id", Q, n_bootstrap=100, min_effective_fraction=0.9).collect()}
    few = out["query_macro_average_precision"]
    assert 0 < few["effective_draws"] < 90 and few["interval_available"] == 0 and few["median"] is None
    assert out["_minimum_effective_draws"]["effective_draws"] == 90


def test_scores_over_many_ranges(spark):
    """Distinct scores by the thousand, over several tasks and slices."""
    rng = random.Random(5)
    rows = [(f"S{rng.randrange(30)}", "s", "c", f"g{i}", float(rng.random() < 0.3), rng.randrange(3000) / 3000) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    values, numbers, draws, _ = draw_values(df, "study_id", Q, n_bootstrap=7, tie=("gene_symbol",))
    names = {r["study"]: r["cluster"] for r in numbers.collect()}
    held = draws.times(np.arange(30))
    got = {r["draw"]: r["value"] for r in values.where("metric = 'global_average_precision'").collect()}
    for d in range(7):
        want = _ap([(r[4], r[5]) for r in rows for _ in range(held[names[r[0]], d])])
        assert got[d] == pytest.approx(want, rel=1e-12)


def test_counts_are_multinomial():
    whole = times_held(np.arange(50), 50, 4000, (3, 0))
    assert (whole.sum(axis=0) == 50).all()
    assert (times_held(np.array([7, 31]), 50, 4000, (3, 0)) == whole[[7, 31]]).all()
    # Mean 1, variance 1 - 1/50, covariance -1/50 of any two; 4000 draws.
    assert abs(whole.mean(axis=1) - 1).max() < 0.08 and abs(whole.var(axis=1) - 0.98).max() < 0.15
    assert abs(np.cov(whole)[~np.eye(50, dtype=bool)].mean() + 0.02) < 0.003
