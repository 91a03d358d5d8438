"""Rank aggregation and smoothed Z against plain Python."""

import math
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.functions.positions import places
from assayline.functions.scratch import written
from assayline.operators import baselines as B, extras, model

SCHEMA = "screen_id string, contrast_id string, gene_symbol string, sgrna_id string, guide_lfc double, mean_control_count double, x string"


def _guides(seed=2, n=240):
    rng = random.Random(seed)
    gene = lambda: rng.choice(["hot"] * 5 + [f"g{i}" for i in range(9)] + [None])
    value = lambda: rng.choice([None, float("nan"), *[round(rng.gauss(0, 1), 1) for _ in range(12)]])
    return [(rng.choice(["s", None]), "c", gene(), f"i{i}", value(), rng.choice([None, float(rng.randrange(40))]), "x") for i in range(n)]


def _used(rows):
    out = defaultdict(list)
    for r in rows:
        if r[2] is not None and r[4] is not None and r[4] == r[4]:
            out[r[:2]].append(r)
    return out


def _binomial_tail(u, k, n):
    return sum(math.comb(n, j) * u**j * (1 - u) ** (n - j) for j in range(k, n + 1))


def test_order_tail():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.choice([1, 2, 4, 9, 60])
        k, u = rng.randint(1, n), rng.choice([0.0, 1.0, rng.random(), rng.random() ** 6])
        assert B.order_tail(np.array([u]), np.array([k]), np.array([n]))[0] == pytest.approx(_binomial_tail(u, k, n), rel=1e-9, abs=1e-300)
    # A very large set: the normal limit, 1 deviation below the mean.
    n, k = 4_000_000, 1_000_000
    u = k / n - math.sqrt(0.25 * 0.75 / n)
    assert B.order_tail(np.array([u]), np.array([k]), np.array([n]))[0] == pytest.approx(0.1587, abs=2e-3)


@pytest.mark.parametrize("ascending", [True, False])
def test_rank_scores(spark, ascending):
    rows = _guides()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["screen_id"], r["contrast_id"], r["gene_symbol"]): (r["guide_n"], r["rho"]) for r in B.rank_scores(df, ascending=ascending, alpha=0.3).collect()}
    want = {}
    for key, rs in _used(rows).items():
        sign = 1 if ascending else -1
        xs = [sign * r[4] for r in rs]
        place = {x: (sum(y < x for y in xs) + (xs.count(x) + 1) / 2 - 0.5) / len(xs) for x in set(xs)}
        genes = defaultdict(list)
        for r in rs:
            genes[r[2]].append(place[sign * r[4]])
        for g, us in genes.items():
            tails = [_binomial_tail(u, k + 1, len(us)) for k, u in enumerate(sorted(us)) if u <= 0.3]
            want[(*key, g)] = (len(us), pytest.approx(min(tails, default=1.0), rel=1e-9))
    assert got == want


def test_null_scores_are_those_of_uniform_numbers(monkeypatch):
    """Drawn in order and in slices, held against drawing all numbers and sorting them."""
    monkeypatch.setattr(B, "_CELLS", 3 * 20_000)
    rng = np.random.default_rng(5)
    for size in (1, 7, 23):
        found = B.null_scores(size, 20_000, 0.25, rng)
        u = np.sort(rng.random((20_000, size)), axis=1)
        tails = B.order_tail(u, np.arange(1, size + 1)[None, :], np.full((1, size), size))
        plain = np.where(u <= 0.25, tails, 1.0).min(axis=1)
        cuts = np.quantile(plain, [0.05, 0.2, 0.5])
        assert [(found <= c).mean() for c in cuts] == pytest.approx([(plain <= c).mean() for c in cuts], abs=0.015)


def test_p_values(spark):
    """Planted genes come out, others have even p-values, and reruns agree."""
    rng = random.Random(8)
    rows = [("s", "c", f"g{i // 4}", f"i{i}", rng.gauss(-4 if i < 12 else 0, 1), 5.0, "x") for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = B.rank_aggregation(df, permutations=250)
    got = {r["gene_symbol"]: r["p_value"] for r in found.collect()}
    assert len(got) == 400 and max(got[f"g{i}"] for i in range(3)) == pytest.approx(1 / 251)
    rest = [got[f"g{i}"] for i in range(3, 400)]
    assert 0.02 < np.mean(np.array(rest) <= 0.05) < 0.09 and min(rest) > 0
    again = {r["gene_symbol"]: r["p_value"] for r in B.rank_aggregation(df.repartition(5), permutations=250).collect()}
    assert again == got
    assert B.rank_aggregation(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="out of range"):
        B.rank_aggregation(df, alpha=0.0)


def test_smoothed_z(spark):
    rows = _guides(7, 300)
    got = {(r["screen_id"], r["contrast_id"], r["gene_symbol"]): (r["guide_n"], r["norm_z"]) for r in B.smoothed_z(spark.createDataFrame(rows, SCHEMA).repartition(3), window=20).collect()}
    want = {}
    for key, rs in _used(rows).items():
        rs = sorted(rs, key=lambda r: (-(r[5] if r[5] is not None else -math.inf), r[3]))
        runs = [rs[i : i + 20] for i in range(0, len(rs), 20)]
        genes, sd = defaultdict(list), 0.0
        for i, run in enumerate(runs):
            sd = max(sd, statistics.stdev([r[4] for near in runs[max(0, i - 1) : i + 2] for r in near]))
            for r in run:
                genes[r[2]].append(r[4] / sd)
        z = {g: sum(v) / math.sqrt(len(v)) for g, v in genes.items()}
        mean, dev = statistics.mean(z.values()), statistics.stdev(z.values())
        want |= {(*key, g): (len(genes[g]), pytest.approx((z[g] - mean) / dev, abs=1e-9)) for g in z}
    assert got == want


def test_smoothed_z_of_equal_and_single_guides(spark):
    same = [("s", "c", f"g{i}", f"i{i}", 1.0, 2.0, "x") for i in range(4)]
    assert {r["norm_z"] for r in B.smoothed_z(spark.createDataFrame(same, SCHEMA)).collect()} == {None}
    assert [r["norm_z"] for r in B.smoothed_z(spark.createDataFrame(same[:1], SCHEMA)).collect()] == [None]
    assert B.smoothed_z(spark.createDataFrame([], SCHEMA)).count() == 0


def _broadcast(frame):
    frame.collect()
    return "BroadcastHashJoin" in frame._jdf.queryExecution().executedPlan().toString()


def test_places_of_many_small_groups_are_not_sent_whole(spark):
    """Starts of groups pack well on disk, so that Spark would take them for a small side."""
    many = spark.range(25_000).selectExpr("concat('g', id) as g", "id as v")
    placed = places(many, ["g"], ["v"], "k", of="n")
    assert not _broadcast(placed) and placed.where("k = 0 and n = 1").count() == 25_000
    few = places(many.withColumn("g", F.lit("one")), ["g"], ["v"], "k", of="n")
    assert _broadcast(few) and few.where("k = v and n = 25000").count() == 25_000


def test_genes_are_not_sent_whole(spark):
    guides = written(spark.createDataFrame(_guides(), SCHEMA), "guides")
    values = B.rank_aggregation(guides, permutations=10)
    assert not any("BroadcastHashJoin" in line and "rho" in line for line in values._jdf.queryExecution().sparkPlan().toString().splitlines())
    genes, ids = guides.select("gene_symbol"), guides.select("sgrna_id")
    assert "BroadcastHashJoin" not in extras.screen_quality(guides, genes, ids)._jdf.queryExecution().sparkPlan().toString()
    notes = guides.selectExpr("sgrna_id", "1 as multi_target_count")
    assert "BroadcastHashJoin" not in extras.guide_flags(guides.select("sgrna_id", "gene_symbol"), notes, genes)._jdf.queryExecution().sparkPlan().toString()
    features, labels = genes.distinct().selectExpr("'t' study_id", "'s' screen_id", "'c' contrast_id", "gene_symbol"), genes.distinct().selectExpr("'t' study_id", "'s' screen_id", "'c' contrast_id", "gene_symbol", "'V' label_code")
    joined = model.assemble_features(features, features.select("screen_id", "contrast_id").distinct().withColumn("d", F.lit(1)), labels)
    assert "SortMergeJoin" in joined._jdf.queryExecution().sparkPlan().toString() and joined.where("d = 1").count() == genes.distinct().count()
