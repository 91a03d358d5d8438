"""Held-out scores, as-of joins, temporal splits and training recurrence against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest

from assayline.functions.scratch import written
from assayline.operators import held_out as H

DAY = dt.datetime(2024, 1, 1)


def test_as_of_join_with_ties_late_rows_nulls_and_a_hot_key(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    time = lambda: rng.choice([None, *[DAY + dt.timedelta(hours=rng.randrange(60)) for _ in range(9)]])
    left = [(i, key(), time()) for i in range(400)] + [(7, "hot", DAY)] * 2 + [(900, "none", DAY)]
    right = [(key(), time(), rng.randrange(3), rng.choice(["x", "y", None])) for _ in range(300)]
    a = spark.createDataFrame(left, "id int, k string, at timestamp").repartition(5)
    b = spark.createDataFrame(right, "k string, seen timestamp, version int, v string").repartition(4)
    got = sorted(map(tuple, H.as_of_join(a, b, ["k"], "at", "seen", ["v"], ["version"]).collect()), key=repr)
    want = []
    for i, k, t in left:
        fit = [(s, n, v is not None, v) for kk, s, n, v in right if None not in (k, t, s) and kk == k and s <= t]
        best = max(fit) if fit else (None, None, None, None)
        want.append((i, k, t, best[0], best[3]))
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError, match="both sides"):
        H.as_of_join(a, b.withColumn("id", b.version), ["k"], "at", "seen", ["id"])
    assert H.as_of_join(a.limit(0), b, ["k"], "at", "seen", ["v"]).count() == 0
    assert {r["v"] for r in H.as_of_join(a, b.limit(0), ["k"], "at", "seen", ["v"]).collect()} == {None}


def test_as_of_join_spreads_a_hot_key(spark, monkeypatch):
    """One key alone lies in several ranges, and rows find their match in earlier ones too."""
    seen = []
    monkeypatch.setattr(H, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).selectExpr("id", "'one' as k", "timestamp_seconds(id) as at", "timestamp_seconds(id) as seen", "id as v")
    found = H.as_of_join(rows.select("id", "k", "at"), rows.select("k", "seen", "v"), ["k"], "at", "seen", ["v"])
    assert found.where("id <> v").count() == 0 and found.count() == 4000
    sparse = H.as_of_join(rows.select("id", "k", "at"), rows.where("id % 1900 = 5").select("k", "seen", "v"), ["k"], "at", "seen", ["v"])
    assert sparse.where("v is distinct from case when id < 5 then null when id < 1905 then 5 when id < 3805 then 1905 else 3805 end").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for ranged in seen:
        sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
        assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2


def test_as_of_join_takes_the_greatest_of_rows_of_one_time_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    right = spark.range(4000).selectExpr("'one' as k", "timestamp_seconds(100) as seen", "id as v")
    left = spark.range(50).selectExpr("id", "'one' as k", "timestamp_seconds(100 + id) as at")
    found = H.as_of_join(left, right, ["k"], "at", "seen", ["v"])
    assert {r["v"] for r in found.collect()} == {3999} and found.count() == 50
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_temporal_split(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, "f", day(1)), (2, "f", day(9)), (3, "g", day(9)), (4, None, day(9)), (5, None, day(2)), (6, "g", None), (7, "h", day(5)), (7, "h", day(5))]
    df = spark.createDataFrame(rows, "id int, fam string, seen timestamp").withColumnRenamed("fam", "_SEEN")
    got = sorted((r["id"], r["split"]) for r in H.temporal_split(df, "seen", "2024-01-05", "_SEEN").collect())
    assert got == [(1, "train"), (2, "purged"), (3, "test"), (4, "test"), (5, "train"), (6, "undated"), (7, "train"), (7, "train")]


def test_training_recurrence(spark):
    rng = random.Random(4)
    fold = {f"f{i}": rng.choice([0, 1, 2, None]) for i in range(12)}
    rows = [(rng.choice(["A", "B", None]), f, rng.choice(["up", "down", None]), fold[f]) for f in rng.choices(sorted(fold), k=80)]
    df = spark.createDataFrame([*rows, ("A", None, "up", 1)], "gene string, fam string, dir string, fold int")
    got = {(r["gene"], r["fam"]): (r["fold"], r["training_families"], r["same_direction_fraction"]) for r in H.training_recurrence(df, ["gene"], "fam", "dir", "fold").collect()}
    per = {}
    for g, f, d, _ in rows:
        per.setdefault((g, f), []).append(d)
    way = {k: max((d for d in v if d is not None), default=None) for k, v in per.items()}
    assert set(got) == set(per)
    for (g, f), d in way.items():
        others = [way[k] for k in per if k[0] == g and k[1] != f and (fold[f] is None or fold[k[1]] != fold[f])]
        part = sum(x == d for x in others) / len(others) if others else None
        assert got[g, f] == (fold[f], len(others), pytest.approx(part) if part is not None else None)
    with pytest.raises(ValueError, match="more than one fold"):
        H.training_recurrence(spark.createDataFrame([*rows, ("A", "f0", "up", 7)], df.schema), ["gene"], "fam", "dir", "fold")


def _fit(x, y, penalty):
    mean, var = x.mean(axis=0), x.var(axis=0)
    kept = var > 1e-9
    z = (x[:, kept] - mean[kept]) / np.sqrt(var[kept])
    w = np.zeros(x.shape[1])
    w[kept] = np.linalg.solve(z.T @ z + penalty * np.eye(kept.sum()), z.T @ (y - y.mean())) / np.sqrt(var[kept])
    return lambda r: y.mean() + (r - mean) @ w


def test_held_out_scores_see_neither_group_nor_family(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        # Families cross studies; study s5 has no family, s4 no targets, and some rows no study.
        study = rng.choice([None, *[f"s{j}" for j in range(6)]])
        fam = None if study == "s5" else rng.choice(["f1", "f2", "f3"]) if study in ("s0", "s1") else f"own-{study}"
        target = None if study == "s4" else rng.choice([0.0, 1.0, None])
        rows.append((i, study, fam, rng.choice([None, rng.random(), float("nan")]), 5.0 + rng.random(), 1.0, target))
    df = spark.createDataFrame(rows, "id int, study string, fam string, a double, _x0 double, one double, target double").repartition(3)
    got = {r["id"]: r for r in H.leave_group_out_scores(df, "study", "fam", ["a", "_x0", "one"], penalty=2.0).collect()}
    assert len(got) == 150 and set(got[0].asDict()) == {*df.columns, "training_rows", "held_out_score"}
    gone = lambda v: v is None or v != v
    row = lambda r: [*[0.0 if gone(v) else v for v in r[3:6]], *[float(gone(v)) for v in r[3:6]]]
    for r in rows:
        if r[1] is None:
            assert got[r[0]]["held_out_score"] is None is got[r[0]]["training_rows"]
            continue
        linked = {x[2] for x in rows if x[1] == r[1]} - {None}
        train = [x for x in rows if x[1] is not None and x[6] is not None and x[1] != r[1] and x[2] not in linked]
        score = _fit(np.array([row(x) for x in train]), np.array([x[6] for x in train]), 2.0)
        assert got[r[0]]["training_rows"] == len(train)
        assert got[r[0]]["held_out_score"] == pytest.approx(score(np.array(row(r))), rel=1e-8)


def test_one_group_has_nothing_to_train_on(spark):
    df = spark.createDataFrame([("s", "f", 1.0, 1.0), ("s", "f", 2.0, 0.0)], "study string, fam string, a double, target double")
    assert [(r["training_rows"], r["held_out_score"]) for r in H.leave_group_out_scores(df, "study", "fam", ["a"]).collect()] == [(0, None)] * 2
