"""Propensities, weights, fits and out-of-fold scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import extras, model
from assayline.operators.boosting import BoostParams


def _candidates(spark, n=160, groups=8):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x = float(rng.normal())
        tested = "tested" if rng.random() < 0.7 else "not_tested"
        good = x + rng.normal() > 0
        label = ("V2" if good else "F0") if tested == "tested" else "U"
        rows.append((f"st{i % groups}", f"sc{i % groups}", "c", f"g{i}", "resistance" if i % 2 else "sensitization", label, tested, x, f"fam{(i % groups) // 2}"))
    return spark.createDataFrame(rows, "study_id string, screen_id string, contrast_id string, gene_symbol string, phenotype_direction string, label_code string, testing_status string, x double, source_family_id string")


def test_out_of_fold(spark):
    df = _candidates(spark)
    scored, notes = model.out_of_fold(df, ["x"], n_splits=2)
    rows = scored.collect()
    assert len(rows) == 160 and len({r["gene_symbol"] for r in rows}) == 160
    assert {r["fold"] for r in rows} == {0, 1} and all(0 < r["score"] < 1 and 0 < r["ipw_score"] < 1 for r in rows)
    folds = {}
    for r in rows:  # studies of one family are one group, in one fold
        folds.setdefault((r["group_used"], r["source_family_id"]), set()).add(r["fold"])
    assert len(folds) == 4 and all(len(f) == 1 for f in folds.values())
    y, s = np.array([r["y"] for r in rows if r["y"] is not None]), np.array([r["score"] for r in rows if r["y"] is not None])
    assert s[y == 1].mean() > s[y == 0].mean() + 0.1
    assert {"ipw_mean_n_labeled", "ipw_mean_clip_upper_fraction", "ipw_mean_effective_sample_size", "ipw_mean_n_selection_status_known"} <= set(notes)


def test_candidates_are_checked_before_any_fit(spark):
    df = _candidates(spark, 16)
    for change, message in (
        ({"phenotype_direction": F.lit("neutral")}, "direction"), ({"label_code": F.lit("U")}, "label_status_differ"),
        ({"label_code": F.lit(None).cast("string")}, "label_code:missing"), ({"gene_symbol": F.lit("g")}, "duplicate_key"),
        ({"study_id": F.col("gene_symbol")}, "several studies"),
    ):
        with pytest.raises(ValueError, match=message):
            model.check_candidates(df.withColumns(change))
    with pytest.raises(ValueError, match="no candidate columns"):
        model.check_candidates(df.drop("contrast_id"))
    model.check_candidates(df.withColumnRenamed("label_code", "own"), label="own")


def test_propensity_and_weights(spark, monkeypatch):
    df = _candidates(spark).withColumns({"y": F.when(F.col("label_code") == "V2", 1.0).when(F.col("label_code") == "F0", 0.0), "tested": model.testing_target(F.col("testing_status"))})
    got = model.fit_propensity(df, ["x"], "study_id", 2).collect()
    assert len(got) == 160 and all(0.2 < r["propensity"] < 0.99 for r in got)
    assert {r["propensity"] for r in model.fit_propensity(df.withColumn("tested", F.lit(1)), ["x"], "study_id").collect()} == {1.0}
    with pytest.raises(ValueError, match="IPW requires"):
        model.fit_propensity(df.withColumn("study_id", F.lit("one")), ["x"], "study_id")
    weights = model.group_weights(df, "study_id").groupBy("study_id").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in weights)
    _, stats = model.fit_success(df.withColumn("propensity", F.lit(0.5)), ["x"], "logistic", "study_id", True)
    assert len(stats) == 10 and stats["effective_sample_size"] == pytest.approx(stats["n_labeled"]) and stats["clip_upper_fraction"] == 0
    monkeypatch.setattr(model, "BOOSTING", BoostParams(rounds=8, rate=0.2))
    fitted, _ = model.fit_success(df, ["x"], "boosted_trees", "study_id", False)
    scored = fitted.score(df, "score").where("y is not null").collect()
    assert np.mean([r["score"] for r in scored if r["y"]]) > np.mean([r["score"] for r in scored if not r["y"]]) + 0.1
    with pytest.raises(ValueError, match="one class"):
        model.fit_success(df.where("y is null or y = 1"), ["x"], "logistic", "study_id", False)


def test_assembly_multiplies_no_rows(spark):
    genes = spark.createDataFrame([("st", "s", "c", "g", 1.0)], "study_id string, screen_id string, contrast_id string, gene_symbol string, x double")
    design = spark.createDataFrame([("s", "c", 2)], "screen_id string, contrast_id string, n int")
    labels = spark.createDataFrame([("st", "s", "c", "g", "V2")], "study_id string, screen_id string, contrast_id string, gene_symbol string, label_code string")
    (row,) = model.assemble_features(genes, design, labels).collect()
    assert (row["x"], row["n"], row["label_code"]) == (1.0, 2, "V2")
    with pytest.raises(ValueError, match="several design"):
        model.assemble_features(genes, design.union(design), labels)
    with pytest.raises(ValueError, match="several candidate"):
        model.assemble_features(genes, design, labels.union(labels))


def test_calibration_equals_newton(spark):
    rng = np.random.default_rng(1)
    s = rng.uniform(0.05, 0.95, 120)
    y = (rng.random(120) < s).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s)], "target double, score double")
    got = extras.calibration(df).first()
    z, b = np.c_[np.ones(120), np.log(s / (1 - s))], np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z.T * (q * (1 - q))) @ z, z.T @ (y - q))
    assert (got["intercept"], got["slope"]) == pytest.approx(tuple(b), abs=1e-3)
