import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import design, model


def test_zero_is_not_missing(spark):
    contrasts = spark.createDataFrame([("s", "c1", 0.0), ("s", "c2", None)], "screen_id string, contrast_id string, recovery_days double")
    screens = spark.createDataFrame([("s", "st")], "screen_id string, study_id string")
    designs = spark.createDataFrame([("s", 0.0, "unknown")], "screen_id string, library_moi double, screen_scale string")
    samples = spark.createDataFrame([("s", "c1", "control", "p"), ("s", "c1", "treatment", "p"), ("s", "c1", "control", "q")], "screen_id string, contrast_id string, condition_role string, pair_id string")
    got = {r["contrast_id"]: r for r in design.featurize_design(screens, designs, contrasts, samples).collect()}
    assert got["c1"]["recovery_days"] == 0 and got["c1"]["recovery_days_missing"] == 0 and got["c2"]["recovery_days_missing"] == 1
    assert got["c1"]["paired_replicate_fraction"] == 0.5 and got["c2"]["control_sample_n"] == 0
    with pytest.raises(ValueError, match="unique"):
        design.featurize_design(screens.union(screens), designs, contrasts, samples)


def test_standardizer_matches_weights(spark):
    df = spark.createDataFrame([(1.0, 0.01)] * 100 + [(100.0, 1.0)], "x double, weight double")
    fitted = model.fit_standardizer(df, ["x"])
    assert fitted.mean["x"] == pytest.approx(50.5)
    assert fitted.scale["x__missing"] == 1.0
    out = fitted.transform(spark.createDataFrame([(None,), (float("nan"),)], "x double")).collect()
    assert out[0]["features"][1] == out[1]["features"][1] == 1.0


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    y = (x + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)], "x double, y double, weight double")
    fitted = model._fit(df, ["x"], "logistic")
    z = np.c_[np.ones(200), (x - x.mean()) / x.std()]
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag([0, 1.0]), z.T @ (y - p) - np.array([0, b[1]]))
    assert fitted.model.coefficients[0] == pytest.approx(b[1], abs=1e-4)
    assert fitted.model.intercept == pytest.approx(b[0], abs=1e-4)


def test_guards(spark):
    with pytest.raises(ValueError, match="leak"):
        model.check_features(["x", "validation_score"])
    assert len(model.PROFILES["screen_only"]) == 24 and len(model.PROFILES["screen_plus_design"]) == 74
    df = spark.createDataFrame([("odd",)], "s string")
    with pytest.raises(Exception, match="unknown testing status"):
        df.select(model.testing_target(F.col("s"))).collect()


def test_groups_stay_in_one_fold(spark):
    rows = [(f"g{i % 9}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, y int")
    folds = model.deal_groups(df, "g", 3, "y").collect()
    assert len({r["group"] for r in folds}) == len(folds) == 9 and {r["fold"] for r in folds} == {0, 1, 2}


def test_a_million_groups_are_dealt_where_they_are(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.pmod(F.hash("id"), F.lit(3)))).alias("i"))
    # Three groups hold a third of all rows.
    rows = rows.withColumn("g", F.when(F.pmod(F.hash("g", "i"), F.lit(3)) == 0, -1 - F.pmod(F.hash("i", "g"), F.lit(3))).otherwise(F.col("g")))
    rows = rows.withColumn("y", F.when(F.col("g") % 4 == 0, None).when(F.col("g") % 7 == 0, 1).otherwise(0))
    folds = model.deal_groups(rows, "g", 5, "y")
    dealt = rows.join(folds, rows["g"].cast("string") == folds["group"])
    got = dealt.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.count_if(F.col("y").isNull()).alias("none")).toPandas()
    assert len(got) == 5 and got["n"].sum() == rows.count() and folds.count() == folds.select("group").distinct().count()
    # Kinds of strata here: all ones, all zeros, all without; a light group has three rows at most.
    assert got["n"].max() - got["n"].min() <= 3 * 2 * 3 * 2
    light = dealt.where("g >= 0").groupBy("fold").agg(F.avg((F.col("y") == 1).cast("double")).alias("share")).toPandas()
    assert light["share"].max() - light["share"].min() < 0.01


def test_room_in_folds():
    assert model._room(np.array([0.0, 0.0]), 10).tolist() == [5, 5]
    assert model._room(np.array([9.0, 1.0, 2.0]), 6).tolist() == [0, 3.5, 2.5]
    assert model._room(np.array([1.0, 4.0]), 0).tolist() == [0, 0]
