import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.functions.positions import medians
from assayline.functions.ranks import average_ranks
from assayline.functions.scratch import written
from assayline.operators import counts as C
from assayline.operators.contracts import with_row_numbers

SHEET = [("c1", "S", "K", "control", 1), ("c2", "S", "K", "control", 2), ("t1", "S", "K", "treatment", 1), ("t2", "S", "K", "treatment", 2)]


def _sheet(spark, rows=SHEET):
    return spark.createDataFrame(rows, "sample_id string, screen_id string, contrast_id string, condition_role string, replicate int")


def _counts(spark, rows, samples=("c1", "c2", "t1", "t2")):
    return spark.createDataFrame(rows, "sgrna_id string, gene_symbol string, " + ", ".join(f"{s} double" for s in samples))


def _by_gene(df):
    return {r["gene_symbol"]: r for r in df.collect()}


def test_signs(spark):
    counts = _counts(spark, [("a1", "A", 100.0, 110.0, 400.0, 420.0), ("a2", "A", 90.0, 95.0, 300.0, 310.0), ("b1", "B", 200.0, 210.0, 40.0, 50.0), ("b2", "B", 220.0, 230.0, 60.0, 70.0)])
    out = _by_gene(C.featurize_count_table(counts, _sheet(spark)))
    assert out["A"]["median_guide_lfc"] > 0 > out["B"]["median_guide_lfc"]
    assert out["A"]["guide_direction_agreement"] == 1
    assert out["A"]["signal_direction"] == "resistance" and out["B"]["signal_direction"] == "sensitization"


def test_neutral(spark):
    sheet = _sheet(spark, [SHEET[0], SHEET[2]])
    out = _by_gene(C.featurize_count_table(_counts(spark, [("a1", "A", 100.0, 100.0), ("a2", "A", 100.0, 100.0)], ("c1", "t1")), sheet))
    assert out["A"]["guide_direction_agreement"] == 0 and out["A"]["neutral_guide_fraction"] == 1
    assert out["A"]["replicate_correlation"] is None and out["A"]["replicate_effect_sd"] is None


def test_composition_shift_does_not_move_other_genes(spark):
    sheet = _sheet(spark, [SHEET[0], SHEET[2]])
    out = _by_gene(C.featurize_count_table(_counts(spark, [("a", "A", 100.0, 10000.0), ("b", "B", 100.0, 100.0), ("c", "C", 100.0, 100.0)], ("c1", "t1")), sheet))
    assert out["A"]["median_guide_lfc"] > 5
    assert abs(out["B"]["median_guide_lfc"]) < 0.05 and abs(out["C"]["median_guide_lfc"]) < 0.05


def test_zero_heavy(spark):
    sheet = _sheet(spark, [SHEET[0], SHEET[2]])
    rows = [(f"z{i}", "Z", 0.0, 0.0) for i in range(3)] + [("a", "A", 100.0, 200.0), ("b", "B", 200.0, 400.0)]
    out = _by_gene(C.featurize_count_table(_counts(spark, rows, ("c1", "t1")), sheet))
    assert abs(out["A"]["median_guide_lfc"]) < 0.05 and abs(out["B"]["median_guide_lfc"]) < 0.05


@pytest.mark.parametrize(
    ("rows", "params", "message"),
    [
        ([("a", "A", 1.0, 2.0, float("inf"), 4.0)], {}, "infinite"),
        ([("a", "A", 1.0, 2.0, 10.5, 4.0)], {}, "not whole"),
        ([("a", "A", 1.0, 2.0, -1.0, 4.0)], {}, "negative"),
        ([("a", "A", 1.0, 2.0, 3.0, 4.0), ("a", "B", 1.0, 2.0, 3.0, 4.0)], {}, "repeated guide"),
        ([(" ", "A", 1.0, 2.0, 3.0, 4.0)], {}, "without guide"),
        ([("a", "A", 1.0, 2.0, 3.0, 4.0)], {"pseudocount": 0}, "pseudocount"),
        ([("a", "A", 1.0, 2.0, 3.0, 0.0)], {}, "without a single count"),
    ],
)
def test_rejects(spark, rows, params, message):
    with pytest.raises(ValueError, match=message):
        C.featurize_count_table(_counts(spark, rows), _sheet(spark), **params)


def test_undeclared_column(spark):
    counts = _counts(spark, [("a", "A", 1.0, 2.0, 3.0, 4.0)]).selectExpr("*", "1 as extra")
    with pytest.raises(ValueError, match="undeclared"):
        C.featurize_count_table(counts, _sheet(spark))
    C.validate_counts(counts, _sheet(spark), ("extra",))


def test_sheet_needs_both_roles(spark):
    with pytest.raises(ValueError, match="control"):
        C.validate_sheet(_sheet(spark, SHEET[:2]))


@pytest.mark.parametrize("n", range(1, 12))
def test_leave_one_out(spark, n):
    values = [math.sin(i * 7.3) * 5 for i in range(n)]
    got = spark.createDataFrame([(sorted(values),)], "v array<double>").select(C.leave_one_out_median_sd(__import__("pyspark").sql.functions.col("v")).alias("x")).first()["x"]
    if n < 3:
        assert got is None
    else:
        want = statistics.stdev(statistics.median(values[:i] + values[i + 1 :]) for i in range(n))
        assert got == pytest.approx(want, abs=1e-12)


def test_average_ranks_by_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [(g, None if rng.random() < 0.05 else float(v), int(i)) for g, n in (("a", 4000), (None, 50), ("b", 1), ("ties", 300)) for i, v in enumerate(rng.integers(0, 7, n) if g == "ties" else rng.normal(size=n).round(2))]
    df = spark.createDataFrame(rows, "g string, v double, _cell int").repartition(3)
    got = average_ranks(df, ["g"], "v", "r", of="n").toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["g", "v", "_cell", "r", "n"]
    for g in ("a", None, "b", "ties"):
        own = got[got["g"].isna() if g is None else got["g"] == g]
        v = own["v"].fillna(-1e9)
        assert (own["r"] == v.rank()).all() and set(own["n"]) == {len(own)}


def test_medians_by_ranges(spark):
    rng = np.random.default_rng(9)
    groups = {"odd": rng.normal(size=3001), "even": rng.normal(size=2000).round(1), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "ties": np.r_[np.zeros(500), np.ones(500)], "same": np.full(700, 0.3)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("odd", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = medians(df, ["g"], "v", "m")
    assert {r["g"]: r["m"] for r in found.collect()} == {g: statistics.median(v.tolist()) for g, v in groups.items()}
    assert medians(df.limit(0), ["g"], "v", "m").count() == 0


def test_no_task_holds_the_ratios_of_a_sample(spark):
    long = spark.range(900).selectExpr("'S' as screen_id", "concat('s', id % 3) as sample_id", "concat('g', id div 3) as sgrna_id", "1 + id * 7 % 50 as cnt")
    found = C.size_factors(long)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan and "percentile(" not in plan
    assert found.count() == 3


def test_row_numbers_stay_when_read_again(spark):
    df = spark.range(1000).select(F.col("id").alias("an id #"), F.lit(None).alias("none"), F.lit("x").alias("row_number")).repartition(7)
    got = with_row_numbers(df)
    assert got.columns == ["an id #", "none", "row_number"]
    assert sorted(r["row_number"] for r in got.collect()) == list(range(2, 1002)) and sorted(got.collect()) == sorted(got.collect())
    ordered = with_row_numbers(spark.range(50).coalesce(1), "n", 1).collect()
    assert all(r["n"] == r["id"] + 1 for r in ordered)
    assert with_row_numbers(spark.range(0)).count() == 0
    assert "map(" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_one_row_a_sample_is_broadcast(spark):
    """Long counts pack so well on disk that Spark may take them for the small side."""
    wide = spark.range(3000).selectExpr("concat('g', id) as sgrna_id", "concat('G', id div 4) as gene_symbol", *[f"id % {7 + i} as s{i}" for i in range(4)])
    sheet = spark.createDataFrame([(f"s{i}", "S", "C", "control" if i < 2 else "treatment", i % 2 + 1) for i in range(4)], list(C.SHEET_COLUMNS))
    long = written(C.with_sheet(C.to_long(wide, [f"s{i}" for i in range(4)]), sheet), "long")
    logged = C.log_counts(long)
    plan = logged._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "sgrna_id" in line]
    sd = C.replicate_effect_sd(written(logged, "logged"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in sd


def test_features_broadcast_no_row_a_gene(spark):
    wide = spark.range(400).selectExpr("concat('g', id) as sgrna_id", "concat('G', id div 4) as gene_symbol", *[f"1 + id % {7 + i} as s{i}" for i in range(4)])
    sheet = spark.createDataFrame([(f"s{i}", "S", "C", "control" if i < 2 else "treatment", i % 2 + 1) for i in range(4)], list(C.SHEET_COLUMNS))
    found = C.featurize_counts(C.with_sheet(C.to_long(wide, [f"s{i}" for i in range(4)]), sheet))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "gene_symbol" in line]
    assert found.count() == 100


def test_ranges_are_cut_once_for_all_readers(spark):
    """Approximate quantiles taken anew by each reader may differ, and with them the ranges."""
    df = spark.range(500).selectExpr("id % 3 as g", "id * 7 % 101 as v")
    ranked = average_ranks(df, ["g"], "v", "r")
    assert "percentile_approx" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    held = {g: sorted(r["v"] for r in df.where(f"g = {g}").collect()) for g in range(3)}
    assert all(r["r"] == sum(v < r["v"] for v in held[r["g"]]) + (held[r["g"]].count(r["v"]) + 1) / 2 for r in ranked.collect())


def test_wide_counts_are_made_of_whole_parts(spark, tmp_path):
    """Wide rows are made only where all counts of a part are, so none is shuffled."""
    from assayline.plans import demo_views as V

    keys = ("id l_suppkey", "id % 5 l_partkey", "cast(id % 3 as int) l_linenumber", "if(id % 2 = 0, 'O', 'F') l_linestatus", "'A' l_returnflag", "cast(id as double) l_quantity")
    spark.range(90).selectExpr(*keys).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    wide = V.wide_counts(spark, str(tmp_path))
    rows = {r["sgrna_id"]: r for r in wide.collect()}
    assert len(rows) == 7 and sum(sum(r[2:]) for r in rows.values()) == sum(range(90)) and not any(rows["G6"][2:])
    assert rows["G1"]["SC1:C1:FA"] == sum(i for i in range(90) if i % 5 == 1 and i % 4 == 1 and i % 3 % 2 == 1)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in a and "pivotfirst" in b for a, b in zip(plan.splitlines(), plan.splitlines()[1:]))
    assert "pivotfirst" in plan
