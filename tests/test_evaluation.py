import math

import pytest

from assayline.operators import evaluation as G
from assayline.operators.resampling import cluster_bootstrap

Q = ["screen_id", "contrast_id", "phenotype_direction"]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "study_id string, screen_id string, contrast_id string, phenotype_direction string, gene_symbol string, target double, score double")


def test_ties_in_ap_and_ndcg(spark):
    rows = [("A", "s", "c", "r", f"g{i}", t, s) for i, (t, s) in enumerate([(1.0, 0.9), (0.0, 0.9), (1.0, 0.5), (0.0, 0.1)])]
    df = _frame(spark, rows)
    (ap,) = [r["ap"] for r in G.average_precision(df, Q).collect()]
    assert ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    got = {r["metric"]: r["value"] for r in G.ranking_metrics(df, Q, "study_id", tie=("gene_symbol",)).collect()}
    dcg = 0.5 * (1 + 1 / math.log2(3)) + 1 / math.log2(4)
    assert got["ndcg_at_5"] == pytest.approx(dcg / (1 + 1 / math.log2(3)))
    assert len(got) == 61 and got["n_labeled"] == 4 and got["precision_at_5"] == 0.5


def test_no_labels(spark):
    with pytest.raises(ValueError, match="no labeled"):
        G.ranking_metrics(_frame(spark, [("A", "s", "c", "r", "g", None, 0.5)]), Q, "study_id")


def test_query_in_two_studies(spark):
    rows = [("A", "s", "c", "r", "g", 1.0, 0.5), ("B", "s", "c", "r", "h", 0.0, 0.4)]
    with pytest.raises(ValueError, match="nested"):
        G.ranking_metrics(_frame(spark, rows), Q, "study_id")


def test_bootstrap(spark):
    rows = [(st, f"{st}1", "c", "r", f"{st}{i}", float(i % 2), i / 10) for st in "ABC" for i in range(6)]
    out = {r["metric"]: r for r in cluster_bootstrap(_frame(spark, rows), "study_id", Q, n_bootstrap=50).collect()}
    assert out["_valid_draws"]["effective_draws"] == 50
    got = out["study_macro_average_precision"]
    assert got["lower"] <= got["median"] <= got["upper"] and got["interval_available"] == 1
    with pytest.raises(ValueError, match="binary"):
        cluster_bootstrap(_frame(spark, [r[:5] + (1.0,) + r[6:] for r in rows]), "study_id", Q)
    with pytest.raises(ValueError, match="two studies"):
        cluster_bootstrap(_frame(spark, rows[:6]), "study_id", Q)


def test_registered_bootstrap_has_all_draws(spark):
    from assayline.plans.ranking_queries import g12_cluster_bootstrap

    out = {r["metric"]: r for r in g12_cluster_bootstrap(spark, "/root/testdata/sf0.001").collect()}
    assert out["_requested_draws"]["effective_draws"] == out["_valid_draws"]["effective_draws"] == 1000
