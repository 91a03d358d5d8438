import pytest

from assayline.functions.graph import connected_components
from assayline.operators import labels as L
from assayline.operators.families import study_families
from pyspark.sql import functions as F


@pytest.mark.parametrize(("codes", "want"), [(["V2", "F0"], "A"), (["V2", "V3"], "V3"), (["T", "A"], "T"), (["D", "V1"], "D"), (["U"], "U"), ([None], "U")])
def test_resolution(spark, codes, want):
    df = spark.createDataFrame([(c,) for c in codes], "label_code string")
    assert df.agg(L.resolve_labels(F.col("label_code"))).first()[0] == want


def test_adjudication_drops_null_keys(spark):
    rows = [("S", "C", "G", "resistance", "V2"), ("S", "C", "G", "resistance", "V3"), ("S", "C", None, "resistance", "V3")]
    df = spark.createDataFrame(rows, "screen_id string, contrast_id string, gene_symbol string, phenotype_direction string, label_code string")
    (row,) = L.adjudicate_events(df).collect()
    assert (row["label_code"], row["n_events"]) == ("V3", 2)
    with pytest.raises(ValueError, match="missing"):
        L.adjudicate_events(df.drop("gene_symbol"))
    with pytest.raises(ValueError, match="unknown label"):
        L.check_labels(df.withColumn("label_code", F.lit("X9")), "label_code")


def test_families_are_transitive(spark):
    rows = [("s1", "f1", None), ("s2", "f1", "r1"), ("s3", None, "r1"), ("s4", " ", None)]
    df = spark.createDataFrame(rows, "study_id string, source_family_id string, raw_data_family_id string")
    got = {r["study_id"]: r["family_group"] for r in study_families(df).collect()}
    assert got["s1"] == got["s2"] == got["s3"] != got["s4"]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500
    assert connected_components(df.limit(0)).count() == 0
