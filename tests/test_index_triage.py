import pytest

from assayline.operators import external_index as X, triage as T
from assayline.sources import delimited as D

HEAD = ["#SCREEN ID", "SOURCE ID", "SOURCE TYPE", "ORGANISM OFFICIAL", "LIBRARY TYPE", "METHODOLOGY", "EXPERIMENTAL SETUP", "SCREEN FORMAT", "CONDITION NAME", "CELL LINE", "CONDITION DOSAGE", "MOI"]


def _index(spark, *rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HEAD)).coalesce(1)


ROWS = [
    ("1", "9", "pubmed", "Homo sapiens", "CRISPRn", "Knockout", "Drug Exposure", "Pool", "drug", "A375", "50.0 nM", "~ 0.3"),
    ("2", "9", "pubmed", "Mus musculus", "CRISPRn", "Knockout", "Drug Exposure", "Pool", "drug", "A375", "50 μM", "0.3"),
    ("3", "-", "pubmed", "Homo sapiens", "CRISPRn", "Knockout", "Toxin Exposure", "Pool", "tox", "A375", "-", "-"),
    ("4", "8", "pubmed", "Homo sapiens", "CRISPRi", "Inhibition", "Drug Exposure", "Pool", "drug", "A375", "5nM", "1."),
]


def test_index(spark):
    found = X.parse_index(_index(spark, *ROWS), release="1.1", retrieved="2026-07-30")
    screens = {r["screen_id"]: r for r in found.screens.collect()}
    first = screens["orcs:1.1:screen:1"]
    assert (first["treatment_dose"], first["treatment_unit"], first["raw_data_family_id"]) == (50.0, "nM", None)
    assert screens["orcs:1.1:screen:2"]["treatment_unit"] == "µM" and screens["orcs:1.1:screen:4"]["treatment_dose"] is None
    assert screens["orcs:1.1:screen:3"]["study_id"].endswith("provisional-screen:3") and screens["orcs:1.1:screen:3"]["drug_name"] is None
    assert found.studies.count() == 3 and found.contrasts.count() == 4
    moi = {r["screen_id"][-1]: r["library_moi"] for r in found.designs.collect()}
    assert moi == {"1": None, "2": 0.3, "3": None, "4": 1.0}
    with pytest.raises(ValueError, match="repeats"):
        X.parse_index(_index(spark, ROWS[0], ROWS[0]), release="1", retrieved="2026-07-30")
    with pytest.raises(ValueError, match="release"):
        X.parse_index(_index(spark, *ROWS), release=" ", retrieved="2026-07-30")


def test_headers(spark):
    assert D.normalize_header("﻿#Dataset-ID ") == "external_dataset_id"
    with pytest.raises(ValueError, match="alike"):
        D.normalize_table(spark.createDataFrame([("a", "b")], ["X Y", "x_y"]))
    with pytest.raises(ValueError, match="empty header"):
        D.normalize_header("#")


def test_triage(spark):
    out = T.triage_index(_index(spark, *ROWS), release="1.1", retrieved="2026-07-30")
    status = {r["external_screen_id"]: (r["status"], r["reason_codes"]) for r in out.intake.collect()}
    assert {k: v[0] for k, v in status.items()} == {"1": "metadata_only", "2": "exclude", "3": "metadata_only", "4": "exclude"}
    assert status["2"][1] == "scope.organism_human" and status["4"][1] == "scope.perturbation_crispr_ko"
    assert out.checks.count() == 4 * 14 and {r[0] for r in out.candidates.collect()} == {"1", "3"}


def test_decisions(spark):
    def decide(stage, outcomes):
        rows = [("i", r, stage, o) for r, o in outcomes]
        return T.decide(spark.createDataFrame(rows, "intake_id string, rule_id string, assessment_stage string, outcome string"), stage).collect()[0]

    from assayline.operators.registry import BENCHMARK_RULES

    every = [(r, "pass") for r in BENCHMARK_RULES]
    assert decide("curated", every)["status"] == "benchmark_ready"
    assert decide("index", every)["reason_codes"] == "full_text_curation_required"
    assert decide("curated", every[:-1])["reason_codes"].startswith("missing:")
    assert decide("curated", [*every[:-1], (every[-1][0], "unknown")])["reason_codes"] == every[-1][0]
    assert decide("curated", [(every[0][0], "fail"), *every[1:]])["status"] == "exclude"
    with pytest.raises(Exception, match="duplicate"):
        decide("curated", [*every, every[0]])
    with pytest.raises(ValueError, match="policy"):
        T.decide(spark.createDataFrame([], "intake_id string"), "index", 9)


def test_scores(spark):
    raw = spark.createDataFrame(
        [("1", "A", "0.5", "2", "YES"), ("1", "B", "-", "x", "NO"), ("1", "C", "-", "-", "N/A"), ("-", "D", "1", "1", "NO"), ("1", "", "1", "1", "odd")],
        "`#SCREEN_ID` string, OFFICIAL_SYMBOL string, `SCORE.1` string, `SCORE.2` string, HIT string",
    ).coalesce(1)
    found = X.parse_scores(raw, release="1")
    scores = sorted((r["gene_symbol"], r["analysis_tail"], r["score"], r["author_hit"]) for r in found.gene_scores.collect())
    assert scores == [("A", "orcs_score_1", 0.5, True), ("A", "orcs_score_2", 2.0, True), ("B", "orcs_author_hit", None, False)]
    issues = sorted((r["row_number"], r["field"]) for r in found.issues.collect())
    assert issues == [(3, "score_2"), (4, "score/hit"), (5, "screen_id"), (6, "official_symbol")]


def test_gene_summary(spark):
    df = spark.createDataFrame([("G", 0.1, 0.2, 0.3, 0.4)], ["id", "pos|score", "pos|fdr", "neg|score", "neg|fdr"])
    got = sorted((r["analysis_tail"], r["score"], r["fdr"], r["direction"]) for r in X.summary_scores(df, "S", "C").collect())
    assert got == [("mageck_neg", 0.3, 0.4, "unknown"), ("mageck_pos", 0.1, 0.2, "unknown")]


def test_files(spark, tmp_path):
    D.write_tables({"a": spark.createDataFrame([("1", "x")], ["k", "v"])}, str(tmp_path), {"K": "k"})
    assert D.read_table(spark, f"{tmp_path}/a.tsv").collect()[0]["v"] == "x"
    (tmp_path / "raw.tsv").write_text("A\tB\n-\t\nNA\t2\n")
    assert [tuple(r) for r in D.read_lossless(spark, str(tmp_path / "raw.tsv")).collect()] == [("-", ""), ("NA", "2")]
    with pytest.raises(ValueError, match="suffix"):
        D.read_table(spark, "x.parquet")


def test_an_index_is_decided_row_by_row_as_from_its_checks(spark):
    """No shuffle brings an intake's checks together again; the general reducer agrees."""
    out = T.triage_index(_index(spark, *ROWS), release="1.1", retrieved="2026-07-30")
    names = ["intake_id", "status", "candidate_for_full_curation", "benchmark_ready", "reason_codes"]
    assert sorted(map(tuple, out.intake.select(names).collect())) == sorted(map(tuple, T.decide(out.checks, "index").select(names).collect()))
    assert "Aggregate" not in out.intake._jdf.queryExecution().sparkPlan().toString()
