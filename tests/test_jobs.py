"""Jobs from files to files."""

import json

import pytest

from assayline.plans import jobs


def _csv(folder, name, header, rows, sep=","):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write("\n".join(sep.join(map(str, r)) for r in [header, *rows]) + "\n")
    return path


def test_validate_job(spark, tmp_path):
    path = _csv(tmp_path, "libraries.csv", ["library_id", "library_name", "perturbation_modality"], [("L1", "one", "CRISPR_KO"), ("L2", "", "odd")])
    assert jobs.validate_job(spark, path, "library", f"{tmp_path}/report") == 2
    errors = {r["error"] for r in spark.read.json(f"{tmp_path}/report").collect()}
    assert errors == {"library_name:missing", "perturbation_modality:not_in_vocabulary"}


def test_feature_jobs(spark, tmp_path):
    counts = _csv(tmp_path, "counts.csv", ["sgrna_id", "gene_symbol", "c1", "t1"], [("a1", "A", 100, 400), ("a2", "A", 90, 300), ("b1", "B", 200, 40), ("b2", "B", 220, 60)])
    sheet = _csv(tmp_path, "sheet.csv", ["sample_id", "screen_id", "contrast_id", "condition_role", "replicate"], [("c1", "S", "K", "control", 1), ("t1", "S", "K", "treatment", 1)])
    jobs.featurize_counts_job(spark, counts, sheet, f"{tmp_path}/genes.tsv", method="cpm")
    got = {r["gene_symbol"]: r for r in spark.read.csv(f"{tmp_path}/genes.tsv", sep="\t", header=True).collect()}
    assert got["A"]["signal_direction"] == "resistance" and got["B"]["signal_direction"] == "sensitization" and got["A"]["normalization_method"] == "cpm"
    screens = _csv(tmp_path, "screens.csv", ["screen_id", "study_id"], [("S", "ST")])
    designs = _csv(tmp_path, "designs.csv", ["screen_id", "library_moi"], [("S", 0.3)])
    contrasts = _csv(tmp_path, "contrasts.csv", ["screen_id", "contrast_id", "control_type"], [("S", "K", "vehicle")])
    jobs.featurize_design_job(spark, screens, designs, contrasts, sheet, f"{tmp_path}/design.csv")
    (row,) = spark.read.csv(f"{tmp_path}/design.csv", header=True).collect()
    assert (row["library_moi"], row["control_type_vehicle"], row["control_sample_n"]) == ("0.3", "1.0", "1")


def test_index_and_triage_jobs(spark, tmp_path):
    header = ["#SCREEN ID", "SOURCE ID", "Organism_Official", "Library Type", "Experimental Setup", "Screen Format"]
    rows = [("1", "77", "Homo sapiens", "CRISPRn", "Drug Exposure", "Pool"), ("2", "-", "Mus musculus", "CRISPRn", "Drug Exposure", "Pool")]
    path = _csv(tmp_path, "index.tsv", header, rows, "\t")
    jobs.ingest_index_job(spark, path, f"{tmp_path}/index", "1.0", "2024-01-02")
    screens = spark.read.csv(f"{tmp_path}/index/screens.tsv", sep="\t", header=True)
    assert screens.count() == 2 and spark.read.csv(f"{tmp_path}/index/raw.tsv", sep="\t", header=True).count() == 2
    assert json.loads(spark.read.text(f"{tmp_path}/index/header_map.json").first()[0])["#SCREEN ID"] == "screen_id"
    summary = jobs.triage_job(spark, path, f"{tmp_path}/triage", "1.0", "2024-01-02")
    assert summary["total_screens"] == 2 and summary["candidates"] == 1 and summary["failed:scope.organism_human"] == 1
    assert [r[0] for r in spark.read.text(f"{tmp_path}/triage/candidates.txt").collect()] == ["1"]
    assert spark.read.csv(f"{tmp_path}/triage/eligibility_checks.tsv", sep="\t", header=True).count() == 28
    scores = _csv(tmp_path, "scores.tsv", ["#SCREEN_ID", "OFFICIAL_SYMBOL", "SCORE.1", "HIT"], [("1", "TP53", "0.5", "YES"), ("1", "MYC", "odd", "maybe")], "\t")
    assert jobs.ingest_scores_job(spark, scores, f"{tmp_path}/scores", "1.0", path) == 3
    assert spark.read.csv(f"{tmp_path}/scores/gene_scores.tsv", sep="\t", header=True).count() == 1


def test_benchmark_job_takes_one_choice_of_features(spark, tmp_path):
    with pytest.raises(ValueError, match="either"):
        jobs.benchmark_job(spark, f"{tmp_path}/x.csv", f"{tmp_path}/y.csv")
