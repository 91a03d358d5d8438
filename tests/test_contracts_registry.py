import pytest

from assayline.operators import contracts, registry
from assayline.sources.schemas import CONTRACTS

EVENT = {
    "event_id": "E", "study_id": "S", "gene_symbol": "G", "drug_name": "d", "cell_line": "c", "perturbation_modality": "CRISPR_KO",
    "phenotype_direction": "resistance", "label_code": "V2", "testing_status": "tested", "perturbation_confirmed": "true",
    "phenotype_reproduced": "true", "opposite_direction_reproduced": None, "appropriate_control": "true", "independent_reagent_count": "2",
    "source_url": "https://example.org", "source_locator": "table",
}


def _errors(spark, contract, *rows):
    names = list(rows[0])
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names)).coalesce(1)
    valid, errors = contracts.validate(df, contract)
    return valid.count(), {(r["row_number"], r["error"]) for r in errors.collect()}


def test_field_counts():
    want = {"study": 13, "screen": 26, "library": 15, "guide_annotation": 13, "screen_design": 37, "contrast": 25, "external_screen_map": 11, "screen_intake": 14,
            "eligibility_check": 13, "design_provenance": 19, "sample": 23, "gene_score": 19, "validation_event": 37, "candidate": 7, "evidence": 19, "data_asset": 14}
    assert {c: len(contracts.fields_of(c)) for c in CONTRACTS} == want


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None),
        ({"opposite_direction_reproduced": "true"}, "both_directions"),
        ({"independent_reagent_count": "1"}, "validated_without_support"),
        ({"phenotype_reproduced": None}, "validated_without_support"),
        ({"label_code": "V3"}, "v3_without_rescue"),
        ({"label_code": "F0", "assay_adequate": "true", "phenotype_reproduced": None}, "f0_without_failure"),
        ({"label_code": "D", "phenotype_reproduced": "false"}, "d_without_opposite"),
        ({"label_code": "U", "testing_status": "not_tested"}, "u_with_outcome"),
        ({"label_code": "V1", "testing_status": "unknown"}, "label_but_not_tested"),
    ],
)
def test_event_rules(spark, change, rule):
    n, errors = _errors(spark, "validation_event", {"assay_adequate": None} | EVENT | change)
    assert (n, {e for _, e in errors}) == (1, set()) if rule is None else (2, f"rule:{rule}") in errors


def test_keys_columns_and_numbers(spark):
    a = {"library_id": "L", "library_name": "n", "perturbation_modality": "CRISPR_KO"}
    assert _errors(spark, "library", a, a) == (0, {(2, "duplicate_key"), (3, "duplicate_key")})
    assert _errors(spark, "library", {"library_id": "L"})[1] == {(1, "missing_columns:library_name|perturbation_modality")}
    assert _errors(spark, "library", a | {"odd": "x"})[1] == {(2, "unknown_column:odd")}
    assert _errors(spark, "library", a | {"target_gene_count": "1.5", "expected_guides_per_gene": "0"})[1] == {
        (2, "target_gene_count:not_int"), (2, "expected_guides_per_gene:out_of_range"),
    }
    assert _errors(spark, "library", a | {"perturbation_modality": "x", "reference_url": "ftp://a"})[1] == {
        (2, "perturbation_modality:not_in_vocabulary"), (2, "reference_url:not_url"),
    }
    empty = spark.createDataFrame([], "library_id string, library_name string, perturbation_modality string")
    assert contracts.validate(empty, "library")[1].collect()[0]["error"] == "empty_table"


def test_dates(spark):
    row = {"mapping_id": "m", "screen_id": "s", "source_name": "n", "source_version": "v", "external_screen_id": "1", "relationship": "r"}
    assert _errors(spark, "external_screen_map", row | {"retrieved_date": "2026-07-30"})[0] == 1
    assert _errors(spark, "external_screen_map", row | {"retrieved_date": "2026-07-30 00:00:00"})[0] == 1
    for odd in ("2026-7-3", "2026-02-30", "soon", "2024-01-15garbage", "2024-01-15T23:59:00", "x2024-01-15"):
        assert _errors(spark, "external_screen_map", row | {"retrieved_date": odd})[1] == {(2, "retrieved_date:not_date")}


def test_registry(spark):
    studies = spark.createDataFrame([("s1",)], "study_id string")
    screens = spark.createDataFrame([("a", "s1"), ("b", "gone"), ("c", None)], "screen_id string, study_id string").coalesce(1)
    samples = spark.createDataFrame([("s1", "a", "k"), ("s1", None, "k"), ("s1", "zz", "k"), ("s1", "a", None)], "study_id string, screen_id string, contrast_id string").coalesce(1)
    got = {(r["table"], r["row_number"], r["error"]) for r in registry.registry_errors({"study": studies, "screen": screens, "sample": samples}).collect()}
    assert got == {("screen", 3, "unknown_study_id"), ("screen", 4, "unknown_study_id"), ("sample", 4, "unknown_screen_id")}
    contrasts = spark.createDataFrame([("a", "k")], "screen_id string, contrast_id string")
    tables = {"study": studies, "screen": screens, "sample": samples, "contrast": contrasts}
    got = {(r["row_number"], r["error"]) for r in registry.registry_errors(tables).where("error like 'unknown_screen_id_contrast%'").collect()}
    assert got == {(3, "unknown_screen_id_contrast_id"), (4, "unknown_screen_id_contrast_id"), (5, "unknown_screen_id_contrast_id")}


_CHECK = "row_number long, intake_id string, screen_id string, assessment_stage string, rule_id string, outcome string, required_for_scope boolean, required_for_benchmark boolean"
_INTAKE = "row_number long, intake_id string, screen_id string, assessment_stage string, status string, policy_version int"


def _policy(spark, checks, status="benchmark_ready", version=2, intakes=()):
    intake = spark.createDataFrame([(2, "I", "S", "curated", status, version), *intakes], _INTAKE)
    rows = [(i, c.get("intake", "I"), c.get("screen", "S"), c.get("stage", "curated"), c["rule"], c.get("outcome", "pass"), c.get("scope", c["rule"] in registry.SCOPE_RULES), c.get("bench", True)) for i, c in enumerate(checks, 2)]
    return sorted((r["table"][:6], r["row_number"], r["error"]) for r in registry.check_policy(intake, spark.createDataFrame(rows, _CHECK)).collect())


def test_policy_of_ready_intakes(spark):
    every = [{"rule": r} for r in registry.BENCHMARK_RULES]
    assert _policy(spark, every) == []
    assert _policy(spark, every[1:]) == [("screen", 2, "ready_without_every_rule")]
    # A rule given twice is there, but not passed.
    assert _policy(spark, [*every, every[5]]) == [("eligib", 7, f"repeated_rules:{registry.BENCHMARK_RULES[5]}"), ("screen", 2, "ready_with_unpassed_rule")]
    assert _policy(spark, [*every[:-1], every[-1] | {"outcome": None}]) == [("screen", 2, "ready_with_unpassed_rule")]
    assert _policy(spark, [*every[:-1], every[-1] | {"outcome": "fail"}]) == [("screen", 2, "ready_with_unpassed_rule")]
    # A check of another screen or stage isn't counted; what is missing and what isn't passed are two errors.
    assert _policy(spark, [every[0] | {"screen": "T"}, every[1] | {"stage": None}, *every[2:-1], every[-1] | {"outcome": "unknown"}]) == [
        ("eligib", 2, "screen_differs_from_intake"), ("eligib", 3, "stage_differs_from_intake"),
        ("screen", 2, "ready_with_unpassed_rule"), ("screen", 2, "ready_without_every_rule"),
    ]
    assert _policy(spark, []) == [("screen", 2, "ready_without_every_rule")]


def test_policy_of_other_intakes(spark):
    scope = [{"rule": r} for r in registry.SCOPE_RULES]
    failed = [scope[0] | {"outcome": "fail"}, *scope[1:]]
    assert _policy(spark, failed, "metadata_only") == [("screen", 2, "failed_scope_not_excluded")]
    assert _policy(spark, failed, None) == [("screen", 2, "failed_scope_not_excluded")]
    assert _policy(spark, failed, "exclude") == []
    assert _policy(spark, scope, "exclude") == [("screen", 2, "excluded_without_failed_scope")]
    # A failed rule that is repeated doesn't count as failed.
    assert _policy(spark, [*failed, failed[0]], "exclude") == [("eligib", 2, f"repeated_rules:{registry.SCOPE_RULES[0]}"), ("screen", 2, "excluded_without_failed_scope")]
    # Both flags wrong, or null where they should be set, is one error a row.
    assert _policy(spark, [scope[0] | {"scope": None, "bench": None}], "metadata_only") == [("eligib", 2, "rule_flags_differ_from_policy")]
    assert _policy(spark, [{"rule": "own.rule", "bench": None}], "metadata_only") == []
    assert _policy(spark, scope, "exclude", version=1) == [("screen", 2, "unsupported_policy")]
    assert _policy(spark, [scope[0] | {"intake": "J"}], "metadata_only", version=None) == [("eligib", 2, "unknown_intake_id"), ("screen", 2, "unsupported_policy")]
    # Of intake rows with one id the last counts.
    assert _policy(spark, scope, "exclude", intakes=[(3, "I", "S", "curated", "metadata_only", 2)]) == []
