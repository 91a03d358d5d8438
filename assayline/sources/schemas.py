"""The sixteen table contracts: fields, keys, vocabularies and cross-field rules, as declarations."""

from __future__ import annotations

from dataclasses import dataclass

# Closed vocabularies.
ENUMS = {
    "modality": ("CRISPR_KO", "CRISPRa", "CRISPRi", "RNAi", "overexpression", "mutation", "inhibitor", "other"),
    "direction": ("resistance", "sensitization", "neutral", "discordant", "unknown"),
    "sample_role": ("control", "treatment", "baseline"),
    "testing": ("tested", "not_tested", "unknown"),
    "source_role": ("original_screen", "protocol", "reanalysis", "validation_only", "review", "other"),
    "scale": ("genome_wide", "targeted", "saturation", "other", "unknown"),
    "selection": (
        "positive_selection", "negative_selection", "bidirectional_selection", "competitive_growth", "marker_sort", "other", "unknown",
    ),
    "control_type": (
        "vehicle", "untreated", "baseline_t0", "later_timepoint", "sorted_population", "matched_nontargeting", "other", "unknown",
    ),
    "schedule": ("continuous", "pulse", "intermittent", "repeated_dose", "other", "unknown"),
    "replicate_unit": ("independent_infection", "biological_culture", "technical_split", "unknown"),
    "intake_status": ("benchmark_ready", "metadata_only", "exclude"),
    "stage": ("index", "curated"),
    "outcome": ("pass", "fail", "unknown"),
    "label": ("V3", "V2", "V1", "F0", "D", "A", "T", "U"),
}


@dataclass(frozen=True)
class Field:
    """``kind``: str, int, float, bool, date, url or enum; ``need``: required, nullable or default; ``limits``: what a number has to be."""

    name: str
    kind: str
    need: str = "nullable"
    default: str | None = None
    vocabulary: str | None = None
    limits: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Contract:
    """``rules``: what must hold of a valid row, by name, as SQL over the typed fields."""

    key: tuple[str, ...]
    fields: tuple[Field, ...]
    rules: tuple[tuple[str, str], ...] = ()


_DOSE = ("dose_without_unit", "treatment_dose is null or coalesce(treatment_unit, '') <> ''")


def _is(column: str) -> str:
    return f"({column} <=> true)"


_NOT_U = "label_code <> 'U'"
_TESTED = "testing_status = 'tested'"

# Fields, keys and limits of each table.
CONTRACTS = {
    "study": Contract(
        ("study_id",),
        (
            Field("study_id", "str", need="required"),
            Field("citation", "str", need="required"),
            Field("doi", "str"),
            Field("publication_date", "date"),
            Field("organism", "str", need="default", default="human"),
            Field("source_url", "url"),
            Field("data_license", "str"),
            Field("source_role", "enum", need="default", default="original_screen", vocabulary="source_role"),
            Field("independent_screen_source", "bool", need="default", default="true"),
            Field("source_id", "str"),
            Field("source_type", "str"),
            Field("pubmed_id", "str"),
            Field("notes", "str"),
        ),
        (("derived_source_is_independent", "not (source_role in ('protocol', 'reanalysis', 'review') and independent_screen_source)"),),
    ),
    "screen": Contract(
        ("screen_id",),
        (
            Field("screen_id", "str", need="required"),
            Field("study_id", "str", need="required"),
            Field("source_family_id", "str"),
            Field("raw_data_family_id", "str"),
            Field("perturbation_modality", "enum", need="required", vocabulary="modality"),
            Field("screen_design", "str", need="required"),
            Field("cell_line", "str", need="required"),
            Field("depmap_id", "str"),
            Field("cellosaurus_id", "str"),
            Field("engineered_genotype", "str"),
            Field("cancer_type", "str"),
            Field("library_id", "str"),
            Field("drug_name", "str"),
            Field("drug_id", "str"),
            Field("drug_class", "str"),
            Field("library_name", "str"),
            Field("library_version", "str"),
            Field("treatment_dose", "float", limits=((">=", 0),)),
            Field("treatment_unit", "str"),
            Field("duration_days", "float", limits=((">=", 0),)),
            Field("intended_direction", "enum", need="default", default="unknown", vocabulary="direction"),
            Field("input_mode", "str"),
            Field("data_accession", "str"),
            Field("source_url", "url"),
            Field("available_date", "date"),
            Field("notes", "str"),
        ),
        (_DOSE,),
    ),
    "library": Contract(
        ("library_id",),
        (
            Field("library_id", "str", need="required"),
            Field("library_name", "str", need="required"),
            Field("library_version", "str"),
            Field("perturbation_modality", "enum", need="required", vocabulary="modality"),
            Field("library_scope", "enum", need="default", default="unknown", vocabulary="scale"),
            Field("target_gene_count", "int", limits=((">=", 1),)),
            Field("total_guide_count", "int", limits=((">=", 1),)),
            Field("expected_guides_per_gene", "float", limits=((">", 0),)),
            Field("nontargeting_guide_count", "int", limits=((">=", 0),)),
            Field("vector_architecture", "str"),
            Field("enzyme", "str"),
            Field("guide_target_region", "str"),
            Field("reference_url", "url"),
            Field("source_locator", "str"),
            Field("notes", "str"),
        ),
    ),
    "guide_annotation": Contract(
        ("library_id", "sgrna_id"),
        (
            Field("library_id", "str", need="required"),
            Field("sgrna_id", "str", need="required"),
            Field("gene_symbol", "str", need="required"),
            Field("targeting_class", "str", need="required"),
            Field("sequence", "str"),
            Field("chromosome", "str"),
            Field("cut_position", "int", limits=((">=", 0),)),
            Field("multi_target_count", "int", limits=((">=", 0),)),
            Field("activity_score", "float"),
            Field("specificity_score", "float"),
            Field("annotation_source", "str"),
            Field("annotation_version", "str"),
            Field("notes", "str"),
        ),
    ),
    "screen_design": Contract(
        ("screen_id",),
        (
            Field("screen_id", "str", need="required"),
            Field("source_role", "enum", need="default", default="original_screen", vocabulary="source_role"),
            Field("parent_screen_id", "str"),
            Field("screen_scale", "enum", need="default", default="unknown", vocabulary="scale"),
            Field("screen_format", "str"),
            Field("experimental_setup", "str"),
            Field("selection_strategy", "enum", need="default", default="unknown", vocabulary="selection"),
            Field("library_type", "str"),
            Field("library_methodology", "str"),
            Field("enzyme", "str"),
            Field("vector_architecture", "str"),
            Field("effector_components", "str"),
            Field("guide_target_region", "str"),
            Field("library_size_guides", "int", limits=((">=", 1),)),
            Field("target_gene_count", "int", limits=((">=", 1),)),
            Field("guides_per_gene_median", "float", limits=((">", 0),)),
            Field("nontargeting_guide_count", "int", limits=((">=", 0),)),
            Field("library_moi", "float", limits=((">=", 0),)),
            Field("effector_moi", "float", limits=((">=", 0),)),
            Field("coverage_transduction", "float", limits=((">=", 0),)),
            Field("coverage_selection", "float", limits=((">=", 0),)),
            Field("coverage_harvest", "float", limits=((">=", 0),)),
            Field("infection_replicate_count", "int", limits=((">=", 1),)),
            Field("replicate_unit", "enum", need="default", default="unknown", vocabulary="replicate_unit"),
            Field("antibiotic_selection_days", "float", limits=((">=", 0),)),
            Field("editing_maturation_days", "float", limits=((">=", 0),)),
            Field("plasmid_reads_per_guide", "float", limits=((">=", 0),)),
            Field("plasmid_zero_guide_fraction", "float", limits=((">=", 0), ("<=", 1),)),
            Field("plasmid_skew_ratio", "float", limits=((">=", 0),)),
            Field("screen_reads_per_guide", "float", limits=((">=", 0),)),
            Field("gdna_fraction_amplified", "float", limits=((">=", 0), ("<=", 1),)),
            Field("pcr_cycle_count", "int", limits=((">=", 0),)),
            Field("cnv_amplification_risk_assessed", "bool"),
            Field("analysis_method", "str"),
            Field("normalization_method", "str"),
            Field("source_locator", "str"),
            Field("notes", "str"),
        ),
        (("reanalysis_without_parent", "source_role <> 'reanalysis' or coalesce(parent_screen_id, '') <> ''"),),
    ),
    "contrast": Contract(
        ("screen_id", "contrast_id"),
        (
            Field("screen_id", "str", need="required"),
            Field("contrast_id", "str", need="required"),
            Field("contrast_name", "str", need="required"),
            Field("treatment_name", "str", need="required"),
            Field("treatment_id", "str"),
            Field("drug_class", "str"),
            Field("treatment_dose", "float", limits=((">=", 0),)),
            Field("treatment_unit", "str"),
            Field("dose_basis", "str"),
            Field("control_type", "enum", need="required", vocabulary="control_type"),
            Field("comparator_name", "str"),
            Field("exposure_schedule", "enum", need="default", default="unknown", vocabulary="schedule"),
            Field("exposure_days", "float", limits=((">=", 0),)),
            Field("recovery_days", "float", limits=((">=", 0),)),
            Field("endpoint_timepoint_days", "float", limits=((">=", 0),)),
            Field("phenotype_endpoint", "str", need="required"),
            Field("intended_direction", "enum", need="required", vocabulary="direction"),
            Field("vehicle_control_present", "bool"),
            Field("baseline_control_present", "bool"),
            Field("same_infection_split", "bool"),
            Field("matched_control", "bool"),
            Field("positive_control_description", "str"),
            Field("negative_control_description", "str"),
            Field("source_locator", "str"),
            Field("notes", "str"),
        ),
        (_DOSE, ("vehicle_without_comparator", "control_type <> 'vehicle' or coalesce(comparator_name, '') <> ''")),
    ),
    "external_screen_map": Contract(
        ("mapping_id",),
        (
            Field("mapping_id", "str", need="required"),
            Field("screen_id", "str", need="required"),
            Field("source_name", "str", need="required"),
            Field("source_version", "str", need="required"),
            Field("external_dataset_id", "str"),
            Field("external_screen_id", "str", need="required"),
            Field("relationship", "str", need="required"),
            Field("replicate_number", "int", limits=((">=", 1),)),
            Field("source_url", "url"),
            Field("retrieved_date", "date", need="required"),
            Field("notes", "str"),
        ),
    ),
    "screen_intake": Contract(
        ("intake_id",),
        (
            Field("intake_id", "str", need="required"),
            Field("screen_id", "str", need="required"),
            Field("external_screen_id", "str"),
            Field("external_dataset_id", "str"),
            Field("source_name", "str", need="required"),
            Field("source_version", "str", need="required"),
            Field("policy_version", "int", need="required", limits=((">=", 1),)),
            Field("assessment_stage", "enum", need="required", vocabulary="stage"),
            Field("status", "enum", need="required", vocabulary="intake_status"),
            Field("candidate_for_full_curation", "bool", need="required"),
            Field("benchmark_ready", "bool", need="required"),
            Field("reason_codes", "str"),
            Field("assessed_date", "date", need="required"),
            Field("notes", "str"),
        ),
        (
            ("index_stage_ready", "not (assessment_stage = 'index' and (benchmark_ready or status = 'benchmark_ready'))"),
            ("ready_flag_differs", "benchmark_ready = (status = 'benchmark_ready')"),
            ("excluded_candidate", "not (status = 'exclude' and candidate_for_full_curation)"),
        ),
    ),
    "eligibility_check": Contract(
        ("check_id",),
        (
            Field("check_id", "str", need="required"),
            Field("intake_id", "str", need="required"),
            Field("screen_id", "str", need="required"),
            Field("assessment_stage", "enum", need="required", vocabulary="stage"),
            Field("rule_id", "str", need="required"),
            Field("outcome", "enum", need="required", vocabulary="outcome"),
            Field("observed_value", "str"),
            Field("normalized_value", "str"),
            Field("required_for_scope", "bool", need="required"),
            Field("required_for_benchmark", "bool", need="required"),
            Field("reason_code", "str", need="required"),
            Field("source_locator", "str", need="required"),
            Field("notes", "str"),
        ),
    ),
    "design_provenance": Contract(
        ("provenance_id",),
        (
            Field("provenance_id", "str", need="required"),
            Field("study_id", "str"),
            Field("screen_id", "str"),
            Field("contrast_id", "str"),
            Field("sample_id", "str"),
            Field("entity_type", "str", need="required"),
            Field("entity_id", "str", need="required"),
            Field("field_name", "str", need="required"),
            Field("reported_value", "str"),
            Field("normalized_value", "str"),
            Field("source_kind", "str", need="required"),
            Field("source_url", "url", need="required"),
            Field("source_locator", "str", need="required"),
            Field("extraction_method", "str", need="required"),
            Field("confidence", "str", need="required"),
            Field("available_date", "date", need="required"),
            Field("retrieved_date", "date", need="required"),
            Field("curator", "str", need="required"),
            Field("notes", "str"),
        ),
        (
            ("no_value", "reported_value is not null or normalized_value is not null"),
            ("retrieved_before_available", "retrieved_date >= available_date"),
        ),
    ),
    "sample": Contract(
        ("sample_id",),
        (
            Field("sample_id", "str", need="required"),
            Field("screen_id", "str", need="required"),
            Field("contrast_id", "str", need="required"),
            Field("condition_role", "enum", need="required", vocabulary="sample_role"),
            Field("sample_subrole", "str"),
            Field("replicate", "int", need="required", limits=((">=", 1),)),
            Field("biological_replicate_id", "str"),
            Field("infection_replicate_id", "str"),
            Field("technical_replicate_id", "str"),
            Field("pair_id", "str"),
            Field("replicate_unit", "enum", need="default", default="unknown", vocabulary="replicate_unit"),
            Field("timepoint_days", "float", limits=((">=", 0),)),
            Field("timepoint_reference", "str"),
            Field("treatment_name", "str"),
            Field("treatment_dose", "float", limits=((">=", 0),)),
            Field("treatment_unit", "str"),
            Field("batch", "str"),
            Field("library_prep_batch", "str"),
            Field("sequencing_batch", "str"),
            Field("cell_count", "int", limits=((">=", 0),)),
            Field("coverage_per_guide", "float", limits=((">=", 0),)),
            Field("fastq_accession", "str"),
            Field("notes", "str"),
        ),
        (("timepoint_without_reference", "timepoint_days is null or coalesce(timepoint_reference, '') <> ''"), _DOSE),
    ),
    "gene_score": Contract(
        ("screen_id", "contrast_id", "gene_symbol", "method", "analysis_tail", "direction", "cnv_corrected"),
        (
            Field("screen_id", "str", need="required"),
            Field("contrast_id", "str", need="required"),
            Field("gene_symbol", "str", need="required"),
            Field("method", "str", need="required"),
            Field("analysis_tail", "str"),
            Field("direction", "enum", need="required", vocabulary="direction"),
            Field("effect", "float"),
            Field("p_value", "float", limits=((">=", 0), ("<=", 1),)),
            Field("fdr", "float", limits=((">=", 0), ("<=", 1),)),
            Field("rank", "float", limits=((">=", 1),)),
            Field("score", "float"),
            Field("author_hit", "bool"),
            Field("score_type", "str"),
            Field("cnv_corrected", "bool", need="default", default="false"),
            Field("correction_method", "str"),
            Field("method_version", "str"),
            Field("source_database", "str"),
            Field("source_screen_id", "str"),
            Field("source_file", "str"),
        ),
        (
            ("corrected_without_method", "not cnv_corrected or coalesce(correction_method, '') <> ''"),
            ("no_result", "coalesce(effect, p_value, fdr, rank, score, cast(author_hit as double)) is not null"),
        ),
    ),
    "validation_event": Contract(
        ("event_id",),
        (
            Field("event_id", "str", need="required"),
            Field("study_id", "str", need="required"),
            Field("screen_id", "str"),
            Field("contrast_id", "str"),
            Field("gene_symbol", "str", need="required"),
            Field("drug_name", "str", need="required"),
            Field("cell_line", "str", need="required"),
            Field("perturbation_modality", "enum", need="required", vocabulary="modality"),
            Field("phenotype_direction", "enum", need="required", vocabulary="direction"),
            Field("label_code", "enum", need="required", vocabulary="label"),
            Field("testing_status", "enum", need="required", vocabulary="testing"),
            Field("perturbation_confirmed", "bool"),
            Field("independent_reagent_count", "int", limits=((">=", 0),)),
            Field("orthogonal_perturbation", "bool"),
            Field("appropriate_control", "bool"),
            Field("assay_adequate", "bool"),
            Field("phenotype_reproduced", "bool"),
            Field("opposite_direction_reproduced", "bool"),
            Field("rescue_performed", "bool"),
            Field("causal_reversal_performed", "bool"),
            Field("effect_size", "float"),
            Field("effect_metric", "str"),
            Field("p_value", "float", limits=((">=", 0), ("<=", 1),)),
            Field("validation_treatment_dose", "float", limits=((">=", 0),)),
            Field("validation_treatment_unit", "str"),
            Field("validation_exposure_days", "float", limits=((">=", 0),)),
            Field("validation_assay_endpoint", "str"),
            Field("validation_control_type", "enum", vocabulary="control_type"),
            Field("validation_biological_replicate_count", "int", limits=((">=", 1),)),
            Field("validation_guide_source", "str"),
            Field("protein_confirmed", "bool"),
            Field("second_model_tested", "bool"),
            Field("source_url", "url", need="required"),
            Field("source_locator", "str", need="required"),
            Field("curator", "str"),
            Field("adjudication_status", "str", need="default", default="single_curator"),
            Field("notes", "str"),
        ),
        (
            ("dose_without_unit", "validation_treatment_dose is null or coalesce(validation_treatment_unit, '') <> ''"),
            ("both_directions", f"not ({_is('phenotype_reproduced')} and {_is('opposite_direction_reproduced')})"),
            (
                "validated_without_support",
                f"label_code not in ('V2', 'V3') or ({_TESTED} and {_is('perturbation_confirmed')} and {_is('phenotype_reproduced')}"
                f" and not {_is('opposite_direction_reproduced')} and {_is('appropriate_control')}"
                f" and (coalesce(independent_reagent_count, 0) >= 2 or {_is('orthogonal_perturbation')}))",
            ),
            ("v3_without_rescue", f"label_code <> 'V3' or {_is('rescue_performed')} or {_is('causal_reversal_performed')}"),
            (
                "f0_without_failure",
                f"label_code <> 'F0' or ({_TESTED} and {_is('perturbation_confirmed')} and {_is('assay_adequate')}"
                f" and (phenotype_reproduced <=> false) and not {_is('opposite_direction_reproduced')})",
            ),
            (
                "d_without_opposite",
                f"label_code <> 'D' or ({_TESTED} and {_is('perturbation_confirmed')} and (phenotype_reproduced <=> false)"
                f" and {_is('opposite_direction_reproduced')})",
            ),
            ("u_but_tested", "label_code <> 'U' or testing_status = 'not_tested'"),
            (
                "u_with_outcome",
                f"label_code <> 'U' or not ({_is('perturbation_confirmed')} or {_is('orthogonal_perturbation')} or {_is('phenotype_reproduced')}"
                f" or {_is('opposite_direction_reproduced')} or {_is('rescue_performed')} or {_is('causal_reversal_performed')}"
                " or coalesce(independent_reagent_count, 0) > 0 or effect_size is not null or p_value is not null)",
            ),
            ("label_but_not_tested", f"label_code = 'U' or {_TESTED}"),
        ),
    ),
    "candidate": Contract(
        ("screen_id", "contrast_id", "gene_symbol", "phenotype_direction"),
        (
            Field("study_id", "str", need="required"),
            Field("screen_id", "str", need="required"),
            Field("contrast_id", "str", need="required"),
            Field("gene_symbol", "str", need="required"),
            Field("phenotype_direction", "enum", need="required", vocabulary="direction"),
            Field("label_code", "enum", need="required", vocabulary="label"),
            Field("testing_status", "enum", need="required", vocabulary="testing"),
        ),
        (("label_status_differ", f"({_NOT_U}) = ({_TESTED})"),),
    ),
    "evidence": Contract(
        ("evidence_id",),
        (
            Field("evidence_id", "str", need="required"),
            Field("source_study_id", "str"),
            Field("source_screen_id", "str"),
            Field("raw_data_family_id", "str"),
            Field("gene_symbol", "str", need="required"),
            Field("evidence_type", "str", need="required"),
            Field("context_type", "str", need="required"),
            Field("context_value", "str", need="required"),
            Field("value_numeric", "float"),
            Field("value_text", "str"),
            Field("source_name", "str", need="required"),
            Field("source_version", "str", need="required"),
            Field("source_url", "url", need="required"),
            Field("source_license", "str"),
            Field("available_date", "date", need="required"),
            Field("retrieved_date", "date", need="required"),
            Field("transformation_id", "str"),
            Field("source_locator", "str"),
            Field("notes", "str"),
        ),
        (("no_value", "value_numeric is not null or coalesce(value_text, '') <> ''"),),
    ),
    "data_asset": Contract(
        ("asset_id",),
        (
            Field("asset_id", "str", need="required"),
            Field("study_id", "str"),
            Field("screen_id", "str"),
            Field("source_name", "str", need="required"),
            Field("source_version", "str", need="required"),
            Field("asset_role", "str", need="required"),
            Field("accession", "str"),
            Field("source_url", "url", need="required"),
            Field("sha256", "str"),
            Field("source_license", "str"),
            Field("redistribution_permitted", "bool"),
            Field("available_date", "date"),
            Field("retrieved_date", "date", need="required"),
            Field("notes", "str"),
        ),
    ),
}
