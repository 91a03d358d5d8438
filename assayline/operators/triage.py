"""Eligibility triage: rule checks for each screen of an index, and a decision from them."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.delimited import text_key
from .external_index import SOURCE, column, parse_index, screen_id
from .registry import POLICIES


class Triage(NamedTuple):
    intake: DataFrame
    checks: DataFrame
    candidates: DataFrame
    summary: DataFrame


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# Terms that decide a check.
_NOT_KNOCKOUT = ("activation", "inhibition", "crispra", "crispri", "base editing", "prime editing")
_NOT_DRUG = ("infection", "pathogen", "virus", "radiation", "hypoxia", "nutrient", "temperature", "genetic interaction")


def _verdict(*cases: tuple[Column, str, str], default: tuple[str, str]) -> Column:
    """A struct of outcome and reason: of the first case that holds, or the default."""
    both = lambda o, r: F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))
    out = F.when(cases[0][0], both(*cases[0][1:]))
    for test, o, r in cases[1:]:
        out = out.when(test, both(o, r))
    return out.otherwise(both(*default))


def organism_check(key: Column) -> Column:
    return _verdict(
        (key.isNull(), "unknown", "organism_unreported"), (key.isin("human", "homo sapiens", "9606"), "pass", "human_scope_confirmed"),
        default=("fail", "non_human_organism"),
    )


def modality_check(text: Column) -> Column:
    return _verdict(
        (_any(text, ("knockout", "crisprn", "crispr ko")), "pass", "crispr_ko_confirmed"), (_any(text, _NOT_KNOCKOUT), "fail", "non_ko_perturbation"),
        default=("unknown", "perturbation_unresolved"),
    )


def setup_check(key: Column) -> Column:
    return _verdict(
        (key.isNull(), "unknown", "experimental_setup_unreported"), (key == "drug exposure", "pass", "drug_exposure_confirmed"),
        (key == "toxin exposure", "unknown", "toxin_or_drug_exposure_requires_curation"), (_any(key, _NOT_DRUG), "fail", "non_drug_primary_setup"),
        default=("unknown", "drug_exposure_unresolved"),
    )


def format_check(key: Column) -> Column:
    return _verdict(
        (key.isNull(), "unknown", "screen_format_unreported"), (key.isin("pool", "pooled"), "pass", "pooled_screen_confirmed"),
        (key.isin("array", "arrayed"), "fail", "arrayed_screen_out_of_scope"), default=("unknown", "screen_format_unresolved"),
    )


def _check(rule: str, verdict: Column, observed: Column, normalized: Column, scope: bool, benchmark: bool) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"), verdict.alias("v"), observed.cast("string").alias("observed_value"), normalized.cast("string").alias("normalized_value"),
        F.lit(scope).alias("required_for_scope"), F.lit(benchmark).alias("required_for_benchmark"),
    )


#: The columns that checks compare as text keys.
_KEYED = ("library_type", "library_methodology", "experimental_setup", "screen_format", "full_size_available")


def with_keys(table: DataFrame, organism_scope: str | None = None) -> DataFrame:
    """A normalized index row with each text key computed once, as ``_key_<column>``, and what the checks derive from them."""
    c = lambda name: column(table, name)
    organism = F.coalesce(c("organism_official"), F.lit(organism_scope))
    keyed = table.withColumns({f"_key_{n}": text_key(c(n)) for n in _KEYED} | {"_organism": organism, "_key_organism": text_key(organism)})
    return keyed.withColumns({
        "_kind": F.nullif(F.concat_ws(" | ", "_key_library_type", "_key_library_methodology"), F.lit("")),
        "_kind_words": F.concat_ws(" ", "_key_library_type", "_key_library_methodology"), "_setup": setup_check(F.col("_key_experimental_setup")),
    })


def index_checks(table: DataFrame) -> Column:
    """The array of all rule checks of one row of ``with_keys``."""
    c = lambda name: column(table, name)
    key = lambda name: F.col(f"_key_{name}")
    none = F.lit(None).cast("string")
    fixed = lambda o, r: F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))
    organism, kind, setup = F.col("_organism"), F.col("_kind"), F.col("_setup")
    drug = c("condition_name")
    named = drug.isNotNull() & (F.col("_setup.outcome") == "pass")
    full = key("full_size_available")
    source = c("source_id")
    return F.array(
        _check("scope.organism_human", organism_check(key("organism")), organism, key("organism"), True, True),
        _check("scope.perturbation_crispr_ko", modality_check(F.col("_kind_words")), kind, kind, True, True),
        _check("scope.drug_exposure", setup, c("experimental_setup"), key("experimental_setup"), True, True),
        _check("scope.pooled_format", format_check(key("screen_format")), c("screen_format"), key("screen_format"), True, True),
        _check("metadata.identifiable_drug", _verdict(
            (named, "pass", "drug_name_confirmed_in_drug_exposure"), (drug.isNotNull(), "unknown", "condition_name_requires_drug_exposure_curation"),
            default=("unknown", "drug_name_unreported")), drug, F.when(named, drug), False, True),
        _check("metadata.identifiable_cell_context", _verdict(
            (c("cell_line").isNotNull(), "pass", "cell_line_reported"), default=("unknown", "cell_context_unreported")), c("cell_line"), c("cell_line"), False, True),
        _check("metadata.gene_level_mapping", fixed("pass", "gene_level_mapping_available"), F.lit("ORCS standardized per-screen gene scores"), F.lit("orcs_gene_scores"), False, True),
        _check("metadata.full_gene_score_set", _verdict(
            (full.isin("yes", "true", "1"), "pass", "full_orcs_score_set_available"), (full.isin("no", "false", "0"), "unknown", "orcs_score_set_incomplete"),
            default=("unknown", "orcs_score_completeness_unreported")), c("full_size_available"), full, False, False),
        _check("curation.comparator_and_sample_map", fixed("unknown", "comparator_sample_map_unresolved"), none, none, False, True),
        _check("data.count_level_signal", fixed("unknown", "count_level_data_unresolved"), none, none, False, True),
        _check("provenance.source_family", _verdict(
            (source.isNotNull(), "unknown", "source_family_provisional_from_source_id"),
            default=("unknown", "source_family_unresolved_missing_source_id")), source, source, False, True),
        _check("provenance.raw_data_family", fixed("unknown", "raw_data_family_unresolved"), none, none, False, True),
        _check("rights.source_and_raw_data", fixed("unknown", "source_raw_rights_unresolved"), none, none, False, True),
        _check("labels.adjudicated_validation_event", fixed("unknown", "validation_events_unreviewed"), none, none, False, True),
    )


def decide(checks: DataFrame, stage: str, policy_version: int = 2) -> DataFrame:
    """``(intake_id, status, candidate_for_full_curation, benchmark_ready, reason_codes)`` from each intake's checks.

    A failed scope rule excludes; otherwise a screen of the index stage is metadata
    only, and a curated one is ready if every benchmark rule is there and passed. Checks
    of another stage, repeated rules and an unsupported policy are errors.
    """
    if policy_version not in POLICIES:
        raise ValueError(f"unsupported policy_version {policy_version}")
    if stage not in ("index", "curated"):
        raise ValueError(f"unknown stage {stage!r}")
    scope, bench = (sorted(x) for x in POLICIES[policy_version])
    # Flags, not texts, are brought together, which needs no sort.
    by_rule = checks.groupBy("intake_id", "rule_id").agg(
        F.count("*").alias("n"), F.max((F.col("assessment_stage") != stage).cast("int")).alias("other"),
        F.max(F.col("outcome") == "fail").alias("fails"), F.max(F.col("outcome") != "pass").alias("open"),
    )
    wrong = (
        F.when(F.col("other") == 1, F.raise_error(F.lit("a check's assessment_stage differs from the reducer's stage")))
        .when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate checks for rule "), "rule_id"))).otherwise(F.lit(False))
    )
    rule = F.col("rule_id")
    sets = by_rule.withColumns({"fails": wrong | F.col("fails"), "open": wrong | F.col("open")}).groupBy("intake_id").agg(
        F.sort_array(F.collect_list(F.when(rule.isin(*scope) & F.col("fails"), rule))).alias("failed"),
        F.collect_list(F.when(rule.isin(*bench), rule)).alias("seen"),
        F.sort_array(F.collect_list(F.when(rule.isin(*bench) & F.col("open"), rule))).alias("open"),
    )
    return sets.select("intake_id", *_decision(F.col("failed"), F.col("seen"), F.col("open"), bench, stage))


def _decision(failed: Column, seen: Column, open_: Column, bench: list[str], stage: str) -> list[Column]:
    """What follows from an intake's failed scope rules, and its benchmark rules that are there and that aren't passed."""
    missing = F.transform(F.array_except(F.array(*[F.lit(b) for b in bench]), seen), lambda r: F.concat(F.lit("missing:"), r))
    blockers = F.concat(missing, open_)
    out, free = F.size(failed) > 0, F.size(blockers) == 0
    ready = ~out & free & F.lit(stage == "curated")
    return [
        F.when(out, "exclude").when(ready, "benchmark_ready").otherwise("metadata_only").alias("status"),
        (~out).alias("candidate_for_full_curation"),
        ready.alias("benchmark_ready"),
        F.when(out, F.array_join(failed, "|")).when(~free, F.array_join(blockers, "|"))
        .when(F.lit(stage == "index"), "full_text_curation_required").alias("reason_codes"),
    ]


def triage_index(
    raw: DataFrame, *, release: str, retrieved: date | str, organism_scope: str | None = None, policy_version: int = 2
) -> Triage:
    """Intake rows, their checks, candidate ids and a summary (``key, value``) of an index."""
    if policy_version not in POLICIES:
        raise ValueError(f"unsupported policy_version {policy_version}")
    table = parse_index(raw, release=release, retrieved=retrieved, organism_scope=organism_scope).normalized
    release = release.strip()
    sid = screen_id(release, F.col("screen_id"))
    intake_id = F.concat(sid, F.lit(f":intake:index:v{policy_version}"))
    dataset = column(table, "external_dataset_id")
    keyed = with_keys(table, organism_scope)
    base = keyed.select(
        F.col("screen_id").alias("external_screen_id"), dataset.alias("external_dataset_id"), sid.alias("screen_id"), intake_id.alias("intake_id"),
        F.concat(F.lit(f"{SOURCE} {release} screen index; SCREEN_ID="), "screen_id").alias("source_locator"),
        F.explode(index_checks(keyed)).alias("k"),
    )
    checks = base.select(
        F.concat("intake_id", F.lit(":check:"), "k.rule_id").alias("check_id"), "intake_id", "screen_id", F.lit("index").alias("assessment_stage"), "k.rule_id", F.col("k.v.outcome").alias("outcome"),
        "k.observed_value", "k.normalized_value", "k.required_for_scope", "k.required_for_benchmark", F.col("k.v.reason").alias("reason_code"), "source_locator",
    )
    # An intake has one row of the index, which holds all of its checks: it is decided where it is.
    scope, bench = (sorted(x) for x in POLICIES[policy_version])
    each = F.col("_checks")
    rules = lambda test: F.sort_array(F.transform(F.filter(each, test), lambda k: k["rule_id"]))
    failed = rules(lambda k: k["rule_id"].isin(*scope) & (k["v"]["outcome"] == "fail"))
    seen, open_ = rules(lambda k: k["rule_id"].isin(*bench)), rules(lambda k: k["rule_id"].isin(*bench) & (k["v"]["outcome"] != "pass"))
    sets = keyed.withColumn("_checks", index_checks(keyed)).withColumns({"_failed": failed, "_seen": seen, "_open": open_})
    intake = sets.select(
        intake_id.alias("intake_id"), sid.alias("screen_id"), F.col("screen_id").alias("external_screen_id"), dataset.alias("external_dataset_id"),
        F.lit(SOURCE).alias("source_name"), F.lit(release).alias("source_version"), F.lit(policy_version).alias("policy_version"),
        F.lit("index").alias("assessment_stage"), F.lit(date.fromisoformat(str(retrieved))).alias("assessed_date"),
        *_decision(F.col("_failed"), F.col("_seen"), F.col("_open"), bench, "index"),
    )
    candidates = intake.where("candidate_for_full_curation").select("external_screen_id")
    counts = intake.agg(
        F.count("*").alias("total_screens"), F.count_if("candidate_for_full_curation").alias("candidates"), F.count_if("benchmark_ready").alias("benchmark_ready"),
        *[F.count_if(F.col("status") == s).alias(f"status:{s}") for s in ("benchmark_ready", "metadata_only", "exclude")],
    )
    names = counts.columns
    summary = counts.unpivot([], [f"`{n}`" for n in names], "key", "value").unionByName(
        checks.where("required_for_scope and outcome = 'fail'").groupBy(F.concat(F.lit("failed:"), "rule_id").alias("key")).agg(F.count("*").alias("value"))
    )
    return Triage(intake, checks, candidates, summary)
