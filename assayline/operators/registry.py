"""Integrity of a registry of tables: foreign keys and agreement between tables, as one error table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scratch import written
from .contracts import as_date, with_row_numbers
from .labels import KEYS, adjudicate_events

# The rules of intake policy 2.
SCOPE_RULES = ("scope.organism_human", "scope.perturbation_crispr_ko", "scope.drug_exposure", "scope.pooled_format")
BENCHMARK_RULES = (
    *SCOPE_RULES, "metadata.identifiable_drug", "metadata.identifiable_cell_context", "metadata.gene_level_mapping",
    "curation.comparator_and_sample_map", "data.count_level_signal", "provenance.source_family", "provenance.raw_data_family",
    "rights.source_and_raw_data", "labels.adjudicated_validation_event",
)
POLICIES = {2: (SCOPE_RULES, BENCHMARK_RULES)}


def _errors(rows: DataFrame, table: str, error: str | Column) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), "row_number", (F.lit(error) if isinstance(error, str) else error).alias("error"))


def unknown_keys(child: DataFrame, table: str, parent: DataFrame, keys: list[str], parent_keys: list[str] | None = None, nulls_ok: bool = False) -> DataFrame:
    """Rows of ``child(row_number, keys)`` whose key has no parent. A null key is an error too, or left out if ``nulls_ok``."""
    known = parent.select(*[F.col(p).cast("string").alias(k) for k, p in zip(keys, parent_keys or keys, strict=True)]).distinct()
    rows = child.select("row_number", *[F.col(k).cast("string").alias(k) for k in keys])
    if nulls_ok:
        rows = rows.dropna(subset=keys)
    return _errors(rows.join(known, keys, "left_anti"), table, "unknown_" + "_".join(keys))


def policy_table(spark) -> DataFrame:
    rows = [(v, r, r in scope, True) for v, (scope, bench) in POLICIES.items() for r in bench]
    return spark.createDataFrame(rows, "policy_version int, rule_id string, in_scope boolean, in_benchmark boolean")


def check_intake(intake: DataFrame) -> DataFrame:
    """Stage, status and flags of intake rows agree."""
    wrong = [
        (F.expr("assessment_stage = 'index' and (coalesce(benchmark_ready, false) or status = 'benchmark_ready')"), "index_stage_ready"),
        (F.expr("coalesce(benchmark_ready, false) <> (status = 'benchmark_ready')"), "ready_flag_differs"),
        (F.expr("status = 'exclude' and coalesce(candidate_for_full_curation, false)"), "excluded_candidate"),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in wrong])))
    return intake.select("row_number", found.alias("e")).select(F.lit("screen_intake").alias("table"), "row_number", F.col("e").alias("error"))


def check_policy(intake: DataFrame, checks: DataFrame) -> DataFrame:
    """Eligibility checks against their intake and its policy, and intake statuses against their checks.

    Of intake rows with one intake_id the last counts. A check whose screen or stage differs from its intake's isn't looked at
    further. A rule is absent if it has no check at all; one that is repeated, or whose outcome isn't ``pass`` (null included), is
    there but not passed. Checks are read and joined once and written; what follows are aggregations of that table.
    """
    own = intake.groupBy("intake_id").agg(
        F.max_by(F.struct(F.col("row_number").alias("i_row"), F.col("screen_id").alias("i_screen"), F.col("assessment_stage").alias("i_stage"),
                          F.col("policy_version").cast("int").alias("policy_version"), "status"), "row_number").alias("own")
    ).select("intake_id", "own.*")
    policies = policy_table(intake.sparkSession)
    supported = F.coalesce(F.col("policy_version").isin(*POLICIES), F.lit(False))
    same_screen, same_stage = F.col("screen_id").eqNullSafe(F.col("i_screen")), F.col("assessment_stage").eqNullSafe(F.col("i_stage"))
    counts = F.col("i_row").isNotNull() & same_screen & same_stage & supported
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    odd = (flag("required_for_scope") != flag("in_scope")) | (flag("required_for_benchmark") != flag("in_benchmark"))
    codes = [
        F.when(F.col("i_row").isNull(), "unknown_intake_id"),
        F.when(F.col("i_row").isNotNull() & ~same_screen, "screen_differs_from_intake"),
        F.when(F.col("i_row").isNotNull() & ~same_stage, "stage_differs_from_intake"),
        F.when(counts & odd, "rule_flags_differ_from_policy"),
    ]
    judged = checks.join(own, "intake_id", "left").join(F.broadcast(policies), ["policy_version", "rule_id"], "left")  # the policies' rules
    judged = written(
        judged.select("row_number", "intake_id", "rule_id", "outcome", flag("in_scope").alias("in_scope"), flag("in_benchmark").alias("in_benchmark"),
                      counts.alias("counts"), F.array_compact(F.array(*codes)).alias("codes")), "judged"
    )
    of_checks = _errors(judged.select("row_number", F.explode("codes").alias("code")), "eligibility_check", F.col("code"))

    per_rule = judged.where("counts").groupBy("intake_id", "rule_id", "in_scope", "in_benchmark").agg(
        F.count("*").alias("n"), F.min("row_number").alias("row"), F.min("outcome").alias("outcome")
    )
    once = F.col("n") == 1
    per_intake = per_rule.groupBy("intake_id").agg(
        F.count_if("in_benchmark").alias("there"),
        F.count_if(F.col("in_benchmark") & once & (F.col("outcome") == "pass")).alias("passed"),
        F.count_if(F.col("in_scope") & once & (F.col("outcome") == "fail")).alias("failed"),
        F.min(F.when(~once, F.col("row"))).alias("repeated_row"),
        F.array_join(F.sort_array(F.collect_set(F.when(~once, F.coalesce("rule_id", F.lit(""))))), "|").alias("repeated"),
    )
    due = policies.groupBy("policy_version").agg(F.count_if("in_benchmark").alias("due"))
    seen = own.join(F.broadcast(due), "policy_version", "left").join(per_intake, "intake_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ready, excluded = F.col("status") == "benchmark_ready", F.coalesce(F.col("status") == "exclude", F.lit(False))

    def error(test: Column, code: str | Column, table: str = "screen_intake", row: str = "i_row") -> Column:
        return F.when(test, F.struct(F.lit(table).alias("table"), F.col(row).alias("row_number"), (F.lit(code) if isinstance(code, str) else code).alias("error")))

    found = [
        error(~supported, "unsupported_policy"),
        error(supported & F.col("repeated_row").isNotNull(), F.concat(F.lit("repeated_rules:"), "repeated"), "eligibility_check", "repeated_row"),
        error(supported & ready & (n("there") < F.col("due")), "ready_without_every_rule"),
        error(supported & ready & (n("passed") < n("there")), "ready_with_unpassed_rule"),
        error(supported & ~excluded & (n("failed") > 0), "failed_scope_not_excluded"),
        error(supported & excluded & (n("failed") == 0), "excluded_without_failed_scope"),
    ]
    of_intake = seen.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.table", "e.row_number", "e.error")
    return of_checks.unionByName(of_intake)


def check_study_links(table: str, rows: DataFrame, studies: DataFrame, screens: DataFrame) -> DataFrame:
    """study_id known, screen_id known where given, and the screen's study the row's."""
    out = []
    if "study_id" in rows.columns:
        out.append(unknown_keys(rows, table, studies, ["study_id"]))
    if "screen_id" in rows.columns:
        out.append(unknown_keys(rows, table, screens, ["screen_id"], nulls_ok=True))
    if {"study_id", "screen_id"} <= set(rows.columns):
        of = screens.select("screen_id", F.col("study_id").alias("_of")).dropDuplicates(["screen_id"])
        out.append(_errors(rows.join(of, "screen_id").where("not (study_id <=> _of)"), table, "study_differs_from_screen"))
    return reduce(DataFrame.unionByName, out)


def check_candidates(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates carry the label their events adjudicate to, and each has events unless it is U."""
    found = adjudicate_events(events).withColumnRenamed("label_code", "_due")
    keys = list(KEYS)
    numbered = events.dropna(subset=keys).groupBy(*keys).agg(F.min("row_number").alias("row_number"))
    lost = numbered.join(candidates.select(*keys).distinct(), keys, "left_anti")
    other = candidates.join(found, keys).where("label_code <> _due")
    bare = candidates.where("label_code <> 'U'").join(found.select(*keys), keys, "left_anti")
    return (
        _errors(lost, "validation_event", "event_without_candidate")
        .unionByName(_errors(other, "candidate", "label_differs_from_events"))
        .unionByName(_errors(bare, "candidate", "candidate_without_event"))
    )


def check_evidence_dates(evidence: DataFrame) -> DataFrame:
    """Evidence is retrieved when it is available or later; what isn't a date, by the rule of the contracts, is left out."""
    return _errors(evidence.where(as_date("retrieved_date") < as_date("available_date")), "evidence", "retrieved_before_available")


def registry_errors(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, row_number, error)`` over the given tables; ``study`` and ``screen`` are needed, others optional.

    Rows keep a ``row_number`` they have; else they are numbered from 2 in their order.
    Each check is an anti-join or a filter, so that tables of any size are
    spread over their keys.
    """
    t = {name: df if "row_number" in df.columns else with_row_numbers(df) for name, df in tables.items()}
    studies, screens = t["study"], t["screen"]
    out = [unknown_keys(screens, "screen", studies, ["study_id"])]
    if "library" in t:
        out.append(unknown_keys(screens, "screen", t["library"], ["library_id"], nulls_ok=True))
        if "guide_annotation" in t:
            out.append(unknown_keys(t["guide_annotation"], "guide_annotation", t["library"], ["library_id"]))
    for name in ("screen_design", "contrast", "external_screen_map", "screen_intake", "eligibility_check"):
        if name in t:
            out.append(unknown_keys(t[name], name, screens, ["screen_id"]))
    if "screen_intake" in t:
        out.append(check_intake(t["screen_intake"]))
        if "eligibility_check" in t:
            out.append(check_policy(t["screen_intake"], t["eligibility_check"]))
    if "screen_design" in t:
        out.append(unknown_keys(t["screen_design"], "screen_design", screens, ["parent_screen_id"], ["screen_id"], nulls_ok=True))
    for name in ("sample", "gene_score", "candidate", "validation_event"):
        if name in t:
            out.append(check_study_links(name, t[name], studies, screens))
            if "contrast" in t:
                out.append(unknown_keys(t[name], name, t["contrast"], ["screen_id", "contrast_id"]))
    if "evidence" in t:
        out.append(check_evidence_dates(t["evidence"]))
    if "candidate" in t and "validation_event" in t:
        out.append(check_candidates(t["candidate"], t["validation_event"]))
    for name in ("design_provenance", "data_asset"):
        if name in t:
            out.append(unknown_keys(t[name], name, studies, ["study_id"], nulls_ok=True))
            out.append(unknown_keys(t[name], name, screens, ["screen_id"], nulls_ok=True))
    if "design_provenance" in t and "contrast" in t:
        out.append(unknown_keys(t["design_provenance"], "design_provenance", t["contrast"], ["screen_id", "contrast_id"], nulls_ok=True))
    return reduce(DataFrame.unionByName, out)
