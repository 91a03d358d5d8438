"""Queries over contracts and registry integrity, with their SQL.

The views' expressions are plain enough to mean the same in both engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import contracts, registry
from .demo_views import table

# Expressions of each view, over the generic table named first.
_VIEWS = {
    "study": ("nation", ["concat('N', n_nationkey) as study_id", "n_name as citation", "cast(n_nationkey + 2 as bigint) as row_number"]),
    "library": ("region", ["concat('L', r_regionkey) as library_id", "cast(r_regionkey + 2 as bigint) as row_number"]),
    "screen": ("supplier", [
        "concat('S', s_suppkey) as screen_id",
        "case when s_suppkey % 13 = 0 then null when s_suppkey % 11 = 0 then concat('X', s_nationkey) else concat('N', s_nationkey) end as study_id",
        "case when s_suppkey % 3 = 0 then null when s_suppkey % 17 = 0 then 'LX' else concat('L', s_suppkey % 5) end as library_id",
        "cast(s_suppkey + 1 as bigint) as row_number",
    ]),
    "contrast": ("part", [
        "concat('S', p_partkey % 110) as screen_id", "concat('C', p_partkey % 3) as contrast_id", "cast(p_partkey + 1 as bigint) as row_number",
    ]),
    "sample": ("customer", [
        "concat('N', c_nationkey) as study_id", "case when c_custkey % 7 = 0 then null else concat('S', c_custkey % 105) end as screen_id",
        "case when c_custkey % 9 = 0 then null else concat('C', c_custkey % 4) end as contrast_id", "cast(c_custkey + 1 as bigint) as row_number",
    ]),
    "screen_design": ("supplier", [
        "concat('S', s_suppkey) as screen_id", "case when s_suppkey % 4 = 0 then concat('S', s_suppkey * 2) end as parent_screen_id",
        "cast(s_suppkey + 1 as bigint) as row_number",
    ]),
    "data_asset": ("supplier", [
        "case when s_suppkey % 5 = 0 then null else concat('N', s_suppkey % 30) end as study_id", "concat('S', s_suppkey + 3) as screen_id",
        "cast(s_suppkey + 1 as bigint) as row_number",
    ]),
    "evidence": ("orders", [
        "case when o_orderkey % 10 = 0 then 'soon' when o_orderkey % 7 = 0 then '2024-03-01x' when o_orderkey % 11 = 0 then '2024-03-01 00:00:00' when o_orderkey % 3 = 0 then '2024-01-15' else '2024-03-01' end as available_date",
        "case when o_orderkey % 4 = 0 then '2024-02-01' else '2024-04-01' end as retrieved_date", "cast(o_orderkey as bigint) as row_number",
    ]),
    "screen_intake": ("supplier", [
        "concat('I', s_suppkey) as intake_id", "concat('S', s_suppkey) as screen_id",
        "case when s_suppkey % 3 = 0 then 'index' else 'curated' end as assessment_stage",
        "case s_suppkey % 4 when 0 then 'benchmark_ready' when 1 then 'exclude' else 'metadata_only' end as status",
        "s_suppkey % 8 = 0 as benchmark_ready", "s_suppkey % 5 <> 0 as candidate_for_full_curation",
        "cast(case when s_suppkey % 19 = 0 then 1 else 2 end as int) as policy_version", "cast(s_suppkey + 1 as bigint) as row_number",
    ]),
    "candidate": ("customer", [
        "concat('SC', c_custkey % 4) as screen_id", "concat('C', c_custkey % 2) as contrast_id", "concat('GENE', c_custkey) as gene_symbol",
        "'resistance' as phenotype_direction", "case c_custkey % 3 when 0 then 'U' when 1 then 'V3' else 'F0' end as label_code",
        "cast(c_custkey + 1 as bigint) as row_number",
    ]),
    "validation_event": ("events", [
        "concat('SC', user_id % 4) as screen_id", "concat('C', user_id % 2) as contrast_id",
        "case when user_id % 11 = 0 then null else concat('GENE', user_id) end as gene_symbol",
        "case event_id % 2 when 0 then 'resistance' else 'sensitization' end as phenotype_direction",
        "case event_type when 'signup' then 'V3' when 'purchase' then 'V2' when 'error' then 'F0' when 'click' then 'V1' else 'T' end as label_code",
        "cast(event_id as bigint) as row_number",
    ]),
}
_VIEWS |= {
    "guide_annotation": ("part", [
        "case when p_partkey % 21 = 0 then null when p_partkey % 17 = 0 then 'LX' else concat('L', p_partkey % 5) end as library_id",
        "cast(p_partkey + 1 as bigint) as row_number",
    ]),
    "external_screen_map": ("supplier", ["concat('S', s_suppkey + case when s_suppkey % 15 = 0 then 90000 else 0 end) as screen_id", "cast(s_suppkey + 1 as bigint) as row_number"]),
    "design_provenance": ("orders", [
        "case when o_orderkey % 6 = 0 then null else concat('N', o_custkey % 27) end as study_id",
        "case when o_orderkey % 5 = 0 then null else concat('S', o_custkey % 110) end as screen_id",
        "concat('C', o_orderkey % 4) as contrast_id", "cast(o_orderkey as bigint) as row_number",
    ]),
    "gene_score": ("lineitem", [
        "concat('S', l_suppkey) as screen_id", "concat('C', l_linenumber % 4) as contrast_id", "cast(l_orderkey * 10 + l_linenumber as bigint) as row_number",
    ]),
}
_RULE_TEXT = ", ".join(f"'{r}'" for r in registry.BENCHMARK_RULES)
_N_RULES = len(registry.BENCHMARK_RULES)
# Lines of an order are checks of an intake: a line's rule, outcome and flags follow from its numbers.
_VIEWS["eligibility_check"] = ("lineitem", [
    "concat('I', l_suppkey + case when l_partkey % 50 = 0 then 1000 else 0 end) as intake_id",
    "concat('S', l_suppkey + case when l_partkey % 40 = 0 then 1 else 0 end) as screen_id",
    "case when l_suppkey % 3 = 0 then 'index' when l_partkey % 30 = 0 then 'index' else 'curated' end as assessment_stage",
    "case l_orderkey % 13 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(registry.BENCHMARK_RULES)) + " end as rule_id",
    "case when l_partkey % 9 = 0 then null when l_partkey % 4 = 0 then 'fail' when l_partkey % 4 = 1 then 'unknown' else 'pass' end as outcome",
    "case when l_linenumber = 6 then null else l_orderkey % 13 < 4 end as required_for_scope", "case when l_linenumber = 5 then null else l_linenumber <> 7 end as required_for_benchmark",
    "cast(l_orderkey * 10 + l_linenumber as bigint) as row_number",
])


def view(spark, sf_dir: str, name: str) -> DataFrame:
    source, expressions = _VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def _cte(*names: str) -> str:
    return "WITH " + ", ".join(
        f"{n} AS (SELECT {', '.join(_VIEWS[n][1])} FROM {_VIEWS[n][0]})" for n in names
    )


def r01_study_of_screen(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "screen"), "screen", view(spark, sf_dir, "study"), ["study_id"])


def r02_library_of_screen(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "screen"), "screen", view(spark, sf_dir, "library"), ["library_id"], nulls_ok=True)


def r04_screen_of_contrast(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "contrast"), "contrast", view(spark, sf_dir, "screen"), ["screen_id"])


def r05_intake_fields(spark, sf_dir):
    return registry.check_intake(view(spark, sf_dir, "screen_intake"))


def r06_policy(spark, sf_dir):
    return registry.check_policy(view(spark, sf_dir, "screen_intake"), view(spark, sf_dir, "eligibility_check"))


def r14_parent_screen(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "screen_design"), "screen_design", view(spark, sf_dir, "screen"), ["parent_screen_id"], ["screen_id"], nulls_ok=True)


def r15_study_links(spark, sf_dir):
    return registry.check_study_links("sample", view(spark, sf_dir, "sample"), view(spark, sf_dir, "study"), view(spark, sf_dir, "screen"))


def r18_evidence_dates(spark, sf_dir):
    return registry.check_evidence_dates(view(spark, sf_dir, "evidence"))


def r19_candidates(spark, sf_dir):
    return registry.check_candidates(view(spark, sf_dir, "candidate"), view(spark, sf_dir, "validation_event"))


def r03_library_of_guides(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "guide_annotation"), "guide_annotation", view(spark, sf_dir, "library"), ["library_id"])


def r23_provenance(spark, sf_dir):
    rows = view(spark, sf_dir, "design_provenance")
    found = [
        registry.unknown_keys(rows, "design_provenance", view(spark, sf_dir, parent), keys, nulls_ok=True)
        for parent, keys in (("study", ["study_id"]), ("screen", ["screen_id"]), ("contrast", ["screen_id", "contrast_id"]))
    ]
    return reduce(DataFrame.unionByName, found)


def r22_contrast_pairs(spark, sf_dir):
    return registry.unknown_keys(view(spark, sf_dir, "sample"), "sample", view(spark, sf_dir, "contrast"), ["screen_id", "contrast_id"])


def r24_data_assets(spark, sf_dir):
    found = [
        registry.unknown_keys(view(spark, sf_dir, "data_asset"), "data_asset", view(spark, sf_dir, parent), [key], nulls_ok=True)
        for parent, key in (("study", "study_id"), ("screen", "screen_id"))
    ]
    return reduce(DataFrame.unionByName, found)


def r00_registry(spark, sf_dir):
    """All checks together: errors by table and kind."""
    found = registry.registry_errors({n: view(spark, sf_dir, n) for n in _VIEWS})
    return found.groupBy("table", "error").agg(F.count("*").alias("n"), F.sum("row_number").alias("rows_sum"))


# Samples with planted faults, as text.
_SAMPLES = [
    "case when c_custkey % 50 = 0 then 'same' else concat('P', c_custkey) end as sample_id", "concat('S', c_custkey % 20) as screen_id",
    "case when c_custkey % 23 = 0 then '  ' else concat('C', c_custkey % 4) end as contrast_id",
    "case when c_custkey % 9 = 0 then 'Control' when c_custkey % 2 = 0 then 'control' else 'treatment' end as condition_role",
    "case when c_custkey % 29 = 0 then '0' when c_custkey % 31 = 0 then '1.5' when c_custkey % 37 = 0 then null else '2.0' end as replicate",
    "case when c_custkey % 8 = 0 then '3' end as timepoint_days", "case when c_custkey % 16 = 0 then 'start' end as timepoint_reference",
    "case when c_custkey % 12 = 0 then 'inf' when c_custkey % 15 = 0 then '-1' when c_custkey % 6 = 0 then '0.5' end as treatment_dose",
    "case when c_custkey % 18 = 0 then 'nM' end as treatment_unit", "cast(c_custkey + 1 as bigint) as row_number",
]


def v01_sample_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(*_SAMPLES)
    return contracts.validate(rows, "sample", "row_number")[1]


def v01_sample_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(*_SAMPLES)
    valid = contracts.validate(rows, "sample", "row_number")[0]
    return valid.select("sample_id", "screen_id", "contrast_id", "condition_role", "replicate", "timepoint_days", "treatment_dose", "treatment_unit", "replicate_unit")


# Validation events whose outcome columns come from bits of the event's number; null where the bit pair is 3.
_BITS = {"perturbation_confirmed": 1, "phenotype_reproduced": 4, "opposite_direction_reproduced": 16, "appropriate_control": 3, "orthogonal_perturbation": 5,
         "rescue_performed": 7, "causal_reversal_performed": 9, "assay_adequate": 11}
_EVENTS = [
    "concat('E', event_id) as event_id", "'N1' as study_id", "concat('GENE', user_id) as gene_symbol", "'drug' as drug_name", "'line' as cell_line",
    "'CRISPR_KO' as perturbation_modality", "'resistance' as phenotype_direction",
    "case event_id % 7 when 0 then 'V3' when 1 then 'V2' when 2 then 'F0' when 3 then 'D' when 4 then 'U' when 5 then 'V1' else 'T' end as label_code",
    "case user_id % 3 when 0 then 'not_tested' else 'tested' end as testing_status",
    *[f"case floor(event_id / {k}) % 4 when 0 then 'true' when 1 then 'false' when 2 then 'true' end as {c}" for c, k in _BITS.items()],
    "case when event_id % 5 = 0 then '2' when event_id % 5 = 1 then '0' end as independent_reagent_count",
    "case when event_id % 17 = 0 then '0.2' end as p_value", "'https://example.org/x' as source_url", "'table 1' as source_locator",
    "cast(event_id as bigint) as row_number",
]


def v04_event_rules(spark, sf_dir):
    """Events by the label rules that they break."""
    rows = table(spark, sf_dir, "events").selectExpr(*_EVENTS)
    errors = contracts.validate(rows, "validation_event", "row_number")[1]
    return errors.groupBy("error").agg(F.count("*").alias("n"), F.sum("row_number").alias("rows_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        r00_registry, r01_study_of_screen, r02_library_of_screen, r03_library_of_guides, r23_provenance, r04_screen_of_contrast, r05_intake_fields, r06_policy, r14_parent_screen, r15_study_links,
        r18_evidence_dates, r19_candidates, r22_contrast_pairs, r24_data_assets, v01_sample_errors, v01_sample_valid, v04_event_rules,
    )
}


def _anti(child: str, parent: str, key: str, parent_key: str | None = None, nulls_ok: bool = False) -> str:
    keys = key.split(", ")
    parents = (parent_key or key).split(", ")
    on = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(keys, parents, strict=True))
    given = " AND ".join(f"c.{a} IS NOT NULL" for a in keys)
    return (
        f"SELECT '{child}' AS \"table\", row_number, 'unknown_{'_'.join(keys)}' AS error FROM {child} c"
        f" WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {on}){' AND ' + given if nulls_ok else ''}"
    )


_LINKS = f"""{_anti('sample', 'study', 'study_id')} UNION ALL {_anti('sample', 'screen', 'screen_id', nulls_ok=True)}
  UNION ALL SELECT 'sample', c.row_number, 'study_differs_from_screen' FROM sample c JOIN screen p USING (screen_id) WHERE c.study_id IS DISTINCT FROM p.study_id"""
def _day(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '\\d{{4}}-\\d{{2}}-\\d{{2}}( 00:00:00)?') THEN TRY_CAST(left({column}, 10) AS DATE) END"


_DATES = f"""SELECT 'evidence' AS "table", row_number, 'retrieved_before_available' AS error FROM evidence
  WHERE {_day('retrieved_date')} < {_day('available_date')}"""
_ASSETS = f"{_anti('data_asset', 'study', 'study_id', nulls_ok=True)} UNION ALL {_anti('data_asset', 'screen', 'screen_id', nulls_ok=True)}"
_PARENT = _anti("screen_design", "screen", "parent_screen_id", "screen_id", nulls_ok=True)
_PAIRS = _anti("sample", "contrast", "screen_id, contrast_id")
_PROVENANCE = " UNION ALL ".join(
    _anti("design_provenance", parent, keys, nulls_ok=True) for parent, keys in (("study", "study_id"), ("screen", "screen_id"), ("contrast", "screen_id, contrast_id"))
)
_SCORED = ("gene_score", "candidate", "validation_event")
_INTAKE = """SELECT 'screen_intake' AS "table", row_number, 'index_stage_ready' AS error FROM screen_intake WHERE assessment_stage = 'index' AND (benchmark_ready OR status = 'benchmark_ready')
UNION ALL SELECT 'screen_intake', row_number, 'ready_flag_differs' FROM screen_intake WHERE benchmark_ready <> (status = 'benchmark_ready')
UNION ALL SELECT 'screen_intake', row_number, 'excluded_candidate' FROM screen_intake WHERE status = 'exclude' AND candidate_for_full_curation"""
_POLICY_TABLES = f"""rules AS (SELECT unnest([{_RULE_TEXT}]) AS rule_id),
linked AS (SELECT c.*, i.row_number AS i_row, i.screen_id AS i_screen, i.assessment_stage AS i_stage, i.policy_version, i.status FROM eligibility_check c JOIN screen_intake i USING (intake_id)),
matched AS (SELECT * FROM linked WHERE screen_id = i_screen AND assessment_stage = i_stage AND policy_version = 2),
per AS (SELECT intake_id, rule_id, count(*) AS n, min(row_number) AS r, CASE WHEN count(*) = 1 THEN min(outcome) END AS outcome FROM matched GROUP BY ALL),
seen AS (
  SELECT i.intake_id, i.row_number, i.status, count(*) FILTER (p.n IS NULL) AS absent, count(*) FILTER (p.n IS NOT NULL AND p.outcome IS DISTINCT FROM 'pass') AS open_,
    count(*) FILTER (p.outcome = 'fail' AND rule_id LIKE 'scope.%') AS failed
  FROM screen_intake i CROSS JOIN rules LEFT JOIN per p USING (intake_id, rule_id) WHERE i.policy_version = 2 GROUP BY ALL)"""
_POLICY = f"""{_anti('eligibility_check', 'screen_intake', 'intake_id')}
UNION ALL SELECT 'eligibility_check', row_number, 'screen_differs_from_intake' FROM linked WHERE screen_id <> i_screen
UNION ALL SELECT 'eligibility_check', row_number, 'stage_differs_from_intake' FROM linked WHERE assessment_stage <> i_stage
UNION ALL SELECT 'screen_intake', row_number, 'unsupported_policy' FROM screen_intake WHERE policy_version <> 2
UNION ALL SELECT 'eligibility_check', row_number, 'rule_flags_differ_from_policy' FROM matched
  WHERE coalesce(required_for_scope, false) <> (rule_id LIKE 'scope.%') OR coalesce(required_for_benchmark, false) <> (rule_id IN (SELECT rule_id FROM rules))
UNION ALL SELECT 'eligibility_check', min(r), 'repeated_rules:' || string_agg(rule_id, '|' ORDER BY rule_id) FROM per WHERE n > 1 GROUP BY intake_id
UNION ALL SELECT 'screen_intake', row_number, 'ready_without_every_rule' FROM seen WHERE status = 'benchmark_ready' AND absent > 0
UNION ALL SELECT 'screen_intake', row_number, 'ready_with_unpassed_rule' FROM seen WHERE status = 'benchmark_ready' AND open_ > 0
UNION ALL SELECT 'screen_intake', row_number, 'failed_scope_not_excluded' FROM seen WHERE failed > 0 AND status <> 'exclude'
UNION ALL SELECT 'screen_intake', row_number, 'excluded_without_failed_scope' FROM seen WHERE status = 'exclude' AND failed = 0"""
_RESOLVE = """CASE WHEN bool_or(label_code IN ('V2', 'V3')) AND bool_or(label_code IN ('F0', 'D')) THEN 'A' WHEN bool_or(label_code = 'V3') THEN 'V3'
  WHEN bool_or(label_code = 'V2') THEN 'V2' WHEN bool_or(label_code = 'F0') THEN 'F0' WHEN bool_or(label_code = 'V1') THEN 'V1' ELSE 'T' END"""
_K = "screen_id, contrast_id, gene_symbol, phenotype_direction"
_EVENT_TABLE = f"""ev AS (SELECT {_K}, {_RESOLVE} AS due, min(row_number) AS r FROM validation_event WHERE gene_symbol IS NOT NULL GROUP BY {_K})"""
_CANDIDATES = """SELECT 'validation_event' AS "table", r AS row_number, 'event_without_candidate' AS error FROM ev WHERE NOT EXISTS (
  SELECT 1 FROM candidate c WHERE c.screen_id = ev.screen_id AND c.contrast_id = ev.contrast_id AND c.gene_symbol = ev.gene_symbol AND c.phenotype_direction = ev.phenotype_direction)
UNION ALL SELECT 'candidate', row_number, 'label_differs_from_events' FROM candidate JOIN ev USING (screen_id, contrast_id, gene_symbol, phenotype_direction) WHERE label_code <> due
UNION ALL SELECT 'candidate', row_number, 'candidate_without_event' FROM candidate LEFT JOIN ev USING (screen_id, contrast_id, gene_symbol, phenotype_direction) WHERE label_code <> 'U' AND due IS NULL"""
_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _tri(text: str) -> str:
    """The events' SQL conditions, of ``x IS TRUE`` for known truths."""
    return text.replace(" <=> true", " IS TRUE").replace(" <=> false", " IS FALSE")


def _event_sql() -> str:
    spec = contracts.CONTRACTS["validation_event"]
    bools = ", ".join(f"CAST({c} AS BOOLEAN) AS {c}" for c in _BITS)
    rules = " UNION ALL ".join(
        f"SELECT row_number, 'rule:{name}' AS error FROM typed WHERE NOT coalesce({_tri(test)}, false)" for name, test in spec.rules
    )
    return f"""WITH raw AS (SELECT {', '.join(_EVENTS)} FROM events), typed AS (
      SELECT * REPLACE ({bools}, CAST(independent_reagent_count AS BIGINT) AS independent_reagent_count, CAST(p_value AS DOUBLE) AS p_value),
        CAST(NULL AS DOUBLE) AS validation_treatment_dose, CAST(NULL AS VARCHAR) AS validation_treatment_unit, CAST(NULL AS DOUBLE) AS effect_size FROM raw)
      SELECT error, count(*) AS n, CAST(sum(row_number) AS BIGINT) AS rows_sum FROM ({rules}) GROUP BY error"""


_SAMPLE_SQL = f"""WITH raw AS (SELECT {', '.join(_SAMPLES)} FROM customer),
  num AS (SELECT *, trim(contrast_id) AS contrast, CASE WHEN regexp_matches(replicate, {_NUMBER}) THEN CAST(replicate AS DOUBLE) END AS rep,
    CASE WHEN regexp_matches(treatment_dose, {_NUMBER}) THEN CAST(treatment_dose AS DOUBLE) END AS dose, CAST(timepoint_days AS DOUBLE) AS days FROM raw),
  wrong AS (
    SELECT row_number, 'contrast_id:empty' AS error FROM num WHERE contrast = ''
    UNION ALL SELECT row_number, 'condition_role:not_in_vocabulary' FROM num WHERE condition_role NOT IN ('control', 'treatment', 'baseline')
    UNION ALL SELECT row_number, 'replicate:missing' FROM num WHERE replicate IS NULL
    UNION ALL SELECT row_number, 'replicate:not_int' FROM num WHERE replicate IS NOT NULL AND (rep IS NULL OR rep <> floor(rep))
    UNION ALL SELECT row_number, 'replicate:out_of_range' FROM num WHERE rep = floor(rep) AND rep < 1
    UNION ALL SELECT row_number, 'treatment_dose:not_float' FROM num WHERE treatment_dose IS NOT NULL AND dose IS NULL
    UNION ALL SELECT row_number, 'treatment_dose:out_of_range' FROM num WHERE dose < 0),
  clean AS (SELECT * FROM num WHERE row_number NOT IN (SELECT row_number FROM wrong)),
  broken AS (
    SELECT row_number, 'rule:timepoint_without_reference' AS error FROM clean WHERE days IS NOT NULL AND coalesce(timepoint_reference, '') = ''
    UNION ALL SELECT row_number, 'rule:dose_without_unit' FROM clean WHERE dose IS NOT NULL AND coalesce(treatment_unit, '') = ''),
  good AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS same FROM clean WHERE row_number NOT IN (SELECT row_number FROM broken))"""

SQL = {
    "r01_study_of_screen": f"{_cte('screen', 'study')} {_anti('screen', 'study', 'study_id')}",
    "r02_library_of_screen": f"{_cte('screen', 'library')} {_anti('screen', 'library', 'library_id', nulls_ok=True)}",
    "r04_screen_of_contrast": f"{_cte('screen', 'contrast')} {_anti('contrast', 'screen', 'screen_id')}",
    "r03_library_of_guides": f"{_cte('guide_annotation', 'library')} {_anti('guide_annotation', 'library', 'library_id')}",
    "r23_provenance": f"{_cte('design_provenance', 'study', 'screen', 'contrast')} {_PROVENANCE}",
    "r05_intake_fields": f"{_cte('screen_intake')} {_INTAKE}",
    "r06_policy": f"{_cte('screen_intake', 'eligibility_check')}, {_POLICY_TABLES} {_POLICY}",
    "r14_parent_screen": f"{_cte('screen', 'screen_design')} {_PARENT}",
    "r15_study_links": f"{_cte('sample', 'study', 'screen')} {_LINKS}",
    "r18_evidence_dates": f"{_cte('evidence')} {_DATES}",
    "r19_candidates": f"{_cte('candidate', 'validation_event')}, {_EVENT_TABLE} {_CANDIDATES}",
    "r22_contrast_pairs": f"{_cte('sample', 'contrast')} {_PAIRS}",
    "r24_data_assets": f"{_cte('data_asset', 'study', 'screen')} {_ASSETS}",
    "r00_registry": f"""{_cte(*_VIEWS)}, {_POLICY_TABLES}, {_EVENT_TABLE}, every AS (
  {_anti('screen', 'study', 'study_id')} UNION ALL {_anti('screen', 'library', 'library_id', nulls_ok=True)} UNION ALL {_anti('guide_annotation', 'library', 'library_id')}
  UNION ALL {' UNION ALL '.join(_anti(t, 'screen', 'screen_id') for t in ('screen_design', 'contrast', 'external_screen_map', 'screen_intake', 'eligibility_check'))}
  UNION ALL {_INTAKE} UNION ALL {_POLICY} UNION ALL {_PARENT} UNION ALL {_LINKS} UNION ALL {_PAIRS} UNION ALL {_DATES} UNION ALL {_ASSETS}
  UNION ALL {' UNION ALL '.join(_anti(t, 'screen', 'screen_id', nulls_ok=True) for t in _SCORED)}
  UNION ALL {' UNION ALL '.join(_anti(t, 'contrast', 'screen_id, contrast_id') for t in _SCORED)}
  UNION ALL {_CANDIDATES} UNION ALL {_PROVENANCE})
SELECT "table", error, count(*) AS n, CAST(sum(row_number) AS BIGINT) AS rows_sum FROM every GROUP BY ALL""",
    "v01_sample_errors": f"{_SAMPLE_SQL} SELECT * FROM wrong UNION ALL SELECT * FROM broken UNION ALL SELECT row_number, 'duplicate_key' FROM good WHERE same > 1",
    "v01_sample_valid": f"{_SAMPLE_SQL} SELECT sample_id, screen_id, contrast AS contrast_id, condition_role, CAST(rep AS BIGINT) AS replicate, days AS timepoint_days, dose AS treatment_dose, treatment_unit, 'unknown' AS replicate_unit FROM good WHERE same = 1",
    "v04_event_rules": _event_sql(),
}
