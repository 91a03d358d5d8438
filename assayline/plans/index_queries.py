"""Queries over external indexes, scores, triage, parsers and adapters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import parsing as P
from ..functions.ranks import rounded
from ..operators import external_index as X, triage as T
from ..sources.delimited import scalar, text_key
from .demo_views import table

_RELEASE, _DAY = "1.1.17", "2026-07-30"

# An index with a screen for each part; the names are as a file would have them.
_INDEX = {
    "#SCREEN ID": "concat('', p_partkey)",
    "SOURCE ID": "case when p_partkey % 7 = 0 then '-' else concat('', p_partkey % 50) end",
    "Source-Type": "case when p_partkey % 2 = 0 then 'PubMed' else ' pubmed ' end",
    "Author": "case when p_partkey % 9 = 0 then '' else concat('Author ', p_partkey % 50) end",
    "Organism_Official": "case p_partkey % 8 when 0 then 'Mus musculus' when 1 then '-' else 'Homo sapiens' end",
    "Library Type": "case p_partkey % 6 when 0 then 'CRISPRi' when 1 then '-' else 'CRISPRn' end",
    "METHODOLOGY": "case p_partkey % 12 when 0 then 'Inhibition' when 1 then 'Knock_out' when 7 then 'base   editing' else 'Knockout' end",
    "Experimental Setup": "case p_partkey % 5 when 0 then 'Toxin Exposure' when 1 then 'Viral infection' when 2 then '-' else 'Drug_Exposure' end",
    "Screen Format": "case p_partkey % 11 when 0 then 'Array' when 1 then '' when 2 then 'mixed' else 'Pool' end",
    "Condition Name": "case when p_partkey % 4 = 0 then '-' else concat('drug ', p_partkey % 30) end",
    "Condition Dosage": "case p_partkey % 6 when 0 then '50.0 nM' when 1 then '.5 μM' when 2 then '10nM' when 3 then '~ 3 nM' when 4 then '-' else '2 mg/ml' end",
    "Duration": "case p_partkey % 4 when 0 then '30 Days' when 1 then '1 day' when 2 then '2 weeks' else '-' end",
    "MOI": "case p_partkey % 3 when 0 then '0.3' when 1 then '~ 0.3' else '-' end",
    "Screen Type": "case p_partkey % 5 when 0 then 'Positive Selection' when 1 then 'negative selection' when 2 then 'positive/negative selection' when 3 then '-' else 'timecourse' end",
    "Throughput": "case p_partkey % 5 when 0 then 'Genome-Wide' when 1 then 'Focused' when 2 then 'tiling array' when 3 then '-' else 'small' end",
    "Cell Line": "case when p_partkey % 10 = 0 then '-' else 'A375' end",
    "Full Size Available": "case p_partkey % 3 when 0 then 'Yes' when 1 then 'no' else '-' end",
}
_NAMES = [
    "screen_id", "source_id", "source_type", "author", "organism_official", "library_type", "library_methodology", "experimental_setup", "screen_format",
    "condition_name", "condition_dosage", "duration", "moi", "screen_type", "throughput", "cell_line", "full_size_available",
]


def index(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_INDEX.values()).toDF(*_INDEX)


def p03_normalized_index(spark, sf_dir):
    return X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).normalized.select(*_NAMES)


def p04_text_key(spark, sf_dir):
    return index(spark, sf_dir).select(F.col("#SCREEN ID").alias("screen_id"), text_key(F.col("METHODOLOGY")).alias("methodology"), text_key(F.col("Experimental Setup")).alias("setup"))


def f01_parsed_values(spark, sf_dir):
    raw = index(spark, sf_dir)
    c = lambda n: scalar(F.col(n))
    return raw.select(
        F.col("#SCREEN ID").alias("screen_id"), P.dose_value(c("Condition Dosage")).alias("dose"), P.dose_unit(c("Condition Dosage")).alias("unit"),
        P.duration_days(c("Duration")).alias("days"), P.plain_number(c("MOI")).alias("moi"), P.modality(c("Library Type"), c("METHODOLOGY")).alias("modality"),
        P.selection_strategy(c("Screen Type")).alias("strategy"), P.screen_scale(c("Throughput")).alias("scale"),
    )


def e00_index_screens(spark, sf_dir):
    found = X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).screens
    return found.select("screen_id", "study_id", "source_family_id", "perturbation_modality", "drug_name", "treatment_dose", "treatment_unit", "source_url")


def e00_index_designs(spark, sf_dir):
    found = X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).designs
    return found.select("screen_id", "screen_scale", "screen_format", "experimental_setup", "selection_strategy", "library_moi", "source_locator")


def e00_index_contrasts(spark, sf_dir):
    found = X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).contrasts
    return found.select("screen_id", "contrast_id", "contrast_name", "treatment_name", "treatment_dose", "treatment_unit", "control_type", "intended_direction")


def e00_index_maps(spark, sf_dir):
    found = X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).maps
    return found.select("mapping_id", "screen_id", "source_version", "external_screen_id", "relationship", "source_url", "retrieved_date")


def u05_index_studies(spark, sf_dir):
    return X.parse_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY).studies.select("study_id", "citation", "organism", "source_type", "pubmed_id")


def e05_rule_checks(spark, sf_dir):
    found = T.triage_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY, organism_scope="human").checks
    return found.select("screen_id", "rule_id", "outcome", "reason_code", "normalized_value", "required_for_scope", "required_for_benchmark")


def e06_decisions(spark, sf_dir):
    found = T.triage_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY, organism_scope="human").intake
    return found.select("screen_id", "status", "candidate_for_full_curation", "benchmark_ready", "reason_codes")


def ai1_triage_summary(spark, sf_dir):
    return T.triage_index(index(spark, sf_dir), release=_RELEASE, retrieved=_DAY, organism_scope="human").summary


# Scores: a row for each order line.
_SCORES = {
    "#SCREEN_ID": "case when l_partkey % 41 = 0 then '-' else concat('', l_suppkey) end",
    "OFFICIAL_SYMBOL": "case when l_partkey % 31 = 0 then '' else concat('GENE', l_partkey) end",
    "SCORE.1": "case when l_orderkey % 5 = 0 then '-' when l_orderkey % 37 = 0 then 'high' else concat('', l_orderkey % 100) end",
    "SCORE.2": "case when l_orderkey % 3 = 0 then '' when l_orderkey % 29 = 0 then 'inf' else concat('', l_linenumber, 'e-1') end",
    "HIT": "case l_linenumber when 1 then 'YES' when 2 then 'no' when 3 then 'N/A' when 4 then 'maybe' else '-' end",
}
_META = {
    "SCREEN ID": "concat('', s_suppkey)", "ANALYSIS": "case when s_suppkey % 3 = 0 then '-' else concat('method ', s_suppkey % 4) end",
    "SCORE.1 TYPE": "'p-value'", "SCORE.2 TYPE": "case when s_suppkey % 2 = 0 then 'log2 fold change' end",
}


def score_meta(spark, sf_dir):
    """A row for each supplier; what every tenth doesn't report is null."""
    values = [e if n == "SCREEN ID" else f"case when s_suppkey % 10 <> 0 then {e} end" for n, e in _META.items()]
    return table(spark, sf_dir, "supplier").selectExpr(*values).toDF(*_META)


def _parsed(spark, sf_dir):
    from ..sources.delimited import normalize_table

    raw = table(spark, sf_dir, "lineitem").selectExpr(*_SCORES.values()).toDF(*_SCORES)
    meta = normalize_table(score_meta(spark, sf_dir))[0]
    return X.parse_scores(raw, release=_RELEASE, index=meta)


def u02_gene_scores(spark, sf_dir):
    """Scores by screen and tail."""
    found = _parsed(spark, sf_dir).gene_scores
    return found.groupBy("screen_id", "method", "analysis_tail", "score_type").agg(
        F.count("*").alias("n"), rounded(F.sum("score")).alias("score_sum"), F.count_if(F.col("author_hit")).alias("hits"), F.count("author_hit").alias("with_hit")
    )


def u04_score_issues(spark, sf_dir):
    return _parsed(spark, sf_dir).issues.groupBy("field", "error", "external_screen_id").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


def u01_summary_scores(spark, sf_dir):
    wide = table(spark, sf_dir, "part").selectExpr(
        "concat('GENE', p_partkey) as id", "p_retailprice / 1000 as `pos|score`", "p_size / 100.0D as `pos|fdr`", "concat('', p_size) as `pos_rank`",
        "case when p_size > 25 then cast(p_size as double) end as `neg.lfc`", "'x' as `neg|p-value`",
    )
    found = X.summary_scores(wide, "S1", "C1")
    return found.select("gene_symbol", "analysis_tail", "direction", *[rounded(c).alias(c) for c in ("score", "effect", "p_value", "fdr", "rank")])


QUERIES = {
    f.__name__: f
    for f in (
        p03_normalized_index, p04_text_key, f01_parsed_values, e00_index_screens, e00_index_designs, e00_index_contrasts, e00_index_maps, u05_index_studies, e05_rule_checks, e06_decisions, ai1_triage_summary,
        u01_summary_scores, u02_gene_scores, u04_score_issues,
    )
}

_RAW = ", ".join(f"{e} AS {n}" for e, n in zip(_INDEX.values(), _NAMES, strict=True))
_CLEAN = ", ".join(f"nullif(nullif(trim({n}), ''), '-') AS {n}" for n in _NAMES)
_IX = f"WITH raw AS (SELECT {_RAW} FROM part), ix AS (SELECT {_CLEAN} FROM raw)"


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower(replace({c}, '_', ' ')), '\\s+', ' ', 'g'))"


_DOSE = r"^(\d+\.?\d*|\.\d+)\s+([A-Za-zµμ%][A-Za-z0-9µμ%/_.^-]*)$"
_VALUE = f"CASE WHEN regexp_matches(condition_dosage, '{_DOSE}') THEN CAST(regexp_extract(condition_dosage, '{_DOSE}', 1) AS DOUBLE) END"
_UNIT = f"CASE WHEN regexp_matches(condition_dosage, '{_DOSE}') THEN replace(regexp_extract(condition_dosage, '{_DOSE}', 2), 'μ', 'µ') END"
_DAYS = r"(?i)^(\d+\.?\d*|\.\d+)\s+days?$"
_MODALITY = """CASE WHEN coalesce(lower(library_type) LIKE '%crispra%', false) OR coalesce(lower(library_methodology) = 'activation', false) THEN 'CRISPRa'
  WHEN coalesce(lower(library_type) LIKE '%crispri%', false) OR coalesce(lower(library_methodology) = 'inhibition', false) THEN 'CRISPRi'
  WHEN coalesce(lower(library_type) LIKE '%crisprn%', false) OR coalesce(lower(library_methodology) = 'knockout', false) THEN 'CRISPR_KO' ELSE 'other' END"""
_SID = f"'orcs:{_RELEASE}:screen:' || screen_id"
_STUDY = f"CASE WHEN source_id IS NULL THEN 'orcs:{_RELEASE}:study:provisional-screen:' || screen_id ELSE 'orcs:{_RELEASE}:study:' || lower(source_type) || ':' || source_id END"
_TEXT = f"concat_ws(' ', {_key('library_type')}, {_key('library_methodology')})"
_KIND = f"nullif(concat_ws(' | ', {_key('library_type')}, {_key('library_methodology')}), '')"
_NOT_KO = " OR ".join(f"t LIKE '%{w}%'" for w in ("activation", "inhibition", "crispra", "crispri", "base editing", "prime editing"))
_NOT_DRUG = " OR ".join(f"st LIKE '%{w}%'" for w in ("infection", "pathogen", "virus", "radiation", "hypoxia", "nutrient", "temperature", "genetic interaction"))


def _rule(rule: str, outcome: str, reason: str, value: str, scope: str, bench: str = "true") -> str:
    return f"SELECT sid AS screen_id, '{rule}' AS rule_id, {outcome} AS outcome, {reason} AS reason_code, {value} AS normalized_value, {scope} AS required_for_scope, {bench} AS required_for_benchmark FROM k"


_U = "'unknown'"
_CHECKS = f"""{_IX}, k AS (
  SELECT *, {_SID} AS sid, {_TEXT} AS t, {_KIND} AS kind, {_key('experimental_setup')} AS st, {_key('screen_format')} AS fm, {_key("coalesce(organism_official, 'human')")} AS og,
    {_key('full_size_available')} AS fl FROM ix),
checks AS (
  {_rule('scope.organism_human', "CASE WHEN og IN ('human', 'homo sapiens', '9606') THEN 'pass' ELSE 'fail' END", "CASE WHEN og IN ('human', 'homo sapiens', '9606') THEN 'human_scope_confirmed' ELSE 'non_human_organism' END", 'og', 'true')}
  UNION ALL {_rule('scope.perturbation_crispr_ko', f"CASE WHEN t LIKE '%knockout%' OR t LIKE '%crisprn%' OR t LIKE '%crispr ko%' THEN 'pass' WHEN {_NOT_KO} THEN 'fail' ELSE 'unknown' END", f"CASE WHEN t LIKE '%knockout%' OR t LIKE '%crisprn%' OR t LIKE '%crispr ko%' THEN 'crispr_ko_confirmed' WHEN {_NOT_KO} THEN 'non_ko_perturbation' ELSE 'perturbation_unresolved' END", 'kind', 'true')}
  UNION ALL {_rule('scope.drug_exposure', f"CASE WHEN st = 'drug exposure' THEN 'pass' WHEN st = 'toxin exposure' THEN 'unknown' WHEN {_NOT_DRUG} THEN 'fail' ELSE 'unknown' END", f"CASE WHEN st IS NULL THEN 'experimental_setup_unreported' WHEN st = 'drug exposure' THEN 'drug_exposure_confirmed' WHEN st = 'toxin exposure' THEN 'toxin_or_drug_exposure_requires_curation' WHEN {_NOT_DRUG} THEN 'non_drug_primary_setup' ELSE 'drug_exposure_unresolved' END", 'st', 'true')}
  UNION ALL {_rule('scope.pooled_format', "CASE WHEN fm IN ('pool', 'pooled') THEN 'pass' WHEN fm IN ('array', 'arrayed') THEN 'fail' ELSE 'unknown' END", "CASE WHEN fm IS NULL THEN 'screen_format_unreported' WHEN fm IN ('pool', 'pooled') THEN 'pooled_screen_confirmed' WHEN fm IN ('array', 'arrayed') THEN 'arrayed_screen_out_of_scope' ELSE 'screen_format_unresolved' END", 'fm', 'true')}
  UNION ALL {_rule('metadata.identifiable_drug', "CASE WHEN condition_name IS NOT NULL AND coalesce(st = 'drug exposure', false) THEN 'pass' ELSE 'unknown' END", "CASE WHEN condition_name IS NULL THEN 'drug_name_unreported' WHEN coalesce(st = 'drug exposure', false) THEN 'drug_name_confirmed_in_drug_exposure' ELSE 'condition_name_requires_drug_exposure_curation' END", "CASE WHEN st = 'drug exposure' THEN condition_name END", 'false')}
  UNION ALL {_rule('metadata.identifiable_cell_context', "CASE WHEN cell_line IS NULL THEN 'unknown' ELSE 'pass' END", "CASE WHEN cell_line IS NULL THEN 'cell_context_unreported' ELSE 'cell_line_reported' END", 'cell_line', 'false')}
  UNION ALL {_rule('metadata.gene_level_mapping', "'pass'", "'gene_level_mapping_available'", "'orcs_gene_scores'", 'false')}
  UNION ALL {_rule('metadata.full_gene_score_set', "CASE WHEN fl IN ('yes', 'true', '1') THEN 'pass' ELSE 'unknown' END", "CASE WHEN fl IN ('yes', 'true', '1') THEN 'full_orcs_score_set_available' WHEN fl IN ('no', 'false', '0') THEN 'orcs_score_set_incomplete' ELSE 'orcs_score_completeness_unreported' END", 'fl', 'false', 'false')}
  UNION ALL {_rule('curation.comparator_and_sample_map', _U, "'comparator_sample_map_unresolved'", 'NULL', 'false')}
  UNION ALL {_rule('data.count_level_signal', _U, "'count_level_data_unresolved'", 'NULL', 'false')}
  UNION ALL {_rule('provenance.source_family', _U, "CASE WHEN source_id IS NULL THEN 'source_family_unresolved_missing_source_id' ELSE 'source_family_provisional_from_source_id' END", 'source_id', 'false')}
  UNION ALL {_rule('provenance.raw_data_family', _U, "'raw_data_family_unresolved'", 'NULL', 'false')}
  UNION ALL {_rule('rights.source_and_raw_data', _U, "'source_raw_rights_unresolved'", 'NULL', 'false')}
  UNION ALL {_rule('labels.adjudicated_validation_event', _U, "'validation_events_unreviewed'", 'NULL', 'false')}),
decided AS (
  SELECT screen_id, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (required_for_scope AND outcome = 'fail') AS failed,
    string_agg(rule_id, '|' ORDER BY rule_id) FILTER (required_for_benchmark AND outcome <> 'pass') AS open_ FROM checks GROUP BY screen_id)"""

_SC = f"""WITH raw AS (SELECT {', '.join(f'{e} AS {n}' for e, n in zip(_SCORES.values(), ('sid', 'gene', 's1', 's2', 'hit'), strict=True))} FROM lineitem),
sc AS (SELECT {', '.join(f"nullif(nullif(trim({n}), ''), '-') AS {n}" for n in ('sid', 'gene', 's1', 's2', 'hit'))} FROM raw),
meta AS (SELECT {', '.join(f"nullif(nullif(trim({e if n == 'sid' else f'CASE WHEN s_suppkey % 10 <> 0 THEN {e} END'}), ''), '-') AS {n}" for e, n in zip(_META.values(), ('sid', 'analysis', 'k1', 'k2'), strict=True))} FROM supplier),
num AS (
  SELECT sc.*, coalesce(analysis, 'ORCS author-reported') AS method, k1, k2, CASE WHEN regexp_matches(s1, '^[0-9.e-]+$') THEN CAST(s1 AS DOUBLE) END AS n1,
    CASE WHEN regexp_matches(s2, '^[0-9.e-]+$') THEN CAST(s2 AS DOUBLE) END AS n2, CASE lower(hit) WHEN 'yes' THEN true WHEN 'no' THEN false END AS h
  FROM sc LEFT JOIN meta USING (sid)),
ok AS (SELECT * FROM num WHERE sid IS NOT NULL AND gene IS NOT NULL),
rows_ AS (
  SELECT sid, method, 'orcs_score_1' AS tail, k1 AS kind, n1 AS score, h FROM ok WHERE n1 IS NOT NULL
  UNION ALL SELECT sid, method, 'orcs_score_2', k2, n2, h FROM ok WHERE n2 IS NOT NULL
  UNION ALL SELECT sid, method, 'orcs_author_hit', 'author_hit', NULL, h FROM ok WHERE n1 IS NULL AND n2 IS NULL AND h IS NOT NULL),
issues AS (
  SELECT 'screen_id' AS field, 'missing_screen_id' AS error, sid, sid AS v FROM num WHERE sid IS NULL
  UNION ALL SELECT 'official_symbol', 'missing_official_symbol', sid, NULL FROM num WHERE sid IS NOT NULL AND gene IS NULL
  UNION ALL SELECT 'hit', 'unrecognized_hit', sid, hit FROM ok WHERE lower(hit) NOT IN ('yes', 'no', 'n/a', 'na')
  UNION ALL SELECT 'score_1', 'score_not_finite', sid, s1 FROM ok WHERE s1 IS NOT NULL AND n1 IS NULL
  UNION ALL SELECT 'score_2', 'score_not_finite', sid, s2 FROM ok WHERE s2 IS NOT NULL AND n2 IS NULL
  UNION ALL SELECT 'score/hit', 'neither_score_nor_hit', sid, NULL FROM ok WHERE n1 IS NULL AND n2 IS NULL AND h IS NULL)"""

SQL = {
    "p03_normalized_index": f"{_IX} SELECT * FROM ix",
    "p04_text_key": f"{_IX} SELECT screen_id, {_key('library_methodology')} AS methodology, {_key('experimental_setup')} AS setup FROM ix",
    "f01_parsed_values": f"""{_IX} SELECT screen_id, {_VALUE} AS dose, {_UNIT} AS unit, CASE WHEN regexp_matches(duration, '{_DAYS}') THEN CAST(regexp_extract(duration, '{_DAYS}', 1) AS DOUBLE) END AS days,
      TRY_CAST(moi AS DOUBLE) AS moi, {_MODALITY} AS modality,
      CASE lower(screen_type) WHEN 'positive selection' THEN 'positive_selection' WHEN 'negative selection' THEN 'negative_selection' WHEN 'positive/negative selection' THEN 'bidirectional_selection' ELSE CASE WHEN screen_type IS NULL THEN 'unknown' ELSE 'other' END END AS strategy,
      CASE throughput WHEN 'Genome-Wide' THEN 'genome_wide' WHEN 'Focused' THEN 'targeted' WHEN 'tiling array' THEN 'saturation' WHEN 'small' THEN 'other' ELSE 'unknown' END AS scale FROM ix""",
    "e00_index_screens": f"""{_IX} SELECT {_SID} AS screen_id, {_STUDY} AS study_id, 'orcs:source-family:' || lower(source_type) || ':' || source_id AS source_family_id, {_MODALITY} AS perturbation_modality,
      CASE WHEN lower(experimental_setup) = 'drug exposure' THEN condition_name END AS drug_name, {_VALUE} AS treatment_dose, {_UNIT} AS treatment_unit, 'https://orcs.thebiogrid.org/Screen/' || screen_id AS source_url FROM ix""",
    "e00_index_designs": f"""{_IX} SELECT {_SID} AS screen_id, CASE throughput WHEN 'Genome-Wide' THEN 'genome_wide' WHEN 'Focused' THEN 'targeted' WHEN 'tiling array' THEN 'saturation' WHEN 'small' THEN 'other' ELSE 'unknown' END AS screen_scale,
      screen_format, experimental_setup, CASE lower(screen_type) WHEN 'positive selection' THEN 'positive_selection' WHEN 'negative selection' THEN 'negative_selection' WHEN 'positive/negative selection' THEN 'bidirectional_selection' ELSE CASE WHEN screen_type IS NULL THEN 'unknown' ELSE 'other' END END AS selection_strategy,
      TRY_CAST(moi AS DOUBLE) AS library_moi, 'BioGRID ORCS {_RELEASE} screen index; SCREEN_ID=' || screen_id AS source_locator FROM ix""",
    "e00_index_contrasts": f"""{_IX} SELECT {_SID} AS screen_id, {_SID} || ':contrast:reported' AS contrast_id, 'ORCS screen ' || screen_id AS contrast_name, coalesce(condition_name, 'unknown') AS treatment_name,
      {_VALUE} AS treatment_dose, {_UNIT} AS treatment_unit, 'unknown' AS control_type, 'unknown' AS intended_direction FROM ix""",
    "e00_index_maps": f"""{_IX} SELECT 'orcs:{_RELEASE}:external-screen:' || screen_id AS mapping_id, {_SID} AS screen_id, '{_RELEASE}' AS source_version, screen_id AS external_screen_id, 'source_record' AS relationship,
      'https://orcs.thebiogrid.org/Screen/' || screen_id AS source_url, DATE '{_DAY}' AS retrieved_date FROM ix""",
    "u05_index_studies": f"""{_IX}, st AS (SELECT {_STUDY} AS study_id, CASE WHEN source_id IS NULL THEN 'BioGRID ORCS screen ' || screen_id ELSE 'BioGRID ORCS source ' || source_id END AS named, *, CAST(screen_id AS BIGINT) AS n FROM ix)
      SELECT study_id, coalesce(arg_min(coalesce(author, named), n), '') AS citation, coalesce(arg_min(coalesce(organism_official, 'unknown'), n), '') AS organism, arg_min(source_type, n) AS source_type, min(source_id) AS pubmed_id FROM st GROUP BY study_id""",
    "e05_rule_checks": f"{_CHECKS} SELECT * FROM checks",
    "e06_decisions": f"{_CHECKS} SELECT screen_id, CASE WHEN failed IS NULL THEN 'metadata_only' ELSE 'exclude' END AS status, failed IS NULL AS candidate_for_full_curation, false AS benchmark_ready, coalesce(failed, open_, 'full_text_curation_required') AS reason_codes FROM decided",
    "ai1_triage_summary": f"""{_CHECKS} SELECT 'total_screens' AS key, count(*) AS value FROM decided UNION ALL SELECT 'candidates', count(*) FROM decided WHERE failed IS NULL UNION ALL SELECT 'benchmark_ready', 0
      UNION ALL SELECT 'status:benchmark_ready', 0 UNION ALL SELECT 'status:metadata_only', count(*) FROM decided WHERE failed IS NULL UNION ALL SELECT 'status:exclude', count(*) FROM decided WHERE failed IS NOT NULL
      UNION ALL SELECT 'failed:' || rule_id, count(*) FROM checks WHERE required_for_scope AND outcome = 'fail' GROUP BY rule_id""",
    "u01_summary_scores": """WITH r AS (SELECT 'GENE' || p_partkey AS gene_symbol, p_retailprice / 1000 AS score, p_size / 100.0::DOUBLE AS fdr, CAST(p_size AS DOUBLE) AS rk FROM part)
      SELECT gene_symbol, 'mageck_pos' AS analysis_tail, 'unknown' AS direction, round(score, 6) + 0.0 AS score, CAST(NULL AS DOUBLE) AS effect, CAST(NULL AS DOUBLE) AS p_value, round(fdr, 6) + 0.0 AS fdr, rk AS rank FROM r
      UNION ALL SELECT gene_symbol, 'mageck_neg', 'unknown', NULL, CASE WHEN rk > 25 THEN rk END, NULL, NULL, NULL FROM r""",
    "u02_gene_scores": f"{_SC} SELECT 'orcs:{_RELEASE}:screen:' || sid AS screen_id, method, tail AS analysis_tail, kind AS score_type, count(*) AS n, round(sum(score), 6) + 0.0 AS score_sum, count(*) FILTER (h) AS hits, count(h) AS with_hit FROM rows_ GROUP BY ALL",
    "u04_score_issues": f"{_SC} SELECT field, error, sid AS external_screen_id, count(*) AS n, count(v) AS with_value FROM issues GROUP BY ALL",
}
