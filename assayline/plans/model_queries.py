"""Queries over design features, models and the further operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ranks import rounded
from ..functions.scratch import written
from ..operators import baselines, design, extras, held_out, model
from ..operators.counts import gene_effects, guide_effects
from ..operators.families import study_families
from ..operators.resampling import cluster_bootstrap
from . import count_queries as CQ, demo_views as V, ranking_queries as RQ

# Contrasts, screens, designs and samples over parts, suppliers and customers.
_CONTRAST = [
    "concat('S', p_partkey % 10) as screen_id", "concat('C', p_partkey) as contrast_id",
    "case p_partkey % 4 when 0 then 'vehicle' when 1 then 'untreated' when 2 then 'sorted_population' end as control_type",
    "case when p_partkey % 3 = 0 then 0.0 when p_partkey % 3 = 1 then cast(p_size as double) end as recovery_days",
    "case when p_partkey % 5 = 0 then cast(p_size as double) end as treatment_dose",
    "case p_partkey % 3 when 0 then 'yes' when 1 then 'No' end as vehicle_control_present",
]
_SCREEN = ["concat('S', s_suppkey) as screen_id", "concat('N', s_nationkey) as study_id", "concat('F', s_nationkey % 7) as source_family_id", "'from screen' as control_type"]
_DESIGN = [
    "concat('S', s_suppkey) as screen_id", "case when s_suppkey % 2 = 0 then 0.3 end as library_moi",
    "case when s_suppkey % 3 = 0 then 500.0 end as coverage_transduction", "case when s_suppkey % 4 = 0 then 200.0 end as coverage_selection",
    "case s_suppkey % 3 when 0 then 'genome_wide' when 1 then 'targeted' end as screen_scale",
    "case s_suppkey % 2 when 0 then 'positive_selection' else 'unknown' end as selection_strategy", "'independent_infection' as replicate_unit",
]
_SAMPLE = [
    "concat('S', (c_custkey % 2000) % 10) as screen_id", "concat('C', c_custkey % 2000) as contrast_id",
    "case c_custkey % 3 when 0 then 'control' when 1 then 'treatment' else 'baseline' end as condition_role",
    "case when c_custkey % 5 = 0 then ' ' else concat('I', c_custkey % 2) end as infection_replicate_id",
    "case when c_custkey % 4 <> 0 then concat('P', c_custkey % 3) end as pair_id", "case when c_custkey % 6 = 0 then '3' when c_custkey % 6 = 1 then 'x' end as timepoint_days",
]


def _design(spark, sf_dir) -> DataFrame:
    t = lambda n, e: V.table(spark, sf_dir, n).selectExpr(*e)
    return design.featurize_design(t("supplier", _SCREEN), t("supplier", _DESIGN), t("part", _CONTRAST), t("customer", _SAMPLE))


_SHOWN = [
    "study_id", "source_family_id", "control_sample_n", "treatment_sample_n", "baseline_sample_n", "observed_infection_replicate_count",
    "observed_timepoint_count", "paired_replicate_fraction", "vehicle_control_present", "recovery_days", "recovery_days_missing",
    "minimum_declared_coverage", "treatment_dose_reported", "control_type_vehicle", "control_type_unknown", "screen_scale_genome_wide",
    "selection_strategy_positive_selection", "design_metadata_completeness",
]


def a26_design_features(spark, sf_dir):
    found = _design(spark, sf_dir)
    return found.select("screen_id", "contrast_id", *_SHOWN[:-1], rounded("design_metadata_completeness").alias("design_metadata_completeness"))


def a27_artifact_context(spark, sf_dir):
    features = V.table(spark, sf_dir, "part").selectExpr("concat('GENE', p_partkey) as gene_symbol", "concat('L', p_partkey % 3) as cell_line", "p_retailprice as raw_effect", "cast(p_size as double) as raw_rank")
    context = V.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr(
        "concat('GENE', p_partkey) as gene_symbol", "concat('L', p_partkey % 3) as cell_line", "case when p_size > 5 then p_size / 10.0D end as copy_number",
        "p_size / 20.0D as expression_log2_tpm", "case when p_size % 3 = 0 then p_retailprice / 2 end as corrected_effect", "cast(p_size - 1 as double) as corrected_rank",
    )
    out = design.merge_context(features, context)
    return out.select("gene_symbol", "high_amplification_flag", "low_expression_flag", "cnv_correction_available",
                      *[rounded(c).alias(c) for c in ("absolute_cnv_deviation", "raw_corrected_effect_delta", "raw_corrected_rank_delta")])


def candidates(spark, sf_dir) -> DataFrame:
    """Scored documents as candidates with labels, testing status, families and numeric features."""
    docs = V.scored(spark, sf_dir)
    label = F.expr("case when target is null then 'U' when toxic = 1 and target = 1 then 'V3' when target = 1 then 'V2' when toxic = 1 then 'D' else 'F0' end")
    status = F.expr("case when target is not null then 'tested' when doc_id % 4 = 0 then 'not_tested' else 'unknown' end")
    lines = F.ln(F.col("n_chars") + 1.0)
    return docs.withColumns({
        "label_code": label, "testing_status": status, "source_family_id": F.expr("case when study_id in ('src1', 'src2') then 'shared' end"),
        "length_feature": F.when(F.col("doc_id") % 10 != 0, lines), "score_feature": F.col("score"), "median_guide_lfc": F.col("score") - 0.5,
        "mean_guide_lfc": F.col("score") - 0.4, "signal_direction": F.expr("case when score > 0.5 then 'resistance' else 'sensitization' end"),
    })


_FEATURES = ["length_feature", "score_feature", "direction_aligned_median_guide_lfc"]


def p06_aligned_direction(spark, sf_dir):
    names = ["direction_aligned_median_guide_lfc", "direction_aligned_mean_guide_lfc", "direction_signal_agreement"]
    return model.align_direction(candidates(spark, sf_dir)).select("gene_symbol", *[rounded(n).alias(n) for n in names])


def p07_testing_target(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy(model.testing_target(F.col("testing_status")).alias("tested")).agg(F.count("*").alias("n"))


def m02_weighted_medians(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").withColumn("weight", F.lit(1.0) / F.col("l_linenumber"))
    rows = rows.withColumn("l_discount", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    return model.weighted_medians(rows, ["l_quantity", "l_discount", "l_tax"], "weight").select("feature", rounded("median").alias("median"))


def m05_group_folds(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    folds = model.deal_groups(rows, "study_id", 5)
    return rows.join(folds, rows.study_id == folds.group).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("study_id").alias("groups"))


def m11_out_of_fold(spark, sf_dir):
    # Candidates have one of two directions.
    rows = candidates(spark, sf_dir).withColumn("phenotype_direction", F.expr("case doc_id % 2 when 0 then 'resistance' else 'sensitization' end"))
    scored, _ = model.out_of_fold(rows, _FEATURES)
    return scored.select("gene_symbol", "group_used", "fold", "y", "score", "ipw_score")


def j04_assembled(spark, sf_dir):
    """Count features with their contrast's design features and their candidate's label."""
    genes = gene_effects(guide_effects(CQ._logged(spark, sf_dir))).withColumn("study_id", F.expr("concat('N', substring(screen_id, 3))"))
    designs = V.sheet(spark, sf_dir).groupBy("screen_id", "contrast_id").agg(F.count_if(F.col("condition_role") == "control").alias("control_sample_n"))
    labels = V.table(spark, sf_dir, "part").selectExpr(
        "concat('N', p_partkey % 4) as study_id", "concat('SC', p_partkey % 4) as screen_id", "concat('SC', p_partkey % 4, ':C', p_size % 2) as contrast_id",
        "concat('GENE', p_partkey) as gene_symbol", "case when p_size > 25 then 'V2' else 'F0' end as label_code",
    )
    found = model.assemble_features(genes, designs, labels)
    return found.select("screen_id", "contrast_id", "gene_symbol", "guide_n", "control_sample_n", "label_code")


def d05_uplift(spark, sf_dir):
    rows = V.scored(spark, sf_dir)
    found = extras.uplift(rows, RQ._QUERY, "target", "score", {"length": F.col("n_chars"), "absolute_effect": F.abs(F.col("score") - 0.5)})
    return found.select("baseline", "queries", *[rounded(c).alias(c) for c in ("score_ap", "baseline_ap", "uplift")])


def _guides(spark, sf_dir) -> DataFrame:
    return guide_effects(CQ._logged(spark, sf_dir))


def d05_smoothed_z(spark, sf_dir):
    found = baselines.smoothed_z(_guides(spark, sf_dir), window=100)
    return found.select("screen_id", "contrast_id", "gene_symbol", "guide_n", rounded("norm_z").alias("norm_z"))


def d05_rank_scores(spark, sf_dir):
    found = baselines.rank_scores(_guides(spark, sf_dir))
    return found.select("screen_id", "contrast_id", "gene_symbol", "guide_n", rounded("rho").alias("rho"))


def d05_rank_aggregation(spark, sf_dir):
    found = baselines.rank_aggregation(_guides(spark, sf_dir))
    return found.select("screen_id", "contrast_id", "gene_symbol", "guide_n", rounded("rho").alias("rho"), "p_value")


def d05_baseline_uplift(spark, sf_dir):
    """How much better than both baselines the mean of a gene's guides ranks its successes, per contrast."""
    keys = ["screen_id", "contrast_id", "gene_symbol"]
    guides = written(_guides(spark, sf_dir), "guides")
    means = guides.groupBy(*keys).agg((-F.avg("guide_lfc")).alias("score"))
    part = V.table(spark, sf_dir, "part").selectExpr("concat('GENE', p_partkey div 4) as gene_symbol", "p_size")
    labels = part.groupBy("gene_symbol").agg((F.max("p_size") > 40).cast("double").alias("target"))
    # All four have a row for each gene, which no driver should send.
    ranks, zs = baselines.rank_scores(guides).drop("guide_n"), baselines.smoothed_z(guides, window=100).drop("guide_n")
    rows = means.join(ranks.hint("merge"), keys).join(zs.hint("merge"), keys).join(labels.hint("merge"), "gene_symbol")
    # Scores that differ by rounding alone are ties.
    rows = written(rows.withColumns({"score": rounded("score"), "norm_z": rounded("norm_z"), "rho": rounded("rho")}), "rows")
    found = extras.uplift(rows, ["screen_id", "contrast_id"], "target", "score", {"rank_aggregation": -F.col("rho"), "smoothed_z": -F.col("norm_z")})
    return found.select("baseline", "queries", *[rounded(c).alias(c) for c in ("score_ap", "baseline_ap", "uplift")])


def d06_coverage(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    found = extras.coverage(rows, rows.where("target is not null"), "demo", {"screen": ["score_feature"], "design": ["length_feature", "toxic"]})
    return found.select("gene_symbol", "profile_name", rounded("metadata_completeness_fraction").alias("metadata_completeness_fraction"), "outside_support", "screen_available", "design_available")


def d07_graded_ndcg(spark, sf_dir):
    rows = V.scored(spark, sf_dir).withColumn("grade", F.expr("case when target is null then null when target = 1 and toxic = 1 then 3.0 when target = 1 then 2.0 else 0.0 end"))
    found = extras.graded_ndcg(rows, RQ._QUERY, "grade", "score", ["gene_symbol"])
    return found.select(*RQ._QUERY, rounded("ndcg").alias("ndcg"))


def d07_failure_rate(spark, sf_dir):
    found = extras.failure_rate(V.scored(spark, sf_dir), RQ._QUERY, "target", "score", ["gene_symbol"])
    return found.select(*RQ._QUERY, rounded("failure_rate").alias("failure_rate"))


def d08_screen_quality(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    essential = part.where("p_size > 40").selectExpr("concat('GENE', p_partkey div 4) as gene_symbol")
    controls = part.where("p_size <= 5").selectExpr("concat('G', p_partkey) as sgrna_id")
    found = extras.screen_quality(guide_effects(CQ._logged(spark, sf_dir)), essential, controls)
    return found.select("screen_id", "contrast_id", rounded("essential_gene_separation").alias("essential_gene_separation"), rounded("nontargeting_dispersion").alias("nontargeting_dispersion"))


def d08_guide_flags(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    guides = part.selectExpr("concat('G', p_partkey) as sgrna_id", "concat('GENE', p_partkey div 4) as gene_symbol")
    notes = part.selectExpr("concat('G', p_partkey) as sgrna_id", "case when p_size % 3 <> 0 then p_size % 4 end as multi_target_count")
    return extras.guide_flags(guides, notes, part.where("p_size > 40").selectExpr("concat('GENE', p_partkey div 4) as gene_symbol"))


def d10_family_bootstrap(spark, sf_dir):
    """Intervals of metrics over families of studies drawn with replacement."""
    rows = candidates(spark, sf_dir)
    families = study_families(rows.select("study_id", "source_family_id").distinct(), families=("source_family_id",))
    return cluster_bootstrap(rows.join(families, "study_id"), "family_group", RQ._QUERY, tie=("gene_symbol",))


def d01_leave_one_out(spark, sf_dir):
    return extras.leave_one_group_out(V.scored(spark, sf_dir), "study_id")


def d02_as_of(spark, sf_dir):
    found = extras.as_of(V.table(spark, sf_dir, "orders"), "1996-01-01", ["o_custkey"], "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "o_orderkey")


def d01_held_out_scores(spark, sf_dir):
    """Each candidate's score by a fit without its study and the families linked with it."""
    rows = candidates(spark, sf_dir).withColumn("all_length", F.ln(F.col("n_chars") + 1.0))
    found = held_out.leave_group_out_scores(rows, "study_id", "source_family_id", ["score", "all_length"])
    return found.select("study_id", "gene_symbol", "training_rows", rounded("held_out_score").alias("held_out_score"))


def d02_as_of_join(spark, sf_dir):
    """Each order with its user's last event by its own cutoff; days hold many events of a user, the greatest counts."""
    orders = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 50 as user_id", "timestampadd(DAY, cast(o_orderkey % 40 as int), timestamp'2024-01-01') as cutoff")
    events = V.table(spark, sf_dir, "events").selectExpr("user_id % 50 as user_id", "date_trunc('DAY', ts) as available", "event_id", "event_type")
    found = held_out.as_of_join(orders, events, ["user_id"], "cutoff", "available", ["event_id", "event_type"])
    return found.select("o_orderkey", "user_id", "available", "event_id", "event_type")


def d02_temporal_split(spark, sf_dir):
    found = held_out.temporal_split(V.table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "o_custkey")
    return found.select("o_orderkey", "split")


def d03_training_recurrence(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").selectExpr("concat('GENE', l_partkey) as gene_symbol", "concat('F', l_suppkey) as family", "l_returnflag as direction", "cast(l_suppkey % 5 as int) as fold")
    found = held_out.training_recurrence(rows, ["gene_symbol"], "family", "direction", "fold")
    return found.select("gene_symbol", "family", "fold", "training_families", rounded("same_direction_fraction").alias("same_direction_fraction"))


def d03_recurrence(spark, sf_dir):
    rows = V.label_events(spark, sf_dir).where("gene_symbol is not null")
    found = extras.recurrence(rows, ["gene_symbol"], "label_code", "phenotype_direction")
    return found.select("gene_symbol", "label_code", "other_families", rounded("same_direction_fraction").alias("same_direction_fraction"))


def d04_calibration(spark, sf_dir):
    return extras.calibration(V.scored(spark, sf_dir))


def d07_reciprocal_rank(spark, sf_dir):
    found = extras.mean_reciprocal_rank(V.scored(spark, sf_dir), RQ._QUERY, "target", "score", ["gene_symbol"])
    return found.select(*RQ._QUERY, rounded("reciprocal_rank").alias("reciprocal_rank"))


def d07_budget_curve(spark, sf_dir):
    return extras.budget_curve(V.scored(spark, sf_dir), RQ._QUERY, "target", "score", ["gene_symbol"])


def d09_count_gini(spark, sf_dir):
    return extras.count_gini(CQ._long(spark, sf_dir)).select("sample_id", rounded("gini").alias("gini"))


def d09_leave_best_out(spark, sf_dir):
    found = extras.leave_best_out(guide_effects(CQ._logged(spark, sf_dir)))
    return found.select("screen_id", "contrast_id", "gene_symbol", rounded("leave_best_out_change").alias("leave_best_out_change"))


def d11_panel(spark, sf_dir):
    found = extras.stratified_panel(V.scored(spark, sf_dir), ["score"], 3, 2, F.md5("gene_symbol"), "gene_symbol", ["study_id"])
    return found.select("study_id", "gene_symbol", "score_bin")


def d12_family_priority(spark, sf_dir):
    rows = V.families(spark, sf_dir)
    return rows.select("study_id", extras.family_of(F.col("source_family_id"), F.col("raw_data_family_id"), F.col("study_id")).alias("family"))


QUERIES = {
    f.__name__: f
    for f in (
        a26_design_features, a27_artifact_context, p06_aligned_direction, p07_testing_target, m02_weighted_medians, m05_group_folds, m11_out_of_fold, j04_assembled, d05_uplift, d05_smoothed_z, d05_rank_scores, d05_rank_aggregation, d05_baseline_uplift, d06_coverage,
        d07_graded_ndcg, d07_failure_rate, d08_screen_quality, d08_guide_flags, d10_family_bootstrap,
        d01_leave_one_out, d01_held_out_scores, d02_as_of, d02_as_of_join, d02_temporal_split, d03_recurrence, d03_training_recurrence, d04_calibration, d07_reciprocal_rank, d07_budget_curve, d09_count_gini, d09_leave_best_out, d11_panel,
        d12_family_priority,
    )
}

_SC = RQ._SCORED
_Q = RQ._Q
_COMPLETE = " + ".join([
    "CAST(library_moi IS NOT NULL AS INT)", "CAST(coverage_transduction IS NOT NULL AS INT)", "CAST(coverage_selection IS NOT NULL AS INT)", "CAST(c.control_type IS NOT NULL AS INT)",
])


def _uplift_sql(name: str, value: str) -> str:
    def ap(score: str) -> str:
        return f"""SELECT {_Q}, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn
          FROM (SELECT {_Q}, {score} AS s, sum(target) AS tp, count(*)::DOUBLE AS n FROM r WHERE target IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY {_Q} ORDER BY s DESC)) GROUP BY {_Q}"""

    return f"""WITH {_SC}, r AS (SELECT sc.*, {value} AS base FROM sc JOIN documents d ON sc.gene_symbol = 'GENE' || d.doc_id),
      mixed AS (SELECT {_Q} FROM r WHERE target IS NOT NULL GROUP BY {_Q} HAVING min(target) <> max(target)), a AS ({ap('score')}), b AS ({ap('base')})
      SELECT '{name}' AS baseline, count(*) AS queries, round(avg(a.ap), 6) + 0.0 AS score_ap, round(avg(b.ap), 6) + 0.0 AS baseline_ap, round(avg(a.ap - b.ap), 6) + 0.0 AS uplift FROM mixed JOIN a USING ({_Q}) JOIN b USING ({_Q})"""


_SMOOTHED = """pz AS (SELECT *, (row_number() OVER (PARTITION BY screen_id, contrast_id ORDER BY mean_control_count DESC NULLS LAST, sgrna_id) - 1) // 100 AS run FROM guides WHERE guide_lfc IS NOT NULL),
rz AS (SELECT screen_id, contrast_id, run, count(*) AS n, sum(guide_lfc) AS s, sum(guide_lfc * guide_lfc) AS q FROM pz GROUP BY ALL),
az AS (SELECT screen_id, contrast_id, run, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM rz WINDOW w AS (PARTITION BY screen_id, contrast_id ORDER BY run ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
sz AS (SELECT screen_id, contrast_id, run, max(sqrt(greatest((q - s * s / n) / nullif(n - 1, 0), 0))) OVER (PARTITION BY screen_id, contrast_id ORDER BY run) AS sd FROM az),
gz AS (SELECT screen_id, contrast_id, gene_symbol, count(*) AS guide_n, sum(guide_lfc / nullif(sd, 0)) / sqrt(count(guide_lfc / nullif(sd, 0))) AS z FROM pz JOIN sz USING (screen_id, contrast_id, run) GROUP BY ALL),
smoothed AS (SELECT screen_id, contrast_id, gene_symbol, guide_n, round((z - avg(z) OVER c) / stddev_samp(z) OVER c, 6) + 0.0 AS norm_z FROM gz WINDOW c AS (PARTITION BY screen_id, contrast_id))"""
_RANKED = """pr AS (SELECT *, (rank() OVER (PARTITION BY screen_id, contrast_id ORDER BY guide_lfc) + (count(*) OVER (PARTITION BY screen_id, contrast_id, guide_lfc) - 1) / 2.0::DOUBLE - 0.5::DOUBLE)
  / count(*) OVER (PARTITION BY screen_id, contrast_id) AS u FROM (SELECT * REPLACE (round(guide_lfc, 9) AS guide_lfc) FROM guides) WHERE guide_lfc IS NOT NULL),
kr AS (SELECT *, row_number() OVER (PARTITION BY screen_id, contrast_id, gene_symbol ORDER BY u, sgrna_id) AS k, count(*) OVER (PARTITION BY screen_id, contrast_id, gene_symbol) AS n FROM pr),
rra AS (SELECT screen_id, contrast_id, gene_symbol, max(n) AS guide_n,
  round(coalesce(min(list_sum(list_transform(range(k, n + 1), lambda j: factorial(CAST(n AS INT))::DOUBLE / factorial(CAST(j AS INT))::DOUBLE / factorial(CAST(n - j AS INT))::DOUBLE * pow(u, j) * pow(1 - u, n - j)))) FILTER (u <= 0.25), 1.0), 6) + 0.0 AS rho FROM kr GROUP BY ALL)"""
_RQ = "screen_id, contrast_id"


def _screen_uplift_sql(name: str, value: str) -> str:
    def ap(score: str) -> str:
        return f"""SELECT {_RQ}, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn
          FROM (SELECT {_RQ}, {score} AS s, sum(target) AS tp, count(*)::DOUBLE AS n FROM r WHERE {value} IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY {_RQ} ORDER BY s DESC)) GROUP BY ALL"""

    return f"""SELECT '{name}' AS baseline, count(*) AS queries, round(avg(a.ap), 6) + 0.0 AS score_ap, round(avg(b.ap), 6) + 0.0 AS baseline_ap, round(avg(a.ap - b.ap), 6) + 0.0 AS uplift
  FROM (SELECT {_RQ} FROM r WHERE {value} IS NOT NULL GROUP BY ALL HAVING min(target) <> max(target)) JOIN ({ap('score')}) a USING ({_RQ}) JOIN ({ap(value)}) b USING ({_RQ})"""


SQL = {
    "a26_design_features": f"""WITH c AS (SELECT {', '.join(_CONTRAST)} FROM part), s AS (SELECT {', '.join(_SCREEN)} FROM supplier), d AS (SELECT {', '.join(_DESIGN)} FROM supplier),
x AS (SELECT {', '.join(_SAMPLE)} FROM customer),
n AS (SELECT screen_id, contrast_id, CAST(count(*) FILTER (condition_role = 'control') AS INT) AS c0, CAST(count(*) FILTER (condition_role = 'treatment') AS INT) AS c1,
  CAST(count(*) FILTER (condition_role = 'baseline') AS INT) AS c2, nullif(count(DISTINCT nullif(trim(infection_replicate_id), '')), 0) AS inf, nullif(count(DISTINCT TRY_CAST(timepoint_days AS DOUBLE)), 0) AS tp FROM x GROUP BY ALL),
p AS (SELECT screen_id, contrast_id, avg(CAST(b AS DOUBLE)) AS pf FROM (SELECT screen_id, contrast_id, pair_id, bool_or(condition_role = 'control') AND bool_or(condition_role = 'treatment') AS b FROM x WHERE trim(pair_id) <> '' GROUP BY ALL) GROUP BY ALL)
SELECT c.screen_id, c.contrast_id, s.study_id, s.source_family_id, coalesce(c0, 0) AS control_sample_n, coalesce(c1, 0) AS treatment_sample_n, coalesce(c2, 0) AS baseline_sample_n,
  CAST(inf AS DOUBLE) AS observed_infection_replicate_count, CAST(tp AS DOUBLE) AS observed_timepoint_count, pf AS paired_replicate_fraction,
  CASE lower(vehicle_control_present) WHEN 'yes' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE END AS vehicle_control_present, recovery_days::DOUBLE AS recovery_days, CAST(recovery_days IS NULL AS DOUBLE) AS recovery_days_missing,
  least(coverage_transduction, coverage_selection)::DOUBLE AS minimum_declared_coverage, CAST(treatment_dose IS NOT NULL AS DOUBLE) AS treatment_dose_reported,
  CAST(coalesce(c.control_type, 'unknown') = 'vehicle' AS DOUBLE) AS control_type_vehicle, CAST(c.control_type IS NULL AS DOUBLE) AS control_type_unknown,
  CAST(coalesce(screen_scale, '') = 'genome_wide' AS DOUBLE) AS screen_scale_genome_wide, CAST(selection_strategy = 'positive_selection' AS DOUBLE) AS selection_strategy_positive_selection,
  round(({_COMPLETE}) / 10.0::DOUBLE, 6) + 0.0 AS design_metadata_completeness
FROM c JOIN s USING (screen_id) LEFT JOIN d USING (screen_id) LEFT JOIN n ON n.screen_id = c.screen_id AND n.contrast_id = c.contrast_id LEFT JOIN p ON p.screen_id = c.screen_id AND p.contrast_id = c.contrast_id""",
    "a27_artifact_context": """WITH x AS (SELECT *, p_partkey % 2 = 0 AS k, CASE WHEN p_partkey % 2 = 0 AND p_size > 5 THEN p_size / 10.0::DOUBLE END AS cn, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN p_retailprice / 2 END AS ce FROM part)
SELECT 'GENE' || p_partkey AS gene_symbol, coalesce(cn >= 4, false) AS high_amplification_flag, k AND p_size / 20.0::DOUBLE < 1 AS low_expression_flag, ce IS NOT NULL AS cnv_correction_available,
  round(abs(cn - 2), 6) + 0.0 AS absolute_cnv_deviation, round(p_retailprice - ce, 6) + 0.0 AS raw_corrected_effect_delta, CASE WHEN k THEN 1.0::DOUBLE END AS raw_corrected_rank_delta FROM x""",
    "p06_aligned_direction": f"""WITH {_SC}, s AS (SELECT *, CASE phenotype_direction WHEN 'resistance' THEN 1 WHEN 'sensitization' THEN -1 ELSE 0 END AS sign FROM sc)
SELECT gene_symbol, round(sign * (score - 0.5), 6) + 0.0 AS direction_aligned_median_guide_lfc, round(sign * (score - 0.4), 6) + 0.0 AS direction_aligned_mean_guide_lfc,
  CAST((CASE WHEN score > 0.5 THEN 'resistance' ELSE 'sensitization' END) = phenotype_direction AS DOUBLE) AS direction_signal_agreement FROM s""",
    "p07_testing_target": f"WITH {_SC} SELECT CASE WHEN target IS NOT NULL THEN 1 WHEN CAST(replace(gene_symbol, 'GENE', '') AS BIGINT) % 4 = 0 THEN 0 END AS tested, count(*) AS n FROM sc GROUP BY 1",
    "m02_weighted_medians": """WITH l AS (SELECT 1.0::DOUBLE / l_linenumber AS w, l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END AS l_discount, l_tax FROM lineitem),
u AS (SELECT 'l_quantity' AS feature, l_quantity AS v, w FROM l UNION ALL SELECT 'l_discount', l_discount, w FROM l UNION ALL SELECT 'l_tax', l_tax, w FROM l),
s AS (SELECT feature, v, sum(w) AS w FROM u WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY feature ORDER BY v) AS c, sum(w) OVER (PARTITION BY feature) AS t FROM s)
SELECT feature, round(min(v), 6) + 0.0 AS median FROM c WHERE c >= t / 2 GROUP BY feature""",
    "j04_assembled": f"""WITH {CQ._LONG}, d AS (SELECT screen_id, contrast_id, count(*) FILTER (condition_role = 'control') AS control_sample_n FROM sheet GROUP BY ALL)
SELECT g.screen_id, g.contrast_id, g.gene_symbol, guide_n, control_sample_n, CASE WHEN p_size > 25 THEN 'V2' WHEN p_size IS NOT NULL THEN 'F0' END AS label_code
FROM genes0 g LEFT JOIN d USING (screen_id, contrast_id) LEFT JOIN part p ON g.gene_symbol = 'GENE' || p_partkey AND g.contrast_id = 'SC' || (p_partkey % 4) || ':C' || (p_size % 2)""",
    "d05_uplift": " UNION ALL ".join(f"SELECT * FROM ({_uplift_sql(name, value)})" for name, value in (("length", "n_chars::DOUBLE"), ("absolute_effect", "abs(score - 0.5)"))),
    "d05_smoothed_z": f"WITH {CQ._LONG}, {_SMOOTHED} SELECT * FROM smoothed",
    "d05_rank_scores": f"WITH {CQ._LONG}, {_RANKED} SELECT * FROM rra",
    "d05_baseline_uplift": f"""WITH {CQ._LONG}, {_SMOOTHED}, {_RANKED}, lab AS (SELECT 'GENE' || (p_partkey // 4) AS gene_symbol, CAST(max(p_size) > 40 AS DOUBLE) AS target FROM part GROUP BY ALL),
m AS (SELECT screen_id, contrast_id, gene_symbol, round(-avg(guide_lfc), 6) + 0.0 AS score FROM guides GROUP BY ALL),
r AS (SELECT screen_id, contrast_id, score, norm_z, rho, target FROM m JOIN smoothed USING (screen_id, contrast_id, gene_symbol) JOIN rra USING (screen_id, contrast_id, gene_symbol) JOIN lab USING (gene_symbol))
{_screen_uplift_sql("rank_aggregation", "-rho")} UNION ALL {_screen_uplift_sql("smoothed_z", "-norm_z")}""",
    "d06_coverage": f"""WITH {_SC}, c AS (SELECT sc.*, d.doc_id, n_chars, toxic, CASE WHEN d.doc_id % 10 <> 0 THEN ln(n_chars + 1.0) END AS lf FROM sc JOIN documents d ON sc.gene_symbol = 'GENE' || d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT min(score) AS s0, max(score) AS s1, min(lf) AS l0, max(lf) AS l1, min(toxic) AS t0, max(toxic) AS t1 FROM c WHERE target IS NOT NULL)
SELECT gene_symbol, 'demo' AS profile_name, round((1 + CAST(lf IS NOT NULL AS INT) + CAST(toxic IS NOT NULL AS INT)) / 3.0::DOUBLE, 6) + 0.0 AS metadata_completeness_fraction,
  CAST(coalesce(score < s0 OR score > s1, false) AS INT) + CAST(coalesce(lf < l0 OR lf > l1, false) AS INT) + CAST(coalesce(toxic < t0 OR toxic > t1, false) AS INT) AS outside_support,
  true AS screen_available, lf IS NOT NULL OR toxic IS NOT NULL AS design_available FROM c, t""",
    "d07_graded_ndcg": f"""WITH {_SC}, g AS (SELECT sc.*, CASE WHEN target = 1 AND toxic = 1 THEN 7.0::DOUBLE WHEN target = 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS gain FROM sc JOIN labels l ON sc.gene_symbol = 'GENE' || l.doc_id WHERE target IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS a, row_number() OVER (PARTITION BY {_Q} ORDER BY gain DESC) AS b FROM g)
SELECT {_Q}, round(sum(CASE WHEN a <= 10 THEN gain / log2(a + 1) ELSE 0 END) / sum(CASE WHEN b <= 10 THEN gain / log2(b + 1) ELSE 0 END), 6) + 0.0 AS ndcg FROM p GROUP BY {_Q} HAVING sum(gain) > 0""",
    "d07_failure_rate": f"WITH {_SC}, p AS (SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS n FROM sc WHERE target IS NOT NULL) SELECT {_Q}, round(avg(CAST(target = 0 AS DOUBLE)), 6) + 0.0 AS failure_rate FROM p WHERE n <= 10 GROUP BY {_Q}",
    "d08_screen_quality": f"""WITH {CQ._LONG}, ess AS (SELECT DISTINCT 'GENE' || (p_partkey // 4) AS gene_symbol FROM part WHERE p_size > 40), con AS (SELECT DISTINCT 'G' || p_partkey AS sgrna_id FROM part WHERE p_size <= 5),
m AS (SELECT g.*, e.gene_symbol IS NOT NULL AS e, c.sgrna_id IS NOT NULL AS c FROM guides g LEFT JOIN ess e ON e.gene_symbol = g.gene_symbol LEFT JOIN con c ON c.sgrna_id = g.sgrna_id)
SELECT screen_id, contrast_id, round((avg(guide_lfc) FILTER (NOT e AND NOT c) - avg(guide_lfc) FILTER (e AND NOT c)) / sqrt((var_samp(guide_lfc) FILTER (e AND NOT c) + var_samp(guide_lfc) FILTER (NOT e AND NOT c)) / 2), 6) + 0.0 AS essential_gene_separation,
  round(stddev_samp(guide_lfc) FILTER (c), 6) + 0.0 AS nontargeting_dispersion FROM m GROUP BY ALL""",
    "d08_guide_flags": """WITH e AS (SELECT DISTINCT p_partkey // 4 AS g FROM part WHERE p_size > 40)
SELECT 'G' || p_partkey AS sgrna_id, 'GENE' || (p_partkey // 4) AS gene_symbol, CASE WHEN p_size % 3 <> 0 THEN p_size % 4 > 0 END AS multi_target, e.g IS NOT NULL AS common_essential FROM part LEFT JOIN e ON e.g = p_partkey // 4""",
    "d01_leave_one_out": f"WITH {_SC} SELECT study_id, count(*) AS held_out, CAST((SELECT count(*) FROM sc WHERE study_id IS NOT NULL) - count(*) AS BIGINT) AS training FROM sc WHERE study_id IS NOT NULL GROUP BY study_id",
    "d02_as_of": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01') WHERE n = 1",
    "d01_held_out_scores": f"""WITH {_SC}, c AS (SELECT sc.study_id, gene_symbol, CASE WHEN sc.study_id IN ('src1', 'src2') THEN 'shared' ELSE sc.study_id END AS fam, score AS a, ln(n_chars + 1.0::DOUBLE) AS b, target AS y
  FROM sc JOIN documents d ON sc.gene_symbol = 'GENE' || d.doc_id),
f AS (SELECT fam, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS "by" FROM c WHERE y IS NOT NULL AND fam IS NOT NULL GROUP BY fam),
g AS (SELECT DISTINCT study_id, fam FROM c WHERE study_id IS NOT NULL),
t AS (SELECT g.study_id, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab, sum(ay) AS ay, sum("by") AS "by" FROM g JOIN f ON f.fam <> g.fam GROUP BY g.study_id),
s AS (SELECT *, sqrt(aa / n - a * a / n / n) AS sa, sqrt(bb / n - b * b / n / n) AS sb, ab - a * b / n AS cab, ay - a * y / n AS cay, "by" - b * y / n AS cby FROM t),
u AS (SELECT *, (n + 1) * (n + 1) - (cab / sa / sb) * (cab / sa / sb) AS det FROM s),
w AS (SELECT study_id, n, a / n AS ma, b / n AS mb, y / n AS my, ((n + 1) * cay / sa - cab / sa / sb * cby / sb) / det / sa AS wa, ((n + 1) * cby / sb - cab / sa / sb * cay / sa) / det / sb AS wb FROM u)
SELECT c.study_id, gene_symbol, CAST(n AS BIGINT) AS training_rows, round(my + wa * (c.a - ma) + wb * (c.b - mb), 6) + 0.0 AS held_out_score FROM c LEFT JOIN w USING (study_id)""",
    "d02_as_of_join": """WITH o AS (SELECT o_orderkey, o_custkey % 50 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(o_orderkey % 40 AS INT) AS cutoff FROM orders),
e AS (SELECT user_id % 50 AS user_id, date_trunc('day', ts)::TIMESTAMP AS available, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL)
SELECT o_orderkey, o.user_id, available, event_id, event_type FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.cutoff >= e.available""",
    "d02_temporal_split": """SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'train'
  WHEN min(o_orderdate) OVER (PARTITION BY o_custkey) <= TIMESTAMP '1996-01-01' THEN 'purged' ELSE 'test' END AS split FROM orders""",
    "d03_training_recurrence": """WITH per AS (SELECT l_partkey, l_suppkey, max(l_returnflag) AS d, CAST(l_suppkey % 5 AS INT) AS fold FROM lineitem GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) - count(*) OVER (PARTITION BY l_partkey, fold) AS t, count(*) OVER (PARTITION BY l_partkey, d) - count(*) OVER (PARTITION BY l_partkey, d, fold) AS a FROM per)
SELECT 'GENE' || l_partkey AS gene_symbol, 'F' || l_suppkey AS family, fold, t AS training_families, round(a / nullif(t, 0), 6) + 0.0 AS same_direction_fraction FROM c""",
    "d03_recurrence": f"""WITH {RQ._EVENTS}, per AS (SELECT gene_symbol, label_code, max(phenotype_direction) AS d FROM ev WHERE gene_symbol IS NOT NULL GROUP BY ALL)
SELECT gene_symbol, label_code, count(*) OVER (PARTITION BY gene_symbol) - 1 AS other_families,
  round((count(*) OVER (PARTITION BY gene_symbol, d) - 1) / nullif(count(*) OVER (PARTITION BY gene_symbol) - 1, 0), 6) + 0.0 AS same_direction_fraction FROM per""",
    "d07_reciprocal_rank": f"WITH {_SC} SELECT {_Q}, round(1.0 / min(n), 6) + 0.0 AS reciprocal_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS DOUBLE) AS n FROM sc) WHERE target > 0 GROUP BY {_Q}",
    "d07_budget_curve": f"WITH {_SC}, p AS (SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS n FROM sc) SELECT budget, count(*) AS validated, count(*) FILTER (target = 1) AS successes, count(*) FILTER (target = 0) AS failures FROM p, (SELECT unnest([1, 2, 5, 10])::INT AS budget) WHERE n <= budget GROUP BY budget",
    "d09_count_gini": f"""WITH {CQ._LONG}, r AS (SELECT sample_id, cnt, row_number() OVER (PARTITION BY sample_id ORDER BY cnt) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM long)
SELECT sample_id, round(2.0 * sum(i * cnt)::DOUBLE / (max(n) * sum(cnt)::DOUBLE) - (max(n) + 1.0) / max(n), 6) + 0.0 AS gini FROM r GROUP BY sample_id""",
    "d09_leave_best_out": f"""WITH {CQ._LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY screen_id, contrast_id, gene_symbol ORDER BY abs(guide_lfc) DESC, sgrna_id) AS i FROM guides)
SELECT screen_id, contrast_id, gene_symbol, round(median(guide_lfc) FILTER (i > 1) - median(guide_lfc), 6) + 0.0 AS leave_best_out_change FROM r GROUP BY ALL""",
    "d11_panel": f"""WITH {_SC}, b AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY study_id ORDER BY score, gene_symbol) AS INT) AS score_bin FROM sc)
SELECT study_id, gene_symbol, score_bin FROM (SELECT *, row_number() OVER (PARTITION BY study_id, score_bin ORDER BY md5(gene_symbol), gene_symbol) AS n FROM b) WHERE n <= 2""",
    "d12_family_priority": "SELECT 'S' || c_custkey AS study_id, CASE WHEN c_custkey % 5 <> 0 THEN 'SF' || (c_custkey // 3) WHEN c_custkey % 3 = 0 THEN 'RF' || (c_custkey // 10) ELSE 'S' || c_custkey END AS family FROM customer",
}
