"""Queries over guide counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ranks import average_ranks, rounded
from ..functions.scratch import written
from ..operators import counts as C
from . import demo_views as V

_CONTRAST = ["screen_id", "contrast_id"]


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, sheet = V.wide_counts(spark, sf_dir), V.sheet(spark, sf_dir)
    samples = [c for c in wide.columns if c not in C.ID_COLUMNS]
    return C.with_sheet(C.to_long(wide, samples), sheet)


def _logged(spark: SparkSession, sf_dir: str, method: str = "median_ratio") -> DataFrame:
    return written(C.log_counts(written(_long(spark, sf_dir), "long-counts"), method), "log-counts")


def _neat(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return df.select(*keys, *[rounded(v).alias(v) for v in values])


def u06_long_counts(spark, sf_dir):
    return _long(spark, sf_dir).select("screen_id", "contrast_id", "condition_role", "sample_id", "sgrna_id", "gene_symbol", "cnt")


def v05_count_checks(spark, sf_dir):
    """The validated matrix's size."""
    wide, sheet = V.wide_counts(spark, sf_dir), V.sheet(spark, sf_dir)
    counts, sheet = C.normalize_ids(wide, sheet)
    C.validate_sheet(sheet)
    samples = C.validate_counts(counts, sheet)
    return counts.agg(F.count("*").alias("n_guides"), F.lit(len(samples)).cast("long").alias("n_samples"), F.count_distinct("gene_symbol").alias("n_genes"))


def a01_library_sizes(spark, sf_dir):
    return C.library_sizes(_long(spark, sf_dir)).select("screen_id", "contrast_id", "condition_role", "sample_id", "library_size")


def a02_cpm(spark, sf_dir):
    return _neat(_logged(spark, sf_dir, "cpm"), ["sample_id", "sgrna_id"], "log_norm")


def a03_size_factors(spark, sf_dir):
    return _neat(C.size_factors(written(_long(spark, sf_dir), "long-counts")), ["screen_id", "sample_id"], "size_factor")


def a04_log_counts(spark, sf_dir):
    return _neat(_logged(spark, sf_dir), ["sample_id", "sgrna_id"], "log_norm")


_GUIDE_VALUES = ["guide_lfc", "mean_control_count", "zero_control", "zero_treatment", "low_count", "positive_lfc", "negative_lfc", "neutral_lfc"]


def a05_guide_effects(spark, sf_dir):
    return _neat(C.guide_effects(_logged(spark, sf_dir)), [*_CONTRAST, "sgrna_id", "gene_symbol"], *_GUIDE_VALUES)


_GENE_KEYS = [*_CONTRAST, "gene_symbol"]


def _genes(spark, sf_dir):
    return C.gene_effects(C.guide_effects(_logged(spark, sf_dir)))


def a07_gene_aggregates(spark, sf_dir):
    values = ["median_guide_lfc", "mean_guide_lfc", "mean_control_count", "low_count_fraction", "zero_fraction_control", "zero_fraction_treatment",
              "positive_guide_fraction", "negative_guide_fraction", "neutral_guide_fraction"]
    return _neat(_genes(spark, sf_dir), [*_GENE_KEYS, "guide_n"], *values)


def a08_guide_spread(spark, sf_dir):
    return _neat(_genes(spark, sf_dir), _GENE_KEYS, "guide_lfc_mad", "guide_lfc_iqr", "top2_abs_lfc_mean", "strongest_guide_dominance")


def a11_leave_one_out(spark, sf_dir):
    return _neat(_genes(spark, sf_dir), _GENE_KEYS, "leave_one_guide_out_median_sd")


def a13_direction(spark, sf_dir):
    values = ["guide_direction_agreement", "absolute_median_guide_lfc", "absolute_mean_guide_lfc", "is_sensitization_signal", "is_neutral_signal"]
    return _neat(_genes(spark, sf_dir), [*_GENE_KEYS, "signal_direction"], *values)


def a14_replicate_correlation(spark, sf_dir):
    values = ["replicate_correlation", "control_replicate_correlation", "treatment_replicate_correlation"]
    return _neat(C.replicate_correlations(_logged(spark, sf_dir)), _CONTRAST, *values)


def a15_replicate_effect_sd(spark, sf_dir):
    return _neat(C.replicate_effect_sd(_logged(spark, sf_dir)), _GENE_KEYS, "replicate_effect_sd")


def a16_median_library_size(spark, sf_dir):
    return _neat(C.median_library_size(_long(spark, sf_dir)), _CONTRAST, "median_library_size")


def a17_count_features(spark, sf_dir):
    found = C.featurize_counts(_long(spark, sf_dir))
    text = [*_GENE_KEYS, "guide_n", "signal_direction", "normalization_method"]
    return _neat(found, text, *[c for c in found.columns if c not in text])


def w01_effect_percentile(spark, sf_dir):
    return _neat(_genes(spark, sf_dir), _GENE_KEYS, "within_screen_effect_percentile")


def w02_average_ranks(spark, sf_dir):
    return _neat(average_ranks(_long(spark, sf_dir), ["sample_id"], "cnt", "r"), ["sample_id", "sgrna_id"], "r")


QUERIES = {
    f.__name__: f
    for f in (
        u06_long_counts, v05_count_checks, a01_library_sizes, a02_cpm, a03_size_factors, a04_log_counts, a05_guide_effects, a07_gene_aggregates,
        a08_guide_spread, a11_leave_one_out, a13_direction, a14_replicate_correlation, a15_replicate_effect_sd, a16_median_library_size,
        a17_count_features, w01_effect_percentile, w02_average_ranks,
    )
}

_LONG = """
lines AS (
  SELECT 'SC' || (l_suppkey % 4) AS screen_id, 'SC' || (l_suppkey % 4) || ':C' || (l_linenumber % 2) AS contrast_id,
    'SC' || (l_suppkey % 4) || ':C' || (l_linenumber % 2) || ':' || l_linestatus || l_returnflag AS sample_id,
    CASE l_linestatus WHEN 'O' THEN 'control' ELSE 'treatment' END AS condition_role, l_partkey, l_quantity
  FROM lineitem),
sheet AS (SELECT DISTINCT screen_id, contrast_id, sample_id, condition_role FROM lines),
had AS (SELECT sample_id, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lines GROUP BY ALL),
long AS (
  SELECT s.*, 'G' || p_partkey AS sgrna_id, 'GENE' || (p_partkey // 4) AS gene_symbol, coalesce(h.cnt, 0) AS cnt
  FROM sheet s CROSS JOIN part p LEFT JOIN had h ON h.sample_id = s.sample_id AND h.l_partkey = p.p_partkey),
sizes AS (SELECT screen_id, contrast_id, condition_role, sample_id, CAST(sum(cnt) AS BIGINT) AS library_size FROM long GROUP BY ALL),
geo AS (SELECT screen_id, sgrna_id, avg(ln(cnt)) AS g FROM long WHERE cnt > 0 GROUP BY ALL HAVING count(*) >= 2),
raw AS (SELECT l.screen_id, sample_id, median(cnt / exp(g)) AS raw FROM long l JOIN geo USING (screen_id, sgrna_id) WHERE cnt > 0 GROUP BY ALL),
factors AS (SELECT screen_id, sample_id, raw / exp(avg(ln(raw)) OVER (PARTITION BY screen_id)) AS size_factor FROM raw),
logged AS (SELECT l.*, log2(cnt / size_factor + 1) AS log_norm FROM long l JOIN factors USING (screen_id, sample_id)),
guides AS (
  SELECT screen_id, contrast_id, sgrna_id, gene_symbol,
    avg(log_norm) FILTER (condition_role = 'treatment') - avg(log_norm) FILTER (condition_role = 'control') AS guide_lfc,
    avg(cnt) FILTER (condition_role = 'control') AS mean_control_count,
    avg(CAST(cnt = 0 AS DOUBLE)) FILTER (condition_role = 'control') AS zero_control,
    avg(CAST(cnt = 0 AS DOUBLE)) FILTER (condition_role = 'treatment') AS zero_treatment
  FROM logged GROUP BY ALL),
flags AS (
  SELECT *, CAST(mean_control_count < 30 AS DOUBLE) AS low_count, CAST(guide_lfc > 0.1 AS DOUBLE) AS positive_lfc,
    CAST(guide_lfc < -0.1 AS DOUBLE) AS negative_lfc, CAST(abs(guide_lfc) <= 0.1 AS DOUBLE) AS neutral_lfc
  FROM guides),
genes0 AS (
  SELECT screen_id, contrast_id, gene_symbol, count(*) AS guide_n, median(guide_lfc) AS median_guide_lfc, avg(guide_lfc) AS mean_guide_lfc,
    avg(mean_control_count) AS mean_control_count, avg(low_count) AS low_count_fraction, avg(zero_control) AS zero_fraction_control,
    avg(zero_treatment) AS zero_fraction_treatment, avg(positive_lfc) AS positive_guide_fraction, avg(negative_lfc) AS negative_guide_fraction,
    avg(neutral_lfc) AS neutral_guide_fraction, quantile_cont(guide_lfc, 0.75) - quantile_cont(guide_lfc, 0.25) AS guide_lfc_iqr,
    list_avg(list_slice(list_reverse_sort(list(abs(guide_lfc))), 1, 2)) AS top2_abs_lfc_mean,
    CASE WHEN sum(abs(guide_lfc)) > 0 THEN max(abs(guide_lfc)) / sum(abs(guide_lfc)) ELSE 0 END AS strongest_guide_dominance
  FROM flags GROUP BY ALL),
mads AS (
  SELECT screen_id, contrast_id, gene_symbol, median(abs(guide_lfc - median_guide_lfc)) AS guide_lfc_mad
  FROM flags JOIN genes0 USING (screen_id, contrast_id, gene_symbol) GROUP BY ALL),
without AS (
  SELECT a.screen_id, a.contrast_id, a.gene_symbol, a.sgrna_id, median(b.guide_lfc) AS m, count(*) + 1 AS n
  FROM flags a JOIN flags b ON a.screen_id = b.screen_id AND a.contrast_id = b.contrast_id AND a.gene_symbol = b.gene_symbol AND a.sgrna_id <> b.sgrna_id
  GROUP BY ALL),
loo AS (SELECT screen_id, contrast_id, gene_symbol, CASE WHEN max(n) >= 3 THEN stddev_samp(m) END AS leave_one_guide_out_median_sd FROM without GROUP BY ALL),
genes AS (
  SELECT *, greatest(positive_guide_fraction, negative_guide_fraction) AS guide_direction_agreement, abs(median_guide_lfc) AS absolute_median_guide_lfc,
    abs(mean_guide_lfc) AS absolute_mean_guide_lfc,
    CASE WHEN abs(median_guide_lfc) <= 0.1 THEN 'neutral' WHEN median_guide_lfc > 0.1 THEN 'resistance' ELSE 'sensitization' END AS signal_direction
  FROM genes0 JOIN mads USING (screen_id, contrast_id, gene_symbol) LEFT JOIN loo USING (screen_id, contrast_id, gene_symbol)),
featured AS (
  SELECT *, CAST(signal_direction = 'sensitization' AS DOUBLE) AS is_sensitization_signal, CAST(signal_direction = 'neutral' AS DOUBLE) AS is_neutral_signal,
    (rank() OVER (PARTITION BY screen_id, contrast_id ORDER BY absolute_median_guide_lfc)
      + (count(*) OVER (PARTITION BY screen_id, contrast_id, absolute_median_guide_lfc) - 1) / 2.0)
      / count(*) OVER (PARTITION BY screen_id, contrast_id) AS within_screen_effect_percentile
  FROM genes),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY log_norm) + (count(*) OVER (PARTITION BY sample_id, log_norm) - 1) / 2.0 AS r FROM logged),
pairs AS (
  SELECT a.screen_id, a.contrast_id, a.condition_role, a.sample_id AS x, b.sample_id AS y,
    CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) > 0 THEN covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) END AS rho
  FROM ranked a JOIN ranked b ON a.contrast_id = b.contrast_id AND a.condition_role = b.condition_role AND a.sgrna_id = b.sgrna_id AND a.sample_id < b.sample_id
  GROUP BY ALL),
by_role AS (SELECT screen_id, contrast_id, condition_role, median(rho) AS m FROM pairs GROUP BY ALL),
correlations AS (
  SELECT screen_id, contrast_id, median(m) AS replicate_correlation, max(m) FILTER (condition_role = 'control') AS control_replicate_correlation,
    max(m) FILTER (condition_role = 'treatment') AS treatment_replicate_correlation
  FROM (SELECT DISTINCT screen_id, contrast_id FROM sheet) LEFT JOIN by_role USING (screen_id, contrast_id) GROUP BY ALL),
base AS (SELECT screen_id, contrast_id, sgrna_id, avg(log_norm) AS b FROM logged WHERE condition_role = 'control' GROUP BY ALL),
per_sample AS (
  SELECT screen_id, contrast_id, gene_symbol, sample_id, median(log_norm - b) AS e
  FROM logged JOIN base USING (screen_id, contrast_id, sgrna_id) WHERE condition_role = 'treatment' GROUP BY ALL),
effect_sd AS (SELECT screen_id, contrast_id, gene_symbol, stddev_samp(e) AS replicate_effect_sd FROM per_sample GROUP BY ALL),
median_sizes AS (SELECT screen_id, contrast_id, median(library_size) AS median_library_size FROM sizes GROUP BY ALL)
"""


def _sql(source: str, keys: list[str], *values: str) -> str:
    return f"WITH {_LONG} SELECT {', '.join([*keys, *[f'round({v}, 6) + 0.0 AS {v}' for v in values]])} FROM {source}"


_SPREAD = ["guide_lfc_mad", "guide_lfc_iqr", "top2_abs_lfc_mean", "strongest_guide_dominance"]
_DIRECTION = ["guide_direction_agreement", "absolute_median_guide_lfc", "absolute_mean_guide_lfc", "is_sensitization_signal", "is_neutral_signal"]
_AGGREGATES = ["median_guide_lfc", "mean_guide_lfc", "mean_control_count", "low_count_fraction", "zero_fraction_control", "zero_fraction_treatment",
               "positive_guide_fraction", "negative_guide_fraction", "neutral_guide_fraction"]
_CORRELATIONS = ["replicate_correlation", "control_replicate_correlation", "treatment_replicate_correlation"]

SQL = {
    "u06_long_counts": f"WITH {_LONG} SELECT screen_id, contrast_id, condition_role, sample_id, sgrna_id, gene_symbol, cnt FROM long",
    "v05_count_checks": f"WITH {_LONG} SELECT count(DISTINCT sgrna_id) AS n_guides, count(DISTINCT sample_id) AS n_samples, count(DISTINCT gene_symbol) AS n_genes FROM long",
    "a01_library_sizes": f"WITH {_LONG} SELECT * FROM sizes",
    "a02_cpm": f"WITH {_LONG} SELECT sample_id, sgrna_id, round(log2(cnt / (library_size / 1e6) + 1), 6) + 0.0 AS log_norm FROM long JOIN sizes USING (sample_id)",
    "a03_size_factors": _sql("factors", ["screen_id", "sample_id"], "size_factor"),
    "a04_log_counts": _sql("logged", ["sample_id", "sgrna_id"], "log_norm"),
    "a05_guide_effects": _sql("flags", [*_CONTRAST, "sgrna_id", "gene_symbol"], *_GUIDE_VALUES),
    "a07_gene_aggregates": _sql("genes", [*_GENE_KEYS, "guide_n"], *_AGGREGATES),
    "a08_guide_spread": _sql("genes", _GENE_KEYS, *_SPREAD),
    "a11_leave_one_out": _sql("genes", _GENE_KEYS, "leave_one_guide_out_median_sd"),
    "a13_direction": _sql("featured", [*_GENE_KEYS, "signal_direction"], *_DIRECTION),
    "a14_replicate_correlation": _sql("correlations", _CONTRAST, *_CORRELATIONS),
    "a15_replicate_effect_sd": _sql("effect_sd", _GENE_KEYS, "replicate_effect_sd"),
    "a16_median_library_size": _sql("median_sizes", _CONTRAST, "median_library_size"),
    "a17_count_features": _sql(
        "featured LEFT JOIN effect_sd USING (screen_id, contrast_id, gene_symbol) LEFT JOIN correlations USING (screen_id, contrast_id)"
        " LEFT JOIN median_sizes USING (screen_id, contrast_id)",
        [*_GENE_KEYS, "guide_n", "signal_direction", "'median_ratio' AS normalization_method"],
        *_AGGREGATES, *_SPREAD, "leave_one_guide_out_median_sd", *_DIRECTION, "within_screen_effect_percentile", "replicate_effect_sd",
        *_CORRELATIONS, "median_library_size",
    ),
    "w01_effect_percentile": _sql("featured", _GENE_KEYS, "within_screen_effect_percentile"),
    "w02_average_ranks": f"WITH {_LONG} SELECT sample_id, sgrna_id, round(rank() OVER (PARTITION BY sample_id ORDER BY cnt) + (count(*) OVER (PARTITION BY sample_id, cnt) - 1) / 2.0, 6) + 0.0 AS r FROM long",
}
