"""Queries over labels, families and scored candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import rounded
from ..operators import evaluation as G, families, labels as L
from ..operators.resampling import cluster_bootstrap
from . import demo_views as V

_QUERY = ["screen_id", "contrast_id", "phenotype_direction"]
_TIE = ("gene_symbol",)


def al1_resolve_labels(spark, sf_dir):
    events = V.label_events(spark, sf_dir)
    return events.groupBy("screen_id").agg(L.resolve_labels(F.col("label_code")).alias("label_code"))


def al2_adjudicate(spark, sf_dir):
    return L.adjudicate_events(V.label_events(spark, sf_dir))


def p08_model_target(spark, sf_dir):
    events = V.label_events(spark, sf_dir)
    return events.groupBy("label_code").agg(F.count("*").alias("n"), F.max(L.model_target(F.col("label_code"))).alias("target"))


def m01_study_families(spark, sf_dir):
    return families.study_families(V.families(spark, sf_dir))


def g01_queries(spark, sf_dir):
    return V.scored(spark, sf_dir).groupBy(G.query_key(_QUERY).alias("q")).agg(F.count("*").alias("n"), F.count("target").alias("labeled")).select("q.*", "n", "labeled")


def g02_average_precision(spark, sf_dir):
    found = G.average_precision(V.scored(spark, sf_dir), _QUERY)
    return found.select(*_QUERY, rounded("ap").alias("ap"))


def g03_brier(spark, sf_dir):
    return G.brier(V.scored(spark, sf_dir)).select(rounded("brier").alias("brier"))


def g04_precision_at_5(spark, sf_dir):
    found = G.precision_at_k(V.scored(spark, sf_dir), _QUERY, "study_id", 5, tie=_TIE)
    return found.select(*_QUERY, rounded("value").alias("value"))


def g05_top_k(spark, sf_dir):
    """What NDCG, yield and recall at 10 are made of, on all candidates."""
    all_ = V.scored(spark, sf_dir).withColumn("target", F.coalesce("target", F.lit(0.0)))
    found = G.top_k_metrics(all_, _QUERY, "study_id", 10, "target", "score", list(_TIE))
    return found.select(*_QUERY, "n", *[rounded(c).alias(c) for c in ("positives", "hits", "dcg", "ideal")])


def g11_ranking_metrics(spark, sf_dir):
    found = G.ranking_metrics(V.scored(spark, sf_dir), _QUERY, "study_id", tie=_TIE)
    return found.select("metric", rounded("value").alias("value"))


def g09_nested_mean(spark, sf_dir):
    found = G.nested_macro_mean(G.precision_at_k(V.scored(spark, sf_dir), _QUERY, "study_id", 5, tie=_TIE), study="study")
    return found.select(rounded("query_macro").alias("query_macro"), rounded("study_macro").alias("study_macro"))


def w03_top_k_rows(spark, sf_dir):
    from pyspark.sql import Window as W

    down = W.partitionBy(*_QUERY).orderBy(F.col("score").desc(), "gene_symbol")
    return V.scored(spark, sf_dir).withColumn("place", F.row_number().over(down)).where("place <= 3").select(*_QUERY, "gene_symbol", "place")


def g12_cluster_bootstrap(spark, sf_dir):
    return cluster_bootstrap(V.scored(spark, sf_dir), "study_id", _QUERY, tie=_TIE)


QUERIES = {
    f.__name__: f
    for f in (
        al1_resolve_labels, al2_adjudicate, p08_model_target, m01_study_families, g01_queries, g02_average_precision, g03_brier,
        g04_precision_at_5, g05_top_k, g09_nested_mean, g11_ranking_metrics, w03_top_k_rows, g12_cluster_bootstrap,
    )
}

_EVENTS = """
ev AS (
  SELECT 'SC' || (user_id % 4) AS screen_id, 'C' || (user_id % 2) AS contrast_id,
    CASE event_id % 2 WHEN 0 THEN 'resistance' ELSE 'sensitization' END AS phenotype_direction,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'GENE' || user_id END AS gene_symbol,
    CASE event_type WHEN 'signup' THEN 'V3' WHEN 'purchase' THEN 'V2' WHEN 'error' THEN 'F0' WHEN 'click' THEN 'V1' ELSE 'T' END AS label_code
  FROM events)
"""
_RESOLVE = """CASE WHEN bool_or(label_code IN ('V2', 'V3')) AND bool_or(label_code IN ('F0', 'D')) THEN 'A'
  WHEN bool_or(label_code = 'V3') THEN 'V3' WHEN bool_or(label_code = 'V2') THEN 'V2' WHEN bool_or(label_code = 'D') THEN 'D'
  WHEN bool_or(label_code = 'F0') THEN 'F0' WHEN bool_or(label_code = 'V1') THEN 'V1' WHEN bool_or(label_code = 'T') THEN 'T'
  WHEN bool_or(label_code = 'A') THEN 'A' ELSE 'U' END AS label_code"""

_SCORED = """
sc AS (
  SELECT source AS study_id, source || '-' || lang AS screen_id, 'C' || (d.doc_id % 2) AS contrast_id,
    CASE d.doc_id % 3 WHEN 0 THEN 'resistance' WHEN 1 THEN 'sensitization' ELSE 'neutral' END AS phenotype_direction,
    'GENE' || d.doc_id AS gene_symbol, CAST(quality AS DOUBLE) AS target, CAST((d.doc_id * 7919) % 101 AS DOUBLE) / 100 AS score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
_Q = ", ".join(_QUERY)


def _ap_sql(source: str, by: str) -> str:
    by_ = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by_}sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM (
      SELECT *, sum(tp) OVER ({over} ORDER BY score DESC) AS ctp, sum(n) OVER ({over} ORDER BY score DESC) AS cn
      FROM (SELECT {by_}score, sum(target) AS tp, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE target IS NOT NULL GROUP BY ALL)) {'GROUP BY ' + by if by else ''}"""


def _top_sql(source: str, k: int) -> str:
    return f"""SELECT {_Q}, min(study_id) AS study_id, count(*) AS n, sum(target) AS positives,
      sum(CASE WHEN place <= {k} THEN target ELSE 0 END) AS hits,
      sum(CASE WHEN place <= {k} THEN mean / log2(place + 1) ELSE 0 END) AS dcg,
      sum(CASE WHEN best <= {k} THEN target / log2(best + 1) ELSE 0 END) AS ideal
    FROM (SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS place,
      row_number() OVER (PARTITION BY {_Q} ORDER BY target DESC) AS best, avg(target) OVER (PARTITION BY {_Q}, score) AS mean FROM {source})
    GROUP BY {_Q}"""


def _metrics_sql() -> str:
    parts = [
        f"SELECT study_id, 'average_precision' AS metric, ap AS value FROM ({_ap_sql('sc', _Q)}) JOIN (SELECT {_Q}, min(study_id) AS study_id FROM sc WHERE target IS NOT NULL GROUP BY {_Q} HAVING min(target) <> max(target)) USING ({_Q})"
    ]
    for k in G.KS:
        for name, source, recall in (("adjudicated", "known", None), ("observed", "seen", "recall")):
            top = _top_sql(source, k)
            first = "adjudicated_precision" if name == "adjudicated" else "observed_success_yield"
            parts.append(f"SELECT study_id, '{first}_at_{k}', hits / least(n, {k}) FROM ({top})")
            parts.append(f"SELECT study_id, '{name}_ndcg_at_{k}', dcg / ideal FROM ({top}) WHERE positives > 0")
            if recall:
                parts.append(f"SELECT study_id, 'observed_recall_at_{k}', hits / positives FROM ({top}) WHERE positives > 0")
    return f"""WITH {_SCORED}, known AS (SELECT * FROM sc WHERE target IS NOT NULL), seen AS (SELECT * REPLACE (coalesce(target, 0) AS target) FROM sc),
      each AS ({' UNION ALL '.join(parts)}),
      means AS (SELECT metric, sum(s) / sum(n) AS q, avg(s / n) AS st FROM (SELECT metric, study_id, sum(value) AS s, count(*) AS n FROM each GROUP BY ALL) GROUP BY metric),
      all_ AS (
        SELECT 'query_macro_' || metric AS metric, q AS value FROM means UNION ALL SELECT 'study_macro_' || metric, st FROM means
        UNION ALL SELECT CASE metric WHEN 'average_precision' THEN 'macro_average_precision' ELSE metric END, st FROM means
        UNION ALL SELECT replace(metric, 'adjudicated_', ''), st FROM means WHERE metric LIKE 'adjudicated_%'
        UNION ALL SELECT 'average_precision', ap FROM ({_ap_sql('sc', '')}) UNION ALL SELECT 'global_average_precision', ap FROM ({_ap_sql('sc', '')})
        UNION ALL SELECT 'uncalibrated_brier_score', avg((score - target) ** 2) FROM known
        UNION ALL SELECT 'n_labeled', count(*) FROM known UNION ALL SELECT 'n_groups', count(*) FROM (SELECT DISTINCT {_Q} FROM known)
        UNION ALL SELECT 'n_studies', count(DISTINCT study_id) FROM sc
        UNION ALL SELECT 'n_groups_with_both_classes', count(*) FROM each WHERE metric = 'average_precision')
      SELECT metric, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM all_"""


SQL = {
    "al1_resolve_labels": f"WITH {_EVENTS} SELECT screen_id, {_RESOLVE} FROM ev GROUP BY screen_id",
    "al2_adjudicate": f"WITH {_EVENTS} SELECT screen_id, contrast_id, gene_symbol, phenotype_direction, {_RESOLVE}, count(*) AS n_events FROM ev WHERE gene_symbol IS NOT NULL GROUP BY ALL",
    "p08_model_target": f"WITH {_EVENTS} SELECT label_code, count(*) AS n, max(CASE WHEN label_code IN ('V2', 'V3') THEN 1 WHEN label_code IN ('F0', 'D') THEN 0 END) AS target FROM ev GROUP BY label_code",
    "m01_study_families": """
WITH RECURSIVE e AS (
  SELECT 'study:S' || c_custkey AS a, 'source_family_id:SF' || (c_custkey // 3) AS b FROM customer WHERE c_custkey % 5 <> 0
  UNION SELECT 'study:S' || c_custkey, 'raw_data_family_id:RF' || (c_custkey // 10) FROM customer WHERE c_custkey % 3 = 0),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, to_) AS (
  SELECT 'study:S' || c_custkey, 'study:S' || c_custkey FROM customer
  UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON b.a = r.to_)
SELECT substr(node, 7) AS study_id, min(to_) AS family_group FROM reach GROUP BY node""",
    "g01_queries": f"WITH {_SCORED} SELECT {_Q}, count(*) AS n, count(target) AS labeled FROM sc GROUP BY {_Q}",
    "g02_average_precision": f"WITH {_SCORED} SELECT {_Q}, round(ap, 6) + 0.0 AS ap FROM ({_ap_sql('sc', _Q)})",
    "g03_brier": f"WITH {_SCORED} SELECT round(avg((score - target) ** 2), 6) + 0.0 AS brier FROM sc WHERE target IS NOT NULL",
    "g04_precision_at_5": f"WITH {_SCORED}, known AS (SELECT * FROM sc WHERE target IS NOT NULL) SELECT {_Q}, round(hits / least(n, 5), 6) + 0.0 AS value FROM ({_top_sql('known', 5)})",
    "g05_top_k": f"WITH {_SCORED}, seen AS (SELECT * REPLACE (coalesce(target, 0) AS target) FROM sc) SELECT {_Q}, n, round(positives, 6) + 0.0 AS positives, round(hits, 6) + 0.0 AS hits, round(dcg, 6) + 0.0 AS dcg, round(ideal, 6) + 0.0 AS ideal FROM ({_top_sql('seen', 10)})",
    "g09_nested_mean": f"WITH {_SCORED}, known AS (SELECT * FROM sc WHERE target IS NOT NULL), q AS (SELECT study_id, hits / least(n, 5) AS v FROM ({_top_sql('known', 5)})), s AS (SELECT study_id, sum(v) AS s, count(*) AS n FROM q GROUP BY 1) SELECT round(sum(s) / sum(n), 6) + 0.0 AS query_macro, round(avg(s / n), 6) + 0.0 AS study_macro FROM s",
    "g11_ranking_metrics": _metrics_sql(),
    "w03_top_k_rows": f"WITH {_SCORED} SELECT {_Q}, gene_symbol, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, gene_symbol) AS INTEGER) AS place FROM sc) WHERE place <= 3",
}
