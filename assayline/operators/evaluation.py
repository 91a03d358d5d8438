"""Ranking metrics over queries, averaged within studies and then across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.positions import running_sums
from ..functions.scratch import written

KS = (5, 10, 20)


def _pair(metric: str | Column, value: str | Column) -> Column:
    name = F.lit(metric) if isinstance(metric, str) else metric
    return F.struct(name.alias("metric"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))


def query_key(columns: list[str]) -> Column:
    """The query a row belongs to; members may be null."""
    return F.struct(*columns)


def _steps(df: DataFrame, by: list[str], target: str, score: str) -> DataFrame:
    value = F.col(target).cast("double")
    return df.groupBy(*by, score).agg(F.sum(value).alias("tp"), F.count("*").cast("double").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def _gained() -> Column:
    """Recall gained times precision, summed up over distinct scores."""
    return F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp"))


def _ap(df: DataFrame, by: list[str], target: str, score: str) -> DataFrame:
    """Average precision per ``by``, the rows of one query, with its least and greatest target."""
    down = W.partitionBy(*by).orderBy(F.col(score).desc())
    steps = _steps(df, by, target, score).withColumns({"ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down)})
    return steps.groupBy(*by).agg(_gained().alias("ap"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def global_average_precision(df: DataFrame, target: str = "target", score: str = "score") -> DataFrame:
    """One row: average precision over all rows; distinct scores are added up in ranges, none of which is the whole."""
    steps = written(_steps(df.where(F.col(target).isNotNull() & F.col(score).isNotNull()), [], target, score), "steps")
    return running_sums(steps, [], score, {"ctp": "tp", "cn": "n"}, down=True).agg(_gained().alias("ap"))


def average_precision(df: DataFrame, by: list[str], target: str = "target", score: str = "score") -> DataFrame:
    return _ap(df.where(F.col(target).isNotNull() & F.col(score).isNotNull()), by, target, score).drop("lo", "hi")


def brier(df: DataFrame, target: str = "target", score: str = "score") -> DataFrame:
    """One row; a score outside 0 to 1 is an error."""
    known = df.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    inside = F.when(F.col(score).between(0, 1), F.col(score)).otherwise(F.raise_error(F.lit("scores must lie in 0 to 1")))
    return known.agg(F.avg((inside - F.col(target)) * (inside - F.col(target))).alias("brier"))


def _discount(place: Column) -> Column:
    return 1.0 / F.log2(place + 1.0)


def top_k_table(df: DataFrame, query: list[str], study: str, ks: tuple[int, ...], target: str, score: str, tie: list[str]) -> DataFrame:
    """Per query: rows, positives, and for each k the hits in the first k (``hits_k``), the DCG with ties averaged and the ideal DCG.

    Rows are ranked once for all k. The first k are by score, then ``tie``, so that reruns agree.
    """
    by = W.partitionBy(*query)
    down = by.orderBy(F.col(score).desc(), *tie)
    placed = df.withColumns({
        "_n": F.row_number().over(down), "_i": F.row_number().over(by.orderBy(F.col(target).desc())), "_mean": F.avg(target).over(W.partitionBy(*query, score)),
    })
    sums = []
    for k in ks:
        inside, best = F.col("_n") <= k, F.col("_i") <= k
        sums += [
            F.sum(F.when(inside, F.col(target)).otherwise(0.0)).alias(f"hits_{k}"),
            F.sum(F.when(inside, F.col("_mean") * _discount(F.col("_n"))).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(best, F.col(target) * _discount(F.col("_i"))).otherwise(0.0)).alias(f"ideal_{k}"),
        ]
    return placed.groupBy(*query).agg(F.first(study).alias("study"), F.count("*").alias("n"), F.sum(target).alias("positives"), *sums)


def top_k_metrics(df: DataFrame, query: list[str], study: str, k: int, target: str, score: str, tie: list[str]) -> DataFrame:
    """``top_k_table`` of one k, its columns without the number."""
    found = top_k_table(df, query, study, (k,), target, score, tie)
    return found.withColumnsRenamed({f"{c}_{k}": c for c in ("hits", "dcg", "ideal")})


def precision_at_k(df: DataFrame, query: list[str], study: str, k: int, target: str = "target", score: str = "score", tie: tuple[str, ...] = ()) -> DataFrame:
    known = df.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    return top_k_metrics(known, query, study, k, target, score, list(tie)).select(*query, "study", (F.col("hits") / F.least(F.col("n"), F.lit(k))).alias("value"))


def nested_macro_mean(per_query: DataFrame, value: str = "value", study: str = "study") -> DataFrame:
    """One row: ``query_macro`` over queries, ``study_macro`` over studies' means; only finite values count."""
    finite = per_query.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    studies = finite.groupBy(study).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return studies.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("query_macro"), F.avg(F.col("s") / F.col("n")).alias("study_macro"))


def per_query_metrics(df: DataFrame, query: list[str], study: str, target: str = "target", score: str = "score", ks: tuple[int, ...] = KS, tie: tuple[str, ...] = ()) -> DataFrame:
    """Long ``(study, metric, value)`` rows: each query's value of each metric."""
    candidates = df.where(F.col(score).isNotNull())
    known = candidates.where(F.col(target).isNotNull())
    # A query lies in one study, so its study may be one more key; with it, members of the query may be null.
    mixed = _ap(known, list(dict.fromkeys([*query, study])), target, score).where("lo <> hi")
    out = mixed.select(F.col(study).alias("study"), F.lit("average_precision").alias("metric"), F.col("ap").alias("value"))
    observed = candidates.withColumn(target, F.coalesce(target, F.lit(0.0)))
    some = F.col("positives") > 0
    for rows, judged in ((known, True), (observed, False)):
        found, pairs = top_k_table(rows, query, study, ks, target, score, list(tie)), []
        for k in ks:
            top, hits = F.least(F.col("n"), F.lit(k)), F.col(f"hits_{k}")
            ndcg = F.when(some, F.try_divide(f"dcg_{k}", f"ideal_{k}"))
            if judged:
                pairs += [_pair(f"adjudicated_precision_at_{k}", hits / top), _pair(f"adjudicated_ndcg_at_{k}", ndcg)]
            else:
                recall = F.when(some, F.try_divide(hits, F.col("positives")))
                pairs += [_pair(f"observed_success_yield_at_{k}", hits / top), _pair(f"observed_recall_at_{k}", recall), _pair(f"observed_ndcg_at_{k}", ndcg)]
        out = out.unionByName(found.select("study", F.explode(F.array(*pairs)).alias("m")).select("study", "m.metric", "m.value"))
    return out.where("value is not null")


def named_means(means: DataFrame, *kept: str) -> DataFrame:
    """``(metric, q, st)`` means over queries and over studies as ``(metric, value)``, under all names that a mean goes by."""
    m = F.col("metric")
    at = ~m.isin("average_precision")
    bare = F.regexp_replace(m, "^adjudicated_", "")
    return means.select(*kept, F.explode(F.concat(
        F.array(_pair(F.concat(F.lit("query_macro_"), m), "q"), _pair(F.concat(F.lit("study_macro_"), m), "st")),
        F.when(at, F.array(_pair(m, "st"))).otherwise(F.array(_pair("macro_average_precision", "st"))),
        F.when(m.startswith("adjudicated_"), F.array(_pair(bare, "st"))).otherwise(F.array().cast("array<struct<metric:string,value:double>>")),
    )).alias("v")).select(*kept, "v.metric", "v.value")


def query_metrics(ks: tuple[int, ...] = KS) -> list[str]:
    """The names that ``per_query_metrics`` gives."""
    each = ("adjudicated_precision", "adjudicated_ndcg", "observed_success_yield", "observed_recall", "observed_ndcg")
    return ["average_precision", *[f"{name}_at_{k}" for k in ks for name in each]]


def check_nesting(df: DataFrame, query: list[str], study: str) -> None:
    odd = df.groupBy(*query).agg(F.count_distinct(study).alias("n")).where("n <> 1").limit(1)
    if not odd.isEmpty():
        raise ValueError("a query has rows of more than one study, or none: it has to be nested in one")


def ranking_metrics(df: DataFrame, query: list[str], study: str | None = None, target: str = "target", score: str = "score", ks: tuple[int, ...] = KS, tie: tuple[str, ...] = ()) -> DataFrame:
    """All metrics as ``(metric, value)`` rows, macro means over queries and over studies with their aliases.

    The columns in use are written once; each query is ranked twice, with and without its unlabelled rows.
    """
    keyed = df.where(F.col(score).isNotNull())
    for c in query if len(query) == 1 else []:
        keyed = keyed.where(F.col(c).isNotNull())
    by_study = study or "_study"
    keyed = keyed if study else keyed.withColumn("_study", F.lit("all"))
    keyed = written(keyed.select(*dict.fromkeys([*query, by_study, target, score, *tie])), "ranked")
    known = keyed.where(F.col(target).isNotNull())
    if known.isEmpty():
        raise ValueError("no labeled rows with a score")
    if study:
        check_nesting(keyed, query, study)
    each = written(per_query_metrics(keyed, query, by_study, target, score, ks, tie), "metrics")
    means = each.groupBy("metric", "study").agg(F.sum("value").alias("s"), F.count("*").alias("n")).groupBy("metric").agg(
        (F.sum("s") / F.sum("n")).alias("q"), F.avg(F.col("s") / F.col("n")).alias("st")
    )
    macro = named_means(means)
    whole = global_average_precision(known, target, score).select(F.explode(F.array(
        _pair("average_precision", "ap"), _pair("global_average_precision", "ap")
    )).alias("v")).select("v.metric", "v.value")
    counts = known.agg(
        F.count("*").cast("double").alias("n_labeled"), F.count_distinct(query_key(query)).cast("double").alias("n_groups")
    ).unpivot([], ["n_labeled", "n_groups"], "metric", "value")
    studies = keyed.agg(F.count_distinct(by_study).cast("double").alias("n_studies")).unpivot([], ["n_studies"], "metric", "value")
    both = each.where("metric = 'average_precision'").agg(F.count("*").cast("double").alias("value")).select(F.lit("n_groups_with_both_classes").alias("metric"), "value")
    loss = brier(known, target, score).select(F.lit("uncalibrated_brier_score").alias("metric"), F.col("brier").alias("value"))
    return whole.unionByName(loss).unionByName(counts).unionByName(studies).unionByName(both).unionByName(macro)
