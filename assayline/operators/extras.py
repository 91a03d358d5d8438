"""Splits, recurrence, calibration and panel operators that protocols declare."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.positions import running_sums
from ..functions.scratch import written
from .evaluation import average_precision


def leave_one_group_out(df: DataFrame, key: str) -> DataFrame:
    """``(key, held_out rows, training rows)`` of each split that holds one value of ``key`` out."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("held_out"))
    total = sizes.agg(F.sum("held_out")).first()[0] or 0
    return sizes.select(key, "held_out", (F.lit(total) - F.col("held_out")).alias("training"))


def as_of(df: DataFrame, cutoff: str, key: list[str], available: str, version: str) -> DataFrame:
    """Each key's latest version among rows available by the cutoff date."""
    latest = W.partitionBy(*key).orderBy(F.col(available).desc(), F.col(version).desc())
    return df.where(F.col(available) <= F.lit(cutoff).cast("timestamp")).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def recurrence(df: DataFrame, by: list[str], family: str, direction: str) -> DataFrame:
    """Per row's ``by`` and family: other families with a signal there, and the part of them of the row's direction."""
    per = df.groupBy(*by, family).agg(F.max(direction).alias("d"))
    groups = per.groupBy(*by).agg(F.count("*").alias("families"))
    same = per.groupBy(*by, "d").agg(F.count("*").alias("alike"))
    return (
        per.join(groups, by).join(same, [*by, "d"])
        .select(*by, family, (F.col("families") - 1).alias("other_families"), F.try_divide(F.col("alike") - 1, F.col("families") - 1).alias("same_direction_fraction"))
    )


def calibration(df: DataFrame, target: str = "target", score: str = "score", floor: float = 1e-6) -> DataFrame:
    """One row: slope and intercept of a logistic regression of the target on the score's logit."""
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1 - floor))
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(F.col(target).cast("double").alias("label"), F.ln(p / (1 - p)).alias("z"))
    model = LogisticRegression(maxIter=200, tol=1e-10).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(rows))
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


def mean_reciprocal_rank(df: DataFrame, query: list[str], target: str, score: str, tie: list[str]) -> DataFrame:
    """Per query with a success: one over the place of the first."""
    down = W.partitionBy(*query).orderBy(F.col(score).desc(), *tie)
    placed = df.withColumn("_n", F.row_number().over(down)).where(F.col(target) > 0)
    return placed.groupBy(*query).agg((1.0 / F.min("_n")).alias("reciprocal_rank"))


def budget_curve(df: DataFrame, query: list[str], target: str, score: str, tie: list[str], budgets: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Successes and failures found within each budget of validations per query, over all queries."""
    down = W.partitionBy(*query).orderBy(F.col(score).desc(), *tie)
    placed = df.withColumn("_n", F.row_number().over(down)).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    inside = placed.where("_n <= budget")
    return inside.groupBy("budget").agg(
        F.count("*").alias("validated"), F.count_if(F.col(target) == 1).alias("successes"), F.count_if(F.col(target) == 0).alias("failures")
    )


def count_gini(long: DataFrame) -> DataFrame:
    """Per sample: the Gini coefficient of its counts. Equal counts are taken together and added up in ranges, so no sample is sorted in one task."""
    steps = written(long.groupBy("sample_id", "cnt").agg(F.count("*").alias("n")), "steps")
    placed = running_sums(steps, ["sample_id"], "cnt", {"upto": "n"}).withColumn("before", F.col("upto") - F.col("n"))
    ranks = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    return placed.groupBy("sample_id").agg(
        F.try_divide(2 * F.sum(F.col("cnt") * ranks), F.sum("n") * F.sum(F.col("cnt") * F.col("n"))).alias("a"), F.sum("n").alias("n")
    ).select("sample_id", (F.col("a") - (F.col("n") + 1) / F.col("n")).alias("gini"))


def leave_best_out(guides: DataFrame) -> DataFrame:
    """Per gene: the median effect, and what it changes by without the strongest guide."""
    keys = ["screen_id", "contrast_id", "gene_symbol"]
    strongest = W.partitionBy(*keys).orderBy(F.abs("guide_lfc").desc(), "sgrna_id")
    placed = guides.withColumn("_n", F.row_number().over(strongest))
    return placed.groupBy(*keys).agg(F.median("guide_lfc").alias("median"), F.median(F.when(F.col("_n") > 1, F.col("guide_lfc"))).alias("rest")).select(
        *keys, (F.col("rest") - F.col("median")).alias("leave_best_out_change")
    )


def stratified_panel(df: DataFrame, scores: list[str], bins: int, per_cell: int, order: Column, tie: str, by: list[str]) -> DataFrame:
    """``per_cell`` rows, in ``order``, of each cell of the scores' quantile bins within ``by``."""
    for s in scores:
        df = df.withColumn(f"{s}_bin", F.ntile(bins).over(W.partitionBy(*by).orderBy(s, tie)))
    cell = W.partitionBy(*by, *[f"{s}_bin" for s in scores]).orderBy(order, tie)
    return df.withColumn("_n", F.row_number().over(cell)).where(F.col("_n") <= per_cell).drop("_n")


def family_of(source: Column, raw: Column, study: Column) -> Column:
    """The group a row's evidence belongs to: its source family, else its raw-data family, else its study."""
    return F.coalesce(source, raw, study)


def graded_ndcg(df: DataFrame, query: list[str], grade: str, score: str, tie: list[str], k: int = 10) -> DataFrame:
    """Per query with a graded row above 0: NDCG@k of ``grade``'s gain 2**grade - 1, null grades left out."""
    known = df.where(F.col(grade).isNotNull() & F.col(score).isNotNull()).withColumn("_gain", F.pow(F.lit(2.0), F.col(grade)) - 1)
    by = W.partitionBy(*query)
    placed = known.withColumns({"_n": F.row_number().over(by.orderBy(F.col(score).desc(), *tie)), "_i": F.row_number().over(by.orderBy(F.col("_gain").desc()))})
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col("_gain") / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    sums = placed.groupBy(*query).agg(part("_n").alias("dcg"), part("_i").alias("ideal"))
    return sums.where("ideal > 0").select(*query, (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def failure_rate(df: DataFrame, query: list[str], target: str, score: str, tie: list[str], k: int = 10) -> DataFrame:
    """Per query: the part of the first k labelled rows that failed."""
    known = df.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    placed = known.withColumn("_n", F.row_number().over(W.partitionBy(*query).orderBy(F.col(score).desc(), *tie))).where(F.col("_n") <= k)
    return placed.groupBy(*query).agg(F.avg((F.col(target) == 0).cast("double")).alias("failure_rate"))


def uplift(df: DataFrame, query: list[str], target: str, score: str, baselines: dict[str, Column]) -> DataFrame:
    """Per baseline: mean average precision of the score and of the baseline over the queries that both rank, and the mean difference.

    A baseline is any column that ranks higher what it holds for better; rows that it gives no value are left out for both.
    """
    out = None
    for name, value in baselines.items():
        rows = df.withColumn("_base", value.cast("double")).where(F.col("_base").isNotNull() & F.col(score).isNotNull())
        mixed = rows.where(F.col(target).isNotNull()).groupBy(*query).agg(F.min(target).alias("lo"), F.max(target).alias("hi")).where("lo <> hi").select(*query)
        ours = average_precision(rows, query, target, score).withColumnRenamed("ap", "ours")
        theirs = average_precision(rows, query, target, "_base").withColumnRenamed("ap", "theirs")
        both = mixed.join(ours, query).join(theirs, query).agg(
            F.lit(name).alias("baseline"), F.count("*").alias("queries"), F.avg("ours").alias("score_ap"), F.avg("theirs").alias("baseline_ap"),
            F.avg(F.col("ours") - F.col("theirs")).alias("uplift"),
        )
        out = both if out is None else out.unionByName(both)
    return out


def coverage(df: DataFrame, train: DataFrame, profile: str, families: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``profile_name``, the part of the profile's features that are given, whether each family has any, and
    how many features lie outside the range seen in ``train``. One row of limits comes from ``train``."""
    columns = [c for f in families.values() for c in f]
    limits = train.agg(*[x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    given = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    outside = [F.coalesce((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(False)).cast("int") for c in columns]
    marked = df.join(F.broadcast(limits))  # one row
    return marked.withColumns({
        "profile_name": F.lit(profile), "metadata_completeness_fraction": sum((given(c).cast("double") for c in columns), F.lit(0.0)) / len(columns),
        "outside_support": sum(outside, F.lit(0)),
        **{f"{name}_available": sum((given(c).cast("int") for c in f), F.lit(0)) > 0 for name, f in families.items()},
    }).drop(*limits.columns)


def screen_quality(guides: DataFrame, essential: DataFrame, controls: DataFrame) -> DataFrame:
    """Per contrast: how far essential genes' guides lie under the others', in pooled deviations, and the spread of non-targeting guides.

    ``guides(screen_id, contrast_id, sgrna_id, gene_symbol, guide_lfc)``, ``essential(gene_symbol)``, ``controls(sgrna_id)``.
    """
    keys = ["screen_id", "contrast_id"]
    # Genes and guides grow with the data: they are brought together by key, never sent whole.
    marked = guides.join(essential.select("gene_symbol").distinct().withColumn("_e", F.lit(True)).hint("merge"), "gene_symbol", "left").join(
        controls.select("sgrna_id").distinct().withColumn("_c", F.lit(True)).hint("merge"), "sgrna_id", "left"
    )
    e = F.coalesce("_e", F.lit(False))
    control = F.coalesce("_c", F.lit(False))
    of = lambda test: F.when(test & ~control, F.col("guide_lfc"))
    spread = F.sqrt((F.var_samp(of(e)) + F.var_samp(of(~e))) / 2)
    return marked.groupBy(*keys).agg(
        F.try_divide(F.avg(of(~e)) - F.avg(of(e)), spread).alias("essential_gene_separation"),
        F.stddev_samp(F.when(control, F.col("guide_lfc"))).alias("nontargeting_dispersion"),
    )


def guide_flags(guides: DataFrame, annotations: DataFrame, essential: DataFrame) -> DataFrame:
    """``guides`` with ``multi_target`` (null if the annotation doesn't tell) and ``common_essential``; annotations are unique per guide."""
    notes = annotations.select("sgrna_id", (F.col("multi_target_count") > 0).alias("multi_target")).dropDuplicates(["sgrna_id"])
    common = essential.select("gene_symbol").distinct().withColumn("common_essential", F.lit(True))
    return guides.join(notes.hint("merge"), "sgrna_id", "left").join(common.hint("merge"), "gene_symbol", "left").na.fill(False, ["common_essential"])
