"""Two-stage reproducibility models: preparation, grouped folds, fits and out-of-fold scores."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import free_names
from ..functions.positions import running_start, running_sums
from ..functions.scratch import written
from . import contracts, evaluation, labels
from .boosting import Boosted, BoostParams, fit_boosted
from .families import study_families
from .fold_fits import FoldFits, fit_all

# Feature profiles, and what may not be a feature.
SCREEN_FEATURES = [
    "guide_n", "absolute_median_guide_lfc", "absolute_mean_guide_lfc", "is_sensitization_signal", "is_neutral_signal",
    "direction_aligned_median_guide_lfc", "direction_aligned_mean_guide_lfc", "direction_signal_agreement", "guide_lfc_mad", "guide_lfc_iqr",
    "guide_direction_agreement", "top2_abs_lfc_mean", "leave_one_guide_out_median_sd", "strongest_guide_dominance", "mean_control_count",
    "low_count_fraction", "zero_fraction_control", "zero_fraction_treatment", "within_screen_effect_percentile", "replicate_correlation",
    "control_replicate_correlation", "treatment_replicate_correlation", "replicate_effect_sd", "median_library_size",
]
DESIGN_FEATURES = [
    "library_size_guides", "target_gene_count", "guides_per_gene_median", "nontargeting_guide_count", "library_moi", "effector_moi",
    "coverage_transduction", "coverage_selection", "coverage_harvest", "minimum_declared_coverage", "infection_replicate_count",
    "observed_infection_replicate_count", "observed_biological_replicate_count", "observed_technical_replicate_count", "observed_timepoint_count",
    "independent_infection_replicates_declared", "paired_replicate_fraction", "vehicle_control_present", "baseline_control_present",
    "same_infection_split", "matched_control", "cnv_amplification_risk_assessed", "control_sample_n", "treatment_sample_n", "baseline_sample_n",
    "antibiotic_selection_days", "editing_maturation_days", "plasmid_reads_per_guide", "plasmid_zero_guide_fraction", "plasmid_skew_ratio",
    "screen_reads_per_guide", "gdna_fraction_amplified", "pcr_cycle_count", "exposure_days", "recovery_days", "endpoint_timepoint_days",
    "treatment_dose_reported", "design_metadata_completeness", "screen_scale_genome_wide", "selection_strategy_positive_selection",
    "selection_strategy_negative_selection", "selection_strategy_bidirectional_selection", "selection_strategy_competitive_growth",
    "selection_strategy_marker_sort", "control_type_vehicle", "control_type_untreated", "control_type_baseline_t0", "control_type_later_timepoint",
    "control_type_matched_nontargeting", "control_type_unknown",
]
PROFILES = {"screen_only": SCREEN_FEATURES, "screen_plus_design": SCREEN_FEATURES + DESIGN_FEATURES}
FORBIDDEN = {
    "label_code", "target", "testing_status", "author_hit", "phenotype_reproduced", "opposite_direction_reproduced", "perturbation_confirmed",
    "rescue_performed", "causal_reversal_performed", "validation_outcome", "validation_label",
}
FORBIDDEN_PARTS = (
    "validation", "phenotype_reproduced", "opposite_direction", "rescue", "causal_reversal", "perturbation_confirmed", "author_hit", "testing_status",
    "label_code",
)


def check_features(columns: list[str]) -> None:
    leaks = sorted({c for c in columns if c in FORBIDDEN or any(p in c.lower() for p in FORBIDDEN_PARTS)})
    if leaks:
        raise ValueError(f"features leak labels, selection or validation: {leaks}")


def align_direction(df: DataFrame) -> DataFrame:
    """Effects signed by the candidate's direction, and whether the signal agrees with it; null where the direction has no sign."""
    needed = ("phenotype_direction", "median_guide_lfc", "mean_guide_lfc", "signal_direction")
    if any(c not in df.columns for c in needed):
        return df
    direction = F.col("phenotype_direction")
    sign = F.when(direction == "resistance", 1.0).when(direction == "sensitization", -1.0).when(direction == "neutral", 0.0)
    return df.withColumns({
        "direction_aligned_median_guide_lfc": sign * F.col("median_guide_lfc"),
        "direction_aligned_mean_guide_lfc": sign * F.col("mean_guide_lfc"),
        "direction_signal_agreement": F.when(sign.isNotNull(), (F.col("signal_direction") == direction).cast("double")),
    })


def testing_target(status: Column) -> Column:
    """1 of tested, 0 of not_tested, null of unknown; anything else is an error."""
    low = F.lower(F.trim(status))
    return (
        F.when(low == "tested", 1).when(low == "not_tested", 0).when(low.isNull() | (low == "unknown"), F.lit(None).cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown testing status: "), low)).cast("int"))
    )


def check_candidates(df: DataFrame, label: str = "label_code", tested: str = "testing_status") -> None:
    """Candidates before any fit: their fields by contract (labels and statuses given and agreeing), directions
    with a sign, unique keys, and each screen in one study."""
    fields = [f.name for f in contracts.fields_of("candidate")]
    named = {"label_code": label, "testing_status": tested}
    lost = [named.get(f, f) for f in fields if named.get(f, f) not in df.columns]
    if lost:
        raise ValueError(f"no candidate columns {lost}")
    rows = df.select(*[F.col(named.get(f, f)).alias(f) for f in fields])
    odd = rows.where(~F.coalesce(F.lower(F.trim("phenotype_direction")).isin("resistance", "sensitization"), F.lit(False)))
    if not odd.limit(1).isEmpty():
        raise ValueError("candidates with a wrong direction: only resistance and sensitization are scored")
    errors = contracts.validate(rows, "candidate")[1].groupBy("error").count().orderBy("error").limit(5).collect()
    if errors:
        raise ValueError("candidates break their contract: " + ", ".join(f"{r['error']} ({r['count']})" for r in errors))
    if not df.groupBy("screen_id").agg(F.count_distinct("study_id").alias("n")).where("n > 1").limit(1).isEmpty():
        raise ValueError("there is a screen of several studies")


def assemble_features(features: DataFrame, designs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gene features with their contrast's design features and their candidates' labels.

    A design is unique for its screen and contrast, and a candidate for its study, screen, contrast and
    gene; anything else is an error, as rows would be multiplied. Features without either keep nulls.
    """
    by_design = ["screen_id", "contrast_id"]
    by_gene = ["study_id", *by_design, "gene_symbol"]
    wanted = features
    for name, df, keys in (("design", designs, by_design), ("candidate", candidates, by_gene)):
        if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"several {name} rows of one {'/'.join(keys)}")
        taken = [c for c in df.columns if c in keys or c not in wanted.columns]
        # Candidates are as many as genes; on disk they look smaller than what a driver could send.
        side = df.select(*taken)
        wanted = wanted.join(side.hint("merge") if name == "candidate" else side, keys, "left")
    if not features.groupBy("screen_id", "contrast_id", "gene_symbol").count().where("count > 1").limit(1).isEmpty():
        raise ValueError("several feature rows of one gene")
    return wanted


@dataclass
class Standardizer:
    """Medians, and means and deviations over values and missing-indicators, of a weighted sample."""

    columns: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``: standardized values with medians for what is missing, then an indicator for each column."""
        parts = []
        for c in self.columns:
            parts.append((c, F.coalesce(_finite(c), F.lit(self.median[c]))))
        for c in self.columns:
            parts.append((f"{c}__missing", _finite(c).isNull().cast("double")))
        added = {f"_z_{n}": (v - self.mean[n]) / self.scale[n] for n, v in parts}
        assembled = VectorAssembler(inputCols=list(added), outputCol="features").transform(df.withColumns(added))
        return assembled.drop(*added)


def _finite(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def weighted_medians(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """``(feature, median)``: the least value at which half of the weight is reached; weights are summed by value first."""
    long = df.select(weight, *[_finite(c).alias(c) for c in columns]).unpivot([weight], columns, "feature", "value").where("value is not null")
    steps = written(long.groupBy("feature", "value").agg(F.sum(weight).alias("w")), "steps")
    totals = steps.groupBy("feature").agg(F.sum("w").alias("t"))
    # A feature's distinct values are added up in ranges, so none is sorted whole.
    reached = running_sums(steps, ["feature"], "value", {"c": "w"}).join(totals, "feature").where("c >= t / 2")
    return reached.groupBy("feature").agg(F.min("value").alias("median"))


def fit_standardizer(df: DataFrame, columns: list[str], weight: str = "weight") -> Standardizer:
    medians = {r["feature"]: r["median"] for r in weighted_medians(df, columns, weight).collect()}
    medians = {c: medians.get(c, 0.0) for c in columns}
    w = F.col(weight)
    values = {c: F.coalesce(_finite(c), F.lit(medians[c])) for c in columns}
    values |= {f"{c}__missing": _finite(c).isNull().cast("double") for c in columns}
    means = df.agg(*[(F.sum(w * v) / F.sum(w)).alias(n) for n, v in values.items()]).first().asDict()
    spread = df.agg(*[F.sqrt(F.sum(w * (v - means[n]) * (v - means[n])) / F.sum(w)).alias(n) for n, v in values.items()]).first().asDict()
    return Standardizer(columns, medians, means, {n: s if s else 1.0 for n, s in spread.items()})


#: What boosted trees are fitted with.
BOOSTING = BoostParams()


@dataclass
class Fitted:
    standardizer: Standardizer
    model: object

    def score(self, df: DataFrame, name: str) -> DataFrame:
        ready = self.standardizer.transform(df)
        if isinstance(self.model, Boosted):
            return self.model.score(ready.withColumn("features", vector_to_array("features")), name).drop("features")
        drop = ["features", "rawPrediction", "probability", "prediction"]
        return self.model.transform(ready).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop(*drop)


def _fit(df: DataFrame, columns: list[str], kind: str) -> Fitted:
    """A model on standardized features: ``logistic``, or ``boosted_trees`` as ``BOOSTING`` says."""
    standard = fit_standardizer(df, columns)
    ready = standard.transform(df)
    if kind == "boosted_trees":
        return Fitted(standard, fit_boosted(ready.withColumn("features", vector_to_array("features")), p=BOOSTING))
    if kind != "logistic":
        raise ValueError(f"unknown model kind {kind!r}")
    total = df.agg(F.sum("weight")).first()[0]
    learner = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=300, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, tol=1e-8)
    return Fitted(standard, learner.fit(ready))


def deal_groups(df: DataFrame, group: str, n_splits: int, strata: str | None = None, seed: int = 17, heavy: int = 1000) -> DataFrame:
    """``(group, fold)``: whole groups, dealt so that folds are even by size and stratum.

    Groups with at least one of ``heavy`` parts of all rows, hence ``heavy`` at most, are dealt on the driver: largest
    first, each to the fold that stays most even. The others stay where they are. Their rows are shared out so that heavy
    and light ones together fill the folds evenly, as far as heavy ones leave room; groups of like strata (shares
    in fourths) stand in the order of a seeded hash, and a group goes to the fold in whose share of their rows its middle falls. So of each
    kind of stratum a fold's light rows differ from its share by less than two light groups.
    """
    level = F.coalesce(F.col(strata).cast("int"), F.lit(-1)) if strata else F.lit(0)
    counts = written(df.groupBy(F.col(group).cast("string").alias("g"), level.alias("s")).agg(F.count("*").alias("n")), "group-counts")
    levels = sorted(r[0] for r in counts.select("s").distinct().collect())
    each = [F.coalesce(F.sum(F.when(F.col("s") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(levels)]
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"), *each)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    table = groups.where(F.col("n") * heavy >= rows).toPandas().set_index("g").sort_index()
    table = table[[f"n{i}" for i in range(len(levels))]]
    rng = np.random.default_rng(seed)
    table = table.iloc[rng.permutation(len(table))] if strata else table
    table = table.loc[table.sum(axis=1).sort_values(ascending=False, kind="stable").index]
    have = np.zeros((n_splits, len(levels)))
    totals = np.maximum(table.sum(axis=0).to_numpy(float), 1)
    folds = []
    for row in table.to_numpy(float):
        after = (have[None] + np.eye(n_splits)[:, :, None] * row) / totals
        spread = after.std(axis=1).mean(axis=1)
        best = int(np.lexsort((have.sum(axis=1), np.round(spread, 12)))[0])
        have[best] += row
        folds.append(best)
    dealt = df.sparkSession.createDataFrame(list(zip(table.index.tolist(), folds, strict=True)), "group string, fold int")
    shares = np.cumsum(_room(have.sum(axis=1), rows - have.sum()))
    if not shares[-1]:
        return dealt
    light = groups.where(F.col("n") * heavy < rows)
    kind = F.concat_ws(",", *[F.round(4 * F.col(f"n{i}") / F.col("n")).cast("int") for i in range(len(levels))])
    place = F.xxhash64(F.lit(seed), "g").bitwiseAND(F.lit((1 << 63) - 1))
    light = written(light.select("g", "n", kind.alias("kind"), place.alias("place")), "light-groups")
    stood = running_start(light, ["kind"], "place", ["g"], "n", "at").join(light.groupBy("kind").agg(F.sum("n").alias("of")), "kind")
    share = (F.col("at") + F.col("n") / 2) / F.col("of")
    fold = F.size(F.filter(F.array(*[F.lit(float(x / shares[-1])) for x in shares[:-1]]), lambda edge: edge <= share))
    return dealt.union(stood.select("g", fold.cast("int")))


def _room(have: np.ndarray, more: float) -> np.ndarray:
    """How ``more`` is shared out among folds that have some already, so that all are as even as can be."""
    order = np.sort(have)
    for n in range(len(order), 0, -1):
        water = (order[:n].sum() + more) / n
        if water >= order[n - 1]:
            return np.maximum(water - have, 0.0)
    return np.zeros(len(have))


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """``df`` with ``weight``, one over the rows of its group."""
    sizes = df.groupBy(group).agg((1.0 / F.count("*")).alias("weight"))
    return df.drop("weight").join(sizes, group)


def fit_propensity(df: DataFrame, columns: list[str], groups: str, n_splits: int = 5) -> DataFrame:
    """``df`` with ``propensity`` of being tested, cross-fitted by groups where the status is known.

    Rows of unknown status are scored by a model of all known ones. One class alone gives 1.
    """
    known = df.where("tested is not null")
    classes = {r[0] for r in known.select("tested").distinct().collect()}
    if len(classes) < 2:
        return df.withColumn("propensity", F.lit(1.0))
    if not known.where(F.col(groups).isNull()).limit(1).isEmpty():
        raise ValueError("IPW requires a group for each row of known status")
    n_groups = known.select(groups).distinct().count()
    if n_groups < 2:
        raise ValueError("IPW requires two groups or more")
    folds = deal_groups(known, groups, min(n_splits, n_groups)).withColumnRenamed("group", groups).withColumnRenamed("fold", "_inner")
    dealt = known.withColumn(groups, F.col(groups).cast("string")).join(folds, groups)
    prepared = dealt.withColumns({"_label": F.col("y"), "y": F.col("tested").cast("double"), "weight": F.lit(1.0)})
    by_fold = prepared.groupBy("_inner").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
    pos, n = sum(r["pos"] for r in by_fold), sum(r["n"] for r in by_fold)
    if any(pos - r["pos"] in (0, n - r["n"]) for r in by_fold):
        raise ValueError("IPW requires both classes in each training fold")
    out = None
    for r in by_fold:
        scored = _fit(prepared.where(F.col("_inner") != r["_inner"]), columns, "logistic").score(prepared.where(F.col("_inner") == r["_inner"]), "propensity")
        out = scored if out is None else out.unionByName(scored)
    rest = df.where("tested is null").withColumn(groups, F.col(groups).cast("string"))
    every = _fit(prepared, columns, "logistic").score(rest, "propensity")
    known_rows = out.drop("_inner", "weight", "y").withColumnRenamed("_label", "y")
    return known_rows.unionByName(every)


def fit_success(train: DataFrame, columns: list[str], kind: str, group: str, ipw: bool) -> tuple[Fitted, dict[str, float]]:
    """The model of success on labelled, tested rows, weighted by group (and inverse clipped propensity), with diagnostics."""
    known = train.where("tested is not null").count()
    rows = group_weights(train.where("y is not null and tested = 1"), group)
    clip = F.least(F.greatest(F.col("propensity"), F.lit(0.1)), F.lit(0.95)) if ipw else F.lit(1.0)
    rows = rows.withColumn("weight", F.col("weight") / clip)
    mean = rows.agg(F.avg("weight")).first()[0]
    rows = written(rows.withColumn("weight", F.col("weight") / mean), "train")
    if rows.select("y").distinct().count() < 2:
        raise ValueError("success labels are of one class")
    p = F.col("propensity") if ipw else F.lit(1.0)
    w = 1.0 / clip
    stats = rows.agg(
        F.count("*").cast("double").alias("n_labeled"), F.lit(float(known)).alias("n_selection_status_known"), F.min(p).alias("propensity_min"),
        F.median(p).alias("propensity_median"), F.max(p).alias("propensity_max"), F.avg((p < 0.1).cast("double")).alias("clip_lower_fraction"),
        F.avg((p > 0.95).cast("double")).alias("clip_upper_fraction"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_sample_size"),
        F.lit(1.0).alias("study_balancing_applied"), F.lit(0.0).alias("outcome_observation_weighting_applied"),
    ).first().asDict()
    return _fit(rows, columns, kind), stats


def out_of_fold(
    df: DataFrame, columns: list[str], *, group: str = "study_id", label: str = "label_code", tested: str = "testing_status", n_splits: int = 5,
    kind: str = "logistic", families: tuple[str, ...] = ("source_family_id", "raw_data_family_id"), ipw: bool = True,
) -> tuple[DataFrame, dict[str, float]]:
    """Scores of each row by models that saw no row of its group: ``fold, group_used, y, score, ipw_score`` are added.

    Studies of one family (shared data, transitively) are one group. Folds are
    stratified by the target. If any fold's weighted fit fails, no row has an ``ipw_score``.
    Rows that aren't proper candidates (``check_candidates``) are an error. Logistic models of all folds, inner
    ones included, are fitted in the same scans; for boosted trees the driver loops over the folds, at most ``n_splits``.
    """
    check_features(columns)
    check_candidates(df, label, tested)
    base = align_direction(df)
    have = [c for c in families if c in base.columns]
    if group == "study_id" and have:
        grouped = base.join(study_families(base.select("study_id", *have).distinct(), families=tuple(have)).withColumnRenamed("family_group", "group_used"), "study_id", "left")
    else:
        grouped = base.withColumn("group_used", F.col(group).cast("string"))
    grouped = grouped.withColumns({"y": labels.model_target(F.col(label)).cast("double"), "tested": testing_target(F.col(tested))})
    n_groups = grouped.select("group_used").distinct().count()
    if n_groups < 2:
        raise ValueError("two groups or more are needed")
    folds = deal_groups(grouped, "group_used", min(n_splits, n_groups), "y")
    rows = written(grouped.join(folds.withColumnRenamed("group", "group_used"), "group_used"), "folds")
    usable = rows.where("y is not null and tested = 1").groupBy("fold").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
    pos, n = sum(r["pos"] for r in usable), sum(r["n"] for r in usable)
    by = {r["fold"]: r for r in usable}
    numbers = sorted(r[0] for r in rows.select("fold").distinct().collect())
    stuck = [f for f in numbers if pos - (by[f]["pos"] if f in by else 0) in (0, n - (by[f]["n"] if f in by else 0))]
    if stuck:
        raise ValueError(f"folds without both classes to train on: {stuck}")
    if kind == "logistic":
        return _fold_scores(rows, columns, numbers, ipw)
    plain, weighted, notes = None, None, []
    for f in numbers:
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        fitted, _ = fit_success(train, columns, kind, "group_used", False)
        scored = written(fitted.score(test, "score"), "scored")
        plain = scored if plain is None else plain.unionByName(scored)
        if ipw:
            try:
                fitted, stats = fit_success(fit_propensity(train, columns, "group_used"), columns, kind, "group_used", True)
            except ValueError as e:
                ipw, weighted = False, None
                notes.append({"ipw_refused": 1.0, "reason": str(e)})
                continue
            notes.append(stats)
            scored = written(fitted.score(test, "ipw_score").select(*labels.KEYS, "ipw_score"), "scored")
            weighted = scored if weighted is None else weighted.unionByName(scored)
    out = plain.join(weighted, list(labels.KEYS), "left") if weighted is not None else plain.withColumn("ipw_score", F.lit(None).cast("double"))
    return out, _means(notes if weighted is not None else [])


def _means(notes: list[dict]) -> dict[str, float]:
    return {f"ipw_mean_{k}": float(np.mean([s[k] for s in notes])) for k in (notes[0] if notes else {})}


def _inner_folds(counts: list, folds: list[int], n_splits: int = 5) -> tuple[dict[str, list[int]], dict[int, int]]:
    """For each group its fold within each fold's training groups (-1: none), and how many these have (0: one class alone, no model needed).

    ``counts``: ``(g, fold, n, ones)`` of rows of known status. Largest groups first, each to the smallest fold.
    """
    inner = {r["g"]: [-1] * len(folds) for r in counts}
    parts: dict[int, int] = {}
    for k, f in enumerate(folds):
        train = sorted((r for r in counts if r["fold"] != f), key=lambda r: (-r["n"], r["g"]))
        n, ones = sum(r["n"] for r in train), sum(r["ones"] for r in train)
        parts[k] = 0
        if ones in (0, n):
            continue
        if len(train) < 2:
            raise ValueError("IPW requires two groups or more")
        parts[k] = min(n_splits, len(train))
        held = [[0, j, 0] for j in range(parts[k])]
        for r in train:
            least = held[0]
            inner[r["g"]][k] = least[1]
            heapq.heapreplace(held, [least[0] + r["n"], least[1], least[2] + r["ones"]])
        if any(ones - lost in (0, n - size) for size, _, lost in held):
            raise ValueError("IPW requires both classes in each training fold")
    return inner, parts


def _fold_scores(rows: DataFrame, columns: list[str], folds: list[int], ipw: bool) -> tuple[DataFrame, dict[str, float]]:
    """The out-of-fold scores of logistic models: models of success of all folds and of testing of all inner folds are
    fitted in the same scans, then the weighted models of success of all folds. The driver holds a row of counts for each group."""
    taken = free_names(rows, "x", "w", "w0", "inner", "clipped", "propensities")
    x, w, w0, inner, clipped, chance = taken
    usable, known = F.col("y").isNotNull() & (F.coalesce("tested", F.lit(-1)) == 1), F.col("tested").isNotNull()
    sizes = rows.where(usable).groupBy("group_used").agg((1.0 / F.count("*")).alias(w0))
    values = F.array(*[F.coalesce(_finite(c), F.lit(float("nan"))) for c in columns])
    based = rows.join(sizes, "group_used", "left").withColumn(x, values)
    others = [F.col("fold") != f for f in folds]

    plan: dict[tuple[int, int | None], int] = {}
    notes: list[dict] = []
    if ipw:
        try:
            if not rows.where(known & F.col("group_used").isNull()).limit(1).isEmpty():
                raise ValueError("IPW requires a group for each row of known status")
            counts = rows.where(known).groupBy(F.col("group_used").alias("g"), "fold").agg(F.count("*").alias("n"), F.sum("tested").alias("ones")).collect()
            dealt, parts = _inner_folds(counts, folds)
            table = rows.sparkSession.createDataFrame(list(dealt.items()), f"group_used string, `{inner}` array<int>")
            based = based.join(table, "group_used", "left")
            for k in range(len(folds)):
                for j in [*range(parts[k]), None] if parts[k] else []:
                    plan[k, j] = len(folds) + len(plan)
        except ValueError as e:
            ipw = False
            notes.append({"ipw_refused": 1.0, "reason": str(e)})

    def fitted(table: DataFrame, weights: list[Column], targets: list[str], what: list[str]) -> FoldFits:
        ready = written(table.select(F.col(x).alias("x"), F.array(*weights).alias("w"), F.col("y").cast("double").alias("y"), F.col("tested").cast("double").alias("tested")), "fits")
        return fit_all(ready, len(columns), targets, what)

    def balanced(table: DataFrame, each: list[Column]) -> list[Column]:
        """For each fold the weights of usable rows of the others, one on average."""
        own = [F.when(usable & other, weight) for other, weight in zip(others, each, strict=True)]
        means = table.agg(*[F.avg(weight).alias(f"m{k}") for k, weight in enumerate(own)]).first()
        return [F.coalesce(weight / F.lit(mean), F.lit(0.0)) for weight, mean in zip(own, means, strict=True)]

    based = written(based, "based")
    weights = balanced(based, [F.col(w0)] * len(folds))
    weights += [F.when(known & others[k] & ((F.col(inner)[k] != j) if j is not None else F.lit(True)), 1.0).otherwise(0.0) for k, j in plan]
    first = fitted(based, weights, ["y"] * len(folds) + ["tested"] * len(plan), [f"success without fold {f}" for f in folds] + [f"testing {key}" for key in plan])
    number = F.lit(None).cast("int")
    for k, f in enumerate(folds):
        number = F.when(F.col("fold") == f, k).otherwise(number)
    scored = based.withColumn("score", first.score(F.col(x), number))
    if not ipw:
        return scored.withColumn("ipw_score", F.lit(None).cast("double")).drop(*taken), {}

    # Chances of being tested: by the inner model that didn't see the row's group, or by all of the training rows for unknown statuses.
    chances = []
    for k in range(len(folds)):
        if (k, None) not in plan:
            chances.append(F.when(others[k], 1.0))
            continue
        which = F.lit(plan[k, None])
        for j in (j for i, j in plan if i == k and j is not None):
            which = F.when(known & (F.col(inner)[k] == j), plan[k, j]).otherwise(which)
        chances.append(first.score(F.col(x), F.when(others[k], which)))
    scored = written(scored.withColumn(chance, F.array(*chances)), "chances")
    stats = [_fit_notes(usable & other, known & other, F.col(chance)[k]) for k, other in enumerate(others)]
    found = scored.agg(*[F.struct(*[c.alias(n) for n, c in s.items()]).alias(f"s{k}") for k, s in enumerate(stats)]).first()
    notes = [r.asDict() for r in found]
    weights = balanced(scored, [F.col(w0) / _clipped(F.col(chance)[k]) for k in range(len(folds))])
    second = fitted(scored, weights, ["y"] * len(folds), [f"weighted success without fold {f}" for f in folds])
    return scored.withColumn("ipw_score", second.score(F.col(x), number)).drop(*taken), _means(notes)


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.1)), F.lit(0.95))


def _fit_notes(used: Column, known: Column, p: Column) -> dict[str, Column]:
    """What is told of a weighted fit, over the rows that are used."""
    own, w = F.when(used, p), F.when(used, 1.0 / _clipped(p))
    return {
        "n_labeled": F.count_if(used).cast("double"), "n_selection_status_known": F.count_if(known).cast("double"), "propensity_min": F.min(own),
        "propensity_median": F.median(own), "propensity_max": F.max(own), "clip_lower_fraction": F.avg((own < 0.1).cast("double")),
        "clip_upper_fraction": F.avg((own > 0.95).cast("double")), "effective_sample_size": F.sum(w) * F.sum(w) / F.sum(w * w),
        "study_balancing_applied": F.lit(1.0), "outcome_observation_weighting_applied": F.lit(0.0),
    }


def evaluate(scored: DataFrame, query: list[str], score: str = "score") -> DataFrame:
    return evaluation.ranking_metrics(scored, query, "study_id", "y", score, tie=("gene_symbol",))
