"""Splits that hold groups or later times out, with scores, as-of joins and recurrence that see no held-out row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import free_names
from ..functions.scratch import written


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], at: str, available: str, values: list[str], version: list[str] = ()) -> DataFrame:
    """``left`` with ``values`` and ``available`` of the last row of ``right`` that was available at the row's own time ``at``.

    A row available at that very time counts. Among rows of one time the greatest ``version`` is taken, then the greatest values, so reruns
    agree. Rows of ``left`` without a match, or with a null in key or time, get nulls; such rows of ``right`` match nothing.
    Columns of the two sides have to differ, but for the key.

    Both sides are laid in one order by ranges of key and time, so a key with very many rows spreads over
    tasks; only the last row of each key and range is carried on to later ranges.
    """
    clash = {available, *values} & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    time, kind, draw, part, row, last, carried, mark = free_names(left, "_time", "_kind", "_draw", "_part", "_row", "_last", "_carried", "_key")
    keys = [f"{mark}{i}" for i in range(len(key))]
    named = lambda df: [df[c].alias(k) for c, k in zip(key, keys, strict=True)]
    usable = F.col(time).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    found = F.struct(F.col(available), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(version)], *values)
    rights = right.select(*named(right), F.col(available).alias(time), F.lit(0).alias(kind), found.alias(last)).where(usable)
    lefts = left.select(*named(left), F.col(at).alias(time), F.lit(1).alias(kind), F.struct(*left.columns).alias(row))
    both = rights.unionByName(lefts.where(usable), allowMissingColumns=True)
    ranged = both.withColumn(draw, F.rand(11)).repartitionByRange(*keys, time, kind, draw).drop(draw).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranged")
    per = ranged.groupBy(*keys, part).agg(F.max(last).alias(last))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*keys, part, F.max(last).over(before).alias(carried))
    # Peers, rows of one time and side, see each other: rows of the right side stand before those of the left.
    inside = W.partitionBy(*keys, part).orderBy(time, kind)
    matched = ranged.withColumn(last, F.max(last).over(inside)).where(F.col(kind) == 1).join(starts, [*keys, part])
    # Structs compare by time first. Rows of one time may lie in several ranges, so the last one met isn't always the greatest.
    best = F.greatest(last, carried)
    plain = lambda df, s: df.select(f"{row}.*", *[s[c].alias(c) for c in (available, *values)])
    rest = lefts.where(~usable).withColumn(last, F.lit(None).cast(ranged.schema[last].dataType))
    return plain(matched, best).unionByName(plain(rest, F.col(last)))


def temporal_split(df: DataFrame, available: str, cutoff: str, family: str) -> DataFrame:
    """``df`` with ``split``: ``train`` (available by the cutoff), ``test`` (later), ``purged`` (later, but its family has rows to train on), ``undated``.

    A family is summed up before it is joined back; rows without a family are families of their own.
    """
    early = F.col(available) <= F.lit(cutoff).cast("timestamp")
    (seen,) = free_names(df, "_seen")
    known = df.where(F.col(family).isNotNull() & early).select(F.col(family).alias(f"{seen}_f")).distinct().withColumn(seen, F.lit(True))
    split = F.when(F.col(available).isNull(), "undated").when(early, "train").when(F.col(seen), "purged").otherwise("test")
    return df.join(known, F.col(family) == F.col(f"{seen}_f"), "left").withColumn("split", split).drop(seen, f"{seen}_f")


def training_recurrence(df: DataFrame, by: list[str], family: str, direction: str, fold: str) -> DataFrame:
    """Per ``by`` and family: families of other folds with a signal there, and the part of them that has this family's direction.

    A family's direction is its greatest. It lies in one fold, so taking the fold off the totals takes off the family and
    all that is scored with it; a null fold holds nothing out but the family. Nulls in ``by`` are a value; rows without a family are left out.
    """
    per = df.where(F.col(family).isNotNull()).groupBy(*by, family).agg(
        F.max(direction).alias("d"), F.min(fold).alias("fold"), F.max(fold).alias("_hi"), F.count_if(F.col(fold).isNull()).alias("_none"), F.count("*").alias("_n")
    )
    folds = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"), F.count_if(F.col(fold).isNull()).alias("none"), F.count("*").alias("n"))
    if not folds.where("lo <> hi or (none > 0 and none < n)").limit(1).isEmpty():
        raise ValueError("a family has rows of more than one fold")
    # One row a key, direction and fold goes into the totals: no window holds a key's rows.
    cells = per.groupBy(*by, "d", "fold").agg(F.count("*").alias("n"))
    alike = lambda c: F.col(f"{c}.d").eqNullSafe(F.col("p.d"))
    same_key = lambda c: [F.col(f"{c}.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by]
    keys = cells.groupBy(*by).agg(F.sum("n").alias("n"))
    own = cells.groupBy(*by, "fold").agg(F.sum("n").alias("n"))
    way = cells.groupBy(*by, "d").agg(F.sum("n").alias("n"))
    joined = (
        per.alias("p").join(keys.alias("k"), same_key("k"))
        .join(own.alias("o"), [*same_key("o"), F.col("o.fold") == F.col("p.fold")], "left")
        .join(way.alias("w"), [*same_key("w"), alike("w")])
        .join(cells.alias("c"), [*same_key("c"), alike("c"), F.col("c.fold") == F.col("p.fold")], "left")
    )
    # Without a fold, only the family itself is taken off.
    off = lambda c: F.coalesce(F.col(f"{c}.n"), F.lit(1))
    others = F.col("k.n") - off("o")
    return joined.select(
        *[F.col(f"p.{c}").alias(c) for c in (*by, family)], F.col("p.fold").alias(fold), others.alias("training_families"),
        F.try_divide(F.col("w.n") - off("c"), others).alias("same_direction_fraction"),
    )


def _moments(terms: list[str]) -> tuple[list[Column], list[str]]:
    """Sums that a least-squares fit needs: of products of all pairs of (1, features, target)."""
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    names = [f"_m{i}" for i in range(len(pairs))]
    return [F.sum(F.col(a) * F.col(b)).alias(n) for (a, b), n in zip(pairs, names, strict=True)], names


def ridge_from_moments(moments: np.ndarray, features: int, penalty: float) -> np.ndarray:
    """Intercept and slopes of the least-squares line, slopes penalised on features of unit variance; constant features have slope 0."""
    size = features + 2
    whole = np.zeros((size, size))
    whole[np.triu_indices(size)] = moments
    whole = whole + np.triu(whole, 1).T
    n = whole[0, 0]
    mean = whole[0, 1:] / n
    spread = whole[1:, 1:] - n * np.outer(mean, mean)
    var = np.diag(spread)[:-1]
    kept = var > 1e-9 * np.maximum(1.0, np.diag(whole)[1:-1])
    slopes = np.zeros(features)
    if kept.any():
        scale = np.sqrt(var[kept] / n)
        gram = spread[:-1, :-1][np.ix_(kept, kept)] / np.outer(scale, scale)
        slopes[kept] = np.linalg.solve(gram + penalty * np.eye(int(kept.sum())), spread[:-1, -1][kept] / scale) / scale
    return np.r_[mean[-1] - mean[:-1] @ slopes, slopes]


def leave_group_out_scores(df: DataFrame, key: str, family: str, features: list[str], target: str = "target", penalty: float = 1.0) -> DataFrame:
    """``df`` with ``training_rows`` and ``held_out_score`` from a penalised least-squares fit that saw neither the row's group nor any family with a row in that group.

    Each family's sums of products are taken once; a group's fit starts from all of them minus those of the group's families, so there is one
    scan however many groups there are. A null feature counts as 0 with an indicator beside it. Rows without a group or target train
    nothing; rows without a family are a family with their group's other such rows. Both columns are null without a group, the score also where fewer than
    two rows are left to train on. One row of totals and as many sums as pairs of features meet on a group.
    """
    gone = list(free_names(df, *[f"_gone{i}" for i in range(len(features))]))
    cols = list(free_names(df, *[f"_x{i}" for i in range(len(features))]))
    one, y, group, fam, left_over, weights, count = free_names(df, "_one", "_y", "_group", "_family", "_left", "_w", "_rows")
    value = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.withColumns({
        one: F.lit(1.0), y: F.col(target).cast("double"), group: F.col(key),
        fam: F.coalesce(F.concat(F.lit("f"), F.col(family).cast("string")), F.concat(F.lit("g"), F.col(key).cast("string"))),
        **{x: F.coalesce(value(c), F.lit(0.0)) for x, c in zip(cols, features, strict=True)},
        **{g: value(c).isNull().cast("double") for g, c in zip(gone, features, strict=True)},
    })
    sums, names = _moments([one, *cols, *gone, y])
    grouped = rows.where(F.col(group).isNotNull())
    per = written(grouped.where(F.col(y).isNotNull()).groupBy(fam).agg(*sums), "families")
    total = per.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"_t{n}") for n in names])
    links = grouped.select(group, fam).distinct()
    off = links.join(per, fam, "left").groupBy(group).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    left = off.join(F.broadcast(total)).select(group, F.array(*[F.col(f"_t{n}") - F.col(n) for n in names]).alias(left_over))  # one row of totals
    size = 2 * len(features)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ridge_from_moments(np.asarray(m), size, penalty).tolist() if round(m[0]) >= 2 else None for m in b[left_over]]
            yield pd.DataFrame({group: b[group], count: [round(m[0]) for m in b[left_over]], weights: found})

    kind = df.schema[key].dataType.simpleString()
    fits = left.mapInPandas(fit, f"{group} {kind}, {count} long, {weights} array<double>")
    score = F.get(weights, F.lit(0))
    for i, c in enumerate([*cols, *gone]):
        score = score + F.get(weights, F.lit(i + 1)) * F.col(c)
    return rows.join(fits, group, "left").withColumn("held_out_score", score).select(*df.columns, F.col(count).alias("training_rows"), "held_out_score")
