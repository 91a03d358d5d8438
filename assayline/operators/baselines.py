"""Rankings that a score is held against: robust rank aggregation with permutations, and a Z statistic with smoothed variance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.positions import places
from ..functions.ranks import average_ranks
from ..functions.scratch import written

CONTRAST = ("screen_id", "contrast_id")
_CELLS = 1 << 18  # numbers drawn at a time
_BLOCK = 100  # permutations of one size that are drawn in one row


def _usable(guides: DataFrame, value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return guides.where(F.col("gene_symbol").isNotNull() & number.isNotNull() & ~F.isnan(number))


def smoothed_z(guides: DataFrame, window: int = 500, value: str = "guide_lfc", abundance: str = "mean_control_count", by: tuple[str, ...] = CONTRAST) -> DataFrame:
    """``(*by, gene_symbol, guide_n, norm_z)``: a gene's summed guide Z over the root of its guides, standardised among the genes of its contrast.

    Guides are laid from the most to the least abundant (then by ``sgrna_id``) and cut into runs of ``window``. A run's deviation is that of itself and the
    runs beside it, and never less than that of a more abundant run. Guides without a gene or value are left out, those without an abundance count
    as the least abundant; a deviation of 0 or of a single guide gives no Z. ``norm_z`` is null where genes don't differ.
    """
    down = F.coalesce(F.col(abundance).cast("double"), F.lit(float("-inf")))
    rows = _usable(guides, value).select(*by, "gene_symbol", "sgrna_id", F.col(value).cast("double").alias("x"), (-down).alias("down"))
    placed = places(rows, list(by), ["down", "sgrna_id"], "place").withColumn("run", F.floor(F.col("place") / window)).drop("place", "down")
    placed = written(placed, "placed")
    sums = placed.groupBy(*by, "run").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    near = W.partitionBy(*by).orderBy("run").rowsBetween(-1, 1)
    around = sums.select(*by, "run", *[F.sum(c).over(near).alias(c) for c in ("n", "s", "q")])
    spread = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1), F.lit(0.0)))
    upto = W.partitionBy(*by).orderBy("run")
    runs = around.withColumn("own", spread).select(*by, "run", F.max("own").over(upto).alias("sd"))
    same = lambda keys: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = placed.alias("a").join(runs.alias("b"), same([*by, "run"])).select(*[f"a.{c}" for c in (*by, "gene_symbol", "x")], "sd")
    z = F.try_divide("x", "sd")
    genes = joined.groupBy(*by, "gene_symbol").agg(F.count("*").alias("guide_n"), F.try_divide(F.sum(z), F.sqrt(F.count(z))).alias("z"))
    genes = written(genes, "genes")
    whole = genes.groupBy(*by).agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("dev"))
    norm = F.try_divide(F.col("z") - F.col("mean"), F.col("dev")).alias("norm_z")
    return genes.alias("a").join(whole.alias("b"), same(by)).select(*[f"a.{c}" for c in (*by, "gene_symbol", "guide_n")], norm)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up from x, where it is exact to some 13 digits."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    steps = np.log(np.multiply.reduce([x + i for i in range(8)]))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - steps


def order_tail(u: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The chance that the k-th least of n uniform numbers is at most u: the regularised incomplete beta function at (k, n - k + 1)."""
    u, a, b = np.broadcast_arrays(np.asarray(u, float), np.asarray(k, float), np.asarray(n, float) - np.asarray(k, float) + 1)
    out = np.where(u >= 1, 1.0, 0.0)
    inside = (u > 0) & (u < 1)
    x, a, b = u[inside], a[inside], b[inside]
    # The fraction converges fast below the mean; above it the other tail is taken.
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value, m = d.copy(), 0
    while x.size:
        m += 1
        before = value
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if np.all(np.abs(value - before) <= 1e-14 * np.abs(value)):
            break
    tail = np.clip(front * value, 0.0, 1.0)
    out[inside] = np.where(swap, 1 - tail, tail)
    return out


@pandas_udf(DoubleType())
def _tails(u: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(order_tail(u.to_numpy(), k.to_numpy(), n.to_numpy()))


def null_scores(size: int, permutations: int, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """Scores of ``permutations`` sets of ``size`` uniform numbers.

    Numbers are drawn in ascending order and in slices, each from the one before it, until all are above ``alpha``: memory doesn't grow with the size.
    """
    best, log_rest, done = np.ones(permutations), np.zeros(permutations), 0
    step = max(1, _CELLS // permutations)
    while done < size:
        k = np.arange(done + 1, min(size, done + step) + 1)
        # Of the numbers left, the least lies above the last by a part whose complement is a power of a uniform number.
        log_left = log_rest[:, None] - np.cumsum(rng.standard_exponential((permutations, len(k))) / (size - k + 1), axis=1)
        u = -np.expm1(log_left)
        if not (low := u <= alpha).any():
            break
        rows, at = np.nonzero(low)
        np.minimum.at(best, rows, order_tail(u[rows, at], k[at], np.full(len(at), size)))
        log_rest, done = log_left[:, -1], done + len(k)
    return best


def rank_scores(guides: DataFrame, value: str = "guide_lfc", ascending: bool = True, alpha: float = 0.25, by: tuple[str, ...] = CONTRAST) -> DataFrame:
    """``(*by, gene_symbol, guide_n, rho)``: how unlikely a gene's best guides are to stand so far ahead by chance.

    Guides of a contrast are ranked by ``value`` to nine decimals, ties by their mean rank, and placed in 0 to 1. Of a gene's guides within the first ``alpha``, the k-th best
    of all n is held against the k-th least of n uniform numbers; rho is the least such chance, 1 without such guides. Guides without gene or value are left out.
    """
    x = F.col(value).cast("double")
    # Values that differ by rounding alone are ties.
    rows = _usable(guides, value).select(*by, "gene_symbol", "sgrna_id", F.round(x if ascending else -x, 9).alias("x"))
    ranked = average_ranks(written(rows, "guides"), list(by), "x", "rank", "among")
    ranked = ranked.withColumn("u", (F.col("rank") - 0.5) / F.col("among")).drop("rank", "among", "x")
    placed = places(ranked, [*by, "gene_symbol"], ["u", "sgrna_id"], "k", of="n")
    chance: Column = F.when(F.col("u") <= alpha, _tails("u", (F.col("k") + 1).cast("double"), F.col("n").cast("double")))
    return placed.groupBy(*by, "gene_symbol").agg(F.max("n").alias("guide_n"), F.coalesce(F.min(chance), F.lit(1.0)).alias("rho"))


def rank_aggregation(
    guides: DataFrame, value: str = "guide_lfc", ascending: bool = True, alpha: float = 0.25, permutations: int = 1000, seed: int = 17, by: tuple[str, ...] = CONTRAST
) -> DataFrame:
    """``rank_scores`` with ``p_value``: one more than the permutations whose rho is as low, over one more than there are.

    A permutation deals ranks at random, so its rho depends on the number of guides alone: each number of guides that occurs is
    drawn once, in blocks that tasks share, from a seed of its own. ``permutations`` numbers meet on a number of guides.
    """
    if permutations < 1 or not 0 < alpha <= 1:
        raise ValueError("permutations or alpha is out of range")
    scored = written(rank_scores(guides, value, ascending, alpha, by), "rho")
    blocks = F.sequence(F.lit(0), F.lit((permutations - 1) // _BLOCK))
    sizes = scored.select(F.col("guide_n").alias("size")).distinct().select("size", F.explode(blocks).alias("block"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, block in zip(b["size"].tolist(), b["block"].tolist(), strict=True):
                many = min(_BLOCK, permutations - block * _BLOCK)
                yield pd.DataFrame({"size": size, "rho0": null_scores(size, many, alpha, np.random.default_rng((seed, size, block)))})

    drawn = sizes.repartition("size", "block").mapInPandas(draw, "size long, rho0 double")
    nulls = written(drawn.groupBy("size").agg(F.collect_list("rho0").alias("null")), "nulls")
    # Equal scores of equal sizes have one value: they are looked up once.
    levels = scored.select("guide_n", "rho").distinct()
    low = F.size(F.filter("null", lambda r: r <= F.col("rho") * (1 + 1e-12)))
    valued = levels.join(nulls, levels.guide_n == nulls.size).select("guide_n", "rho", ((low + 1.0) / (permutations + 1.0)).alias("p_value"))
    # Both sides grow with the genes, however small they are on disk.
    return scored.hint("merge").join(valued, ["guide_n", "rho"]).select(*by, "gene_symbol", "guide_n", "rho", "p_value")
