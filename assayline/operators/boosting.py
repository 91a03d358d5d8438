"""Gradient boosting of leaf-wise grown trees on histograms, for a binary target with row weights.

Rows are binned once and written. A tree's leaves are opened best gain first. One pass over the rows sums gradients and
Hessians by leaf, feature and bin for the children of all leaves that may be opened next, so a tree takes as many passes as it is deep, about, and
not one for each leaf. A task sums its rows before anything is shuffled; what is shuffled is a histogram a task,
leaf and feature, whatever the number of rows. The driver sees the best split of each leaf and feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.positions import running_sums
from ..functions.scratch import remove, scratch_path, written


@dataclass(frozen=True)
class BoostParams:
    """``bins``: for present values, a further one is for missing ones; ``rewrite``: trees after which rows' scores are written anew."""

    rounds: int = 250
    leaves: int = 15
    rate: float = 0.05
    l2: float = 1.0
    min_rows: int = 10
    min_hessian: float = 1e-3
    bins: int = 255
    rewrite: int = 10


@dataclass
class Node:
    """``split``: ``(gain, feature, bin, missing_left, left sums, right sums)`` or None; sums are ``(gradient, Hessian, rows)``."""

    sums: tuple[float, float, float]
    split: tuple | None = None
    left: Node | None = None
    right: Node | None = None
    opened: bool = False


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Values in bins up to ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray, missing: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            b = bins[inner, self.feature[node]]
            goes_left = np.where(b == missing, self.missing_left[node], b <= self.bin[node])
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return at

    def predict(self, bins: np.ndarray, missing: int) -> np.ndarray:
        return self.value[self.leaf_of(bins, missing)]


def flat(root: Node, p: BoostParams, whole: bool) -> tuple[Tree, list[Node]]:
    """The tree below ``root`` as arrays and its nodes in their order; ``whole``: with nodes that aren't opened (yet)."""
    nodes, rows = [root], []
    for node in nodes:  # grows as it is read
        deeper = node.left is not None and (node.opened or whole)
        g, h, _ = node.sums
        if deeper:
            _, feature, at, missing_left, _, _ = node.split
            rows.append((feature, at, missing_left, len(nodes), len(nodes) + 1, 0.0))
            nodes += [node.left, node.right]
        else:
            rows.append((-1, 0, False, 0, 0, -p.rate * g / (h + p.l2)))
    columns = list(zip(*rows, strict=True))
    kinds = (np.int64, np.int64, bool, np.int64, np.int64, float)
    return Tree(*[np.array(c, k) for c, k in zip(columns, kinds, strict=True)]), nodes


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: BoostParams) -> tuple | None:
    """``(gain, bin, missing_left, left sums)`` of one leaf's histogram of one feature, the missing bin last; the first of equal gains."""
    total = np.array([g.sum(), h.sum(), n.sum()])
    present = np.stack([np.cumsum(x[:-1]) for x in (g, h, n)])
    lost = np.array([[g[-1]], [h[-1]], [n[-1]]])
    found = None
    for missing_left in (False, True) if n[-1] else (False,):
        left = present + lost * missing_left
        right = total[:, None] - left
        ok = (left[2] >= p.min_rows) & (right[2] >= p.min_rows) & (left[1] >= p.min_hessian) & (right[1] >= p.min_hessian)
        gain = np.where(ok, left[0] ** 2 / (left[1] + p.l2) + right[0] ** 2 / (right[1] + p.l2) - total[0] ** 2 / (total[1] + p.l2), -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 0 and (found is None or gain[at] > found[0] + 1e-12):
            found = (float(gain[at]), at, bool(missing_left), left[:, at].tolist())
    return found


@dataclass
class Boosted:
    """``edges[j]``: the upper bounds of feature j's bins but the last."""

    edges: list[np.ndarray]
    baseline: float
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)

    def bin(self, values: np.ndarray) -> np.ndarray:
        out = np.full(values.shape, self.params.bins, np.uint16)
        for j, edges in enumerate(self.edges):
            given = np.isfinite(values[:, j])
            out[given, j] = np.searchsorted(edges, values[given, j], side="left")
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.baseline + sum((t.predict(bins, self.params.bins) for t in self.trees), np.zeros(len(bins)))

    def score(self, df: DataFrame, name: str, features: str = "features") -> DataFrame:
        """``df`` with the probability of 1 by its array of features, whose nulls count as missing."""
        model = self

        @F.pandas_udf("double")
        def scored(column: pd.Series) -> pd.Series:
            values = np.array(column.tolist(), float).reshape(len(column), -1)
            return pd.Series(1 / (1 + np.exp(-model.raw(model.bin(values)))))

        return df.withColumn(name, scored(F.col(features)))


def bin_edges(df: DataFrame, features: str, weight: str, n_features: int, p: BoostParams) -> list[np.ndarray]:
    """Bounds between bins of about equal weight; a feature with at most ``bins`` values has one for each. At most ``bins`` numbers a feature reach the driver."""
    long = df.select(F.col(weight).alias("w"), F.posexplode(features).alias("feature", "value"))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    steps = written(long.where(finite).groupBy("feature", "value").agg(F.sum("w").alias("w")), "steps")
    totals = steps.groupBy("feature").agg(F.sum("w").alias("t"), F.count("*").alias("kinds"))
    few = steps.join(totals.where(F.col("kinds") <= p.bins), "feature").select("feature", "value", "value")
    many = steps.join(totals.where(F.col("kinds") > p.bins).select("feature"), "feature", "left_semi")
    part = F.least(F.floor((F.col("c") - F.col("w") / 2) / F.col("t") * p.bins), F.lit(p.bins - 1))
    cut = running_sums(many, ["feature"], "value", {"c": "w"}).join(totals, "feature").groupBy("feature", part.alias("part"))
    rows = few.toDF("feature", "low", "high").union(cut.agg(F.min("value").alias("low"), F.max("value").alias("high")).select("feature", "low", "high")).collect()
    out = []
    for j in range(n_features):
        own = sorted((r["low"], r["high"]) for r in rows if r["feature"] == j)
        out.append(np.array([(a[1] + b[0]) / 2 for a, b in zip(own, own[1:])]))
    return out


_ROWS = "bins binary, y double, w double, f double"


def _binned(df: DataFrame, features: str, y: str, weight: str, model: Boosted) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                bins = [row.tobytes() for row in model.bin(values)]
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), batch.column(1), batch.column(2), pa.array(np.full(len(batch), model.baseline))], ["bins", "y", "w", "f"])

    return df.select(features, F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).mapInArrow(run, _ROWS)


def _read(batch: pa.RecordBatch, trees: list[Tree], missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(len(batch), -1)
    f = batch.column("f").to_numpy().copy()
    for tree in trees:
        f += tree.predict(bins, missing)
    return bins, batch.column("y").to_numpy(), batch.column("w").to_numpy(), f


def _splits(rows: DataFrame, late: list[Tree], tree: Tree, asked: np.ndarray, p: BoostParams) -> dict[int, tuple]:
    """``{node: (gain, feature, bin, missing_left, left sums, total sums)}`` of the asked nodes of ``tree`` (the root's sums even without a split)."""
    slots = np.full(len(tree.feature), -1)
    slots[asked] = np.arange(len(asked))
    wide = p.bins + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            bins, y, w, f = _read(batch, late, p.bins)
            slot = slots[tree.leaf_of(bins, p.bins)]
            own = np.flatnonzero(slot >= 0)
            q = 1 / (1 + np.exp(-f[own]))
            g, h = w[own] * (q - y[own]), w[own] * q * (1 - q)
            if total is None:
                total = np.zeros((bins.shape[1], 3, len(asked) * wide))
            at = slot[own] * wide
            for j in range(bins.shape[1]):
                key = at + bins[own, j]
                for k, weights in enumerate((g, h, None)):
                    total[j, k] += np.bincount(key, weights, len(asked) * wide)
        if total is not None:
            each = total.reshape(-1, 3, len(asked), wide).transpose(2, 0, 1, 3)
            nodes, features = np.indices(each.shape[:2])
            lists = [pa.array(list(each[:, :, k].reshape(-1, wide)), pa.list_(pa.float64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(asked[nodes.ravel()], pa.int32()), pa.array(features.ravel(), pa.int32()), *lists], ["node", "feature", "g", "h", "n"])

    def best(group: pd.DataFrame) -> pd.DataFrame:
        g, h, n = (np.sum(np.stack(group[c].tolist()), axis=0) for c in ("g", "h", "n"))
        found = best_split(g, h, n, p)
        gain, at, missing_left, left = found or (0.0, 0, False, [0.0, 0.0, 0.0])
        row = (group["node"].iloc[0], group["feature"].iloc[0], gain, at, missing_left, left, [g.sum(), h.sum(), n.sum()])
        return pd.DataFrame([row], columns=["node", "feature", "gain", "bin", "missing_left", "left", "total"])

    histograms = rows.mapInArrow(sums, "node int, feature int, g array<double>, h array<double>, n array<double>")
    found = histograms.groupBy("node", "feature").applyInPandas(
        best, "node int, feature int, gain double, bin int, missing_left boolean, left array<double>, total array<double>"
    )
    out: dict[int, tuple] = {}
    for r in sorted(found.collect(), key=lambda r: (r["node"], r["feature"])):
        if r["node"] not in out or r["gain"] > out[r["node"]][0] + 1e-12:
            out[r["node"]] = (r["gain"], r["feature"], r["bin"], r["missing_left"], tuple(r["left"]), tuple(r["total"]))
    return out


def _next_leaf(root: Node, p: BoostParams) -> Node | None:
    """The leaf of the best gain, while the tree may have more leaves; the first of equal gains."""
    leaves, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.opened:
            stack += [node.right, node.left]
        else:
            leaves.append(node)
    can = [x for x in leaves if x.split is not None]
    return max(can, key=lambda x: x.split[0]) if can and len(leaves) < p.leaves else None


def grow(rows: DataFrame, late: list[Tree], p: BoostParams) -> Tree:
    """One tree on the gradients of ``rows`` after the trees ``late``."""
    root = Node((0.0, 0.0, 0.0))
    _learn(rows, late, root, [root], p)
    while (leaf := _next_leaf(root, p)) is not None:
        if leaf.left is None:
            # Children of every leaf that could be opened are learnt in one pass.
            fresh, stack = [], [root]
            while stack:
                node = stack.pop()
                if node.opened:
                    stack += [node.right, node.left]
                elif node.split is not None and node.left is None:
                    node.left, node.right = Node(node.split[4]), Node(node.split[5])
                    fresh += [node.left, node.right]
            _learn(rows, late, root, fresh, p)
        leaf.opened = True
    return flat(root, p, whole=False)[0]


def _learn(rows: DataFrame, late: list[Tree], root: Node, fresh: list[Node], p: BoostParams) -> None:
    tree, nodes = flat(root, p, whole=True)
    # A node with too few rows for two leaves isn't asked about.
    asked = [i for i, x in enumerate(nodes) if any(x is y for y in fresh) and (x is root or x.sums[2] >= 2 * p.min_rows)]
    if not asked:
        return
    for i, (gain, feature, at, missing_left, left, total) in _splits(rows, late, tree, np.array(asked), p).items():
        nodes[i].sums = total
        if gain > 0:
            nodes[i].split = (gain, feature, at, missing_left, left, tuple(t - x for t, x in zip(total, left, strict=True)))


def fit_boosted(df: DataFrame, features: str = "features", y: str = "y", weight: str = "weight", p: BoostParams = BoostParams()) -> Boosted:
    """The model of ``df``, whose ``features`` is an array of doubles (null, NaN and infinite: missing) of one length.

    The driver holds bin bounds and trees, whose sizes are parameters. Rows are written once binned, and again with
    their scores after each ``rewrite`` trees; a lost task begins again from them. A tree that can't split is a leaf. ``y`` of one class is an error.
    """
    spark = df.sparkSession
    first = df.agg(F.max(F.size(features)), F.sum(F.col(weight) * F.col(y)), F.sum(weight)).first()
    n_features, ones, total = first
    if not total or not 0 < ones < total:
        raise ValueError("boosting needs rows of both classes")
    model = Boosted(bin_edges(df, features, weight, n_features, p), math.log(ones / (total - ones)), p)
    path = scratch_path(spark, "binned")
    _binned(df, features, y, weight, model).write.parquet(path)
    rows = spark.read.schema(_ROWS).parquet(path)
    late: list[Tree] = []
    for _ in range(p.rounds):
        tree = grow(rows, late, p)
        model.trees.append(tree)
        late.append(tree)
        if len(late) >= p.rewrite and len(model.trees) < p.rounds:
            new, old, path = rows.mapInArrow(_scored(late, p.bins), _ROWS), path, scratch_path(spark, "binned")
            new.write.parquet(path)
            remove(spark, old)
            rows, late = spark.read.schema(_ROWS).parquet(path), []
    remove(spark, path)
    return model


def _scored(trees: list[Tree], missing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                f = _read(batch, trees, missing)[3]
                yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), batch.column("w"), pa.array(f)], ["bins", "y", "w", "f"])

    return run
