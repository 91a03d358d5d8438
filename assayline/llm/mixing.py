"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import free_names
from ..functions.positions import running_start
from ..functions.scratch import written


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code point order, null last.

    ``blocks`` bounds how many blocks the whole mix is cut into (and with them the
    tree's numbers on the driver); up to ``sent_sources`` sources their table is sent out, above that it is joined by shuffle.
    A source's rows are ordered in at least ``cells`` ranges, and in as many as leave about ``cell_words`` words to each.
    """

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    shards: int = 64
    blocks: int = 100_000
    block_words: int = 10_000
    sent_sources: int = 10_000
    cells: int = 256
    cell_words: int = 1 << 24
    seed: int = 20


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """Shares of the total by weight; above ``max_repeats`` times its size a source stops and the rest is shared anew."""
    goal = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > max_repeats * sizes[i]]
        if not over:
            for i in free:
                goal[i] = unit * weights[i]
            break
        for i in over:
            goal[i] = float(max_repeats * sizes[i])
            left -= goal[i]
        stopped = set(over)
        free = [i for i in free if i not in stopped]
    return goal


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``shards`` by sources: how many blocks of each source a shard draws.

    A node shares its quotas between its halves: the left half's number of blocks
    is fixed by how many shards it has, and which sources they come from is one
    multivariate hypergeometric draw. Shards so differ by one block at most.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(sum(quotas))
    edge = [total * s // shards for s in range(shards + 1)]

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, edge[mid] - edge[lo], method="marginals")
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.array(quotas, np.int64))
    return out


@dataclass(frozen=True)
class _Names:
    """Inner columns, named as no column of the input is."""

    source: str
    r: str
    passes: str
    upto: str
    pos: str
    rest: str
    fill: str
    named: str
    key: str
    shift: str


def _is_long(rest: Column) -> Column:
    return F.col("size") * 16 > rest


def _fillers(narrow: DataFrame, n: _Names, send, cells: int) -> DataFrame:
    """``(source, shift, fill)``: of each source, the words of long rows that don't fit, and where the one row past the last
    that fits stands whose size best fills what is left. Repeated rows stand in places of their own, so that is one of them."""
    placed = written(running_start(narrow, [n.source], n.r, [n.key], "size", n.pos, cells), "positions")
    size, end, rest = F.col("size"), F.col(n.pos) + F.col("size"), F.col(n.rest)
    long_ = _is_long(rest)
    shifts = placed.groupBy(n.source).agg(F.coalesce(F.sum(F.when(long_ & (end > rest), size)), F.lit(0)).alias(n.shift))
    shifted = placed.join(send(shifts), n.source)
    fits = F.when(long_, end).otherwise(end - F.col(n.shift)) <= rest
    gaps = shifted.groupBy(n.source).agg((F.first(n.rest) - F.coalesce(F.sum(F.when(fits, size)), F.lit(0))).alias("gap"))
    off = F.abs(F.col("gap") - size)
    past = shifted.where(~fits & (size > 0)).join(send(gaps), n.source).where(off < F.col("gap"))
    best = past.groupBy(n.source).agg(F.min(F.struct(off.alias("off"), F.col(n.r).alias("r"), F.col(n.pos).alias("pos"))).alias("best"))
    return shifts.join(best, n.source, "left").select(n.source, n.shift, F.struct("best.r", "best.pos").alias(n.fill))


def mix_plan(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: what the mix takes of each row.

    Sizes are words. Each source's rows are permuted by a seeded hash; as many
    whole passes as the target holds, then rows from the front of the permutation
    as long as they fit, and then the one further row that best fills what is left,
    are laid end to end and cut into blocks. Rows longer than a sixteenth of what the last pass
    takes stand first, and the short ones go on from the last of them that fits, so that no long row ends that pass early. The splitting tree says how many blocks of each source a shard
    draws; shards draw disjoint runs of the permuted blocks. ``copies`` holds a
    ``(epoch, shard, place)`` for each time a row is taken; sorting a shard by
    ``place`` shuffles it.

    Null or blank texts have size 0 and are never taken. A null source is a source
    of its own. Rows that repeat a doc_id and text stand one after the other in the
    permutation and each count. Very long texts are taken whole. Columns of ``docs`` named size, source_size, target or copies are
    replaced; all others stay, whatever their names. An empty table gives an empty result. The
    driver holds a few numbers, and one for each shard, of each source. Rerun on the same rows it gives the same mix.
    """
    p = params
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    n = _Names(*free_names(docs, "_source", "_r", "_passes", "_upto", "_pos", "_rest", "_fill", "_named", "_key", "_shift"))
    sized = base.withColumn("size", word_count(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in sums]
    weights = [p.weights[i % len(p.weights)] for i in range(len(sums))]
    goal = targets(sizes, weights, p.max_repeats)
    block = max(p.block_words, -(-sum(sizes) // p.blocks))
    tree = splitting_tree([int(-(-g // block)) for g in goal], p.shards, p.seed)
    upto = tree.cumsum(axis=0).T  # of each source: blocks drawn by this shard and those before
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [
            (i, r["source"], int(n_), float(g), int(g // n_) if n_ else 0, [int(x) for x in u])
            for i, (r, n_, g, u) in enumerate(zip(sums, sizes, goal, upto, strict=True))
        ],
        f"`{n.source}` int, `{n.named}` string, source_size long, target double, `{n.passes}` int, `{n.upto}` array<long>",
    )
    send = F.broadcast if len(sums) <= p.sent_sources else lambda table: table  # a few hundred bytes a source
    rest = F.col("target") - F.col(n.passes) * F.col("source_size")
    word_hash = F.xxhash64(F.lit(p.seed), "doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    late = F.when(_is_long(rest), F.lit(0)).otherwise(F.lit(1 << 62))
    placed = (
        sized.join(send(known), F.col("source").eqNullSafe(F.col(n.named))).drop(n.named)
        .withColumn(n.r, (word_hash + late).cast("long")).withColumn(n.key, F.col("doc_id"))
    )
    end = F.col(n.pos) + F.col("size")
    fits = F.when(_is_long(rest), end).otherwise(end - F.col(n.shift)) <= rest
    cells = max(p.cells, -(-max(sizes, default=0) // p.cell_words))
    fill = _fillers(placed.select(n.source, n.r, n.key, "size", rest.alias(n.rest)), n, send, cells)
    placed = running_start(placed, [n.source], n.r, [n.key], "size", n.pos, cells).join(send(fill), n.source, "left")
    filler = (F.col(n.r) == F.col(f"{n.fill}.r")) & (F.col(n.pos) == F.col(f"{n.fill}.pos"))
    once_more = fits | F.coalesce(filler, F.lit(False))
    n_copies = F.when(F.col("size") > 0, F.col(n.passes) + once_more.cast("int")).otherwise(0)

    def copy(epoch: Column) -> Column:
        at = F.floor((epoch * F.col("source_size") + F.col(n.pos)) / F.lit(block))
        last = F.element_at(n.upto, -1) - 1
        shard = F.size(F.filter(n.upto, lambda u: u <= F.least(at, last)))
        return F.struct(
            epoch.cast("int").alias("epoch"),
            shard.cast("int").alias("shard"),
            F.xxhash64(F.lit(p.seed + 1), F.col(n.key), epoch, F.col(n.r), F.col(n.pos)).alias("place"),
        )

    epochs = F.slice(F.array(*[F.lit(e).cast("long") for e in range(p.max_repeats + 1)]), 1, n_copies)
    plan = placed.withColumn("copies", F.transform(epochs, copy))
    return plan.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", "copies")


def taken_rows(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs``' rows as often as the mix takes them, with all their columns as they were."""
    inner = free_names(docs, "size", "source_size", "target", "copies")
    names = dict(zip(("size", "source_size", "target", "copies"), inner, strict=True))
    stand_in = {c: new for c in docs.columns for old, new in names.items() if c.lower() == old}
    plan = mix_plan(docs.withColumnsRenamed(stand_in), params)
    (copy,) = free_names(plan, "_copy")
    return plan.withColumn(copy, F.explode("copies")).select(*[F.col(f"`{stand_in.get(c, c)}`").alias(c) for c in docs.columns])


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs``' rows as often as the mix takes them, with ``shard`` and ``place`` (see ``mix_plan``)."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "place")]
    plan = mix_plan(docs.select(*[F.col(f"`{c}`") for c in kept]), params)
    (copy,) = free_names(plan, "_copy")
    names = [F.col(f"`{c}`") for c in kept if c in plan.columns]
    return plan.withColumn(copy, F.explode("copies")).select(*names, F.col(f"{copy}.shard").alias("shard"), F.col(f"{copy}.place").alias("place"))


def write_mix(mixed: DataFrame, path: str, params: MixParams = MixParams()) -> None:
    """Each shard as a folder of Parquet files, sorted by ``place``; a shard may span several tasks."""
    mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
