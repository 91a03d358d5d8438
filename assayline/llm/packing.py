"""Conflict-constrained best-fit packing of documents into fixed windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .mixing import word_count


@dataclass(frozen=True)
class PackParams:
    """``capacity`` in words; ``group_rows`` pieces, on average, are packed by one call in one task."""

    capacity: int = 2048
    group_rows: int = 4096
    seed: int = 7


_PACKED = "doc_id long, piece int, start long, size long, source string, cluster long, bin_id long, slot int, bin_fill long"


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each piece, given largest first.

    Bins are kept in order of their residual. A piece goes to the first bin, from
    the least residual that holds it upwards, whose source and cluster bitmaps have
    neither of its bits; if there's none a bin is opened.
    """
    out = np.empty(len(sizes), np.int64)
    order: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    for i, (size, s, c) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        s_bit, c_bit = 1 << s, 1 << c if c >= 0 else 0
        for at in range(bisect_left(order, (size, -1)), len(order)):
            b = order[at][1]
            if not source_bits[b] & s_bit and not cluster_bits[b] & c_bit:
                left = order.pop(at)[0] - size
                break
        else:
            b, left = len(source_bits), capacity - size
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s_bit
        cluster_bits[b] |= c_bit
        if left:
            insort(order, (left, b))
        out[i] = b
    return out


def _pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sources = pd.factorize(group["source"], use_na_sentinel=False)[0]
        codes, kinds = pd.factorize(group["cluster"])
        often = np.bincount(codes, minlength=len(kinds)) > 1
        # Only clusters found twice in the group can conflict; they alone have a bit.
        bit = np.where(often, np.cumsum(often) - 1, -1)[codes]
        bins = best_fit(group["size"].to_numpy(), sources, bit, capacity)
        group["bin_id"] = group["g"].to_numpy(np.int64) * (1 << 24) + bins
        group["slot"] = group.groupby("bin_id").cumcount().astype("int32")
        group["bin_fill"] = group.groupby("bin_id")["size"].transform("sum")
        return group[["doc_id", "piece", "start", "size", "source", "cluster", "bin_id", "slot", "bin_fill"]]

    return run


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Pieces of ``docs(doc_id, text, source)`` with the bin, and the slot in it, that each goes to.

    A document is cut into pieces of ``capacity`` words and a remainder; a whole
    piece fills a bin alone. Pieces are dealt by a seeded hash into groups of about
    ``group_rows`` and each group is packed largest first. No bin holds two pieces
    of one source or of one duplicate cluster (equal texts). ``start`` is the
    piece's first word in its document.

    Null or blank texts have no words, hence no piece. A null source is a source of
    its own. Rows that repeat are packed each; being of one cluster they never
    share a bin. Hot sources and clusters are spread over all groups by the
    deal. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    p = params
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("n"),
        F.xxhash64("text").alias("cluster"),
    ).where("n > 0")
    cut = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("n") / p.capacity).cast("int") - 1),
        lambda k: F.struct(
            k.alias("piece"),
            (k.cast("long") * p.capacity).alias("start"),
            F.least(F.lit(p.capacity).cast("long"), F.col("n") - k.cast("long") * p.capacity).alias("size"),
        ),
    )
    pieces = sized.withColumn("_p", F.explode(cut)).select("doc_id", "_p.piece", "_p.start", "_p.size", "source", "cluster")
    whole = F.col("size") == p.capacity
    # Documents, which are counted without a look at texts, are about as many as their remainders. Dealing
    # by a hash makes reruns agree; only rows that repeat an id and a text meet in one group.
    groups = max(1, -(-docs.select(F.lit(1)).count() // p.group_rows))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(p.seed), "doc_id", "piece", "cluster", "source"), F.lit(groups)).cast("long"))
    packed = dealt.where(~whole).groupBy("g").applyInPandas(_pack_group(p.capacity), _PACKED)
    # A full piece needs no search: it is a bin, numbered below zero by its group and its place there, so that reruns agree.
    line = F.row_number().over(W.partitionBy("g").orderBy("doc_id", "piece", "source", "cluster"))
    alone = dealt.where(whole).select(
        "doc_id", "piece", "start", "size", "source", "cluster",
        (-F.col("g") * (1 << 32) - line).alias("bin_id"), F.lit(0).alias("slot"), F.col("size").alias("bin_fill"),
    )
    return packed.unionByName(alone)
