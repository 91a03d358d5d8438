"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.graph import connected_components
from ..functions.names import free_names
from ..functions.scratch import written
from . import _bytes as B


@dataclass(frozen=True)
class NearDupParams:
    """128 coordinates in 32 bands of 4: a pair of Jaccard 0.75 shares no band in 5 cases of a million.

    ``sketch_floor``: pairs whose 128 one-byte coordinates estimate less are not
    verified; 0.55 stands five standard deviations under 0.75. ``block``: members
    of a bucket that one task compares with as many others.
    """

    shingle_words: int = 5
    bands: int = 32
    rows: int = 4
    percent: int = 75
    sketch_floor: float = 0.55
    block: int = 512


_U32 = np.uint32


def _sigma(keys: np.ndarray) -> np.ndarray:
    """The first permutation: a shingle's place in a universe of 2**32."""
    return (B.mix64(keys & np.uint64((1 << 52) - 1)) >> np.uint64(32)).astype(_U32)


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, a bijection on 32 bits."""
    x = x * _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    return x


def signatures(keys: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """``n`` rows by ``coordinates``: coordinate k is the least of pi(sigma(shingle) + k), pi shifted circularly by k."""
    rows = (keys >> np.uint64(52)).astype(np.int64)
    bounds = B.row_bounds(rows, n)
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((n, coordinates), _U32(0xFFFFFFFF))
    if len(full):
        place, first = _sigma(keys), bounds[:-1][full]
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(_pi(place + _U32(k)), first)
    return out


_PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _profiles(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch):
                n = len(piece)
                keys = B.shingle_keys(*B.utf8(piece.column("text")), p.shingle_words)
                bounds = B.row_bounds((keys >> np.uint64(52)).astype(np.int64), n)
                size = np.diff(bounds)
                bare = keys & np.uint64((1 << 52) - 1)
                sums = []
                for salt in (0x51ED270B1F2A5C3D, 0x0B5AD4ECEDA1CE2A):
                    total = np.zeros(len(keys) + 1, np.uint64)
                    np.cumsum(B.mix64(bare ^ np.uint64(salt)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                sig = signatures(keys, n, p.bands * p.rows)
                band = np.arange(1, p.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(p.rows):
                    band = B.mix64(band ^ sig[:, r :: p.rows].astype(np.uint64))
                some = size > 0
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum(some * p.bands, out=offsets[1:])
                low = np.ascontiguousarray((sig & _U32(0xFF)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(offsets, pa.array(band[some].ravel().view(np.int64))),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return run


def _sets(p: NearDupParams):
    """``(rep, shingles)`` of ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch):
                keys = B.shingle_keys(*B.utf8(piece.column("text")), p.shingle_words)
                bounds = B.row_bounds((keys >> np.uint64(52)).astype(np.int64), len(piece)).astype(np.int32)
                bare = (keys & np.uint64((1 << 52) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(bare))],
                    ["rep", "shingles"],
                )

    return run


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard as estimated from two columns of one-byte coordinates."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) * (256 / 255))


def _promising(pairs: DataFrame, reps: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs whose set sizes and sketches allow the asked similarity."""
    narrow = reps.select("rep", "n_shingles", "sketch")
    both = pairs.join(narrow.toDF("a", "_na", "_sa"), "a").join(narrow.toDF("b", "_nb", "_sb"), "b")
    sized = both.where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * p.percent)
    return sized.where(_alike("_sa", "_sb") >= p.sketch_floor).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    both = pairs.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("i"), (F.size("_x") + F.size("_y")).alias("t"))
    return shared.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * p.percent).select("a", "b")


def _shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of each other set's members the sorted set ``one`` holds."""
    ends = np.cumsum([len(o) for o in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[ends - [len(o) for o in others]]


def _pairs_ahead(group: pd.DataFrame, p: NearDupParams):
    """Yields each row of the first block, as a tuple, and which rows of the second may be linked with it by size and sketch.

    Members of the bucket's largest component are never asked about each other. ``answer`` of the
    yield joins components for the rest of the call.
    """
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left = group[group["own"] == i]
    right = group[group["own"] == j].reset_index(drop=True)
    sketches = np.frombuffer(b"".join(right["sketch"]), np.uint8).reshape(len(right), -1)
    ids, sizes, roots = right["rep"].to_numpy(), right["n_shingles"].to_numpy(), right["component"].to_numpy().copy()
    floor = p.sketch_floor * (255 / 256) + 1 / 256
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    for k, (rep, comp, size, sketch) in enumerate(zip(left["rep"], left["component"], left["n_shingles"], left["sketch"], strict=True)):
        mine = root(comp)
        open_ = (roots != mine) & (np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * p.percent)
        if i == j:
            open_ &= ids > rep
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        alike = (sketches[at] == np.frombuffer(sketch, np.uint8)).mean(axis=1)
        order = np.argsort(-alike, kind="stable")
        yield k, rep, size, mine, at[order][alike[order] >= floor], ids, sizes, roots, joined


def _survivors(p: NearDupParams):
    """Of one bucket's members in two blocks, those that size and sketch leave a partner of another component."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keep: set[int] = set()
        for _, rep, _, _, at, ids, *_ in _pairs_ahead(group, p):
            if len(at):
                keep.add(int(rep))
                keep.update(ids[at].tolist())
        found = group[group["rep"].isin(keep)]
        return found[["key", "i", "j", "rep", "component", "n_shingles", "own"]]

    return run


def _across(p: NearDupParams):
    """Verified links that join different components, within one bucket's members of two blocks.

    Pairs of one component are skipped, and each link found joins its two for the rest of the call.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        mine_sets = group[group["own"] == i]["shingles"].tolist()
        sets = group[group["own"] == j]["shingles"].tolist()
        out: list[tuple[int, int]] = []
        for k, rep, size, mine, at, ids, sizes, roots, joined in _pairs_ahead(group, p):
            # First the most alike member of each component, then whatever is still apart.
            best = np.zeros(len(at), bool)
            best[np.unique(roots[at], return_index=True)[1]] = True
            for some in (best, ~best):
                check = at[some]
                check = check[roots[check] != mine]
                if not len(check):
                    continue
                shared = _shared_counts(mine_sets[k], [sets[x] for x in check])
                for x in check[shared * 100 >= (size + sizes[check] - shared) * p.percent]:
                    if roots[x] != mine:
                        out.append((min(rep, ids[x]), max(rep, ids[x])))
                        lost = int(roots[x])
                        joined[lost] = int(mine)
                        roots[roots == lost] = mine
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _one_of_equals(standing: DataFrame) -> DataFrame:
    """The keys of ``standing(key, rep, component, members)`` that hold several components; of buckets with the same members one.

    Buckets are taken for equal by their number of members and two sums of hashes, and
    then member by member against the one that stays.
    """
    open_keys = standing.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("members").alias("members"),
        F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("also"),
    ).where("lo <> hi")
    open_keys = written(open_keys, "open")
    alike = ["members", "who", "also"]
    stays = open_keys.groupBy(*alike).agg(F.min("key").alias("stays"), F.count("*").alias("same"))
    twins = open_keys.join(stays.where("same > 1"), alike).where("key <> stays").select("key", "stays", "members")
    there = standing.select("rep", F.col("key").alias("stays")).join(stays.where("same > 1").select("stays"), "stays", "left_semi")
    met = standing.join(twins.drop("members"), "key").select("key", "stays", "rep").join(there, ["stays", "rep"]).groupBy("key").agg(F.count("*").alias("met"))
    equal = met.join(twins, "key").where("met = members").select("key")
    return open_keys.select("key", "members").join(equal, "key", "left_anti")


def _placed(standing: DataFrame, keys: DataFrame, reps: DataFrame, p: NearDupParams) -> DataFrame:
    """Members of the open buckets, with sketches, once for each pair of blocks that they meet in.

    A bucket's largest component and its other members have blocks of their own; the former, numbered
    below zero, only meet the latter's, so a hot group is read as often as its rest has blocks.
    """
    # Counted before the join, so that a bucket with very many members is no hot key of it.
    sizes = standing.groupBy("key", "component").agg(F.count("*").alias("n")).join(keys.select("key"), "key")
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("all"))
    blocks = largest.select(
        "key", F.col("big.component").alias("hub"), F.ceil(F.col("big.n") / p.block).cast("int").alias("hubs"),
        F.ceil((F.col("all") - F.col("big.n")) / p.block).cast("int").alias("rest"),
    )
    in_hub = F.col("component") == F.col("hub")
    own = F.when(in_hub, -1 - F.pmod(F.xxhash64("rep"), F.col("hubs"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.col("rest") - 1)
    hubs = F.transform(F.sequence(F.lit(1), F.col("hubs")), lambda x: -x)
    # Written, so that in the next join a bucket with very many members can be split.
    blocks = written(blocks, "blocks")
    return (
        standing.join(blocks, "key").join(reps.select("rep", "n_shingles", "sketch"), "rep")
        .withColumn("own", own)
        .withColumn("with", F.explode(F.when(in_hub, others).otherwise(F.concat(others, hubs))))
        .select("key", "rep", "component", "n_shingles", "sketch", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    )


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Rows with equal shingle sets become one representative (the least doc_id). A
    signature of ``bands * rows`` coordinates comes from two permutations: each
    shingle is placed by the first, and coordinate k is its least image under the
    second shifted circularly by k. Representatives that share a band are
    candidates. First each is verified, on full sets, with the least member and
    with one drawn member of its buckets, and buckets of two with their pair; then
    larger buckets that still hold several components are searched, in blocks of
    bounded size, for links between them, so that no link is lost and no large group
    is written out pair by pair. Blocks compare sizes and sketches; full sets are sent only
    where these leave a pair open.

    Null or blank text: no shingles, linked with nothing. Null doc_id: never
    linked, kept. A doc_id is one node: rows that repeat it with other texts link all
    that any of these texts is linked with, and all get its component. An empty
    table gives an empty result; further columns are ignored.
    """
    p = params
    slim = docs.select("doc_id", "text")
    profiles = written(slim.mapInArrow(_profiles(p), _PROFILE), "profiles")
    linkable = profiles.where("n_shingles > 0 and doc_id is not null")
    sets_key = ["set_a", "set_b", "n_shingles"]
    groups = linkable.groupBy(*sets_key).agg(F.min("doc_id").alias("rep"))
    reps = written(
        linkable.join(groups.withColumnRenamed("rep", "doc_id"), ["doc_id", *sets_key], "left_semi")
        .withColumnRenamed("doc_id", "rep")
        .dropDuplicates(["rep", *sets_key]),
        "representatives",
    )

    banded = reps.select("rep", F.explode("bands").alias("key"))
    # A member drawn by the bucket's key: the least id after its bits are flipped by the key.
    mask = F.col("key").bitwiseAND(F.lit((1 << 62) - 1))
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.min(F.col("rep").bitwiseXOR(mask)).alias("drawn"))
        .where("members > 1")
        .withColumn("drawn", F.col("drawn").bitwiseXOR(mask))
    )
    buckets = written(buckets, "buckets")
    # Stars are drawn per member, not per bucket, so a bucket of two gives its pair itself.
    twos = buckets.where("members = 2 and least < most").select(F.col("least").alias("a"), F.col("most").alias("b"))
    members = written(banded.join(buckets.drop("most"), "key"), "members")

    hubs = members.groupBy("rep").agg(F.min("least").alias("least"), F.min(F.struct(F.xxhash64("drawn"), "drawn")).alias("other"))
    stars = (
        hubs.select("rep", F.explode(F.array("least", "other.drawn")).alias("hub"))
        .where("rep <> hub")
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .union(twos)
        .distinct()
    )
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    in_buckets = slim.join(wanted, "doc_id", "left_semi")
    sets = written(in_buckets.mapInArrow(_sets(p), "rep long, shingles array<long>"), "sets")
    # An id that repeats with other texts is one node: its texts' representatives are linked.
    texts = linkable.groupBy("doc_id").agg(F.min(F.struct(*sets_key)).alias("x"), F.max(F.struct(*sets_key)).alias("y")).where("x <> y")
    again = linkable.join(texts.select("doc_id"), "doc_id", "left_semi").join(groups, sets_key).groupBy("doc_id")
    same_id = again.agg(F.collect_set("rep").alias("reps")).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    links = written(_verified(_promising(stars, reps, p), sets, p).union(same_id), "links")
    first = connected_components(links)

    # A bucket of two was settled by its pair; equal buckets of several bands count once.
    standing = members.where("members > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    standing = written(standing.select("key", "rep", "members", F.coalesce("component", "rep").alias("component")), "standing")
    placed = _placed(standing, _one_of_equals(standing), reps, p)
    # Sketches go to the blocks; full sets only to those members of a block that sketches leave a partner.
    left = written(
        placed.groupBy("key", "i", "j").applyInPandas(_survivors(p), "key long, i int, j int, rep long, component long, n_shingles long, own int"), "survivors"
    )
    with_sets = left.join(reps.select("rep", "sketch"), "rep").join(sets, "rep")
    more = written(with_sets.groupBy("key", "i", "j").applyInPandas(_across(p), "a long, b long").distinct(), "links")
    components = connected_components(links.union(more)) if not more.isEmpty() else first

    named = (
        groups.join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*sets_key, F.coalesce("component", "rep").alias("_component"))
    )
    return (
        profiles.select("doc_id", *sets_key)
        .join(named, sets_key, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that of its least doc_id, with all columns as they are.

    Of rows that repeat this doc_id the one with the least text stays, and of those that repeat the text
    too the one with the least hash of its columns. Rows with a null doc_id all stay.
    """
    found = near_duplicates(docs, params).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = written(found, "kept")
    once, often = (ids.where(w).select("doc_id") for w in ("n = 1", "n > 1"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    nameless = docs.where(F.col("doc_id").isNull())
    single = docs.join(once, "doc_id", "left_semi").select(*names)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*names), F.struct(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(*hashed).alias("h")))
    (row,) = free_names(docs, "_row")
    chosen = docs.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias(row)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return single.unionByName(chosen).unionByName(nameless.select(*names))
