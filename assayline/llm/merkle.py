"""A manifest of a dataset as a Merkle tree, kept as a content-addressed graph, and proofs found by descent.

Each language has a tree of its documents and the trees' roots have one above them. The store
is a table of records, digest to children's digests. A request names a leaf by language and
rank. All requests descend together: at each height a path looks up its node's record,
the requests' next rank digits pick children, and what isn't picked is collected as a path
segment; a path that several requests share is followed once. Segments are reversed at the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.positions import places
from ..functions.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of the document's fields in a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class ManifestParams:
    """``fan_out`` children a node; ``tamper_every``: ids whose checksum it divides get a changed text in the check."""

    fan_out: int = 8
    tamper_every: int = 3


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(text: Column) -> Column:
    """The digest of a document's fields, each as its bytes' count, ``:`` and its value, or ``-`` if null."""
    fields = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]))


def levels(nodes: DataFrame, p: ManifestParams) -> list[DataFrame]:
    """Tables ``(tree, place, n, digest, children)`` from the parents of ``nodes(tree, place, n, digest)`` upwards.

    ``n`` is how many nodes the tree has at this height; a tree ends where that is one. A parent is
    made from at most ``fan_out`` rows, whatever the size of a tree, and each height is written before the next is made.
    """
    out: list[DataFrame] = []
    while True:
        up = F.floor(F.col("place") / p.fan_out).cast("long")
        runs = (
            nodes.where("n > 1")
            .groupBy("tree", up.alias("place"))
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        )
        children = F.transform("run", lambda x: x["digest"])
        above = runs.select("tree", "place", F.ceil(F.col("n") / p.fan_out).cast("long").alias("n"), children.alias("children"))
        above = written(above.select("tree", "place", "n", digest(F.array_join("children", "")).alias("digest"), "children"), "manifest")
        if above.limit(1).count() == 0:
            return out
        out.append(above)
        nodes = above.drop("children")


def tops(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """``(tree, height, digest)``: each tree's root; a tree of one leaf is that leaf."""
    found = leaves.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    for height, nodes in enumerate(above, 1):
        found = found.union(nodes.where("n = 1").select("tree", F.lit(height), "digest"))
    return found


_PATH = "array<struct<at:int,others:array<string>>>"


def descend(start: DataFrame, store: list[DataFrame], requests: DataFrame, p: ManifestParams) -> DataFrame:
    """``requests(tree, place, ...)`` with ``digest``, the leaf's that is found, and ``path``, its segments from the leaf upwards.

    ``start(tree, height, digest, path)`` are the roots, with the path that led to them, from above downwards;
    ``store[h]`` are the records of nodes of height h + 1. A request for a leaf that isn't there, or
    below a record that is missing, gives no row. Equal digests are one record. A record is looked up once for
    each path that is asked for, so upper nodes, which all requests share, are no hot keys.
    """
    wanted = [requests.select("tree", "place")]
    for _ in store:
        wanted.append(wanted[-1].select("tree", F.floor(F.col("place") / p.fan_out).cast("long").alias("place")).distinct())
        wanted[-1] = written(wanted[-1], "requests")
    at_height = start.select("tree", F.lit(0).cast("long").alias("place"), "height", "digest", F.col("path").cast(_PATH))
    here = at_height.where("false").drop("height")
    for height in range(len(store), 0, -1):
        here = here.union(at_height.where(F.col("height") == height).drop("height"))
        records = store[height - 1].groupBy("digest").agg(F.first("children").alias("children"))
        opened = here.join(records, "digest").select("tree", F.col("place").alias("above"), "path", "children")
        asked = (requests if height == 1 else wanted[height - 1]).withColumn("above", F.floor(F.col("place") / p.fan_out).cast("long"))
        digit = F.pmod("place", F.lit(p.fan_out)).cast("int")
        picked = opened.join(asked, ["tree", "above"]).where(digit < F.size("children"))
        others = F.filter("children", lambda _, i: i != digit)
        segment = F.struct(digit.alias("at"), others.alias("others"))
        kept = [c for c in asked.columns if c not in ("tree", "above", "place")]
        here = picked.select("tree", "place", F.get("children", digit).alias("digest"), F.concat("path", F.array(segment)).cast(_PATH).alias("path"), *kept)
        if height > 1:
            here = written(here, "paths")
    lone = at_height.where("height = 0").drop("height", "place").join(requests.where("place = 0"), "tree")
    found = lone.select("tree", "place", "digest", "path", *[c for c in requests.columns if c not in ("tree", "place")])
    if store:
        found = here.unionByName(found)
    return found.withColumn("path", F.reverse("path"))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def parent(below: Column, segment: Column) -> Column:
        at, others = segment["at"], segment["others"]
        before, after = F.slice(others, F.lit(1), at), F.slice(others, at + 1, F.size(others) - at)
        return digest(F.concat(F.array_join(before, ""), below, F.array_join(after, "")))

    return F.aggregate(path, node, parent)


def manifest(docs: DataFrame, p: ManifestParams = ManifestParams()) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row a row of ``docs``.

    Leaves ascend by doc_id within their language, null ids first; rows of one id are ordered by digest. Null
    languages are a language, the first. ``tampered`` rows lower-case their text; null ids never are tampered
    with. Texts of any length are hashed where they are read, and only digests are moved. Repeated rows are leaves
    of their own. Other columns are ignored. An empty table gives an empty result.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"),
    )
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.tamper_every == 0
    low = F.when(changed, leaf(F.translate("text", _UPPER, _LOWER)))
    hashed = slim.select("lang", "doc_id", leaf(F.col("text")).alias("leaf"), low.alias("tampered"))
    ranked = places(hashed, ["lang"], ["doc_id", "leaf"], "place", of="n")
    langs = places(ranked.select("lang").distinct(), [], ["lang"], "tree", of="langs")
    langs = written(langs, "langs")
    same = ranked["lang"].eqNullSafe(langs["lang"])
    leaves = written(ranked.join(langs, same).select("tree", "place", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"), "leaves")

    store = levels(leaves.select("tree", "place", "n", "digest"), p)
    subroots = written(tops(leaves, store), "subroots")
    # The tree above has the languages' trees as its leaves, at their own numbers.
    whole = F.lit(0).cast("long").alias("tree")
    upper = subroots.join(langs.select("tree", "langs"), "tree").select(whole, F.col("tree").alias("place"), F.col("langs").alias("n"), "digest", "height")
    upper = written(upper, "upper")
    upper_store = levels(upper.select("tree", "place", "n", "digest"), p)
    root = tops(upper, upper_store).withColumn("path", F.array().cast(_PATH))
    starts = descend(root, upper_store, upper.select("tree", "place", "height"), p)
    starts = starts.select(F.col("place").alias("tree"), "height", "digest", F.reverse("path").alias("path"))
    starts = written(starts, "starts")

    found = descend(starts, store, leaves.select("tree", "place", "doc_id", "tampered"), p)
    proof = F.flatten(F.transform("path", lambda s: s["others"]))
    named = found.join(starts.select("tree", F.col("digest").alias("subroot")), "tree").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    return named.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(F.array_join(proof, "")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
