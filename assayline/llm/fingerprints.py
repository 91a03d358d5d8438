"""Document fingerprints by threshold-scaled sketches, from DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import free_names


@dataclass(frozen=True)
class FingerprintParams:
    """A shingle's hash is kept if it is among the lowest 1 / ``scale`` of all hashes.

    ``cell_rows``: about how many rows, next to each other by doc_id, meet in one window task.
    """

    shingle_words: int = 5
    scale: int = 8
    cell_rows: int = 1000
    max_cells: int = 65536


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, params: FingerprintParams = FingerprintParams()) -> Column:
    """Sorted distinct hashes of the text's word shingles under the threshold, and always the lowest.

    Words are what white space separates, letters lower-cased. A text of fewer words
    than a shingle is one shingle; one without words, or null, has an empty sketch.
    """
    k = params.shingle_words
    top = (1 << 63) // params.scale - 1
    low = F.lit((1 << 63) - 1)

    def of_words(words: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            at = lambda i, j: F.get(h, i + j)
            full = F.transform(
                F.sequence(F.lit(0), F.size(h) - k),
                lambda i: F.xxhash64(*[at(i, j) for j in range(k)]).bitwiseAND(low),
            )
            hashes = F.when(F.size(h) >= k, full).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(low))).otherwise(
                F.array().cast("array<bigint>")
            )
            return let(
                hashes,
                lambda x: let(F.array_min(x), lambda least: F.array_sort(F.array_distinct(F.filter(x, lambda v: (v <= top) | (v == least))))),
            )

        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(split, of_words)


def as_string(kept: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def resemblance(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches of one scale; 1 if both are empty."""
    return let(
        F.size(F.array_intersect(a, b)).cast("double"),
        lambda i: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(i / (F.size(a) + F.size(b) - i)),
    )


def containment(a: Column, b: Column) -> Column:
    """The part of ``a``'s hashes that ``b`` holds: also for a ``b`` that is far longer; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def _edges(edges: list[int], width: int = 256) -> list[list[int]]:
    """Sorted edges in groups, as data of one row: a plan doesn't grow with their number."""
    return [edges[i : i + width] for i in range(0, len(edges), width)]


def _rank(value: Column, groups: Column, width: int = 256) -> Column:
    """How many of the grouped edges are below ``value``: first of every group's first edge, then of those of one group."""
    below = let(
        F.size(F.filter(groups, lambda g: F.get(g, F.lit(0)) < value)),
        lambda k: F.when(k == 0, 0).otherwise((k - 1) * width + F.size(F.filter(F.get(groups, k - 1), lambda e: e < value))),
    )
    return below.cast("long")


def with_next(docs: DataFrame, columns: list[str], params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """``docs`` with ``next_<c>`` of the row that follows in descending doc_id, and the first after the last.

    Rows are ordered by doc_id, a hash of the text and the text, and cut into cells of about
    as many rows each: at quantiles of the ids, and an id that has very many
    rows (or null, which comes last) is cut by ranges of the hash. So neither sparse ids nor repeated ones fill a cell,
    but for rows that agree in id and text. Each cell's rows meet in a window; the
    highest row of a cell is also sent to the next cell above that has rows, whose
    lowest row it follows. Ids are compared, not calculated with, so any will do;
    columns of ``docs`` keep their names and values.
    """
    cell, tie, guest, top, to, heavy, slot, edge = free_names(docs, "_cell", "_tie", "_guest", "_top", "_to", "_heavy", "_slot", "_edge")
    known = F.col("doc_id").isNotNull()
    n = docs.select(F.lit(1)).count()
    cells = max(1, min(params.max_cells, n // params.cell_rows))
    edges: list[int] = []
    if cells > 1:
        # One literal, however many quantiles.
        quantiles = F.split(F.lit(",".join(repr(i / cells) for i in range(1, cells))), ",").cast("array<double>")
        found = docs.agg(F.percentile_approx("doc_id", quantiles, 8 * cells).alias("e")).first()["e"]
        edges = sorted(set(found or []))
    bounds = docs.sparkSession.createDataFrame([(_edges(edges),)], f"`{edge}` array<array<long>>")
    # One row, of at most ``max_cells`` numbers.
    placed = docs.withColumn(tie, F.xxhash64("text")).crossJoin(F.broadcast(bounds))
    placed = placed.withColumn(cell, F.when(known, _rank(F.col("doc_id"), F.col(edge))).otherwise(F.lit(-1))).drop(edge)
    most = 4 * max(params.cell_rows, n // cells)
    full = placed.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") > most)
    # Ids with that many rows: at most a quarter as many as there are cells, so all of this is fit to be sent out.
    many = placed.join(F.broadcast(full.select(cell)), cell, "left_semi").groupBy(cell, "doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    split = many.groupBy(cell).agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.ceil(F.col("n") * 4 / most).alias("parts"))).alias(heavy))
    placed = placed.join(F.broadcast(split), cell, "left")
    # Below an id with many rows, at it, above it: three cells in order.
    under = F.size(F.filter(heavy, lambda x: x["id"] < F.col("doc_id")))
    parts = F.get(F.filter(heavy, lambda x: x["id"].eqNullSafe(F.col("doc_id"))), F.lit(0))["parts"]
    at = F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * parts)
    none = F.lit(0).cast("long")
    own = F.struct(
        F.col(cell).cast("long").alias("rank"),
        F.when(F.col(heavy).isNull(), none).otherwise(2 * under + parts.isNotNull().cast("int")).cast("long").alias("step"),
        F.coalesce(at, none).cast("long").alias("part"),
    )
    keyed = placed.withColumn(cell, own).withColumn(slot, F.struct(known.alias("known"), F.col("doc_id").alias("id"), F.col(tie).alias("tie")))
    order = W.orderBy(cell)
    tops = keyed.groupBy(cell).agg(F.max(slot).alias(top))
    around = tops.select(cell, top, F.coalesce(F.lead(cell).over(order), F.first(cell).over(order)).alias(to))
    # A few rows of numbers for each cell.
    marked = keyed.join(F.broadcast(around), cell)
    stays = F.struct(F.col(cell).alias("c"), F.lit(False).alias("g"))
    goes = F.struct(F.col(to).alias("c"), F.lit(True).alias("g"))
    copies = F.when(F.col(slot).eqNullSafe(F.col(top)), F.array(stays, goes)).otherwise(F.array(stays))
    spread = marked.drop(heavy).withColumn(heavy, F.explode(copies)).withColumn(cell, F.col(f"{heavy}.c")).withColumn(guest, F.col(f"{heavy}.g"))
    # A guest stands after the cell's own rows; of guests that tie the first in the same order is looked at.
    down = W.partitionBy(cell).orderBy(F.col(guest), F.col(slot).desc(), F.col("text").desc())
    with_lead = spread.select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in columns])
    return with_lead.where(~F.col(guest)).drop(cell, tie, guest, top, to, heavy, slot)


def half_edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many code points, or all, of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)`` and of its half-edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (``resemblance``), in_edited and in_next
    (``containment``). A null text counts as empty. Empty texts have an empty
    fingerprint, alike only to another. The row that follows is the one of the next
    lower doc_id (``with_next``); a lone row follows itself. Repeated rows follow
    each other. An empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = slim.withColumn("kept", sketch(F.col("text"), params))
    paired = with_next(own, ["text", "kept"], params)
    edited = paired.withColumn("edited", half_edited(F.col("text"), F.col("next_text"))).withColumn("kept_edited", sketch(F.col("edited"), params))
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("kept")).alias("fingerprint"),
        as_string(F.col("kept_edited")).alias("edited_fingerprint"),
        resemblance(F.col("kept"), F.col("kept_edited")).alias("near_edited"),
        resemblance(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("kept"), F.col("kept_edited")).alias("in_edited"),
        containment(F.col("kept"), F.col("next_kept")).alias("in_next"),
    )
