"""Quality rules per document, and verdicts per host from shrunken failure rates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import free_names
from ..functions.scratch import written
from . import _bytes as B


@dataclass(frozen=True)
class HostRuleParams:
    """Base rule limits, and the shrunken failure rate from which on a host is turned down."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.5


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """The values found twice or more, sorted."""
    keys = np.sort(keys)
    return B.distinct(keys[1:][keys[1:] == keys[:-1]])


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(keys), bool)
    return values[np.minimum(np.searchsorted(values, keys), len(values) - 1)] == keys


def text_counts(raw: np.ndarray, offsets: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """The arrays named in COUNTS, a value per row."""
    n = len(offsets) - 1
    start, end, rows = B.spans(raw, offsets, B.SPACE)
    head = np.uint64(52)
    hashes, first = B.window_hashes(B.span_hashes(raw, start, end), rows, n, window)
    keys = (rows[first].astype(np.uint64) << head) | (hashes >> np.uint64(12))
    inside = np.zeros(len(start) + 1, np.int32)
    found = first[_among(keys, _repeated(keys))]
    np.add.at(inside, found, 1)
    np.add.at(inside, found + window, -1)
    covered = np.cumsum(inside[:-1]) > 0

    ls, le, lrows = B.spans(raw, offsets, _NEWLINE)
    solid = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~B.SPACE[raw], out=solid[1:])
    worded = solid[le] > solid[ls]
    ls, le, lrows = ls[worded], le[worded], lrows[worded]
    lines = (lrows.astype(np.uint64) << head) | (B.span_hashes(raw, ls, le) >> np.uint64(12))
    kinds = B.distinct(lines)
    per_row = np.bincount(lrows, minlength=n) - np.bincount((kinds >> head).astype(np.int64), minlength=n)
    return [
        np.bincount(rows, minlength=n),
        B.count_per_row(~B.SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
        B.count_per_row(_SYMBOL[raw], offsets),
        per_row,
        np.bincount(rows[covered], minlength=n),
    ]


_RULES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def rules(text: Column, params: HostRuleParams = HostRuleParams()) -> Column:
    """A struct of COUNTS; a null text counts as none."""
    p = params

    def count(texts: pa.Array) -> pa.Array:
        found = [text_counts(*B.utf8(piece), p.window) for piece in B.pieces(texts)]
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(COUNTS))]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)

    return F.arrow_udf(count, _RULES)(text)


def failed(counts: str, params: HostRuleParams = HostRuleParams()) -> Column:
    """Whether the document whose COUNTS are in the struct ``counts`` fails by itself."""
    words, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < params.min_words) | (repeated * 100 > words * params.repeat_percent)


def host_verdicts(judged: DataFrame, params: HostRuleParams = HostRuleParams()) -> DataFrame:
    """``(source, docs, failed, rate, host_ok)`` from ``judged(source, base_failed)``.

    The beta prior is fitted to the hosts by moments: mean m and variance v of the
    hosts' rates give a strength m(1-m)/v - 1, held to 1 to 1000 documents (the
    upper end also where all rates agree); m is taken over all documents. A host's rate
    is then (failed + m * strength) / (docs + strength). A null source is a host.
    """
    hosts = judged.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    prior = hosts.agg(
        F.sum("docs").alias("docs"), F.sum("failed").alias("failed"), F.var_pop(F.col("failed") / F.col("docs")).alias("v")
    ).first()  # three numbers
    m = prior["failed"] / prior["docs"] if prior["docs"] else 0.0
    strength = min(1000.0, max(1.0, m * (1 - m) / prior["v"] - 1)) if prior["v"] else 1000.0
    return (
        hosts.withColumn("rate", (F.col("failed") + F.lit(m * strength)) / (F.col("docs") + F.lit(strength)))
        .withColumn("host_ok", F.col("rate") <= params.max_host_rate)
        .select("source", "docs", "failed", "rate", "host_ok")
    )


def host_rules(docs: DataFrame, params: HostRuleParams = HostRuleParams()) -> DataFrame:
    """``(doc_id, COUNTS, base_failed, host_rate, kept)`` for each row of ``docs(doc_id, text, source)``.

    A document fails with fewer than ``min_words`` words, or if more than
    ``repeat_percent`` of its words stand in five-word windows found twice or more
    in it. Failures are summed by host before any shuffle; verdicts come back by a
    join on the host, which AQE splits where one host holds much of the table. A
    document is kept if neither it nor its host fails. Empty or null text: no
    words, so it fails. Null source: a host of its own. Repeated rows are judged
    each. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    counted = docs.select("doc_id", "source", rules(F.col("text"), params).alias("counts"))
    judged = written(counted.select("doc_id", "source", "counts", failed("counts", params).alias("base_failed")), "rules")
    found = with_host(judged, host_verdicts(judged, params), "host")
    return found.select(
        "doc_id", *[F.col("counts")[c].alias(c) for c in COUNTS], "base_failed", F.col("host.rate").alias("host_rate"),
        (~F.col("base_failed") & F.col("host.host_ok")).alias("kept"),
    )


def with_host(rows: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``, the struct ``(rate, host_ok)`` of their source; null sources meet each other."""
    (key,) = free_names(rows, "_host_key")
    of = verdicts.select(F.col("source").alias(key), F.struct("rate", "host_ok").alias(name))
    return rows.join(of, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)


def drop_low_quality(docs: DataFrame, params: HostRuleParams = HostRuleParams()) -> DataFrame:
    """``docs`` without the rows that fail or whose host is turned down; all columns stay as they are.

    Texts are counted twice, for the hosts and for the documents, as that is
    cheaper than moving them.
    """
    counts, host = free_names(docs, "_counts", "_host")
    slim = docs.select("source", rules(F.col("text"), params).alias("counts"))
    verdicts = written(host_verdicts(slim.select("source", failed("counts", params).alias("base_failed")), params), "hosts")
    judged = with_host(docs.withColumn(counts, rules(F.col("text"), params)), verdicts, host)
    return judged.where(~failed(counts, params) & F.col(f"{host}.host_ok")).select(*[F.col(f"`{c}`") for c in docs.columns])
