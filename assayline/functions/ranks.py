"""Rank and rounding helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .names import free_names
from .positions import sorted_cells


def average_ranks(df: DataFrame, group: list[str], value: str, out: str, of: str | None = None, cells: int = 64) -> DataFrame:
    """``df`` with ``out``: the rank of ``value`` in its group, ties sharing the mean of their places; ``of``: the group's rows.

    A group is cut into ranges of its values, ties kept whole, so that no task ranks a large group alone: places inside a range are
    added to the number of rows in the ranges before, of which there are ``cells`` at most. Nulls come first.
    """
    cell, n, before = free_names(df, "_cell", "_n", "_before")
    keyed = sorted_cells(df, group, value, cell, cells)
    counted = keyed.groupBy(*group, cell).agg(F.count("*").alias(n))
    upto = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = counted.withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0)))
    if of:
        starts = starts.withColumn(of, F.sum(n).over(W.partitionBy(*group)))
    given = starts.select(*[F.col(c).alias(f"{cell}{i}") for i, c in enumerate([*group, cell])], before, *([of] if of else []))
    same = F.lit(True)
    for i, c in enumerate([*group, cell]):
        same &= F.col(c).eqNullSafe(F.col(f"{cell}{i}"))
    inside = F.rank().over(W.partitionBy(*group, cell).orderBy(value)) + (F.count("*").over(W.partitionBy(*group, cell, value)) - 1) / 2.0
    found = keyed.withColumn(out, inside).join(given, same)
    return found.withColumn(out, F.col(out) + F.col(before)).drop(cell, before, *[f"{cell}{i}" for i in range(len(group) + 1)])


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)
