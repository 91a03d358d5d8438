"""Running totals over a very large ordered group, without one task holding the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .names import free_names
from .scratch import joinable, written


def running_start(
    df: DataFrame, group: list[str], order: str, ties: list[str | Column], weight: str | Column, out: str, cells: int = 256
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over rows that stand before this one in its group.

    ``order`` holds uniform 63-bit numbers. The group is cut into ``cells`` equal
    ranges of ``order``; sums per cell are added up in a small table (``cells``
    rows a group) and only rows of one cell are sorted together. Columns of ``group``
    hold no nulls. Inner columns take names that ``df`` doesn't have.
    """
    cell, start, inner, total = free_names(df, "_cell", "_start", "_in", "_sum")
    width = (1 << 63) // cells
    keyed = df.withColumn(cell, F.floor(F.col(order) / F.lit(width)).cast("int"))
    sums = keyed.groupBy(*group, cell).agg(F.sum(weight).alias(total))
    before = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn(start, F.coalesce(F.sum(total).over(before), F.lit(0))).drop(total)
    inside = W.partitionBy(*group, cell).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.withColumn(inner, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(starts, [*group, cell])
        .withColumn(out, (F.col(start) + F.col(inner)).cast("long"))
        .drop(cell, start, inner)
    )


def places(df: DataFrame, group: list[str], order: list[str], out: str, of: str | None = None) -> DataFrame:
    """Add ``out``: how many rows of its group stand before a row, by ``order``; ``of``: how many the group has.

    Rows are dealt by range of group and order, so a large group spreads over many
    tasks; only a row a range and group is counted up. Rows that are equal in all of these columns are told apart by a
    seeded draw, so that they spread too. Groups and order may hold nulls, which come first. ``df`` is written once
    to the shared folder, hence places don't change when tasks are done again.
    """
    part, line, first, n, draw = free_names(df, "_part", "_line", "_first", "_n", "_draw")
    keys = [*group, *order, draw]
    ranged = df.withColumn(draw, F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(draw)
    # The upper bits of such an id are the task's number, the lower ones count its rows.
    numbered = ranged.withColumn(line, F.monotonically_increasing_id()).withColumn(part, F.shiftright(line, 33))
    rows = written(numbered, "places")
    counted = rows.groupBy(*group, part).agg(F.min(line).alias(first), F.count("*").alias(n))
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = counted.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first))
    if of:
        starts = starts.withColumn(of, F.sum(n).over(W.partitionBy(*group)))
    # A row for each group and range: few where groups are large, as many as the rows where they are small.
    starts = joinable(written(starts.drop(first, n), "starts"))
    given = starts.select(*[F.col(c).alias(f"{part}{i}") for i, c in enumerate(group)], F.col(part).alias(n), out, *([of] if of else []))
    same = F.col(part) == F.col(n)
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"{part}{i}"))
    found = rows.join(given, same).withColumn(out, F.col(out) + F.col(line))
    return found.drop(part, line, n, *[f"{part}{i}" for i in range(len(group))])


def sorted_cells(df: DataFrame, group: list[str], value: str, cell: str, cells: int = 64) -> DataFrame:
    """``df`` with ``cell``: a range of ``value`` in its group, ascending, so that no task sorts a large group whole.

    Ranges end at the group's approximate quantiles; equal values share a cell, nulls
    are in cell 0. Columns of ``group`` may be null. Such quantiles depend on the order in which parts arrive, so they are
    written once: every reader of the result then cuts at the same places.
    """
    if group:
        marks, given = free_names(df, "_marks", "_given")
        steps = F.array(*[F.lit(i / cells) for i in range(1, cells)])
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{given}{i}") for i, c in enumerate(group)]
        keys += [F.col(c).isNull().alias(f"{given}n{i}") for i, c in enumerate(group)]
        names = [f"{given}{i}" for i in range(len(group))] + [f"{given}n{i}" for i in range(len(group))]
        edges = df.select(*keys, F.col(value)).groupBy(*names).agg(F.percentile_approx(value, steps, F.lit(1000)).alias(marks))
        keyed = df.select("*", *keys).join(written(edges, "edges"), names)
        edge = F.col(marks)
        out = keyed.withColumn(cell, F.coalesce(F.size(F.filter(edge, lambda m: m < F.col(value))), F.lit(0)))
        return out.drop(marks, *names)
    found = df.approxQuantile(value, [i / cells for i in range(1, cells)], 0.005)
    edge = F.array(*[F.lit(float(x)) for x in sorted(set(found))]).cast("array<double>")
    return df.withColumn(cell, F.coalesce(F.size(F.filter(edge, lambda m: m < F.col(value))), F.lit(0)))


def medians(df: DataFrame, group: list[str], value: str, out: str, cells: int = 64) -> DataFrame:
    """``(*group, out)``: the exact median of each group's values that aren't null, without one task holding a group's values.

    Ranges of ``value`` are counted first; only the distinct values of the one or two ranges around the middle are counted
    up one by one. ``df`` is read several times, so it is best written before; columns of ``group`` hold no nulls.
    """
    cell, n, upto, total, before = free_names(df, "_cell", "_n", "_upto", "_total", "_before")
    keyed = sorted_cells(df.select(*group, value).where(F.col(value).isNotNull()), group, value, cell, cells)
    by = W.partitionBy(*group)
    counted = keyed.groupBy(*group, cell).agg(F.count("*").alias(n)).withColumns({
        total: F.sum(n).over(by), before: F.coalesce(F.sum(n).over(by.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    # Of n values in order, the median is the mean of those at (n - 1) div 2 and n div 2, counted from 0.
    low, high = F.floor((F.col(total) - 1) / 2), F.floor(F.col(total) / 2)
    middle = counted.where((F.col(before) <= high) & (F.col(before) + F.col(n) > low)).drop(n)  # at most two rows a group
    kept = keyed.join(F.broadcast(middle), [*group, cell]).groupBy(*group, cell, value, total, before).agg(F.count("*").alias(n))
    inside = W.partitionBy(*group, cell).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = kept.withColumn(upto, F.col(before) + F.sum(n).over(inside))
    at = lambda place: F.max(F.when((F.col(upto) - F.col(n) <= place) & (F.col(upto) > place), F.col(value)))
    return placed.groupBy(*group).agg(((at(low) + at(high)) / 2).alias(out))


def running_sums(df: DataFrame, group: list[str], value: str, sums: dict[str, str], down: bool = False, cells: int = 64) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of that column over the group's rows up to this one in order of ``value``.

    Equal values count as one place. Ranges of ``value`` are summed up first, so that only rows of one
    range are sorted together. ``df`` is read several times; columns of ``group`` hold no nulls.
    """
    (cell,) = free_names(df, "_cell")
    keyed = sorted_cells(df, group, value, cell, cells)
    totals = [f"{o}_total" for o in sums]
    per = keyed.groupBy(*group, cell).agg(*[F.sum(w).alias(t) for t, w in zip(totals, sums.values(), strict=True)])
    before = W.partitionBy(*group).orderBy(F.col(cell).desc() if down else F.col(cell)).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*group, cell, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t) for t in totals])
    inside = W.partitionBy(*group, cell).orderBy(F.col(value).desc() if down else F.col(value))
    found = keyed.withColumns({o: F.sum(w).over(inside) for o, w in sums.items()}).join(starts, [*group, cell])
    return found.withColumns({o: F.col(o) + F.col(t) for o, t in zip(sums, totals, strict=True)}).drop(cell, *totals)
