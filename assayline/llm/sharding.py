"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.names import free_names
from ..functions.positions import running_start
from ..functions.scratch import written


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    seed: int = 3
    cells: int = 256


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` draws are good; for any sizes.

    Above what NumPy takes, the distribution is summed outwards from its mode over
    16 standard deviations a side, beyond which less than 1e-50 is left out.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    n = good + bad
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (n + 2)))
    sd = (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    reach = int(16 * sd) + 32
    k = np.arange(max(lo, mode - reach), min(hi, mode + reach), dtype=np.float64)
    # log p(k + 1) - log p(k)
    up = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(up)])
    p = np.exp(logs - logs.max())
    return int(max(lo, mode - reach) + rng.choice(len(p), p=p / p.sum()))


def _shares(rng: np.random.Generator, room: list[int], n: int) -> list[int]:
    """How many of ``n`` rows go to each shard with that much room: one multivariate hypergeometric draw."""
    if sum(room) < 10**9:
        return rng.multivariate_hypergeometric(room, n, method="marginals").tolist()
    out, left = [], sum(room)
    for free in room:
        left -= free
        out.append(hypergeometric(rng, free, left, n))
        n -= out[-1]
    return out


def matrix_rows(rows: dict[int, int], shards: int, seed: int) -> Iterator[tuple[int, list[int]]]:
    """``(partition, rows sent to each shard)``, one partition after the other.

    Shard sizes differ by one at most. A partition's row is drawn from the room
    that is left in the shards, which makes the whole matrix that of a uniform
    permutation.
    """
    total = sum(rows.values())
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    rng = np.random.default_rng(seed)
    for p, n in sorted(rows.items()):
        sent = _shares(rng, room, n)
        room = [free - x for free, x in zip(room, sent, strict=True)]
        yield p, sent


def shuffle_into_shards(df: DataFrame, params: ShardParams = ShardParams(), stable: bool = False) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, gapless from 0 in each shard: a uniform permutation.

    First job: rows per partition. The matrix (partitions by shards) is drawn on the
    driver and written as a table, of which each task reads its own row. Second
    job: each partition deals its rows to shards in a random order of exactly its
    matrix row, which is its local permutation; whole rows are exchanged, and each
    shard orders what it got by a second random number. The shard's order is found in
    cells, so that a shard may be larger than a task.

    Partitions must hold the same rows in both jobs. Set ``stable`` if ``df`` is a
    plain scan of files; anything else is written to the shared folder first. A
    partition that changed stops the job. Null values, ties, repeated rows and very
    long texts don't matter, as rows are told apart by their place; columns named
    shard or slot are replaced, all others stay, whatever their names. An empty
    table gives an empty result.
    """
    p = params
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    df = df if stable else written(df, "to-shuffle")
    spark = df.sparkSession
    found = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    counts = {r["p"]: r["n"] for r in found}
    # A row a partition, found by its number in a file: tasks don't carry the others' rows.
    matrix = written(spark.createDataFrame(list(matrix_rows(counts, p.shards, p.seed)), "part int, sent array<long>"), "matrix")
    part, sent, second = free_names(df, "_part", "_sent", "_second")
    own = df.withColumn(part, F.spark_partition_id())
    # The matrix has a row for each partition of one scan, far below the driver's list of files.
    dealt = own.join(F.broadcast(matrix.toDF(part, sent)), part)
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(second, T.LongType())])
    width = len(kept)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, rng, at, mine = None, None, 0, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            if to is None:
                mine = batch.column(width)[0].as_py()
                rng = np.random.default_rng([p.seed, mine])
                row = np.asarray(batch.column(width + 1)[0].values)
                to = rng.permutation(np.repeat(np.arange(p.shards, dtype=np.int32), row))
            if at + n > len(to):
                raise RuntimeError("a partition holds more rows than it did when rows were counted")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(to[at : at + n]), pa.array(rng.integers(0, 1 << 63, n, dtype=np.int64))], [*schema.names]
            )
            at += n
        if to is not None and at != len(to):
            raise RuntimeError("a partition holds fewer rows than it did when rows were counted")

    moved = dealt.select(*[F.col(f"`{c}`") for c in kept], part, sent).mapInArrow(deal, schema)
    return running_start(moved, ["shard"], second, [], F.lit(1), "slot", p.cells).select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")
