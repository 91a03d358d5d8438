"""Tables written between the stages of one job, in storage that every node shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master, where all tasks share a disk, a temporary one if it is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = context._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            root = existing.get()
        elif context.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="assayline-")
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        spark.conf.set("spark.checkpoint.dir", root)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/assayline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: a cut in lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joinable(table: DataFrame, most: int = 20_000) -> DataFrame:
    """A written table as the side of a join: sent to every task up to ``most`` rows, else brought together by key.

    Left open, Spark goes by the size on disk, where sorted narrow rows take a fraction of what they take on the driver.
    """
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this job that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """An eager ``checkpoint()``, with a checkpoint folder made sure of first."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
