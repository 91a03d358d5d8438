"""Studies that share data, transitively, as one family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.graph import connected_components


def study_families(df: DataFrame, study: str = "study_id", families: tuple[str, ...] = ("source_family_id", "raw_data_family_id")) -> DataFrame:
    """``(study, family_group)``: the least node of the study's component.

    Nodes are ``study:x`` and ``<family column>:y``; blank and null families link nothing.
    """
    node = F.concat(F.lit("study:"), F.col(study).cast("string"))
    known = df.where(F.col(study).isNotNull())
    edges = [known.select(node.alias("a"), node.alias("b"))]
    for c in families:
        family = F.trim(F.col(c).cast("string"))
        edges.append(known.where(F.coalesce(family, F.lit("")) != "").select(node.alias("a"), F.concat(F.lit(f"{c}:"), family).alias("b")))
    found = connected_components(reduce(DataFrame.union, edges))
    return found.where(F.col("node").startswith("study:")).select(
        F.substring("node", F.lit(7), F.length("node")).alias(study), F.col("component").alias("family_group")
    )
