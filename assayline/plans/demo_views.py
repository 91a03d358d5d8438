"""The operators' inputs, as views over generic order, document and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS = (
    "concat('SC', l_suppkey % 4) as screen_id",
    "concat('SC', l_suppkey % 4, ':C', l_linenumber % 2) as contrast_id",
    "concat('SC', l_suppkey % 4, ':C', l_linenumber % 2, ':', l_linestatus, l_returnflag) as sample_id",
    "case l_linestatus when 'O' then 'control' else 'treatment' end as condition_role",
    "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as replicate",
)


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_KEYS).distinct()


def wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each sample, a row for each part; parts without lines have zeros."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(*_KEYS, "l_partkey", "l_quantity")
    samples = sorted(r["sample_id"] for r in sheet(spark, sf_dir).collect())
    # Every count is summed up before it is brought to its part, so that no task makes a wide row of a single count. The number of
    # partitions is given: narrow counts pack well, and merged by their packed size they would fill a task with wide rows.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = lines.repartition(n, "l_partkey", "sample_id").groupBy("l_partkey", "sample_id").agg(F.sum("l_quantity").alias("n"))
    pivoted = summed.repartition(n, "l_partkey").groupBy("l_partkey").pivot("sample_id", samples).agg(F.sum("n").cast("long"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return (
        parts.join(pivoted, parts.p_partkey == pivoted.l_partkey, "left").na.fill(0)
        .selectExpr("concat('G', p_partkey) as sgrna_id", "concat('GENE', p_partkey div 4) as gene_symbol", *[f"`{s}`" for s in samples])
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each document: its score has ties, its target is null if it has no label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "source as study_id",
        "concat(source, '-', lang) as screen_id",
        "concat('C', doc_id % 2) as contrast_id",
        "case doc_id % 3 when 0 then 'resistance' when 1 then 'sensitization' else 'neutral' end as phenotype_direction",
        "concat('GENE', doc_id) as gene_symbol",
        "cast(quality as double) as target",
        "cast((doc_id * 7919) % 101 as double) / 100 as score",
        "doc_id", "toxic", "n_chars",
    )


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('SC', user_id % 4) as screen_id",
        "concat('C', user_id % 2) as contrast_id",
        "case event_id % 2 when 0 then 'resistance' else 'sensitization' end as phenotype_direction",
        "case when user_id % 11 = 0 then null else concat('GENE', user_id) end as gene_symbol",
        "case event_type when 'signup' then 'V3' when 'purchase' then 'V2' when 'error' then 'F0' when 'click' then 'V1' else 'T' end as label_code",
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('S', c_custkey) as study_id",
        "case when c_custkey % 5 <> 0 then concat('SF', c_custkey div 3) end as source_family_id",
        "case when c_custkey % 3 = 0 then concat('RF', c_custkey div 10) end as raw_data_family_id",
    )
