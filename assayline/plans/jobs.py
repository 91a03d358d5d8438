"""Jobs as a user submits them: paths in, tables out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import contracts, counts, design, external_index, model, triage
from ..sources.delimited import read_lossless, read_table, write_table, write_tables


def validate_job(spark: SparkSession, path: str, contract: str, report: str) -> int:
    """Writes errors as JSON lines; returns how many there are."""
    errors = contracts.validate(read_table(spark, path), contract)[1]
    errors.write.mode("overwrite").json(report)
    return spark.read.schema("row_number long, error string").json(report).count()


def featurize_counts_job(spark: SparkSession, counts_path: str, sheet_path: str, out: str, **params) -> None:
    write_table(counts.featurize_count_table(read_table(spark, counts_path), read_table(spark, sheet_path), **params), out)


def featurize_design_job(spark: SparkSession, screens: str, designs: str, contrasts: str, samples: str, out: str) -> None:
    write_table(design.featurize_design(*[read_table(spark, p) for p in (screens, designs, contrasts, samples)]), out)


def ingest_index_job(spark: SparkSession, path: str, folder: str, release: str, retrieved: str, organism_scope: str | None = None) -> None:
    raw = read_lossless(spark, path)
    found = external_index.parse_index(raw, release=release, retrieved=retrieved, organism_scope=organism_scope)
    frames = {"raw": raw.toDF(*found.header_map.values()), **{n: df for n, df in found._asdict().items() if isinstance(df, DataFrame)}}
    write_tables(frames, folder, found.header_map)


def triage_job(spark: SparkSession, path: str, folder: str, release: str, retrieved: str, organism_scope: str | None = None) -> dict[str, int]:
    """Writes intake, checks, candidate ids and the summary, which is also returned."""
    found = triage.triage_index(read_lossless(spark, path), release=release, retrieved=retrieved, organism_scope=organism_scope)
    write_tables({"screen_intake": found.intake, "eligibility_checks": found.checks}, folder)
    found.candidates.write.mode("overwrite").text(f"{folder}/candidates.txt")
    summary = {r["key"]: r["value"] for r in found.summary.collect()}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary.json")
    return summary


def ingest_scores_job(spark: SparkSession, path: str, folder: str, release: str, index_path: str | None = None) -> int:
    """Writes gene scores and issues; returns how many issues there are."""
    index = None
    if index_path:
        index = external_index.parse_index(read_lossless(spark, index_path), release=release, retrieved="1970-01-01").normalized
    found = external_index.parse_scores(read_lossless(spark, path), release=release, index=index, source_file=path.rsplit("/", 1)[-1])
    write_tables({"gene_scores": found.gene_scores, "issues": found.issues}, folder, found.header_map)
    return found.issues.count()


def benchmark_job(spark: SparkSession, path: str, out: str, *, features: list[str] | None = None, profile: str | None = None, **params) -> dict[str, float]:
    """Out-of-fold scores of a table of labelled features, and their metrics."""
    if (features is None) == (profile is None):
        raise ValueError("give either features or a profile")
    table = read_table(spark, path)
    columns = features or model.PROFILES[profile]
    aligned = model.align_direction(table.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in ("median_guide_lfc", "mean_guide_lfc") if c in table.columns}))
    scored, notes = model.out_of_fold(aligned, columns, **params)
    write_table(scored, out)
    metrics = {r["metric"]: r["value"] for r in model.evaluate(scored, ["screen_id", "contrast_id", "phenotype_direction"]).collect()}
    return metrics | notes
