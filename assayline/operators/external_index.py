"""External screen indexes and author scores as normalized tables."""

from __future__ import annotations

import re
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import parsing as P
from ..sources.delimited import normalize_table
from .contracts import with_row_numbers

#: How identifiers and links of the public index are written.
PREFIX, SOURCE, PAGE = "orcs", "BioGRID ORCS", "https://orcs.thebiogrid.org/Screen/"


class IndexTables(NamedTuple):
    normalized: DataFrame
    studies: DataFrame
    screens: DataFrame
    designs: DataFrame
    contrasts: DataFrame
    maps: DataFrame
    header_map: dict[str, str]


class ScoreTables(NamedTuple):
    normalized: DataFrame
    gene_scores: DataFrame
    issues: DataFrame
    header_map: dict[str, str]


def _release(release: str) -> str:
    if not release.strip():
        raise ValueError("the release cannot be empty")
    return release.strip()


def screen_id(release: str, external: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX}:{_release(release)}:screen:"), F.trim(external))


def contrast_id(release: str, external: Column) -> Column:
    return F.concat(screen_id(release, external), F.lit(":contrast:reported"))


def column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def parse_index(raw: DataFrame, *, release: str, retrieved: date | str, organism_scope: str | None = None) -> IndexTables:
    """Studies, screens, designs, contrasts and mappings of an index with one row for each external screen.

    One normalized table and five selections over it. What the index doesn't say
    stays null: comparators and directions are unknown, no raw-data family is taken from
    a shared source, and a screen without a source has a provisional study of its own.
    """
    release, retrieved = _release(release), date.fromisoformat(str(retrieved))
    table, header_map = normalize_table(raw)
    if "screen_id" not in table.columns:
        raise ValueError("the index has no SCREEN_ID column")
    odd = table.groupBy("screen_id").agg(F.count("*").alias("n")).where("screen_id is null or n > 1").limit(1).collect()
    if odd:
        raise ValueError("SCREEN_ID is missing" if odd[0]["screen_id"] is None else f"SCREEN_ID repeats: {odd[0]['screen_id']}")
    table = with_row_numbers(table)
    c = lambda name: column(table, name)
    external, source_id = c("screen_id"), c("source_id")
    kind = F.coalesce(c("source_type"), F.lit("unknown"))
    low_kind = F.lower(F.trim(kind))
    provisional = F.concat(F.lit(f"{PREFIX}:{release}:study:provisional-screen:"), external)
    study = F.when(source_id.isNull(), provisional).otherwise(F.concat(F.lit(f"{PREFIX}:{release}:study:"), low_kind, F.lit(":"), source_id))
    family = F.when(source_id.isNotNull(), F.concat(F.lit(f"{PREFIX}:source-family:"), low_kind, F.lit(":"), source_id))
    sid, day = screen_id(release, external), F.lit(retrieved)
    locator = F.concat(F.lit(f"{SOURCE} {release} screen index; SCREEN_ID="), external)
    page = F.concat(F.lit(PAGE), P.url_quoted(external))
    rationale = F.concat(F.lit("ORCS screen rationale: "), c("screen_rationale"))
    dose, unit = P.dose_value(c("condition_dosage")), P.dose_unit(c("condition_dosage"))
    unknown = F.lit("unknown")
    named = F.when(source_id.isNotNull(), F.concat(F.lit(f"{SOURCE} source "), source_id)).otherwise(F.concat(F.lit(f"{SOURCE} screen "), external))
    note = F.when(
        source_id.isNull(), " No source id was given: the study stands for this screen alone, without a source family."
    ).otherwise("")
    all_studies = table.select(
        study.alias("study_id"), F.coalesce(c("author"), named).alias("citation"),
        F.coalesce(c("organism_official"), F.lit(organism_scope), unknown).alias("organism"), F.lit(None).cast("string").alias("data_license"),
        F.lit("original_screen").alias("source_role"), F.lit(True).alias("independent_screen_source"), source_id.alias("source_id"),
        kind.alias("source_type"), F.when(F.lower(kind) == "pubmed", source_id).alias("pubmed_id"),
        F.concat(F.lit(f"From the screen index of {SOURCE} {release}."), note).alias("notes"), "row_number",
    )
    first = W.partitionBy("study_id").orderBy("row_number")
    studies = all_studies.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "row_number")
    screens = table.select(
        sid.alias("screen_id"), study.alias("study_id"), family.alias("source_family_id"), F.lit(None).cast("string").alias("raw_data_family_id"),
        P.modality(c("library_type"), c("library_methodology")).alias("perturbation_modality"),
        F.coalesce(c("screen_type"), unknown).alias("screen_design"), c("cell_line").alias("cell_line"),
        F.when(F.lower(c("experimental_setup")) == "drug exposure", c("condition_name")).alias("drug_name"), c("library").alias("library_name"),
        dose.alias("treatment_dose"), unit.alias("treatment_unit"), P.duration_days(c("duration")).alias("duration_days"),
        unknown.alias("intended_direction"), F.lit("orcs_gene_scores").alias("input_mode"), page.alias("source_url"), day.alias("available_date"),
        P.joined_notes(c("notes"), rationale).alias("notes"),
    )
    designs = table.select(
        sid.alias("screen_id"), F.lit("original_screen").alias("source_role"), P.screen_scale(c("throughput")).alias("screen_scale"),
        c("screen_format").alias("screen_format"), c("experimental_setup").alias("experimental_setup"),
        P.selection_strategy(c("screen_type")).alias("selection_strategy"), c("library_type").alias("library_type"),
        c("library_methodology").alias("library_methodology"), c("enzyme").alias("enzyme"), P.plain_number(c("moi")).alias("library_moi"),
        c("analysis").alias("analysis_method"), locator.alias("source_locator"),
        P.joined_notes(rationale, F.concat(F.lit("ORCS significance criteria: "), c("significance_criteria"))).alias("notes"),
    )
    contrasts = table.select(
        sid.alias("screen_id"), contrast_id(release, external).alias("contrast_id"),
        F.coalesce(c("screen_name"), F.concat(F.lit("ORCS screen "), external)).alias("contrast_name"),
        F.coalesce(c("condition_name"), unknown).alias("treatment_name"), dose.alias("treatment_dose"), unit.alias("treatment_unit"),
        unknown.alias("control_type"), unknown.alias("exposure_schedule"), F.coalesce(c("phenotype"), unknown).alias("phenotype_endpoint"),
        unknown.alias("intended_direction"), locator.alias("source_locator"),
        F.lit("The index names neither comparator nor score direction; both are left open.").alias("notes"),
    )
    maps = table.select(
        F.concat(F.lit(f"{PREFIX}:{release}:external-screen:"), external).alias("mapping_id"), sid.alias("screen_id"), F.lit(SOURCE).alias("source_name"),
        F.lit(release).alias("source_version"), c("external_dataset_id").alias("external_dataset_id"), external.alias("external_screen_id"),
        F.lit("source_record").alias("relationship"), page.alias("source_url"), day.alias("retrieved_date"),
        F.lit("source_version and external_screen_id together identify the external record.").alias("notes"),
    )
    return IndexTables(table, studies, screens, designs, contrasts, maps, header_map)


def parse_scores(
    raw: DataFrame, *, release: str, index: DataFrame | None = None, contrast: str | None = None, source_file: str | None = None
) -> ScoreTables:
    """Long gene scores, and an issue for each value that could not be taken.

    Each ``score_N`` that is given is a row; a row with a hit but no score gives a
    hit row. ``index``: a normalized index, of which the last row of a screen tells
    the method and the scores' types; a row without screen_id is the default.
    """
    release = _release(release)
    table, header_map = normalize_table(raw)
    lost = sorted({"screen_id", "official_symbol"} - set(table.columns))
    if lost:
        raise ValueError(f"missing score table columns: {lost}")
    table = with_row_numbers(table)
    scores = sorted((x for x in table.columns if re.fullmatch(r"score_\d+", x)), key=lambda x: int(x[6:]))
    hit = column(table, "hit")
    wanted = ["analysis", *[f"{s}_type" for s in scores]]
    if index is None:
        table = table.withColumns({f"_{w}": F.lit(None).cast("string") for w in wanted})
    else:
        known = index if "row_number" in index.columns else with_row_numbers(index)
        info = known.select(column(known, "screen_id").alias("screen_id"), "row_number", *[column(known, w).alias(f"_{w}") for w in wanted])
        last = W.partitionBy("screen_id").orderBy(F.col("row_number").desc())
        info = info.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "row_number")
        fallback = info.where("screen_id is null").drop("screen_id").limit(1).collect()
        default = fallback[0].asDict() if fallback else {}
        table = table.join(info.where("screen_id is not null").withColumn("_known", F.lit(True)), "screen_id", "left").withColumns(
            {f"_{w}": F.when(F.col("_known"), F.col(f"_{w}")).otherwise(F.lit(default.get(f"_{w}"))) for w in wanted}
        )
    table = table.withColumns({"_sid": F.col("screen_id"), "_gene": F.col("official_symbol"), "_hit": P.author_hit(hit)})
    usable = F.col("_sid").isNotNull() & F.col("_gene").isNotNull()
    numbers = {s: P.finite_number(F.col(s)) for s in scores}
    any_score = sum((numbers[s].isNotNull().cast("int") for s in scores), F.lit(0)) > 0

    def issue(when: Column, field: str, value: Column, error: str) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(error).alias("error")))

    issues = [
        issue(F.col("_sid").isNull(), "screen_id", F.col("screen_id"), "missing_screen_id"),
        issue(F.col("_sid").isNotNull() & F.col("_gene").isNull(), "official_symbol", F.col("official_symbol"), "missing_official_symbol"),
        issue(usable & ~P.author_hit_known(hit), "hit", hit, "unrecognized_hit"),
        *[issue(usable & F.col(s).isNotNull() & numbers[s].isNull(), s, F.col(s), "score_not_finite") for s in scores],
        issue(usable & ~any_score & F.col("_hit").isNull(), "score/hit", F.lit(None).cast("string"), "neither_score_nor_hit"),
    ]
    found = table.select("row_number", F.col("_sid").alias("external_screen_id"), F.col("_gene").alias("gene_symbol"), F.explode(F.array_compact(F.array(*issues))).alias("i"))
    rows = [
        F.when(numbers[s].isNotNull(), F.struct(F.lit(f"orcs_{s}").alias("tail"), numbers[s].alias("score"), F.col(f"_{s}_type").alias("kind"))) for s in scores
    ]
    only_hit = F.when(
        ~any_score & F.col("_hit").isNotNull(),
        F.struct(F.lit("orcs_author_hit").alias("tail"), F.lit(None).cast("double").alias("score"), F.lit("author_hit").alias("kind")),
    )
    long = table.where(usable).withColumn("_s", F.explode(F.array_compact(F.array(*rows, only_hit))))
    gene_scores = long.select(
        screen_id(release, F.col("_sid")).alias("screen_id"), (F.lit(contrast) if contrast else contrast_id(release, F.col("_sid"))).alias("contrast_id"),
        F.col("_gene").alias("gene_symbol"), F.coalesce("_analysis", F.lit("ORCS author-reported")).alias("method"),
        F.col("_s.tail").alias("analysis_tail"), F.lit("unknown").alias("direction"), F.col("_s.score").alias("score"), F.col("_hit").alias("author_hit"),
        F.col("_s.kind").alias("score_type"), F.lit(False).alias("cnv_corrected"), F.lit(SOURCE).alias("source_database"),
        F.col("_sid").alias("source_screen_id"), F.lit(source_file).cast("string").alias("source_file"),
    )
    return ScoreTables(table.drop("_sid", "_gene", "_hit", "_known", *[f"_{w}" for w in wanted]), gene_scores, found.select("row_number", "external_screen_id", "gene_symbol", "i.*"), header_map)


def summary_scores(df: DataFrame, screen: str, contrast: str) -> DataFrame:
    """Long scores of a wide gene summary with positive and negative tails; the direction stays unknown."""
    gene = next((c for c in ("id", "gene", "Gene", "gene_symbol") if c in df.columns), None)
    aliases = {"score": ("score",), "effect": ("lfc",), "p_value": ("p-value", "pvalue", "p_value"), "fdr": ("fdr",), "rank": ("rank",)}
    tails = []
    for tail in ("pos", "neg"):
        have = {}
        for metric, names in aliases.items():
            found = next((f"{tail}{sep}{n}" for n in names for sep in ("|", "_", ".") if f"{tail}{sep}{n}" in df.columns), None)
            have[metric] = F.expr(f"try_cast(`{found}` as double)") if found else None
        if any(v is not None for v in have.values()):
            tails.append((tail, have))
    if gene is None or not tails:
        raise ValueError("the gene summary lacks a gene column or score columns")
    rows = F.explode(F.array(*[
        F.struct(F.lit(f"mageck_{tail}").alias("analysis_tail"), *[(v if v is not None else F.lit(None).cast("double")).alias(m) for m, v in have.items()])
        for tail, have in tails
    ]))
    return df.select(
        F.lit(screen).alias("screen_id"), F.lit(contrast).alias("contrast_id"), F.col(f"`{gene}`").cast("string").alias("gene_symbol"),
        F.lit("MAGeCK").alias("method"), F.lit("unknown").alias("direction"), rows.alias("r"),
    ).select("screen_id", "contrast_id", "gene_symbol", "method", "direction", "r.*")
