"""Validation events to one conservative label per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LABELS = ("V3", "V2", "V1", "F0", "D", "A", "T", "U")
KEYS = ("screen_id", "contrast_id", "gene_symbol", "phenotype_direction")
#: From the strongest on.
PRECEDENCE = ("V3", "V2", "D", "F0", "V1", "T", "A", "U")


def check_labels(df: DataFrame, column: str) -> None:
    odd = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*LABELS)).select(column).limit(1).collect()
    if odd:
        raise ValueError(f"unknown label code {odd[0][0]!r}")


def model_target(label: Column) -> Column:
    """1 for V2 and V3, 0 for F0 and D, null for any other label."""
    return F.when(label.isin("V2", "V3"), 1).when(label.isin("F0", "D"), 0).cast("int")


def resolve_labels(label: Column) -> Column:
    """An aggregate: A if positive and negative labels meet, else the strongest one; U of none."""
    has = lambda *codes: F.coalesce(F.max(label.isin(*codes)), F.lit(False))
    out = F.when(has("V2", "V3") & has("F0", "D"), "A")
    for code in PRECEDENCE:
        out = out.when(has(code), code)
    return out.otherwise("U")


def adjudicate_events(events: DataFrame) -> DataFrame:
    """``KEYS``, ``label_code`` and ``n_events``; rows with a null key are dropped, an empty table gives an empty result."""
    missing = [c for c in (*KEYS, "label_code") if c not in events.columns]
    if missing:
        raise ValueError(f"missing event columns: {missing}")
    return events.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(
        resolve_labels(F.col("label_code")).alias("label_code"), F.count("*").alias("n_events")
    )
