"""Exact parsers and classifiers of free text: what isn't exact is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"(\d+\.?\d*|\.\d+)"
_DOSE = rf"^{_NUMBER}\s+([A-Za-zµμ%][A-Za-z0-9µμ%/_.^-]*)$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def dose_value(text: Column) -> Column:
    return _part(text, _DOSE, 1).cast("double")


def dose_unit(text: Column) -> Column:
    """The unit of an exact dose, with the Greek letter mu as the micro sign."""
    return F.replace(_part(text, _DOSE, 2), F.lit("μ"), F.lit("µ"))


def duration_days(text: Column) -> Column:
    return _part(text, rf"(?i)^{_NUMBER}\s+days?$", 1).cast("double")


def plain_number(text: Column) -> Column:
    return _part(text, rf"^{_NUMBER}$", 1).cast("double")


def finite_number(text: Column) -> Column:
    """A finite decimal, perhaps signed and with an exponent; else null."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def author_hit(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "yes", True).when(low == "no", False)


def author_hit_known(text: Column) -> Column:
    """False for a value that is neither yes, no, not applicable nor missing."""
    return text.isNull() | F.lower(text).isin("yes", "no", "n/a", "na")


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def modality(library_type: Column, methodology: Column) -> Column:
    kind, how = _low(library_type), _low(methodology)
    return (
        F.when(kind.contains("crispra") | (how == "activation"), "CRISPRa")
        .when(kind.contains("crispri") | (how == "inhibition"), "CRISPRi")
        .when(kind.contains("crisprn") | (how == "knockout"), "CRISPR_KO")
        .otherwise("other")
    )


def selection_strategy(text: Column) -> Column:
    low = _low(text)
    both = ("positive and negative selection", "positive/negative selection", "bidirectional selection")
    return (
        F.when(low == "positive selection", "positive_selection").when(low == "negative selection", "negative_selection")
        .when(low.isin(*both), "bidirectional_selection").when(low != "", "other").otherwise("unknown")
    )


def screen_scale(text: Column) -> Column:
    low = F.replace(_low(text), F.lit("-"), F.lit(" "))
    return (
        F.when(low.contains("genome") & low.contains("wide"), "genome_wide")
        .when(low.contains("target") | low.contains("focused"), "targeted")
        .when(low.contains("saturation") | low.contains("tiling"), "saturation")
        .when(low != "", "other").otherwise("unknown")
    )


def joined_notes(*parts: Column) -> Column:
    """The parts that are not empty, with `` | `` between; null if there's none."""
    text = F.concat_ws(" | ", *[F.when(p != "", p) for p in parts])
    return F.when(text != "", text)


def url_quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
