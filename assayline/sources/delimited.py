"""Delimited tables in and out, and header and scalar normalization."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
# Fixed values.
HEADER_ALIASES = {
    "dataset_id": "external_dataset_id",
    "methodology": "library_methodology",
    "score_column_count": "score_col_count",
}


def _separator(path: str) -> str:
    suffix = re.search(r"(\.[A-Za-z]+)(\.gz)?/?$", path)
    found = _SEPARATORS.get(suffix[1].lower()) if suffix else None
    if found is None:
        raise ValueError(f"unsupported table suffix: {path}")
    return found


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv, .tsv or .txt file with a header, all columns as text: types come from contracts."""
    return spark.read.csv(path, sep=_separator(path), header=True, inferSchema=False)


def read_lossless(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text as it stands: markers such as ``-`` stay and empty fields are empty text; no rows is an error."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="\u0000", ignoreLeadingWhiteSpace=False)
    if df.isEmpty():
        raise ValueError(f"the table is empty: {path}")
    return df.na.fill("")


def write_table(df: DataFrame, path: str) -> None:
    """A folder of delimited files, with headers, by the path's suffix."""
    df.write.mode("overwrite").csv(path, sep=_separator(path), header=True)


def write_tables(frames: dict[str, DataFrame], folder: str, header_map: dict[str, str] | None = None) -> None:
    """Each frame as ``<name>.tsv`` under the folder, and the header map as one row of JSON."""
    for name, df in frames.items():
        write_table(df, f"{folder}/{name}.tsv")
    if header_map is not None:
        spark = next(iter(frames.values())).sparkSession
        spark.createDataFrame([(json.dumps(header_map, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header_map.json")


def normalize_header(header: str) -> str:
    name = header.lstrip("﻿").strip()
    name = name[1:].strip() if name.startswith("#") else name
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    if not name:
        raise ValueError("the table has an empty header")
    return HEADER_ALIASES.get(name, name)


def normalize_table(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Normalized column names and scalars (trimmed, with empty text and ``-`` as null), and the map from old names."""
    names = [normalize_header(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"headers that normalize alike: {clash}")
    renamed = df.toDF(*names)
    return renamed.select(*[scalar(F.col(c)).alias(c) for c in names]), dict(zip(df.columns, names, strict=True))


def scalar(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (text != "-"), text)


def text_key(value: Column) -> Column:
    """Lower case, underscores as spaces, white space collapsed; null if there's nothing."""
    return F.trim(F.regexp_replace(F.lower(F.replace(scalar(value), F.lit("_"), F.lit(" "))), r"\s+", " "))
