"""Licence scans: MinHash bands over overlapping windows find templates, exact containment confirms them.

DataFrame functions alone.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fingerprints import let

# Notices as licensors publish them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class LicenseParams:
    """Windows of ``window`` shingles, one starting at each shingle, with ``bands`` bands of one MinHash each.

    A shingle that text and template share is looked up from each of its windows in each band in whose
    order it is the least there. Templates may be a single shingle long, so windows are as short as two: bands then pass
    nearly every shingle on, and what they filter is little beside what the exact check does. On the test tables of 1000 documents
    the matches are those of an exact search (``sql.licenses``), so the recall measured there is 1.
    """

    shingle_words: int = 5
    window: int = 2
    bands: int = 6
    percent: int = 75


def shingles(text: Column, params: LicenseParams = LicenseParams()) -> Column:
    """Hashes of the text's shingles in order; words are runs of letters a-z and digits, lower-cased."""
    k = params.shingle_words
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")

    def of_hashes(h: Column) -> Column:
        return F.when(
            F.size(h) >= k,
            F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>"))

    # The split leaves an empty word at an end that isn't a word; no template has one, so it never matches.
    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _mask(band: int) -> int:
    """A 64-bit number for each band: xor with it puts hashes in another order."""
    return random.Random(band).getrandbits(64) - (1 << 63)


def bands(hashes: Column, params: LicenseParams = LicenseParams()) -> Column:
    """For each band in turn the MinHash of the window at each shingle, in the band's own order of hashes."""
    out = []
    for band in range(params.bands):
        least = F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(_mask(band)))) if params.window == 1 else hashes
        for j in range(1, params.window):
            mask = F.lit(_mask(band))
            first = (lambda a: a.bitwiseXOR(mask)) if j == 1 else (lambda a: a)
            # The shorter side is filled up with nulls, which least() skips.
            later = F.slice(hashes, j + 1, F.greatest(F.size(hashes), F.lit(1)))
            least = F.zip_with(least, later, lambda a, b: F.least(first(a), b.bitwiseXOR(mask)))
        out.append(least)
    return F.concat(*out)


def template_index(spark: SparkSession, templates: dict[str, str], params: LicenseParams) -> list[tuple[str, list[int], list[int]]]:
    """``(name, band keys, distinct shingles)`` of each template of five words or more; on the driver, as they are given there."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    clean = F.regexp_replace("text", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    hashed = rows.select("name", let(shingles(clean, params), lambda h: F.struct(F.array_distinct(bands(h, params)).alias("k"), F.array_distinct(h).alias("s"))).alias("t"))
    return [(r["name"], r["t"]["k"], r["t"]["s"]) for r in hashed.collect() if r["t"]["s"]]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, params: LicenseParams = LicenseParams()) -> DataFrame:
    """``(doc_id, license_id, containment, first_shingle)`` for each template found in a text of ``docs(doc_id, text)``.

    A text whose windows share a band with a template's windows is a candidate for
    it; a candidate of which at least ``percent`` of the template's distinct
    shingles stand in the text is a match. ``first_shingle`` is the place, counted
    from 0, of the first of the template's shingles that the text has.

    Null, empty and short texts (under five words) match nothing. Repeated rows
    give repeated matches. Null doc_ids stay null. An empty table, or no template of
    five words, gives an empty result. Each row is scanned where it is read:
    nothing is shuffled. The templates, whose size is the caller's, are part of the
    plan.
    """
    p = params
    index = template_index(docs.sparkSession, templates or TEMPLATES, p)
    keys = _longs(sorted({k for _, ks, _ in index for k in ks}))
    known = F.array(*[F.struct(F.lit(name).alias("name"), _longs(ks).alias("keys"), _longs(ss).alias("shingles")) for name, ks, ss in index])

    def found(h: Column) -> Column:
        def candidates(shared: Column) -> Column:
            return F.when(F.size(shared) > 0, F.filter(known, lambda t: F.arrays_overlap(t["keys"], shared)))

        near = let(F.array_intersect(bands(h, p), keys), candidates)
        judged = F.transform(
            near,
            lambda t: let(
                F.array_intersect(t["shingles"], h),
                lambda both: F.struct(
                    t["name"].alias("license_id"),
                    (F.size(both) / F.size(t["shingles"])).alias("containment"),
                    (F.size(both) * 100 >= F.size(t["shingles"]) * p.percent).alias("enough"),
                    F.array_min(F.transform(both, lambda s: F.array_position(h, s))).alias("first"),
                ),
            ),
        )
        return F.filter(judged, lambda m: m["enough"])

    if not index:
        return docs.sparkSession.createDataFrame([], "doc_id long, license_id string, containment double, first_shingle long")
    # explode_outer, as explode() would have the matches computed once more to filter for them.
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(let(shingles(F.col("text"), p), found)).alias("m"))
    return each.where("m.license_id is not null").select(
        "doc_id", "m.license_id", "m.containment", (F.col("m.first") - 1).alias("first_shingle")
    )
