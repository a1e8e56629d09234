"""Licence scan by canonical digests of entire texts.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, spaces) and digested, and
digests are joined by hash with those of known licences. The same is done for each line of a document as a text of its own, since
short notices stand on lines. The known texts are a short fixed list, so their digests are a bounded table.

Defined cases: a null or empty text, and one of copyright lines only, has no licence; a text repeated is judged each time; a
document may hold several notices, listed once each in order of name; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names and texts of licences and notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Spellings that count as equal, after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("sub license", "sublicense"),
    ("merchantibility", "merchantability"), ("recognise", "recognize"), ("organisation", "organization"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("creative commons attribution", "cc by"), ("v2", "version 2"), ("v3", "version 3"),
)


def canonical(text: Column) -> Column:
    """Words of a text in lower case and one spelling, without copyright lines; empty for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"(?m)^\W*(?:copyright\b|\(c\)|©)[^\n]*$", " ")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, one in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(plain)


def known_digests(df: DataFrame) -> DataFrame:
    known = df.sparkSession.createDataFrame(list(KNOWN), "licence string, text string")
    return known.select("licence", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")).dropDuplicates(["digest"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, licence (of the entire text), notices (of lines), n_lines of each document."""
    known = known_digests(docs)
    lines = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    digest = F.sha2(canonical(F.col("text")).cast("binary"), 256)
    rows = docs.select("doc_id", digest.alias("text_digest"), lines.alias("lines")).withColumn("row", F.monotonically_increasing_id())
    # digests of a bounded list of licences, as a map
    names = F.map_from_entries(F.array(*[F.struct(F.lit(r["digest"]), F.lit(r["licence"])) for r in known.collect()]))
    digests = F.transform("lines", lambda x: F.element_at(names, F.sha2(canonical(x).cast("binary"), 256)))
    found = F.array_sort(F.array_distinct(F.filter(digests, lambda x: x.isNotNull())))
    return rows.select("doc_id", "text_digest", F.element_at(names, F.col("text_digest")).alias("licence"), F.array_join(found, ",").alias("notices"), F.size("lines").alias("n_lines"))
