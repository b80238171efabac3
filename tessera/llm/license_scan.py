"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

DataFrame functions only. Words are lower-case runs of a-z and 0-9; a shingle is
three consecutive words. Windows of ``WINDOW`` words start every ``STEP`` words. A
window and a template are candidates when one of ``bands`` MinHash values agrees
(bands of one row): at Jaccard j the chance to miss is (1 - j) ** bands. The
smallest template here (three shingles) stands whole in a window of 14, so
j >= 3/14 and 64 bands miss it with a chance of 2e-7. Windows without any shingle
of any template have j = 0; they are left out before hashing, which loses
nothing. Candidates are verified by the exact share of the template's shingles
that the document holds.

Defined results: null, empty and short texts hold nothing; rows that share a
doc_id and a text give one row per template, other repeated ids one row per
text; templates below three words are ignored; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, text_key

WINDOW, STEP, SHINGLE = 16, 8, 3
#: Above this many template shingles the windows are hashed without being screened, and templates are joined without a broadcast.
SCREEN = 20_000

# License notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of the shingles of an array of words (neighbours are zipped, so no lambda looks the array up again)."""
    n = F.size(w)
    two = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    three = F.zip_with(two, F.slice(w, 3, n), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return F.when(n >= SHINGLE, F.slice(three, 1, n - (SHINGLE - 1))).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__w", words(F.col("text"))).withColumn("__s", shingles(F.col("__w"))).drop("__w")


def min_hashes(s: Column, bands: int) -> Column:
    """``bands`` MinHash values of a column of shingle hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(s, lambda h: F.xxhash64(h, b))))


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, templates: DataFrame | None = None, bands: int = 64, least: float = 0.75) -> DataFrame:
    """doc_id, license, containment, first_word: templates of which a document holds at least ``least`` of the shingles.

    first_word is the place of the first shingle of the template in the document.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "license-scan")
    t = with_shingles((default_templates(spark) if templates is None else templates).select("license", "text"))
    t = ws.write(t.select("license", F.array_distinct("__s").alias("t")).where(F.size("t") > 0).distinct(), "templates")
    total = t.agg(F.sum(F.size("t"))).first()[0] or 0
    small = total <= SCREEN
    d = with_shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    known = None
    if small:
        known = F.array(*[F.lit(r.h) for r in t.select(F.explode("t").alias("h")).distinct().collect()]).cast("array<bigint>")
        d = d.where(F.arrays_overlap("__s", known))
    d = ws.write(d.select("doc_id", text_key().alias("tk"), F.col("__s").alias("s")).distinct(), "held")
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(STEP))
    win = d.where(F.size("s") > 0).select("doc_id", "tk", "s", F.explode(starts).alias("at")).select("doc_id", "tk", F.slice("s", F.col("at"), WINDOW - SHINGLE + 1).alias("win"))
    if small:
        win = win.where(F.arrays_overlap("win", known))
    bands_of = lambda rows, c, *keep: rows.select(*keep, F.posexplode(min_hashes(F.col(c), bands)).alias("band", "h"))
    tb = bands_of(t, "t", "license")
    near = bands_of(win, "win", "doc_id", "tk").distinct().join(F.broadcast(tb) if small else tb, ["band", "h"]).select("doc_id", "tk", "license").distinct()
    near = near.withColumnsRenamed({"doc_id": "__d", "tk": "__k"})
    same = d["doc_id"].eqNullSafe(near["__d"]) & (d["tk"] == near["__k"])
    j = d.join(near, same).select("doc_id", "tk", "s", "license")
    j = j.join(F.broadcast(t) if small else t, "license")
    j = j.withColumn("held", F.array_intersect("t", "s"))
    out = j.select("doc_id", "license", (F.size("held") / F.size("t")).alias("containment"), F.array_min(F.transform("held", lambda h: F.array_position("s", h) - 1)).cast("long").alias("first_word"))
    return out.where(F.col("containment") >= least)


def oracle(least: float = 0.75) -> str:
    """The same scan in DuckDB SQL: every document's shingles against every template's."""
    rows = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "SELECT {key}, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {key}, {split} AS w FROM {source}))"
    return f"""
WITH templates(license, text) AS (VALUES {rows}),
t AS (SELECT DISTINCT license, g FROM ({grams.format(key="license", split=split, source="templates")})),
n AS (SELECT license, count(*) AS n FROM t GROUP BY 1),
d AS ({grams.format(key="doc_id", split=split, source="documents")}),
m AS (SELECT doc_id, license, count(DISTINCT g) AS k, min(pos) AS first_word FROM d JOIN t USING (g) GROUP BY 1, 2)
SELECT doc_id, license, k::DOUBLE / n AS containment, first_word::BIGINT AS first_word FROM m JOIN n USING (license) WHERE k::DOUBLE / n >= {least}
"""
