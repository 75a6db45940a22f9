"""License scans with DataFrame functions alone: MinHash bands retrieve templates, shingle containment verifies them.

Texts and templates become lower-case words (runs of letters and digits) and the hashes of their shingles of SHINGLE
words. Overlapping windows of a text then go against the windows of all templates:

- a template of fewer than LONG shingles has windows of one shingle, at every place. A window of one shingle has the
  same minimum under every hash function, namely itself, so that one band finds each shared shingle for certain.
- a longer template has windows of LONG shingles; the text has one at every STEP-th shingle, the template at every one.
  A verbatim run of LONG + STEP - 1 shingles holds a window of the text that equals one of the template. Each of
  BANDS bands is the minimum under one hash function; windows of Jaccard similarity J meet in a band with probability
  1 - (1 - J) ** BANDS if bands were independent; a test measures 0.99 and more at J = 0.45, which is what is left of
  a window beside the worst placed edges.

A template found like this is verified: the text is cut at every n-th shingle (n: those of the template), and the
share of the template's shingles that stand in two neighbouring cuts must reach THRESHOLD in some place. So a run of
n + 1 shingles is always seen whole.

The templates are a fixed list whose size is known, so they are literals of the plan; nothing is shuffled, joined or
collected. Null and empty texts, and texts of fewer than SHINGLE words, have no shingle and match nothing. Texts are
scanned whole; repeated rows give repeated results, and an empty table none. Other columns, whatever their names, are not
read. A template of fewer than SHINGLE words is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, LONG, STEP, BANDS, THRESHOLD = 5, 8, 4, 16, 0.8

#: The wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Each makes a hash function, namely the exclusive or with it; they spread over all 64 bits, the sign included, so that
#: every band looks for its minimum near another value.
SEEDS = [(k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(1, BANDS + 1)]


def shingles(text: Column) -> Column:
    """Hashes of the shingles, in order; empty if there are none, null for a null text."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE)))

    # The words are bound to a name by a lambda, so that they are split once.
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= SHINGLE, hashes(ws)).otherwise(_longs([])))[0]


def _minimum(window: Column, seed: int) -> Column:
    return F.array_min(F.transform(window, lambda h: h.bitwiseXOR(F.lit(seed))))


def bands(hashes: Column, step: int) -> Column:
    """Bands of all windows of LONG shingles that begin at every `step`-th."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(step))
    windows = F.transform(starts, lambda i: F.slice(hashes, i, LONG))
    return F.flatten(F.transform(windows, lambda w: F.array(*(_minimum(w, seed) for seed in SEEDS))))


def best_share(hashes: Column, own: list[int]) -> Column:
    """The largest share of the shingles `own` that stand together within twice their number."""
    n = len(own)
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(n))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(hashes, i, 2 * n), _longs(own))))) / F.lit(float(n))


def _prepared(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """Name, shingles and window keys of each template, by the same expressions as for texts."""
    given = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in sorted(templates.items())))
    rows = spark.range(1).select(F.inline(given)).withColumn("hashes", shingles(F.col("text")))
    rows = rows.select("name", F.array_distinct("hashes").alias("hashes"), F.when(F.size("hashes") >= LONG, bands(F.col("hashes"), 1)).otherwise(F.col("hashes")).alias("keys"), F.size("hashes").alias("n"))
    found = rows.collect()
    if short := [r.name for r in found if not r.n]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    return [(r.name, r.hashes, sorted({k for k in r.keys if k is not None})) for r in found]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and license that it holds: doc_id, license and containment (the best, to 4 places)."""
    found = _prepared(docs.sparkSession, templates or TEMPLATES)
    short = sorted({k for _, hashes, keys in found if len(hashes) < LONG for k in keys})
    long = sorted({k for _, hashes, keys in found if len(hashes) >= LONG for k in keys})
    # explode() of one value gives it a column of its own; the optimizer would else write it out at each use.
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(shingles(F.col(text_col)))).alias("hashes"))
    hit = F.concat(F.filter("hashes", lambda h: h.isin(short)), F.filter(bands(F.col("hashes"), STEP), lambda h: h.isin(long)))
    hits = hashed.filter(F.col("hashes").isNotNull()).select("doc_id", "hashes", F.explode(F.array(hit)).alias("hit")).filter(F.size("hit") > 0)
    checks = []  # one for each template
    for name, hashes, keys in found:
        share = best_share(F.col("hashes"), hashes)
        checks.append(F.when(F.arrays_overlap("hit", _longs(keys)), F.struct(F.lit(name).alias("license"), F.round(share, 4).alias("containment"))))
    rows = hits.select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("match"))
    return rows.select("doc_id", "match.license", "match.containment").filter(F.col("containment") >= threshold)


def _shingles_sql(source: str, key: str) -> str:
    following = ", ".join(f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY i)" for k in range(1, SHINGLE))
    words = f"SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {source})"
    return f"SELECT {key}, i, s FROM (SELECT {key}, i, lead(w, {SHINGLE - 1}) OVER (PARTITION BY {key} ORDER BY i) AS last, concat_ws(' ', w, {following}) AS s FROM ({words})) WHERE last IS NOT NULL"


#: The same rows by plain containment: every text against every template, shingles as strings, without bands.
ORACLE_SQL = f"""
    WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
    given AS (SELECT * FROM (VALUES {", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in sorted(TEMPLATES.items()))}) t(license, text)),
    own AS (SELECT DISTINCT license, s FROM ({_shingles_sql("given", "license")})),
    sizes AS (SELECT license, count(*) AS n FROM own GROUP BY license),
    shared AS (
        SELECT h.row, license, n, h.s, (h.i - 1) // n AS cut
        FROM ({_shingles_sql("docs", "row")}) h JOIN own USING (s) JOIN sizes USING (license)),
    cuts AS (
        SELECT row, license, n, cut, count(DISTINCT s) AS found
        FROM (SELECT * FROM shared UNION ALL SELECT * REPLACE (cut - 1 AS cut) FROM shared WHERE cut > 0) GROUP BY row, license, n, cut),
    best AS (SELECT row, license, round(max(found) / any_value(n), 4) AS containment FROM cuts GROUP BY row, license)
    SELECT doc_id, license, containment FROM best JOIN docs USING (row) WHERE containment >= {THRESHOLD}
"""


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)
