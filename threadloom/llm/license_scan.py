"""License scans: MinHash bands over overlapping text windows retrieve templates; shingle containment verifies them.

All in DataFrame functions. A text becomes lower-case words (runs of letters and digits) and its word 5-grams become
hashes. Per template length, windows of a quarter more than the template start every quarter of it, so that a notice lies
whole in one of them. Windows are sketched by BANDS bands of ROWS minima; a window retrieves the templates that share a
band. A window that holds at least 0.8 of a template's shingles has Jaccard similarity of 0.5 or more with it, and so
shares a band with probability 1 - (1 - 0.5 ** ROWS) ** BANDS, above 0.99999. Retrieved pairs are verified exactly:
shared distinct shingles over the template's.

A window without any of the templates' shingles has no minimum in common with a template, so such windows (and texts)
are dropped before sketching; that changes no result.

Cases: null, empty and short texts match nothing; a template of exactly five words needs its one shingle; a text with
several copies of a notice gives one row for it, with the best window (the first of equals); equal texts, equal rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8
BANDS, ROWS = 48, 2

# Public license notices and grants.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def _once(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, not once per element of an inner function."""
    return F.transform(F.array(value), body)[0]


def _hashes(words: Column) -> Column:
    """Hashes of the word 5-grams, in order; empty where there are fewer words."""

    def grams(w: Column) -> Column:
        n = F.size(w) - SHINGLE
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))

    return _once(words, grams)


def _sketch(hashes: Column) -> Column:
    """A key per band: the hash of the band's minima."""

    def least(j: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(j))))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def _layout(words: int) -> tuple[int, int]:
    """Stride of windows for a template of so many words, and shingles per window."""
    shingles = words - SHINGLE + 1
    stride = max(1, shingles // 4)
    return stride, shingles + stride


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per text and template found: key, license, matched, n_shingles, containment, start_word.

    templates: a bounded set; its shingles become part of the plan."""
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in sorted(templates.items())])).alias("t")
    t = df.sparkSession.range(1).select(listed).select("t.license", _words(F.regexp_replace("t.body", r"[^\p{L}\p{N}]+$", "")).alias("w"))
    t = t.select("license", F.size("w").alias("n_words"), F.array_distinct(_hashes(F.col("w"))).alias("t_hashes")).filter(F.size("t_hashes") > 0)
    known = t.collect()
    lengths: dict[int, list[int]] = {}
    for r in known:
        lengths.setdefault(r["n_words"], []).extend(r["t_hashes"])
    every = sorted({h for hs in lengths.values() for h in hs})

    docs = df.select(F.col(key).alias("k"), _hashes(_words(F.col(text))).alias("h")).filter(F.exists("h", lambda h: h.isin(every)))

    def windows(n_words: int, hashes: list[int]) -> Column:
        """Starts of the windows of one layout that hold a shingle of its templates."""
        stride, wide = _layout(n_words)
        at = F.filter(F.transform("h", lambda h, i: F.when(h.isin(sorted(set(hashes))), i)), lambda i: i.isNotNull())
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - wide + 1) / stride).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(first(i), F.floor(i / stride).cast("int")))))
        return F.transform(starts, lambda s: F.struct(F.lit(n_words).alias("n_words"), (s * stride).alias("start"), F.lit(wide).alias("wide")))

    spots = reduce(F.concat, [windows(n, hs) for n, hs in sorted(lengths.items())], F.array().cast("array<struct<n_words:int,start:int,wide:int>>"))
    rows = docs.select("k", "h", F.explode(spots).alias("s")).select("k", "s.n_words", "s.start", F.array_distinct(F.slice("h", F.col("s.start") + 1, F.col("s.wide"))).alias("window"))
    bands = rows.select("*", F.posexplode(_sketch(F.col("window"))).alias("band", "sketch"))
    keys = t.select("license", F.col("n_words").alias("t_words"), "t_hashes", F.posexplode(_sketch(F.col("t_hashes"))).alias("t_band", "t_sketch"))
    # the templates' side is BANDS rows per template of the bounded set
    met = bands.join(F.broadcast(keys), (F.col("n_words") == F.col("t_words")) & (F.col("band") == F.col("t_band")) & (F.col("sketch") == F.col("t_sketch")))
    met = met.withColumn("matched", F.size(F.array_intersect("window", "t_hashes")).cast("long")).filter(F.col("matched") >= CONTAINED * F.size("t_hashes"))
    best = met.groupBy("k", "license").agg(F.max(F.struct("matched", (-F.col("start")).alias("s"))).alias("b"), F.first(F.size("t_hashes")).cast("long").alias("n_shingles"))
    return best.select(F.col("k").alias(key), "license", "b.matched", "n_shingles", (F.col("b.matched") / F.col("n_shingles")).alias("containment"), (-F.col("b.s")).cast("long").alias("start_word"))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same by exact containment over all windows, without sketches, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    split = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+')"
    gram = f"list_transform(range(1, greatest(len(w) - {SHINGLE} + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' '))"
    return rf"""
WITH t0(license, body) AS (VALUES {values}),
t1 AS (SELECT license, {split.format(r"regexp_replace(body, '[^\p{L}\p{N}]+$', '')")} AS w FROM t0),
t AS (SELECT license, list_distinct({gram}) AS th, greatest(1, (len(w) - {SHINGLE - 1}) // 4) AS stride, len(w) - {SHINGLE - 1} AS s FROM t1),
d0 AS (SELECT doc_id, {split.format("text")} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {gram} AS h FROM d0 WHERE len(w) >= {SHINGLE}),
p AS (SELECT doc_id, license, h, th, stride, s, unnest(range(0, len(h), stride)) AS start FROM d JOIN t ON list_has_any(h, th)),
m AS (SELECT doc_id, license, start, len(list_intersect(list_distinct(list_slice(h, start + 1, start + s + stride)), th)) AS matched, len(th) AS n FROM p),
b AS (SELECT doc_id, license, CAST(matched AS BIGINT) AS matched, CAST(n AS BIGINT) AS n_shingles, matched / n AS containment, CAST(start AS BIGINT) AS start_word,
 row_number() OVER (PARTITION BY doc_id, license ORDER BY matched DESC, start) AS r FROM m WHERE matched >= {CONTAINED} * n)
SELECT doc_id, license, matched, n_shingles, containment, start_word FROM b WHERE r = 1"""
