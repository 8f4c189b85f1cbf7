"""License scans with MinHash bands, in DataFrame operations only.

Texts are read in overlapping windows of word 5-grams (shingles). For templates of L shingles a window has L + stride shingles and
begins every ``stride`` (at most L / 4) shingles, so any passage of L shingles lies inside one whole window. A window that holds the share
``least`` of a template has at least the Jaccard similarity j = need / (window + L - need) with it; each of b bands (one minimum
each) agrees with probability j, and b is chosen so that (1 - j)^b, the chance to miss, stays below ``miss``. Retrieved
pairs of window and template are verified by exact containment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.schema import DIMENSION_ROW_LIMIT

#: Wording of common public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
GRAM = 5
#: Words of a piece of a text that is handled at once (a multiple of every stride).
PIECE = 512
SPLIT = r"[^\p{L}\p{N}]+"


def stride_of(length: int) -> int:
    """Largest power of two up to a quarter of the template."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def plan(length: int, least: float, miss: float) -> tuple[int, int, int, int]:
    """(window, stride, shingles that must agree, bands) for templates of so many shingles."""
    stride = stride_of(length)
    window, need = length + stride - 1, math.ceil(least * length - 1e-9)
    j = need / (window + length - need)
    return window, stride, need, 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _shingled(df: DataFrame, words: str, *kept: str) -> DataFrame:
    """Kept columns and ``s``, the 64-bit hashes of all 5-grams of an array of words. Word hashes are a column, so made once."""
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    run = F.sequence(F.lit(0), F.size("h") - GRAM)
    s = F.transform(run, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(GRAM)]))
    return df.select(*kept, F.when(F.size("h") >= GRAM, s).otherwise(F.array().cast("array<long>")).alias("s"))


def _templates(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """Distinct shingles of each template, by the same expressions."""
    if len(templates) > DIMENSION_ROW_LIMIT:
        raise ValueError("more templates than can go to every task")
    table = docs.sparkSession.createDataFrame(list(templates), "license string, text string")
    rows = _shingled(table.select("license", _words(F.col("text")).alias("words")), "words", "license").select("license", F.array_distinct("s").alias("s"))
    return [(r["license"], list(r["s"])) for r in rows.collect() if r["s"]]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.75,
         miss: float = 1e-4) -> DataFrame:
    """(key, ``license``, ``n_shared``, ``n_shingles``, ``containment``, ``first_word``, ``n_windows``), one row per key and license found.

    ``containment`` is the largest share of the template's shingles in one window, ``first_word`` where the first such window begins.
    Texts that are null or have less than 5 words match nothing, rows of one key are one document, templates of less
    than 5 words are left out.
    """
    known = _templates(docs, templates)
    pieces = docs.select(F.col(key).alias("id"), _words(F.col(text)).alias("words")).where(F.size("words") >= GRAM)
    reach = max((plan(len(s), least, miss)[0] for _, s in known), default=1) + GRAM
    pieces = pieces.select("id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - GRAM, F.lit(PIECE))).alias("base"))
    pieces = _shingled(pieces.select("id", "base", F.slice("words", F.col("base") + 1, PIECE + reach).alias("words")), "words", "id", "base")
    by_length: dict[int, list[tuple[str, list[int]]]] = {}
    for name, s in known:
        by_length.setdefault(len(s), []).append((name, s))
    if not by_length:
        raise ValueError("no template has as many as 5 words")
    bands = max(plan(n, least, miss)[3] for n in by_length)
    minima, least_shingles = _minima(docs, known, bands)
    # a band agrees only where the template's own least shingle occurs, so other pieces needn't be hashed further
    pieces = pieces.select("id", "base", F.when(F.arrays_overlap("s", F.array(*[F.lit(x).cast("long") for x in least_shingles])), F.col("s")).alias("s"))
    # one minimum hash function per band, over all shingles of a piece once
    pieces = pieces.select("id", "base", "s", *[F.transform("s", _salted(k)).alias(f"h{k}") for k in range(bands)])
    hits, listed = [], []
    for length, group in sorted(by_length.items()):
        window, stride, need, b = plan(length, least, miss)
        values = [[minima[name][k] for name, _ in group] for k in range(b)]
        hits.append(_hits(length, window, stride, values))
        listed += [F.struct(F.lit(length).alias("length"), F.lit(need).alias("need"), F.lit(name).alias("license"), F.array(*[
            F.lit(x).cast("long") for x in s]).alias("t"), F.array(*[F.lit(minima[name][k]).cast("long") for k in range(b)]).alias("m")) for name, s in group]
    windows = pieces.select("id", "base", F.explode(F.concat(*hits)).alias("x")).select("id", "base", "x.*")
    agree = F.filter(F.array(*listed), lambda t: (t["length"] == F.col("length")) & F.arrays_overlap(t["m"], F.col("v")))
    pairs = windows.select("id", "base", "p", "w", F.explode(agree).alias("t")).select(
        "id", "t.license", "t.need", (F.col("base") + F.col("p")).cast("long").alias("at"), F.size(F.array_intersect("w", "t.t")).cast("long").alias("n_shared"),
        F.col("t.length").cast("long").alias("n_shingles"))
    return (pairs.where("n_shared >= need").groupBy(F.col("id").alias(key), "license")
            .agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"), F.min("at").alias("first_word"), F.count("*").alias("n_windows"))
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles")))


def _salted(k: int):
    return lambda x: F.xxhash64(x, F.lit(k))


def _hits(length: int, window: int, stride: int, values: list[list[int]]) -> Column:
    """Windows of a piece that agree with a template of this length in any band."""
    bands = range(len(values))

    def low(p: Column, k: int) -> Column:
        return F.array_min(F.slice(F.col(f"h{k}"), p + 1, window))

    starts = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.size("s")) - 1, F.lit(stride))
    hit = F.filter(starts, lambda p: _any([low(p, k).isin(values[k]) for k in bands]))
    return F.transform(hit, lambda p: F.struct(
        F.lit(length).alias("length"), p.alias("p"), F.slice("s", p + 1, window).alias("w"), F.array(*[low(p, k) for k in bands]).alias("v")))


def _minima(docs: DataFrame, known: list[tuple[str, list[int]]], bands: int) -> tuple[dict[str, list[int]], list[int]]:
    """Minimum of each band per template, and the shingles that have them."""
    table = docs.sparkSession.createDataFrame(known, "license string, t array<long>")
    least = [F.array_min(F.transform("t", _paired(k))) for k in range(bands)]
    rows = table.select("license", F.array(*least).alias("m")).collect()
    return {r["license"]: [x["h"] for x in r["m"]] for r in rows}, sorted({x["x"] for r in rows for x in r["m"]})


def _paired(k: int):
    return lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), x.alias("x"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
