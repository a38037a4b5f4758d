"""License scans, in DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

Templates are short licence notices; others can be passed. Words are runs of letters
and digits, lower-cased; shingles are ``SHINGLE`` words (a shorter template is one
shingle of its own length and is not allowed).

1. Every window of a text is a run of shingles, half overlapping the next, of twice a
   template's number of shingles (templates are grouped by length in powers of two).
2. A window's MinHash under each of ``BANDS`` hash functions is the smallest hash of
   its shingles; a band of one row. A window over a whole template has Jaccard at
   least 1/4 with it, one over 0.8 of it at least 0.19, so the 32 bands miss it with
   probability (3/4)^32 = 0.01 % or 0.81^32 = 0.1 %.
3. Templates that share a band are checked exactly: the share of the template's
   distinct shingles found in the window must reach ``CONTAINMENT``.

Cost: shingles are hashed once a word. A window can only share a band or shingle with a
template if it holds one of the templates' shingles, so windows are built only around
such hits; this skips no window that could match. Hits are few in clean text; texts of
any length are scanned whole. A text's matches are merged by template: best containment
and number of matching windows.

Null and empty texts, and texts shorter than a shingle, match nothing and give no rows.
Repeated rows are scanned each; templates that fit equally well (ties) are all given. An
empty table gives no rows. Columns besides doc_id and text are ignored; a null
doc_id stays null in its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 32, 0.8
#: Names and wording of public licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _row() -> Column:
    """The row's number, unchanged; but Spark moves no filter below a projection that isn't deterministic.

    Moved down, a filter would hold a copy of the arrays' expressions, computed again
    for every element of a lambda that refers to them."""
    return (F.col("_row") + F.floor(F.rand(0)).cast("long")).alias("_row")


def shingled(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a number _row for each row and, in place of text, the hash of the shingle at each place; empty if too short."""
    others = [F.col(c) for c in df.columns if c != text]
    df = df.select(*others, F.monotonically_increasing_id().alias("_row"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("_h"))
    n = F.size("_h") - SHINGLE
    runs = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)]))
    return df.select(*others, _row(), F.when(n >= 0, runs).otherwise(F.array().cast("array<bigint>")).alias(out))


def bands(shingles: Column) -> Column:
    """The MinHash of an array of shingles under each hash function."""

    def lowest(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(F.lit(k), x)))

    return F.array(*[lowest(k) for k in range(BANDS)])


def _starts(hits: Column, c: int) -> Column:
    """Windows of size 2c, which start at multiples of c, that hold one of the hits."""
    near = F.flatten(F.transform(hits, lambda i: F.array(i - i % c, i - i % c - c)))
    return F.transform(F.array_distinct(F.filter(near, lambda x: x >= 0)), lambda x: F.struct(F.lit(c).alias("c"), x.cast("int").alias("at")))


def prepared(spark, templates: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """Name, distinct shingles and band values of each template: a few values, made by the same expressions."""
    rows = shingled(spark.createDataFrame(list(templates.items()), "name string, text string"), "text", "s").withColumn("s", F.array_distinct("s"))
    rows = rows.select("name", "s", bands(F.col("s")).alias("bands"))
    got = [(r.name, list(r.s), list(r.bands)) for r in rows.orderBy("name").collect()]
    if short := [name for name, s, _ in got if not s]:
        raise ValueError(f"templates need at least {SHINGLE} words: {short}")
    return got


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def scan(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, n_windows, first_word for each template found in a text."""
    spark = documents.sparkSession
    known = prepared(spark, TEMPLATES if templates is None else templates)
    every = sorted({v for _, s, _ in known for v in s})
    classes: dict[int, list[tuple[str, list[int], list[int]]]] = {}
    for t in known:
        size = 1
        while size < len(t[1]):
            size *= 2
        classes.setdefault(size, []).append(t)
    hashed = shingled(documents.select("doc_id", F.col("text").cast("string").alias("text")), "text", "s")
    held = hashed.where("size(s) > 0").select("doc_id", _row(), "s", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get("s", i).isin(every)).alias("hits")).where("size(hits) > 0")
    starts = [_starts(F.col("hits"), c) for c in sorted(classes)]
    windows = held.select("doc_id", _row(), "s", F.concat(*starts).alias("ws")).select("doc_id", "_row", "s", F.explode("ws").alias("w")).select("doc_id", _row(), "w.c", "w.at", F.array_distinct(F.slice("s", F.col("w.at") + 1, 2 * F.col("w.c"))).alias("x"))
    signed = windows.select("doc_id", _row(), "c", "at", "x", bands(F.col("x")).alias("bands"))
    checks = []
    for c, group in sorted(classes.items()):
        for name, s, signs in group:
            met = F.exists(F.arrays_zip(F.col("bands").alias("a"), _longs(signs).alias("b")), lambda z: z["a"] == z["b"])
            share = F.size(F.array_intersect("x", _longs(s))) / F.lit(float(len(s)))
            checks.append(F.when((F.col("c") == c) & met, F.struct(F.lit(name).alias("license"), share.alias("containment"))))
    found = signed.select("doc_id", "_row", "at", F.explode(F.filter(F.array(*checks), lambda z: z.isNotNull() & (z["containment"] >= containment))).alias("m"))
    return found.groupBy("_row", "doc_id", "m.license").agg(F.max("m.containment").alias("containment"), F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word")).drop("_row")
