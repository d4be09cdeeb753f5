"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies
(DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import read

#: Words of a shingle and the share of a template's shingles that a window must contain.
SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of the signature and rows of a band.
BANDS, ROWS = 24, 2

#: Notices by license; short public notices in their usual wording.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def window_of(n: int) -> tuple[int, int]:
    """(length, step) of the windows, in shingles, for a template of ``n``: each stretch of n lies whole in one window,
    which is at most a quarter longer."""
    step = max(1, n // 4)
    return n + step - 1, step


def chance(n: int) -> float:
    """Least probability that a window with CONTAINMENT of a template of ``n`` shingles is retrieved."""
    length, _ = window_of(n)
    common = CONTAINMENT * n
    jaccard = common / (n + length - common)
    return 1 - (1 - jaccard**ROWS) ** BANDS


def once(value: Column) -> Column:
    """A generator of the one value. Spark merges plain projections and pushes filters through them, and would compute
    a value anew wherever it is used, in a lambda for each element; it does not look behind a generator."""
    return F.explode(F.array(value))


def words_of(text: Column) -> Column:
    """Lower-case ASCII letters and digits of the text, as an array of words; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; empty for fewer words."""
    n = F.size(words) - (SHINGLE - 1)
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(n > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column) -> tuple[Column, Column]:
    """The MinHash minima, to be kept as ``_least``, and a hash of each band of them; row j's function is xxhash64 of
    the shingle and j."""
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))))
    signed = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(*[F.get(F.col("_least"), b * ROWS + r) for r in range(ROWS)]))
    return least, signed


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(template, license, n, set, key): the templates' shingle sets; a handful of rows, fixed by the parameter."""
    rows = [(i, lic, template_words(t)) for i, (lic, t) in enumerate(texts)]
    if any(len(w) < SHINGLE for _, _, w in rows):
        raise ValueError(f"a template needs {SHINGLE} words")
    made = spark.createDataFrame(rows, "template int, license string, words array<string>")
    made = made.select("template", "license", once(F.array_distinct(shingles_of(F.col("words")))).alias("set"))
    return made.select("template", "license", F.size("set").alias("n"), "set")


def scanned(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the licenses found in each document's whole text.

    For each length of template, windows of fitting length step over the text's shingles. A window is signed only
    if it holds a shingle of some template: without one its minima differ from every template's, so no retrieval
    is lost. Windows that share a band with a template of their length are verified by the exact share of the
    template's shingles in them, CONTAINMENT at least. Kept per document and license: the best share, the number
    of windows and the first word of the first one.

    Null, empty and short texts hold none. Rows with the same id count as one document. The work is in the rows
    themselves up to the few windows with hits; only those are shuffled.
    """
    spark = docs.sparkSession
    known = templates(spark, texts).collect()  # the parameter's rows
    everything = F.array(*[F.lit(h) for h in sorted({h for t in known for h in t["set"]})])
    lengths = sorted({window_of(t["n"]) for t in known})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), once(words_of(F.col(text_col).cast("string"))).alias("words"))
    rows = rows.select("doc_id", once(shingles_of(F.col("words"))).alias("sh"))
    rows = rows.select("doc_id", "sh", once(F.array_intersect("sh", everything)).alias("seen")).where(F.size("seen") > 0)
    at = F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains(F.col("seen"), F.get(F.col("sh"), i)))
    rows = rows.select("doc_id", "sh", once(at).alias("at"))

    def touched(length: int, step: int) -> Column:
        """Numbers of the windows that hold a hit: from the first that reaches it to the last that starts at or before it."""
        first = lambda p: F.greatest(F.ceil((p - (length - 1)) / step), F.lit(0)).cast("int")
        return F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(first(p), F.floor(p / step).cast("int")))))

    def windows_of(length: int, step: int) -> Column:
        return F.transform(touched(length, step), lambda w: F.struct(F.lit(length).alias("length"), (w * step).alias("start"), F.slice("sh", w * step + 1, length).alias("win")))

    windows = F.flatten(F.array(*[windows_of(*x) for x in lengths]))
    windows = rows.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.length", "w.start", "w.win")
    least, signed = signature(F.col("win"))
    banded = windows.select("doc_id", "length", "start", "win", once(least).alias("_least")).select("doc_id", "length", "start", "win", F.posexplode(signed).alias("band", "key"))
    mine = spark.createDataFrame([(t["template"], t["license"], t["n"], t["set"], window_of(t["n"])[0]) for t in known], "template int, license string, n int, set array<bigint>, _len int")
    least, signed = signature(F.col("set"))
    mine = mine.select("template", "license", "n", "set", "_len", once(least).alias("_least")).select("template", "license", "n", "set", "_len", F.posexplode(signed).alias("_band", "_key"))
    hits = banded.join(F.broadcast(mine), (F.col("length") == F.col("_len")) & (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
    share = F.size(F.array_intersect("win", "set")) / F.col("n")
    found = hits.withColumn("share", share).where(F.col("share") >= CONTAINMENT)
    found = found.groupBy("doc_id", "license", "start", "length").agg(F.max("share").alias("share"))
    return found.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for ``op2_license_scan``: every window compared with every template of its length by shared shingles."""
    values = []
    for i, (lic, t) in enumerate(TEMPLATES):
        w = template_words(t)
        own = sorted({" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)})
        length, step = window_of(len(own))
        values += [f"({i}, '{lic}', {len(own)}, {length}, {step}, '{s}')" for s in own]
    return f"""
    WITH tem(template, license, n, len, step, sh) AS (VALUES {", ".join(values)}),
    doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    pos AS (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS p FROM doc WHERE len(w) >= {SHINGLE}),
    hit AS (
      SELECT doc_id, p, template, license, n, len, step, tem.sh
      FROM pos JOIN tem ON tem.sh = array_to_string(w[p + 1 : p + {SHINGLE}], ' ')),
    win AS (
      SELECT doc_id, template, license, n, len, sh, step * unnest(range(CAST(greatest(ceil((p - (len - 1)) / CAST(step AS DOUBLE)), 0) AS BIGINT), p // step + 1)) AS start
      FROM hit),
    share AS (
      SELECT doc_id, license, start, len, count(DISTINCT sh) / CAST(n AS DOUBLE) AS share
      FROM win GROUP BY doc_id, template, license, n, len, start)
    SELECT doc_id, license, max(share) AS containment, count(DISTINCT (start, len)) AS n_windows, CAST(min(start) AS BIGINT) AS first_word
    FROM share WHERE share >= {CONTAINMENT}e0 GROUP BY doc_id, license"""
