"""Licence notices in texts, found by MinHash bands over overlapping windows. Built-in functions only.

Texts and templates are words of small letters and digits; shingles are five words. Every template belongs to a window size
of at least one and a half times its length, and windows of a size follow each other so closely that any stretch of the
template's length lies whole in one. From the template's shingles, the least containment and the window's size follows the
least similarity of a window that holds the template (an eighth for five words in a window of twelve). Each size has as many
bands of one row as its templates need for a chance of ``MISS``, one in ten thousand, at most to miss one; a template that
would need more than ``MOST`` is refused. The templates a window meets are verified by exact containment of their shingles.

A stretch that holds ``LEAST`` of a template's shingles holds one of the anchors, since more than the rest of the
template's shingles contain one (checked when the templates are made). So windows are only made of texts with an anchor.

The templates are a fixed list and lent to every task; a document's windows stay within its row until they are matched.

Defined results: null and empty texts have no licence; repeated rows with one id are reported once; a document is reported
once per licence, with its best window; rows without an id are reported together.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole

WIDTH = 5
LEAST = 0.75
MISS = 1e-4
#: Bands of a window size, at most.
MOST = 128
#: Parts of words that licence notices use.
ANCHORS = ("licen", "permission", "redistribut", "copyright", "warrant", "software")

# Short public notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
                " Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
            " following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i:i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))})


def size_of(words: int) -> int:
    """Window sizes grow by half from 12 words."""
    size = 12
    while size < 1.5 * words:
        size = size * 3 // 2
    return size


def bands_of(words: int, shingles: int) -> int:
    """Bands that meet a template of so many words and shingles in a window that holds ``LEAST`` of it, but for ``MISS``."""
    if words < WIDTH:
        raise ValueError(f"a notice of {words} words has no shingle of its own")
    held = math.ceil(LEAST * shingles)
    like = held / (max(size_of(words) - WIDTH + 1, held) + shingles - held)
    need = 1 if like == 1 else math.ceil(math.log(MISS) / math.log1p(-like))
    if need > MOST:
        raise ValueError(f"a notice of {words} words needs {need} bands")
    return need


def _check(templates) -> None:
    for name, text in templates:
        shingles = _shingles(_words(text))
        bare = sum(not any(a in s for a in ANCHORS) for s in shingles)
        if bare >= LEAST * len(shingles):
            raise ValueError(f"a notice of {name} can be met without an anchor")


def _minimum_hashes(shingles: Column, bands: Column) -> Column:
    """Per band the least hash of the shingles."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(
        F.transform(shingles, lambda s: F.xxhash64(b, s))))


def _bands(templates) -> dict[int, int]:
    """Bands of every window size."""
    out: dict[int, int] = {}
    for _, text in templates:
        words = _words(text)
        size = size_of(len(words))
        out[size] = max(out.get(size, 1), bands_of(len(words), len(_shingles(words))))
    return out


def templates_of(spark, templates=TEMPLATES) -> DataFrame:
    """The templates: licence, shingles, window size, and hash of each band."""
    _check(templates)
    bands = _bands(templates)
    rows = [(i, name, _shingles(_words(text)), size_of(len(_words(text)))) for i, (name, text) in enumerate(templates)]
    made = spark.createDataFrame([(*r, bands[r[3]]) for r in rows], "template int, license string, wanted array<string>, size int, bands int")
    return made.select("template", "license", "wanted", "size", F.posexplode(_minimum_hashes(F.col("wanted"), F.col("bands"))).alias("band", "hash"))


def windows(docs: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """Windows (doc_id, size, start, shingles) of texts with an anchor; ``sizes``: window sizes and the steps between them."""
    lower = F.lower(whole())
    anchored = docs.where(reduce(or_, [lower.contains(a) for a in ANCHORS]))
    words = F.filter(F.split(F.lower(whole()), "[^a-z0-9]+"), lambda w: w != "")
    rows = anchored.select("doc_id", words.alias("words")).select(
        "doc_id", "words", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(step).alias("step")) for s, step in sizes])).alias("kind"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("kind.step"))
    cut = rows.select("doc_id", F.col("kind.size").alias("size"), F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.slice(F.col("words"), s + 1, F.col("kind.size")).alias("words")))).alias("window"))
    near = cut.where(F.array_join("window.words", " ").rlike("|".join(ANCHORS)))
    own = F.col("window.words")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - WIDTH + 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(own, i, WIDTH), " "))
    return near.select("doc_id", "size", F.col("window.start").alias("start"), F.array_distinct(shingles).alias("shingles"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document and licence: ``doc_id``, ``license``, ``containment``, ``start`` (first word of the best window)."""
    spark = docs.sparkSession
    steps: dict[int, int] = {}
    for _, text in templates:
        n = len(_words(text))
        size = size_of(n)
        steps[size] = min(steps.get(size, size), size - n + 1)
    made = templates_of(spark, templates)
    rows = windows(docs, sorted(steps.items()))
    bands = F.create_map(*[F.lit(x) for pair in _bands(templates).items() for x in pair])[F.col("size")]
    banded = rows.select("*", F.posexplode(_minimum_hashes(F.col("shingles"), bands)).alias("band", "hash"))
    met = banded.join(F.broadcast(made), ["size", "band", "hash"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    return (met.withColumn("containment", share).where(F.col("containment") >= LEAST)
            .groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
            .select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("start")))
