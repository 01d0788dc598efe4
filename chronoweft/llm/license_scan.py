"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance.

A file's own licence is the template with the largest cosine to one of its segments: every window of up to ``WINDOW`` successive lines of
a paragraph (lines without a blank one between), every paragraph, and, for a licence file, the whole text. An inverted index
of the templates' words gives a segment's products with all templates; a segment whose product, over the least length that its
other words can give it, stays below the threshold is passed over, which loses nothing. Document frequencies of all words of the
others are counted over all files. Files without a licence of their own inherit that of the
licence file in the nearest ancestor directory, found by joins on directory paths.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise

# Notices of public licences, several wordings each.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": ["Released under the zlib License", "SPDX-License-Identifier: Zlib"],
}
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = sorted({w for texts in TEMPLATES.values() for t in texts for w in words(t)})


#: Lines of a window at most: a notice may be wrapped to a word a line. Whole paragraphs and licence files are segments as well.
WINDOW = 64
#: Lines whose counts are held at a time.
LINES = 4096
_PLACE = {w: i for i, w in enumerate(VOCABULARY)}

Segment = tuple[int, int, float]


class Index:
    """The templates by word, for document frequencies ``df`` of the vocabulary over ``n`` files."""

    def __init__(self, df: dict[str, int], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        self.idf = {w: self.weight(df.get(w, 0)) for w in VOCABULARY}
        self.weights = np.array([self.idf[w] for w in VOCABULARY])
        self.names: list[str] = []
        self.posts: dict[str, list[tuple[int, float]]] = {w: [] for w in VOCABULARY}
        columns = []
        for name, texts in TEMPLATES.items():
            for t in texts:
                x = np.zeros(len(VOCABULARY))
                for w, c in Counter(words(t)).items():
                    x[_PLACE[w]] = c * self.idf[w]
                x /= sqrt(x @ x)
                for i in np.flatnonzero(x):
                    self.posts[VOCABULARY[i]].append((len(self.names), float(x[i])))
                self.names.append(name)
                columns.append(x)
        self.columns = np.array(columns).T * self.weights[:, None]  # a count's part of the products

    def weight(self, files: int) -> float:
        return log((1 + self.n) / (1 + files)) + 1

    def reachable(self, found: set[str]) -> bool:
        """Whether a text with these words of the vocabulary can come as near as the threshold to any template: its cosine is
        at most the length of the template's part in these words."""
        mass: dict[int, float] = {}
        for w in found:
            for t, x in self.posts[w]:
                mass[t] = mass.get(t, 0.0) + x * x
        return bool(mass) and max(mass.values()) >= self.threshold**2 - 1e-9

    def bounds(self, counts: np.ndarray, products: np.ndarray, others: np.ndarray) -> np.ndarray:
        """No less than the largest cosine of each row of counts: a word weighs 1 at least, and so do the squares of its count."""
        own = ((counts * self.weights) ** 2).sum(1)
        return np.divide(products.max(1), np.sqrt(own + others), out=np.zeros(len(own)), where=own > 0)

    def windows(self, counted: list[tuple[Counter, int]]) -> list[Segment]:
        """Windows (from, to, bound) of up to ``WINDOW`` successive lines of a paragraph that can reach the threshold. They begin and end with a line that has a word of the templates, as others
        add nothing. Sums of a window are differences of running ones."""
        out: list[Segment] = []
        for start in range(0, len(counted), LINES):
            part = counted[start : start + LINES + WINDOW - 1]
            counts = np.zeros((len(part) + 1, len(VOCABULARY)), np.int32)
            for i, (c, _) in enumerate(part, 1):
                for w, k in c.items():
                    counts[i, _PLACE[w]] = k
            has = counts[1:].any(1)
            products = np.cumsum(counts @ self.columns, 0)
            counts, others = np.cumsum(counts, 0, dtype=np.int32), np.cumsum([0, *(n for _, n in part)])
            for length in range(1, min(WINDOW, len(part)) + 1):
                first = np.flatnonzero(has[: min(LINES, len(part) - length + 1)] & has[length - 1 : length - 1 + min(LINES, len(part) - length + 1)])
                if not len(first):
                    continue
                last = first + length
                bound = self.bounds(counts[last] - counts[first], products[last] - products[first], others[last] - others[first])
                hit = bound >= self.threshold - 1e-9
                out += [(start + i, start + i + length, x) for i, x in zip(first[hit].tolist(), bound[hit].tolist())]
        return out

    def whole(self, counted: list[tuple[Counter, int]]) -> float:
        counts = np.zeros((1, len(VOCABULARY)))
        for c, _ in counted:
            for w, k in c.items():
                counts[0, _PLACE[w]] += k
        return float(self.bounds(counts, counts @ self.columns, np.array([sum(n for _, n in counted)]))[0])

    def segments(self, text: str, whole: bool) -> tuple[list[str], list[Segment]]:
        """Lines, and the segments of them (from, to, bound) that can reach the threshold."""
        if not self.reachable(set(words(text)) & self.idf.keys()):
            return [], []
        lines = text.split("\n")
        counted = []
        for line in lines:
            w = words(line)
            c = Counter(x for x in w if x in self.idf)
            counted.append((c, len(w) - c.total()))
        out: dict[tuple[int, int], float] = {}
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and lines[end].strip():
                end += 1
            paragraph = counted[at:end]
            if end > at and self.reachable({w for c, _ in paragraph for w in c}):
                out |= {(at + a, at + b): x for a, b, x in self.windows(paragraph)}
                if (bound := self.whole(paragraph)) >= self.threshold - 1e-9:
                    out[at, end] = bound
            at = end + 1
        if whole and (bound := self.whole(counted)) >= self.threshold - 1e-9:
            out[0, len(lines)] = bound
        # only the lines that stand in a segment are kept
        change = np.zeros(len(lines) + 1, np.int64)
        for a, b in out:
            change[a] += 1
            change[b] -= 1
        used = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        place = np.zeros(len(lines) + 1, np.int64)
        place[used] = np.arange(len(used))
        return [lines[i] for i in used], sorted((int(place[a]), int(place[b - 1]) + 1, x) for (a, b), x in out.items())

    def scan(self, lines: list[str], segments: list[Segment], df: dict[str, int]) -> tuple[float, str | None]:
        """Best (cosine, licence) of the segments; (0, None) without any. ``df``: files of the words outside the templates. Segments are taken from the largest bound on, until
        none can reach what is found."""
        counted = [Counter(words(line)) for line in lines]
        best: tuple[float, str | None] = (0.0, None)
        for a, b, bound in sorted(segments, key=lambda x: -x[2]):
            if bound < best[0] - 1e-9:
                break
            counts: Counter = Counter()
            for c in counted[a:b]:
                counts.update(c)
            norm = sqrt(sum((c * (self.idf[w] if w in self.idf else self.weight(df.get(w, 0)))) ** 2 for w, c in counts.items()))
            dots: dict[int, float] = {}
            for w, c in counts.items():
                if w in self.idf:
                    for t, x in self.posts[w]:
                        dots[t] = dots.get(t, 0.0) + c * self.idf[w] * x
            for t, x in dots.items():
                best = max(best, (x / norm, self.names[t]), key=lambda p: (p[0], p[1] or ""))
        return best


def document_frequencies(files: DataFrame, asked: DataFrame | frozenset[str]) -> DataFrame:
    """word, files: the files that hold each of the ``asked`` words, counted within a task's batch first. A set of words is
    looked up in place; a table of them (word), of any size, is joined."""
    chosen = asked if isinstance(asked, frozenset) else None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = Counter()
            for t in b["text"].fillna(""):
                found = set(words(t))
                sums.update(found if chosen is None else found & chosen)
            yield pd.DataFrame([*sums.items()], columns=["word", "n"])

    counted = files.select("text").mapInPandas(count, "word string, n long")
    if chosen is None:
        counted = counted.join(asked, "word")
    return counted.groupBy("word").agg(F.sum("n").alias("files"))


def own_licenses(files: DataFrame, threshold: float) -> DataFrame:
    """id, path, is_license, score, license for every row: a score depends on the segments alone, so equal ones are scored once."""
    import hashlib

    spark = files.sparkSession
    vocabulary = spark.createDataFrame([(w,) for w in VOCABULARY], "word string")
    known = {r["word"]: r["files"] for r in document_frequencies(files, frozenset(VOCABULARY)).collect()}
    n = files.count()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(known, n, threshold)
        for b in batches:
            parts = [index.segments(t, w) for t, w in zip(b["text"], b["is_license"])]
            keys = [hashlib.md5(repr(p).encode("utf-8", "replace")).digest() if p[1] else None for p in parts]
            yield b[["id", "path", "is_license"]].assign(key=keys, lines=[p[0] for p in parts], starts=[[a for a, _, _ in p[1]] for p in parts], ends=[[e for _, e, _ in p[1]] for p in parts], bounds=[[x for _, _, x in p[1]] for p in parts])

    rows = materialise(files.mapInPandas(cut, "id long, path string, is_license boolean, key binary, lines array<string>, starts array<int>, ends array<int>, bounds array<double>"), "segments")
    distinct = materialise(rows.where("key is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("lines", "starts", "ends", "bounds"))), "distinct-segments")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, w) for k, lines in zip(b["key"], b["lines"]) for w in {w for x in lines for w in words(x)}]
            yield pd.DataFrame(found, columns=["key", "word"])

    held = materialise(distinct.mapInPandas(split, "key binary, word string").join(F.broadcast(vocabulary), "word", "left_anti"), "segment-words")
    others = document_frequencies(files, held.select("word").distinct())
    by_key = held.join(materialise(others, "word-files"), "word").groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("files").alias("files"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(known, n, threshold)
        for b in batches:
            columns = (b[c] for c in ("lines", "starts", "ends", "bounds", "words", "files"))
            found = [index.scan(list(x), [*zip(s, e, y)], {} if w is None else dict(zip(w, f))) for x, s, e, y, w, f in zip(*columns)]
            yield b[["key"]].assign(score=[s for s, _ in found], license=[x if s >= threshold else None for s, x in found])

    scored = materialise(distinct.join(by_key, "key", "left").select("key", "lines", "starts", "ends", "bounds", "words", "files").mapInPandas(score, "key binary, score double, license string"), "scored")
    bare = rows.select("id", "path", "is_license", "key")
    without = bare.where("key is null").select("id", "path", "is_license", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license"))
    return without.union(bare.where("key is not null").join(scored, "key").select("id", "path", "is_license", "score", "license"))


def license_scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """id, path, license, score, origin, license_path for every row of ``files`` (id, path, text, is_license).

    ``is_license`` marks licence files (null: by the file's name). ``origin``: ``own`` (a segment's cosine is
    at least ``threshold``), ``inherited`` or ``none`` (license null). Of several licence files in a directory
    the least path counts; ties between templates go to the last name. ``score`` is 0 where no segment can reach the threshold.
    Other columns are not looked at, whatever their names. Null and empty texts have no licence of their own, null paths inherit nothing, texts and paragraphs of any length are compared
    whole. Rows are judged one by one, so repeated rows are alike. An empty table gives no rows.
    """
    files = files.select("id", "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("is_license"), F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("is_license"))
    own = materialise(own_licenses(files, threshold), "licences")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    declared = own.where("is_license and license is not null and path is not null").groupBy(directory.alias("at")).agg(F.min_by("license", "path").alias("given"), F.min("path").alias("license_path"))
    # ancestors are resolved once for each directory that holds a file, not for each file
    directories = own.where("path is not null").select(directory.alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    ancestors = materialise(directories.select("directory", F.inline(above)), "ancestors")
    nearest = ancestors.join(materialise(declared, "declared"), "at").groupBy("directory").agg(
        F.max_by("given", "depth").alias("given"), F.max_by("license_path", "depth").alias("license_path"))
    out = own.withColumn("directory", directory).join(materialise(nearest, "nearest"), "directory", "left")
    is_own = F.col("license").isNotNull()
    return out.select(
        "id", "path", F.coalesce("license", "given").alias("license"), "score",
        F.when(is_own, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(is_own, F.col("path")).otherwise(F.col("license_path")).alias("license_path"),
    )
