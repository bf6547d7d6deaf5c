"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Runs of neighbouring segments of a file (lines, and sentences in them) are held against header
templates, the whole file against whole licence texts and their openings. A file without a
licence of its own takes that of the nearest directory above it that holds a licence file: a
file with the name of one that matches a licence. A licence pasted into another file covers that file alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.resources import files as resources

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import NOT_ALNUM, Words, found_in, hashes_of

#: Fixed values: (licence, text) of customary notices.
HEADERS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Licences whose whole texts lie in licence_texts.
WHOLE = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
#: Fixed values: (licence, opening text) of licence files, then (licence, whole text).
FILES: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    *((name, resources(__package__).joinpath("licence_texts", f"{name}.txt").read_text("utf-8")) for name in WHOLE),
)
#: Licences known from their notices alone that share nearly all of a whole text: (licence of that text, a term, how often it stands in the other one at least, the other one).
LIKENESSES = (("GPL-3.0", "affero", 6, "AGPL-3.0"),)
#: Goes along with open licences too: counts where no other licence matches.
WEAK = "Proprietary"
#: Cosine from which a segment or a whole file matches a template.
HEADER_AT, FILE_AT = 0.75, 0.6
TERMS = re.compile(rb"[a-z0-9]+").findall
SEGMENTS = regex.compile(r"\n|(?<=[.!?])[^\S\n]+").split
#: Comment marks that are words; others are no terms.
MARKS = re.compile(r"^[^\S\n]*(?:rem|dnl)\b", re.IGNORECASE | re.MULTILINE)
#: Names of licence files: one of these words, alone or beside others.
LICENCE_NAME = r"(?i)(^|[-_. ])(licen[cs]es?|unlicen[cs]e|copying|copyright|notice)([-_. ]|$)"
#: Rows whose terms are counted at once.
ROWS = 256


def terms(text: str) -> list[str]:
    """Runs of ASCII letters and digits, A-Z in lower case."""
    return [t.decode() for t in TERMS(text.encode("utf-8").lower())]


@dataclass
class Templates:
    """Template vectors of unit length over the templates' own terms, and the terms that every header needs one of."""

    idf: dict[str, float]
    unknown: float
    headers: list[tuple[str, dict[str, float]]] = field(init=False)
    files: list[tuple[str, dict[str, float]]] = field(init=False)
    cues: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.headers = [(name, self.vector(terms(t))) for name, t in HEADERS]
        self.files = [(name, self.vector(terms(t))) for name, t in FILES]
        self.header_terms = frozenset(t for _, v in self.headers for t in v)
        #: A run of segments beyond this holds more than a notice.
        self.longest = 2 * max(len(terms(t)) for _, t in HEADERS)
        # a text that shares only terms of a small part of a template's length with it cannot reach the cosine
        spare: set[str] = set()
        for term in sorted(self.header_terms, key=lambda t: (self.idf[t], t)):
            spare.add(term)
            if any(sum(w * w for t, w in v.items() if t in spare) >= HEADER_AT * HEADER_AT * 0.999 for _, v in self.headers):
                spare.discard(term)
        self.cues = self.header_terms - spare

    def vector(self, words: list[str]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf.get(t, self.unknown) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def best(self, words: list[str], group: list[tuple[str, dict[str, float]]], at: float) -> tuple[float, str] | None:
        """The highest cosine from ``at`` on and its licence; the first name of equals."""
        v = self.vector(words)
        found = [(-sum(w * q[t] for t, w in v.items() if t in q), name) for name, q in group]
        score, name = min((round(s, 12), n) for s, n in found)
        return (-score, name) if -score >= at else None

    def notices(self, text: str) -> Iterator[tuple[float, str]]:
        """Matches of single segments and of runs of neighbouring ones, such as the lines of a wrapped notice.

        A run begins and ends with segments that have a header's term: others would only draw the cosine down.
        """
        pieces = [p for s in SEGMENTS(MARKS.sub("", text)) if (p := terms(s))]
        ends = [not self.header_terms.isdisjoint(p) for p in pieces]
        cued = [not self.cues.isdisjoint(p) for p in pieces]
        for i, first in enumerate(ends):
            run: list[str] = []
            seen = False
            for j in range(i, len(pieces) if first else i):
                if j > i and len(run) + len(pieces[j]) > self.longest:
                    break
                run += pieces[j]
                seen |= cued[j]
                if seen and ends[j] and (x := self.best(run, self.headers, HEADER_AT)):
                    yield x

    def scan(self, text: str | None, whole: bool = True) -> tuple[str | None, str | None, float | None]:
        """(licence, "file" or "header", cosine) of a whole text; without ``whole`` it is known to be no licence file."""
        words = terms(text or "")
        if whole and words and (found := self.best(words, self.files, FILE_AT)):
            name = next((other for like, term, least, other in LIKENESSES if found[1] == like and words.count(term) >= least), found[1])
            return name, "file", found[0]
        if self.cues.isdisjoint(words):
            return None, None, None
        hits = list(self.notices(text))
        if not hits:
            return None, None, None
        _, score, name = min((n == WEAK, -s, n) for s, n in hits)
        return name, "header", -score


class Screen:
    """Which texts can be licence files and which can hold a notice, from the hashes of their words; none that can is left out."""

    def __init__(self, templates: Templates) -> None:
        known = list(templates.idf)
        keys = hashes_of(known, separators=NOT_ALNUM)
        order = np.argsort(keys)
        known = [known[k] for k in order]
        self.keys, self.unknown = keys[order], templates.unknown
        self.idf = np.array([templates.idf[t] for t in known])
        self.cue = np.array([t in templates.cues for t in known])
        self.files = np.array([[v.get(t, 0.0) for _, v in templates.files] for t in known])

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(can be a licence file, has a cue term) for each text."""
        term, size = found_in(hashes, self.keys), len(self.keys)
        ends = np.append(0, np.cumsum(counts))
        whole, cue = np.zeros(len(counts), bool), np.zeros(len(counts), bool)
        for a in range(0, len(counts), ROWS):
            n = len(counts[a : a + ROWS])
            part = term[ends[a] : ends[a + n]]
            doc = np.repeat(np.arange(n), counts[a : a + n])
            times = np.bincount(doc[part >= 0] * size + part[part >= 0], minlength=n * size).reshape(n, size)
            cue[a : a + n] = (times[:, self.cue] > 0).any(axis=1)
            weights = np.zeros((n, size))
            at = np.nonzero(times)
            weights[at] = (1 + np.log(times[at])) * self.idf[at[1]]
            # the other words weigh least when they are all the same
            others = counts[a : a + n] - times.sum(axis=1)
            least = np.where(others > 0, (1 + np.log(np.maximum(others, 1))) * self.unknown, 0.0)
            norm = np.sqrt((weights * weights).sum(axis=1) + least * least)
            whole[a : a + n] = (weights @ self.files).max(axis=1) >= (FILE_AT - 1e-6) * norm
        return whole & (counts > 0), cue


def template_terms() -> list[str]:
    return sorted({t for _, text in (*HEADERS, *FILES) for t in terms(text)})


def learn(docs: DataFrame) -> Templates:
    """Templates weighed by the document frequencies of their terms over all of ``docs``; one row a batch leaves the executors.

    Null and empty texts count as documents without terms, rows that repeat count again; an empty table gives all terms one weight; columns other than text are ignored.
    """
    known = template_terms()

    keys = hashes_of(known, separators=NOT_ALNUM)
    order = np.argsort(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, n = Words(separators=NOT_ALNUM), np.zeros(len(known), np.int64), 0
        for b in batches:
            n += len(b)
            for _, hashes, counts in hasher.of(b.column("text")):
                term = found_in(hashes, keys[order])
                doc = np.repeat(np.arange(len(counts)), counts)
                pairs = np.unique(doc[term >= 0] * len(known) + term[term >= 0])
                total += np.bincount(pairs % len(known), minlength=len(known))
        rows = [("", n), *((known[order[k]], int(c)) for k, c in enumerate(total) if c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    counted = dict(tuple(r) for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    n = counted.get("", 0)
    idf = {t: math.log((1 + n) / (1 + counted.get(t, 0))) + 1 for t in known}
    # a term of no template weighs like the median term of notices and openings: it draws the cosine down
    short = sorted(idf[t] for t in {t for _, text in (*HEADERS, *FILES[: -len(WHOLE)]) for t in terms(text)})
    return Templates(idf, short[len(short) // 2])


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, licence, how ("file", "header", "inherited"), score, licence_dir of each file.

    ``path`` is a string column over ``docs`` with "/" between directories; a
    null path is a file of the root. A file matches by its whole text or by the best run of its
    segments; without either it inherits from the nearest directory at or above
    its own that holds a licence file, which is one that matches and whose name says so (LICENCE_NAME; of several, the highest
    cosine, then the first licence), else its licence is null. Null and empty texts match nothing of
    themselves; repeated rows give repeated results; null doc_ids pass through.

    Inheritance joins directories, not files: each directory counts once, however many files it has.
    """
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: Templates = shared.value
        screen = Screen(templates)
        hasher = Words(separators=NOT_ALNUM)
        for b in batches:
            found = []
            # only texts that can match are scanned in full
            for n, hashes, counts in hasher.of(b.column("text")):
                whole, cue = screen.of(hashes, counts)
                found += [templates.scan(t.as_py(), w) if w or c else (None, None, None) for t, w, c in zip(b.column("text").slice(len(found), n), whole.tolist(), cue.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()),
            ], names=["doc_id", "path", "own", "how", "score"])

    scanned = durable(
        files.mapInArrow(run, "doc_id long, path string, own string, how string, score double")
        .withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    )
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_NAME)
    # tables of their own, so that adaptive execution can split a directory that holds most files, or that most directories are in
    licensed = durable(scanned.filter("own is not null").filter(named).groupBy("dir").agg(F.min_by("own", F.struct(-F.col("score"), F.col("own"))).alias("dir_licence"), F.max("score").alias("dir_score")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = scanned.select("dir").distinct().select("dir", F.inline(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(above)))
    nearest = durable(
        dirs.join(licensed.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir").agg(F.max_by(F.struct("dir_licence", "dir_score", "above"), "depth").alias("from"))
    )
    mine = F.col("own").isNotNull()
    return scanned.join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("own", "from.dir_licence").alias("licence"),
        F.when(mine, F.col("how")).when(F.col("from").isNotNull(), F.lit("inherited")).alias("how"),
        F.when(mine, F.col("score")).otherwise(F.col("from.dir_score")).alias("score"),
        F.when(~mine, F.col("from.above")).alias("licence_dir"),
    )
