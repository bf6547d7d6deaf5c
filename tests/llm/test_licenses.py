import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofmill.llm.licenses import FILE_AT, FILES, HEADER_AT, HEADERS, SEGMENTS, Templates, learn, scan, template_terms, terms

from .data import AWKWARD, SCHEMA

MIT_FILE, GPL_FILE = FILES[0][1], FILES[2][1]
ROWS = [
    (0, "A text.\nReleased under the MIT License.\nMore text here.", "a/x.txt"),
    (1, "plain words", "a/b/c/y.txt"), (2, MIT_FILE + "\nCopyright someone 2020", "a/LICENSE"), (3, GPL_FILE, "a/b/COPYING"),
    (4, "plain words too", "a/bc/z.txt"), (5, "nothing above", "other/z.txt"), (6, "root file", "z.txt"), (7, "This work is licensed under the GNU General Public License, version 3.", "other/n.txt"),
    (8, "We had a license to drive and all rights to do so.", None), (9, "Intro. Licensed under CC BY-NC 4.0. Outro follows", "q/x"), (9, "Intro. Licensed under CC BY-NC 4.0. Outro follows", "q/x"),
    (None, "no id", "a/b/n"), (10, None, "a/b/c/d/e"),
]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, p, None) for d, t, p in rows], SCHEMA).selectExpr("*", "'x' as path", "'y' as dir", "'z' as score")


def test_scan(spark):
    got = {(r.doc_id, r.path): (r.licence, r.how, r.licence_dir) for r in scan(docs(spark, ROWS), F.col("source")).collect()}
    assert got == {
        (0, "a/x.txt"): ("MIT", "header", None), (1, "a/b/c/y.txt"): ("GPL-3.0", "inherited", "a/b"), (2, "a/LICENSE"): ("MIT", "file", None), (3, "a/b/COPYING"): ("GPL-3.0", "file", None),
        (4, "a/bc/z.txt"): ("MIT", "inherited", "a"), (5, "other/z.txt"): (None, None, None), (6, "z.txt"): (None, None, None), (7, "other/n.txt"): ("GPL-3.0", "header", None),
        (8, ""): (None, None, None), (9, "q/x"): ("CC-BY-NC-4.0", "header", None), (None, "a/b/n"): ("GPL-3.0", "inherited", "a/b"), (10, "a/b/c/d/e"): ("GPL-3.0", "inherited", "a/b"),
    }


def test_root_licence_covers_all(spark):
    got = scan(docs(spark, [(0, MIT_FILE, "LICENSE"), (1, "x", "deep/er/f"), (2, "y", "g")]), F.col("source")).collect()
    assert {(r.doc_id, r.licence, r.licence_dir) for r in got} == {(0, "MIT", None), (1, "MIT", ""), (2, "MIT", "")}


def test_awkward(spark):
    assert len(scan(docs(spark, [(d, t, None) for d, t in AWKWARD]), F.col("source")).collect()) == len(AWKWARD)
    assert scan(docs(spark, []), F.col("source")).collect() == []


def test_cue_terms_lose_no_match(spark):
    """A text without any cue term is below every cosine: with and without the shortcut the scan is the same."""
    t = learn(docs(spark, ROWS))
    slow = Templates(t.idf, t.unknown)
    slow.cues = frozenset(t.idf)
    texts = [r[1] for r in ROWS] + ["the of and under this", "under the terms of the", "this is free", "all the rights"]
    assert [t.scan(x) for x in texts] == [slow.scan(x) for x in texts]
    assert len(t.cues) < len(t.idf)


def test_cosines(spark):
    t = learn(docs(spark, ROWS))
    df = Counter(x for r in ROWS if r[1] for x in set(terms(r[1])) & set(template_terms()))
    assert all(math.isclose(t.idf[x], math.log((1 + len(ROWS)) / (1 + df[x])) + 1) for x in t.idf)

    def cosine(a, b):
        va, vb = t.vector(terms(a)), t.vector(terms(b))
        return sum(w * vb.get(x, 0) for x, w in va.items())

    for _, text, _ in ROWS:
        if text:
            whole = max((round(cosine(text, b), 12), n) for n, b in FILES)
            parts = max((round(cosine(s, b), 12) for s in SEGMENTS(text) for _, b in HEADERS), default=0)
            _, how, score = t.scan(text)
            assert (how, score) == (("file", whole[0]) if whole[0] >= FILE_AT else ("header", parts) if parts >= HEADER_AT else (None, None))


def test_whole_licence_texts_are_files_and_inherited(spark):
    """Real texts, not the openings: each is a file of its own licence, and what lies below inherits it."""
    from pathlib import Path

    import proofmill.llm.licenses as licenses

    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "licence_texts").glob("*.txt")}
    assert set(texts) == set(licenses.WHOLE) and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows = [(k, f"Copyright (c) 2020 Some One. All rights reserved.\n\n{t}", f"{name}/COPYING") for k, (name, t) in enumerate(sorted(texts.items()))]
    rows += [(100 + k, "plain words", f"{name}/deep/x") for k, name in enumerate(sorted(texts))]
    got = {r.path: (r.licence, r.how) for r in scan(docs(spark, rows), F.col("source")).collect()}
    assert got == {f"{n}/COPYING": (n, "file") for n in texts} | {f"{n}/deep/x": (n, "inherited") for n in texts}


def test_vectors_against_the_definition(spark):
    """Cosines from plain sums: tf 1 + ln n, idf as learnt, terms of no template under one weight."""
    import re

    t = learn(docs(spark, ROWS))

    def cosine(a, b):
        x, y = (Counter(re.findall("[a-z0-9]+", s.lower())) for s in (a, b))
        weigh = lambda c, w: (1 + math.log(c[w])) * t.idf.get(w, t.unknown) if c[w] else 0.0
        words = sorted(set(x) | set(y))
        dot = sum(weigh(x, w) * weigh(y, w) for w in words)
        return dot / math.sqrt(sum(weigh(x, w) ** 2 for w in words)) / math.sqrt(sum(weigh(y, w) ** 2 for w in words))

    for text in (MIT_FILE, GPL_FILE, *(f"{h} and a few words more" for _, h in HEADERS[:6])):
        for group, at in ((HEADERS, HEADER_AT), (FILES, FILE_AT)):
            vectors = t.headers if group is HEADERS else t.files
            want = [(cosine(text, b), n) for n, b in group]
            got = t.best(terms(text), vectors, at)
            top = max(c for c, _ in want)
            assert (got is None and top < at) or (math.isclose(got[0], top, abs_tol=1e-9) and got[1] in {n for c, n in want if math.isclose(c, top, abs_tol=1e-9)})


def test_affero_is_told_from_the_text_that_it_shares(spark):
    gpl = next(t for n, t in FILES if n == "GPL-3.0" and len(t) > 10_000)
    affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")
    got = scan(docs(spark, [(1, gpl, "a/COPYING"), (2, affero, "b/COPYING")]), F.col("source")).collect()
    assert {(r.doc_id, r.licence, r.how) for r in got} == {(1, "GPL-3.0", "file"), (2, "AGPL-3.0", "file")}


def test_wrapped_notices(spark):
    import textwrap

    from proofmill.llm.licenses import HEADERS

    wanted = [(name, t) for name, t in HEADERS if len(terms(t)) > 30]
    assert {"GPL-3.0", "GPL-2.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0"} <= {n for n, _ in wanted}
    rows, want = [], {}
    for name, t in wanted:
        for width in (40, 70, 80):
            for mark in ("", "# ", " * ", "// ", "dnl "):
                lines = [mark + x for x in textwrap.wrap(t, width)]
                want[len(rows)] = (name, "header")
                rows.append((len(rows), "\n".join([mark + "A tool of ours.", mark.rstrip(), *lines, mark.rstrip(), "int main() { return 0; }"]), f"f/{len(rows)}"))
    got = {r.doc_id: (r.licence, r.how) for r in scan(docs(spark, rows), F.col("source")).collect()}
    assert got == want


def test_all_rights_reserved_yields_to_a_licence(spark):
    rows = [(0, "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "a"), (1, "Copyright 2009 X. All rights reserved.", "b")]
    assert {(r.doc_id, r.licence) for r in scan(docs(spark, rows), F.col("source")).collect()} == {(0, "BSD-3-Clause"), (1, "Proprietary")}


def test_screen_leaves_out_no_match(spark):
    """The hashed screen before the scan changes nothing."""
    t = learn(docs(spark, ROWS))
    texts = [r[1] or "" for r in ROWS] + [x[:n] for _, x in FILES for n in (200, 1000, 5000, 40000)] + ["word " * 300, "the of and " * 300]
    rows = [(k, x, f"{k}/f") for k, x in enumerate(texts)]
    learned = learn(docs(spark, rows))
    got = {r.doc_id: (r.licence, r.how, r.score) for r in scan(docs(spark, rows), F.col("source")).collect()}
    assert got == {k: learned.scan(x) for k, x in enumerate(texts)} and t.cues


def test_pasted_licences_cover_their_file_alone(spark):
    rows = [
        (0, FILES[0][1], "a/post.html"), (1, "plain", "a/x"), (2, "Licensed under CC BY 4.0.", "b/LICENSE.md"), (3, "plain", "b/c/d/x"), (4, "plain", "b/x"), (5, "plain", "LICENSES.txt"),
        (6, "Released under the MIT License.", "b/c/COPYING"), (7, "SPDX-License-Identifier: MIT", "d/licensed_work.py"), (8, "plain", "d/x"), (9, "Licensed under CC BY 4.0.", "d/MIT-LICENSE"),
    ]
    got = {r.doc_id: (r.licence, r.how, r.licence_dir) for r in scan(docs(spark, rows), F.col("source")).collect()}
    assert got == {
        0: ("MIT", "file", None), 1: (None, None, None), 2: ("CC-BY-4.0", "header", None), 3: ("MIT", "inherited", "b/c"), 4: ("CC-BY-4.0", "inherited", "b"), 5: (None, None, None),
        6: ("MIT", "header", None), 7: ("MIT", "header", None), 8: ("CC-BY-4.0", "inherited", "d"), 9: ("CC-BY-4.0", "header", None),
    }


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_inherits_as_by_hand(spark):
    """Own matches as the operator's definition gives them, then the nearest licence file by walking up each path."""
    from proofmill.llm.common import read
    from proofmill.llm.queries import op6_licenses, stand_in_path

    documents = read(spark, "/root/testdata/sf0.01", "documents")
    rows = documents.select("doc_id", stand_in_path(documents).alias("path")).collect()
    # a path of its own for each text, under no licence file: what the operator finds in the text itself
    alone = scan(documents, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/x")))
    found = {r.doc_id: (r.licence, r.how, r.score) for r in alone.collect()}
    own = {r.doc_id: (*found[r.doc_id], r.path) for r in rows}
    licensed = {}
    for d, (name, _, score, path) in own.items():
        folder, _, file = path.rpartition("/")
        if name and file == "LICENSE":
            licensed[folder] = min(licensed.get(folder, (1, "")), (-score, name))
    want = {}
    for d, (name, how, score, path) in own.items():
        folder = path.rpartition("/")[0]
        while name is None and folder and folder not in licensed:
            folder = folder.rpartition("/")[0]
        want[d] = (name, how) if name else (licensed[folder][1], "inherited") if folder in licensed else (None, None)
    got = {r.doc_id: (r.licence, r.how) for r in op6_licenses(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(h == "inherited" for _, h in got.values()) >= 20
