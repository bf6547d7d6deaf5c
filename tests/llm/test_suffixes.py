import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import suffixes
from proofmill.llm.suffixes import RUN, Runs, equal_bytes, merged, pack, repeat_digests, repeated_windows, settle, unpack

from . import brute
from .data import AWKWARD, table


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(10, 120))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts.insert(rng.randrange(len(parts)), s[a : a + rng.randrange(1, 400)])
        rows.append((i * 3 + 1, "\n".join(parts)))
    rows += [(1000, rows[0][1]), (0, rows[5][1]), (1001, "ab" * 200), (1002, "=" * 150), (1003, "=" * 99), (1004, "x" + "=" * 120 + "y")]
    return rows


def compare(spark, rows, length=100):
    want = [(d, len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for (d, k, n), t in zip(brute.repeated_bytes(rows, length), [(t or "").encode() for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))], strict=True)]
    got = [tuple(r)[:5] for r in repeat_digests(table(spark, rows), length).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("seed,length", [(1, 100), (2, 100), (3, 20), (4, 7)])
def test_against_brute_force(spark, seed, length):
    compare(spark, corpus(seed), length)


def test_hot_anchors(spark, monkeypatch):
    """Passages with other words around them each time, under an anchor that counts as hot: the windows of such anchors are dealt one by one."""
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = corpus(7, 40) + [(5000 + i, f"{rng.random()}{shared}{rng.choice(['one end', 'two ends'])} " + "x" * rng.randrange(60)) for i in range(300)]
    key = hot_keys(rows)
    assert len(key)
    monkeypatch.setattr(suffixes, "_hot_anchors", lambda matched: key)
    compare(spark, rows)


def hot_keys(rows):
    """The anchors of more than 20 runs."""
    data, offsets = suffixes.text_bytes(pa.array([t for _, t in rows]))
    runs = np.concatenate([x for x, _, _ in Runs(100, np.empty(0, np.uint64)).of(data, offsets, np.array([d for d, _ in rows], np.int64), np.zeros(len(rows), np.uint64))])
    keys, n = np.unique(runs["key"], return_counts=True)
    return keys[n > 20]


def test_counts_of_hot_anchors(monkeypatch):
    """However the rows of a bin come, the hot anchors of it are found and the other runs kept."""
    monkeypatch.setattr(suffixes, "HOT_CLASSES", 5)
    runs = np.zeros(60, RUN)
    runs["key"] = [1] * 20 + [2] * 6 + [*range(100, 134)]
    runs["lo"] = np.arange(60)
    held = [(0, pack(runs[a : a + 9])) for a in range(0, 60, 9)] + [(1, b"spans")]
    whole = suffixes._counted(held)
    piecewise = []
    for x in held:
        piecewise = suffixes._counted([*piecewise, x]) if x[0] == 0 else [*piecewise, x]
    for found in (whole, piecewise):
        keys = {int(k) for kind, d in found if kind == 3 for k in unpack(d, suffixes.COUNT)["key"]}
        left = np.concatenate([unpack(d, RUN) for kind, d in found if kind == 0])
        assert keys == {1, 2} and (1, b"spans") in found
        assert {int(k) for k in left["key"]} == {*range(100, 134)}


def test_awkward(spark):
    rows = [r for r in AWKWARD if r[0] != 4] + [(8, "é" * 300), (9, "z" + "word " * 100)]
    compare(spark, rows)
    assert repeat_digests(table(spark, [])).collect() == []


def test_repeated_rows_are_one_document(spark):
    text = " ".join(map(str, range(100)))
    got = repeat_digests(table(spark, [(1, text), (1, text), (2, text), (1, "another " + text)])).collect()
    removed = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got)
    n = len(text)
    # of the two texts under doc_id 1 a hash says which comes first
    assert removed in ([(1, n, 0), (1, n, 0), (1, n + 8, n), (2, n, n)], [(1, n, n), (1, n, n), (1, n + 8, 0), (2, n, n)])


def test_long_texts_are_scanned_in_parts(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc ") for _ in range(5000))
    text = text[:2000] + text[100:900] + text[2000:]
    find = lambda: np.concatenate([x for x, _, _ in Runs(100, np.empty(0, np.uint64)).of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int64), np.zeros(1, np.uint64))])
    whole = find()
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    parts = find()
    for runs in (whole, parts):
        assert sorted(x for r in runs for x in range(int(r["lo"]), int(r["lo"]) + int(r["len"]))) == [*range(len(text) - 99)]


def test_refinement_finds_equal_windows():
    rng = random.Random(9)
    for _ in range(30):
        length = rng.choice([3, 4, 5, 8, 13, 100])
        contexts = [bytes(rng.choice(b"ab") for _ in range(length + rng.randrange(40))) for _ in range(20)]
        places = [(rng.randrange(5), rng.randrange(1000)) for _ in contexts]
        got = repeated_windows(np.frombuffer(b"".join(contexts), np.uint8), np.array([*map(len, contexts)]), np.array([p[0] for p in places]), np.zeros(20, np.uint64), np.array([p[1] for p in places], np.uint64), length)
        windows = [(c[i : i + length], d, lo + i) for c, (d, lo) in zip(contexts, places) for i in range(len(c) - length + 1)]
        first = {}
        for w, d, p in windows:
            first[w] = min(first.get(w, (d, p)), (d, p))
        assert sorted(zip(got["doc"].tolist(), got["lo"].tolist())) == sorted((d, p) for w, d, p in windows if (d, p) != first[w])


def test_small_parts():
    runs = np.zeros(3, RUN)
    runs["doc"], runs["lo"], runs["len"] = [2, 1, 2], [5, 9, 5], 3
    assert (unpack(pack(runs), RUN) == runs).all()
    first, rest = (runs[x] for x in settle(runs, np.zeros(200, np.uint8), np.array([0, 102, 0]), 10))
    assert first["doc"].tolist() == [1] and rest["doc"].tolist() == [2]
    assert [x.tolist() for x in merged(runs, 4)] == [[5], [15]]


def test_equal_hashes_of_different_bytes(spark, monkeypatch):
    """With hashes that say that everything is equal, bytes still decide: in a task and over tasks."""
    scan = Runs._scan

    def one_hash(self, *args):
        found, data, at = scan(self, *args)
        found["key"], found["ctx"] = 7, 7
        return found, data, at

    monkeypatch.setattr(Runs, "_scan", one_hash)
    rows = corpus(5, 25)
    data, offsets = suffixes.text_bytes(pa.array([t for _, t in rows]))
    doc = np.array([d for d, _ in rows], np.int64)
    found = [*Runs(100, np.empty(0, np.uint64)).of(data, offsets, doc, np.zeros(len(rows), np.uint64))]
    runs, part, at = found[0]
    first, rest = (runs[x] for x in settle(runs, part, at, 100))
    body = lambda r: part[int(at[np.flatnonzero((runs["doc"] == r["doc"]) & (runs["lo"] == r["lo"]))[0]]) :][: int(r["len"]) + 99].tobytes()
    kept = {body(r) for r in first}
    assert len(rest) and all(body(r) in kept for r in rest)
    # what tasks send on is refined on bytes alone
    contexts = [part[int(a) :][: int(r["len"]) + 99] for r, a in zip(runs, at)]
    got = repeated_windows(np.concatenate(contexts), np.array([*map(len, contexts)]), runs["doc"], runs["dh"], runs["lo"], 100)
    texts = dict(rows)
    want = brute.repeated_bytes(rows, 100)
    gone = {d: len((texts[d] or "").encode()) - len(k) for d, k, _ in want}
    for d in gone:
        mine = np.zeros(0, suffixes.SPAN) if not len(got) else got[got["doc"] == d]
        lo, hi = merged(mine, 100)
        assert int((hi - lo).sum()) == gone[d]


def test_equal_bytes(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    a, b, n = rng.integers(0, 3900, 500), rng.integers(0, 3900, 500), rng.integers(1, 12, 500)
    want = [data[x : x + k].tobytes() == data[y : y + k].tobytes() for x, y, k in zip(a, b, n)]
    for at_once in (1, 50, 1 << 22):
        monkeypatch.setattr(suffixes, "COMPARED", at_once)
        assert equal_bytes(data, a, b, n).tolist() == want
