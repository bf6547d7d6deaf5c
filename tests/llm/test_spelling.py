import random
import re
import zlib
from collections import Counter

import pytest

from proofmill.llm import spelling
from proofmill.llm.spelling import Shard, Trie, spelling_variants

from .data import AWKWARD, table

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least_chars=6, least_count=5, ratio=5, every=199):
    counts = Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    form, out = {}, []
    close = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    for w, c in close.items():
        if c and words[c[0]] >= ratio * words[w]:
            form[w] = c[0]
    for w, n in words.items():
        last = w
        while last in form:
            last = form[last]
        out.append((w, form.get(w), last, n, len(close[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def compare(spark, rows, **more):
    found = spelling_variants(table(spark, rows), **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows, **{{"typo_every": "every"}.get(k, k): v for k, v in more.items()})


def varied(rng, base, n):
    """Texts of words with edits, frequent words and their variants, and variants of these."""
    rows = []
    for d in range(n):
        text = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aéz") + w[k:], w[:k] + rng.choice("aéz") + w[k + 1 :]])
            text.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((d, rng.choice([" ", ", ", "-", "\n", "1"]).join(text)))
    return rows


def test_variants(spark):
    rows = varied(random.Random(1), ["abcabc", "déjàvue", "letters", "aaaaaaa", "straße", "other÷words"], 150)
    compare(spark, rows)
    compare(spark, rows, typo_every=7, least_count=2, ratio=2)
    compare(spark, rows, typo_every=0, least_chars=3, least_count=1)


def test_small_shards_and_groups(spark, monkeypatch):
    """Many shards, several groups of them and small blocks of states change nothing."""
    rows = varied(random.Random(2), ["abcabc", "bcabca", "cabcab"], 100)
    monkeypatch.setattr(spelling, "STATES", 50)
    words = spelling.durable(spelling.word_counts(table(spark, rows)).filter("n >= 2"))
    whole = {tuple(r) for r in spelling.neighbours(words).collect()}
    assert whole and whole == {tuple(r) for r in spelling.neighbours(words, chars=60, most=5000).collect()}


def test_chains(spark):
    """Forms are followed to the last one over several steps."""
    chain = ["xxxxxxa", "xxxxxab", "xxxxabb", "xxxabbb", "xxabbbb", "xabbbbb"]
    # each word is one replacement away from the next; every count is five times the one before
    chain = ["xxxxxx" + "a" * k for k in range(6)]
    rows = [(0, " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1))))]
    found = {r["word"]: r["root"] for r in spelling_variants(table(spark, rows), typo_every=0).collect()}
    assert set(found.values()) == {chain[-1]} and len(found) == 6


def test_awkward(spark):
    compare(spark, [*AWKWARD, (None, "letters " * 40), (8, "letterz " * 5), (9, "é" * 3000 + " x" * 9)])
    assert spelling_variants(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(table(spark, []), ratio=1)


def test_long_text_is_cut_between_runs(spark):
    """Runs at any cut of a text beyond a megabyte, runs longer than that, and letters of two bytes there."""
    compare(spark, [(1, "ÀÉîõüÿ " * 180_000), (2, "é" * 700_000), (3, "-" * (1 << 20) + " letter" * 9)])


def test_trie():
    words = sorted({"a", "ab", "abc", "b", "ba", "é", "éa", ""})
    trie = Trie(words)
    shard = Shard(trie, words, None)
    codes, offsets = spelling._codes(words)
    found = {(p >> 32, p & 0xFFFFFFFF) for p in shard.neighbours(codes, offsets).tolist()}
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a != b and near(a, b)}
    assert shard.neighbours(*spelling._codes([])).tolist() == []
