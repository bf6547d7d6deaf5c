import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import neardup
from proofmill.llm.components import connected_components
from proofmill.llm.neardup import near_duplicates
from proofmill.llm.words import CHUNK, Words, shingles

import pyarrow as pa

from . import brute
from .data import AWKWARD, table


def expected(rows, k):
    out = []
    for i, (n, least) in brute.near_duplicates(rows, k).items():
        out.append((rows[i][0], n, least, rows[i][0] == least))
    return sorted(map(repr, out))


def compare(spark, rows, k):
    got = near_duplicates(table(spark, rows), words=k).collect()
    assert sorted(map(repr, map(tuple, got))) == expected(rows, k)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_awkward(spark, k):
    compare(spark, [*AWKWARD, (20, "One  TWO\nthree"), (21, "solo"), (22, "SOLO"), (23, "É a"), (24, "é a"), (25, "\x1d a"), (26, " a")], k)


def test_empty(spark):
    assert near_duplicates(table(spark, [])).collect() == []


def test_copies_of_copies(spark):
    """Chains and stars whose members are not all alike, in ids that put any of them first."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 300]))]
        ids = rng.sample(range(g * 1000, g * 1000 + 900), 30)
        for i in ids[:15]:
            rows.append((i, edited(rng, base, max(1, len(base) // 30))))
        chain = base
        for i in ids[15:]:
            chain = edited(rng, chain, max(1, len(base) // 25)).split()
            rows.append((i, " ".join(chain)))
    rows += [(50_000 + i, " ".join(f"c{rng.randrange(40)}" for _ in range(30))) for i in range(200)]
    rng.shuffle(rows)
    compare(spark, rows, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_words_match_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "\x1f", "\x85", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", None, "w " * CHUNK, "z" * (2 * CHUNK + 5), ("long" * 300_000 + " ") * 3]
    got = [s for n, h, c in Words().of(pa.array(texts)) for s in shingles(h, c, 1)]
    assert [len(s) for s in got] == [len(brute.shingle_set(t, 1)) for t in texts]
    one = {}
    for t in texts:
        for s in ([] if not t else [t]):
            h = shingles(*next(Words().of(pa.array([s])))[1:], 2)[0]
            assert one.setdefault(h.tobytes(), brute.shingle_set(s, 2)) == brute.shingle_set(s, 2)


def test_signatures_estimate_similarity():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = neardup.signatures([x, x[200:], x[:10]], 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
    assert (sig[0] == sig[2]).mean() < 0.05


def test_block_links_at_the_threshold():
    """Sets of 80 and 100 at exactly 0.8, whose shingles agree in their upper or lower halves, are linked; one shingle less is not."""
    for shift in (0, 32):
        x = (np.arange(100, dtype=np.uint64) + np.uint64(1)) << np.uint64(shift)
        # the least two differ in the other half alone
        x[1] = x[0] ^ (np.uint64(1) << np.uint64(32 - shift if shift == 0 else 0))
        x = np.unique(x)
        assert len(x) == 100
        subset = np.delete(x, np.arange(50, 70))
        assert neardup.links_in_block([x, subset], [b"a", b"b"], [2, 2], 80, 100) == [(0, 1)]
        assert neardup.links_in_block([x, subset[1:]], [b"a", b"b"], [2, 2], 80, 100) == []


def test_every_pair_of_an_open_bucket(spark, monkeypatch):
    """Buckets of many unlike members of many sizes, cut into chunks of a few members."""
    monkeypatch.setattr(neardup, "CHUNK_MEMBERS", 4)
    rng = random.Random(11)
    rows = []
    for g in range(6):
        shared = [f"s{g}x{k}" for k in range(60)]
        for i in range(60):
            own = [f"o{g}y{rng.randrange(10**6)}" for _ in range(rng.choice([1, 5, 10, 14, 15, 16, 30, 60, 90]))]
            rows.append((len(rows), " ".join(shared + own)))
    rng.shuffle(rows)
    compare(spark, rows, 2)


def test_size_classes(spark):
    pairs = [(n, -(-n * 80 // 100)) for n in range(1, 20_000, 7)] + [(125 * 5**k, 100 * 5**k) for k in range(8)]
    for a, b in spark.createDataFrame(pairs, "a long, b long").select(neardup._size_class(F.col("a"), 80, 100), neardup._size_class(F.col("b"), 80, 100)).collect():
        assert 0 <= a - b <= 1


def test_columns_of_the_caller(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "a b c d e f g"), (5, "")]
    names = ("doc", "text_hash", "_doc", "_hash", "h", "g", "node", "component", "bucket", "component_id", "n_shingles")
    df = table(spark, rows).drop("h")
    for name in names:
        df = df.withColumn(name, F.lit(f"mine {name}"))
    got = neardup.drop_near_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "5"]
    assert all(r[name] == f"mine {name}" for r in got for name in names) and all(r.kept == "x" for r in got)
