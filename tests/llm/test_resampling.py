import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from proofmill.llm import resampling
from proofmill.llm.resampling import Tournament, resample
from proofmill.llm.runs import CHUNK, crc32, find_runs

from .data import AWKWARD, table

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORDS.findall((text or "").translate(CAPITALS))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def expected(rows, target, num=10, den=100, least=20, longest=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text, longest)[0]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for k, (doc, text) in enumerate(rows):
        f, words = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, words >= least, k])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(order[: num * len(order) // den], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def compare(spark, rows, target, **more):
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = resample(table(spark, rows), goal, **more)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    names = {"least_words": "least"}
    want = expected(rows, target, **{names.get(k, k): v for k, v in more.items()})
    # rows that repeat a doc_id and text share their ranks in any order
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "naïve", "数据"]
    return [(d, rng.choice([" ", "-", "\n", "'"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for d in rng.sample(range(10_000), n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_against_the_definition(spark, longest):
    rows = corpus(random.Random(longest), 300)
    compare(spark, rows, ["w1 w2 w3 Été 数据", None, "", "W1 w7"], longest=longest)


def test_ranges_and_runs(spark, monkeypatch):
    """Ranges of a few rows, whole draws and none."""
    rows = corpus(random.Random(5), 400)
    monkeypatch.setattr(resampling, "ROWS_PER_RANGE", 7)
    for ranges in (1, 60):
        monkeypatch.setattr(resampling, "LEAST_RANGES", ranges)
        for num in (0, 33, 100):
            compare(spark, rows, ["w1 w2"], num=num)


def test_ties(spark):
    """One text and few different ids: scores tie, ids decide; rows that repeat get ranks of their own."""
    text = "same words " * 20
    rows = [(d % 7, text) for d in range(140)] + [(None, text)] * 9
    compare(spark, rows, ["words"], num=50)


def test_awkward(spark):
    compare(spark, [*AWKWARD, (8, "x " * 30), (9, "\x00a{b" * 30)], ["word"], num=50)
    compare(spark, AWKWARD, [], num=100, least_words=1)
    compare(spark, [], ["word"])


def test_tournament():
    rng = random.Random(1)
    for k in (1, 2, 3, 8, 13):
        runs = [sorted(bytes([rng.randrange(9), rng.randrange(9)]) for _ in range(rng.randrange(12))) for _ in range(k)]
        tree, out = Tournament(runs), []
        for _ in range(sum(map(len, runs))):
            run, index = tree.take()
            out.append(runs[run][index])
        assert out == sorted(x for r in runs for x in r)


def test_crc_of_runs():
    """Short and long runs, continued from another text, over pieces of a long text."""
    texts = ["Ab cd", None, "", "x" * 300 + " Y", "é" * (CHUNK // 2 + 50) + " end", " ".join(["word"] * (CHUNK // 3))]
    got = []
    for found in find_runs(pa.array(texts), lambda b: resampling.MEMBER[b]):
        start = zlib.crc32(b"7:")
        crc = crc32(found, resampling.np.full(len(found.starts), start, resampling.np.uint32))
        got += list(zip(found.rows.tolist(), crc.tolist()))
    want = [(k, zlib.crc32(b"7:" + w.encode())) for k, t in enumerate(texts) for w in WORDS.findall((t or "").translate(CAPITALS))]
    assert got == want
