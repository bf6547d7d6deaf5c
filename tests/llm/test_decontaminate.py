import random
import re

import numpy as np

from proofmill.llm import decontaminate
from proofmill.llm.decontaminate import RATE, approximate_find, leaks

from .data import AWKWARD, table

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def nearest(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (t != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items):
    return {(d, i, nearest(words(b), words(t))) for d, t in docs for i, b in items if words(b) and words(t) and nearest(words(b), words(t)) <= int(RATE * len(words(b)))}


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1])] = rng.choice([[], [f"new{rng.randrange(999)}"]])
    return w


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 15, 40, 60])))) for i in range(30)] + [(None, "a null id here"), (98, None), (99, " ,")]
    docs = list(AWKWARD)
    for d in range(150):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items[:30])[1])
            w = edited(rng, w, rng.randrange(len(w) // 3 + 1))
            at = rng.randrange(len(body))
            body[at:at] = w
        docs.append((1000 + d, ", ".join(body).upper() if d % 3 else "\n".join(body)))
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    got = leaks(table(spark, docs), benchmark).collect()
    want = brute(docs, items)
    found = {(r.doc_id, r.item_id, r.distance) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want)
    for r in got:
        text, item = next(words(t) for d, t in docs if d == r.doc_id), next(words(b) for i, b in items if i == r.item_id)
        stretch = text[r.start_word : r.end_word]
        assert nearest(item, stretch) == r.distance and abs(len(stretch) - len(item)) <= r.distance


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20))) for i in range(10)]
    docs = table(spark, [(i, "before " + items[i % 10][1] + " after") for i in range(30)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 45)
    assert sorted(map(tuple, leaks(docs, benchmark).collect())) == whole and len(whole) == 30


def test_out_of_reach(spark, monkeypatch):
    """Where the repetitions cannot reach the recall, every seed is checked: nothing is lost."""
    monkeypatch.setattr(decontaminate, "MOST", 1)
    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(30))) for i in range(12)]
    docs = [(i, " ".join(edited(rng, words(items[i % 12][1]), 6))) for i in range(60)]
    got = {(r.doc_id, r.item_id, r.distance) for r in leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) >= 60


def test_stage_keeps_columns_and_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(6)]
    rows = [(i, "before " + items[i][1] + " after") for i in range(3)] + [(50, None), (51, ""), (None, "clean"), (52, "clean"), (52, "clean")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows).selectExpr("*", "'mine' as item_id", "'mine' as distance")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 45)
    got = decontaminate.drop_leaking(docs, benchmark)
    assert got.columns == docs.columns and all(r.item_id == r.distance == "mine" for r in got.collect())
    assert sorted(str(r.doc_id) for r in got.collect()) == ["50", "51", "52", "52", "None"]
    assert decontaminate.drop_leaking(docs, benchmark.limit(0)).count() == len(rows)


def test_empty(spark):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert leaks(table(spark, []), benchmark).collect() == []
    assert leaks(table(spark, AWKWARD), benchmark.limit(0)).collect() == []


def test_nearest_stretch():
    x = np.arange(1, 40, dtype=np.uint64)
    assert approximate_find(x[10:20], x) == (0, 10, 20)
    assert approximate_find(np.delete(x[10:20], 4), x) == (1, 10, 20)
    assert approximate_find(x[:3], x[:0]) == (3, 0, 0)
