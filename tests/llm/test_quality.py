import math
import random
import re

import numpy as np
import pyarrow as pa

from proofmill.llm import quality
from proofmill.llm.words import PUNCTUATION, SEPARATOR, hashes_of
from proofmill.llm.quality import OrdinalModel, grade_documents, learn, shapes

from .data import AWKWARD, table


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))]
        kind = i % 3
        if kind == 0:
            w = [x + "$$$" for x in w]
        elif kind == 1:
            w[3:6] = ["bad", "worse", "worst"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_grades(spark):
    rows, labels = corpus()
    docs = table(spark, rows)
    model = learn(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in grade_documents(docs, model).collect()}
    mean = [np.mean([got[d].expected_grade for d, q, t in labels[400:] if q + (q and not t) == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert sum(got[d].kept == bool(q) for d, q, _ in labels[400:]) >= 0.95 * len(labels[400:])
    odd = grade_documents(table(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in odd)


def test_nothing_to_learn(spark):
    model = learn(table(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.tail_probability for r in grade_documents(table(spark, [(1, "a b"), (2, None)]), model).collect()] == [0.5, 0.5]


def test_fit_beats_the_prior():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    rows = [(np.array([g, 10 + g % 2], np.int64), np.array([1.0, 1.0])) for g in grades]
    model = OrdinalModel.fit(rows, grades, 3)
    eta = [model.weights[r[0]].sum() for r in rows]
    assert np.mean([sum(p > 0.5 for p in model.tails(e)) == g for e, g in zip(eta, grades)]) > 0.95


def test_shapes():
    got = shapes(pa.array(["word Word", "", None, "WORD!!!!! x1&&", "Éa"]).slice(0))
    assert got.to_pylist() == [b"a Aa", b"", b"", b"A! a0&", b"a"]


def loss(weights, cuts, rows, grades):
    """Mean negative log likelihood of the cumulative-link model and the ridge, by their definition."""
    edges = [-math.inf, *cuts, math.inf]
    below = lambda t, eta: 0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(eta - t))
    total = 0.0
    for (ids, values), g in zip(rows, grades, strict=True):
        eta = sum(v * weights[i] for i, v in zip(ids, values, strict=True))
        total -= math.log(max(1e-12, below(edges[g + 1], eta) - below(edges[g], eta)))
    return total / len(rows) + quality.RIDGE / 2 * sum(w * w for w in weights.values())


def test_fit_is_the_least_loss():
    """No step along any weight or threshold makes the loss of the definition smaller, and plain gradient descent ends there too."""
    rng = random.Random(12)
    grades, rows = [], []
    for _ in range(120):
        g = rng.randrange(3)
        ids = sorted(rng.sample(range(6), 3))
        rows.append((np.array(ids, np.int64), np.array([rng.random() + (0.7 * g if i == 0 else 0) for i in ids])))
        grades.append(g)
    model = OrdinalModel.fit(rows, np.array(grades), 3)
    weights, cuts = {i: float(model.weights[i]) for i in range(6)}, [float(t) for t in model.thresholds]
    best = loss(weights, cuts, rows, grades)
    for step in (0.05, 0.3):
        for sign in (-1, 1):
            for i in weights:
                assert loss(weights | {i: weights[i] + sign * step}, cuts, rows, grades) > best - 1e-4
            for k in range(2):
                assert loss(weights, [c + sign * step * (j == k) for j, c in enumerate(cuts)], rows, grades) > best - 1e-4
    w, c = dict.fromkeys(range(6), 0.0), [-0.5, 0.5]
    for _ in range(400):
        at = loss(w, c, rows, grades)
        gw = {i: (loss(w | {i: w[i] + 1e-5}, c, rows, grades) - at) / 1e-5 for i in w}
        gc = [(loss(w, [x + 1e-5 * (j == k) for j, x in enumerate(c)], rows, grades) - at) / 1e-5 for k in range(2)]
        w, c = {i: w[i] - 2.0 * gw[i] for i in w}, [x - 2.0 * g for x, g in zip(c, gc, strict=True)]
    assert best <= loss(w, c, rows, grades) + 1e-3


def test_grades_by_definition(spark):
    """Expected grade and tail probability from features counted in plain Python."""
    rows, labels = corpus(90)
    model = learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [*rows, (1000, "Same same same ä-b 12,5 !!!"), (1001, None), (1002, "...")]
    for r in grade_documents(table(spark, texts), model).collect():
        text = next(t for d, t in texts if d == r.doc_id) or ""
        words, tokens = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text), re.findall(r"[^\x20\x09-\x0D]+", text)
        looks = [x.decode("utf-8", "surrogateescape") for x in shapes(pa.array([text])).to_pylist()[0].split()]
        eta = 0.0
        for kind, found, separators, lower in ((1, words, PUNCTUATION, True), (2, looks, SEPARATOR, False)):
            for h in hashes_of(found, lower, separators):
                eta += quality.SCALE / len(found) * model.weights[int(h ^ np.uint64(kind)) % (quality.BUCKETS - 2)]
        eta += model.weights[quality.REPEATED] * quality.SCALE * sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, len(tokens))
        eta += model.weights[quality.EMPTY] * quality.SCALE * (not tokens)
        tails = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        assert math.isclose(r.expected_grade, sum(tails), abs_tol=1e-6) and math.isclose(r.tail_probability, tails[quality.SELECT - 1], abs_tol=1e-6), text
