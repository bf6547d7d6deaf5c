import math
import random
import zlib
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from proofmill.llm import toxicity
from proofmill.llm.sampling import held_out
from proofmill.llm.toxicity import ToxicModel, learn, maximal_segments, score_documents

from .data import AWKWARD, table


def brute_segments(scores):
    """Maximal segments by their recursive definition: the best segment (shortest of equals), then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] or total == best[0] and j - i < best[2] - best[1] - 1):
                best = total, i, j + 1
    if best is None:
        return []
    s, i, j = best
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, x) for a, b, x in brute_segments(scores[j:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-5, -3, -2, -1, 1, 2, 4, 7]), max_size=16))
def test_segments(scores):
    got = maximal_segments(scores)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in brute_segments(scores))
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in brute_segments(scores)), default=0)
    assert all(sum(scores[a:b]) == s > 0 for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_segments_with_their_bounds():
    """Without ties the segments are the definition's, one by one."""
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.uniform(-3, 2.5) for _ in range(rng.randrange(30))]
        got, want = maximal_segments(scores), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want, strict=True))


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["down", "known", "close", "clock", "town"]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(body) - 5)
            for k in range(4):
                body[at + k] = rng.choice(["nasty", "vile", "foul", "grim"]) + rng.choice(["", "ly", "er"])
            body[rng.randrange(len(body))] = "clown"
            body[rng.randrange(len(body))] = "uglimor" + "".join(rng.choice("aeiou") for _ in range(3))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return rows, labels


class Plain:
    """The same model by its definition, in plain Python, from all rows and their labels."""

    def __init__(self, rows, labels):
        truth = dict(labels)
        seen = set()
        self.texts = [(self.tokens(t), truth[d]) for d, t in rows if t is not None and d in truth]
        for w, grade in self.texts:
            p = ["", *w, ""]
            seen |= {(p[i], grade, p[i - 1], p[i + 1]) for i in range(1, len(p) - 1)}
        self.count = {g: Counter(t for t, grade, *_ in seen if grade == g) for g in (0, 1)}
        n = {g: sum(self.count[g].values()) for g in (0, 1)}
        self.rate = n[1] / (n[0] + n[1])
        types = {t: self.count[1][t] / (self.count[1][t] + self.count[0][t]) for t in {t for t, *_ in seen}}
        base = sum(types.values()) / len(types)
        of = {}
        for t, share in types.items():
            for a in self.affixes(t):
                of.setdefault(a, []).append(share)
        self.shares = {}
        for a, x in of.items():
            k, m = sum(x), len(x)
            if m >= 4:
                g = sum(2 * o * math.log(o / e) for o, e in ((k, m * base), (m - k, m * (1 - base))) if o > 1e-12)
                if g >= 4.5**2:
                    self.shares[a] = g, (k + 4 * base) / (m + 4)
        weights = [(self.weight(t), c) for t, c in self.count[0].items()]
        high = [self.weight(t) for t in types if self.weight(t) > 0 and self.weight(t) != self.weight(t, known=False)]
        weights = [(round(x + 0.3, 3) - 0.3, c) for x, c in weights] + [(x, 1 / len(high)) for x in high]
        total = sum(c for _, c in weights)
        low, up = 1e-6, 50.0
        for _ in range(80):
            mid = (low + up) / 2
            low, up = (mid, up) if sum(c * math.exp(mid * x) for x, c in weights) < total else (low, mid)
        self.scale = up
        calm = [self.scale * max((s for *_, s in self.segments(w)), default=0) - math.log(max(1, len(w))) for w, g in self.texts if not g]
        self.log_k = sum(calm) / len(calm) - 0.5772156649015329

    @staticmethod
    def tokens(text):
        return regex.findall(r"\w+", text.lower())

    @staticmethod
    def affixes(t):
        return [x for k in range(3, 9) if k < len(t) for x in ("^" + t[:k], "$" + t[-k:])]

    def weight(self, t, known=True):
        near = max((self.shares[a] for a in self.affixes(t) if a in self.shares), default=(0, self.rate))[1]
        a1, a0 = ((self.count[g][t] if known else 0) + 8 * p for g, p in ((1, near), (0, 1 - near)))
        odds = math.log(a1) - math.log(a0) - math.log(self.rate) + math.log(1 - self.rate)
        width = (1 / a1 + 1 / a0) ** 0.5
        return (odds - width if odds > width else odds + width if odds < -width else 0) - 0.3

    def segments(self, w):
        scores = [-0.3 if i and w[i] == w[i - 1] else self.weight(t) for i, t in enumerate(w)]
        # stretches that cost more than anything can regain part the segments, so the recursion stays small
        return brute_segments(scores)

    def evidence(self, text):
        w = self.tokens(text or "")
        strong = [s for *_, s in self.segments(w) if self.log_k + math.log(max(1, len(w))) - self.scale * s < math.log(0.05)]
        return max(0.0, self.scale * sum(strong) - self.log_k - math.log(max(1, len(w)))) if strong else 0.0


def test_against_definition(spark):
    """Every token's weight, the extreme-value parameters, passages and evidence."""
    rows, labels = corpus(3, 240)
    model = learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = Plain(rows, labels)
    for t in {t for w, _ in plain.texts for t in w} | {"unknown", "uglimorzzz", "clowns", "own", ""}:
        assert math.isclose(model.weights[t], plain.weight(t), rel_tol=1e-6, abs_tol=1e-6), t
    assert any(x < -0.4 for x in map(plain.weight, plain.count[0])) and any(plain.weight(t) > 1 for t in plain.count[1])
    assert math.isclose(model.rate, plain.scale, rel_tol=1e-4) and math.isclose(model.log_k, plain.log_k, rel_tol=1e-3)
    got = {r.doc_id: r for r in score_documents(table(spark, rows), model).collect()}
    for d, text in rows:
        assert math.isclose(got[d].score, model.score(plain.evidence(text)), abs_tol=1e-2), d


def test_kin_of_one_toxic_token_stay_clean(spark):
    """"clown" alone teaches nothing about "down", "known", "close", or about words that no text held."""
    rows, labels = corpus(5)
    model = learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights["clown"] > 1 and model.weights["uglimorxyz"] > 0.5
    for t in ("down", "known", "close", "clock", "town", "own", "clove", "flown", "cloister"):
        assert model.weights[t] <= 0, t
    clean = [(1, "down the known town close to a clock"), (2, "flown clove cloister own " * 30), (3, "w7 w7 w7 " * 200)]
    assert [r.predicted for r in score_documents(table(spark, clean), model).collect()] == [0, 0, 0]


def test_held_out_documents(spark):
    rows, labels = corpus(1)
    docs = table(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = learn(docs, lab.filter(~held_out("doc_id")))
    truth = dict(labels)
    got = [r for r in score_documents(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(r.n_passages >= 1 for r in got if r.predicted)
    odd = score_documents(table(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert score_documents(table(spark, []), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, None), (None, 0)], [(0, 0), (1, 0)]])
def test_little_to_learn(spark, labels):
    rows, _ = corpus(2, 20)
    model = learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert isinstance(model, ToxicModel) and all(0 <= r.score < 0.7 for r in score_documents(table(spark, rows), model).collect())


def test_constants_of_the_definition():
    assert (toxicity.PRIOR, toxicity.DRAWN_IN, toxicity.DRIFT, toxicity.AFFIX_PRIOR, toxicity.SIGNIFICANT, toxicity.EXPECTED) == (8.0, 1.0, 0.3, 4.0, 4.5, 0.05)
