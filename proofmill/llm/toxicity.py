"""Toxicity by maximum-scoring segments.

Every token has a signed log-odds between toxic and other training documents
under an informative Dirichlet prior, drawn towards none by its standard error.
The prior's mean is the base rate, or for tokens with an affix that many
different toxic tokens share, the rate among the tokens with that affix: so a
token not met in training weighs what its affix lets expect, and one that was
met often what its own counts say. Each token also costs DRIFT, which keeps segments
local. A linear scan finds all maximal segments of a text; a segment is significant when
extreme-value statistics expect few of its score by chance in a text of that
length; a logistic curve over the evidence of the significant segments gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .sampling import labelled_sample

#: Documents of either class that the weights are learnt from.
SAMPLE = 3000
#: The prior's weight in contexts, and the standard errors that a log-odds is drawn in by.
PRIOR, DRAWN_IN = 8.0, 1.0
#: The root of the likelihood ratio that an affix must reach, and the tokens' worth of base rate that its own rate is mixed with.
SIGNIFICANT, AFFIX_PRIOR = 4.5, 4.0
#: Lengths of the beginnings and endings that count as affixes of a token.
AFFIXES = range(3, 9)
CACHED_TOKENS = 500_000
#: What each token costs a segment.
DRIFT = 0.3
#: Segments with fewer expected by chance are passages.
EXPECTED = 0.05
TOKENS = regex.compile(r"\w+").findall
EULER = 0.5772156649015329


def tokens(text: str) -> list[str]:
    return TOKENS(text.lower())


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by their start.

    One pass: a new segment joins with the nearest earlier one that begins
    lower, if that one also ends lower. ``back`` leads from each segment to the
    nearest earlier one that begins lower, so that the search steps over the
    others and the pass stays linear.
    """
    found: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, high, end = i, before, total, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = back[j]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                back.append(j)
                break
            start, low = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def affixes_of(token: str) -> list[str]:
    """The token's beginnings and endings."""
    n = len(token)
    return [*(f"^{token[:k]}" for k in AFFIXES if k < n), *(f"${token[n - k :]}" for k in AFFIXES if k < n)]


def log_odds(c1: float, c0: float, share: float, rate: float) -> float:
    """A token's log-odds between contexts in toxic and other texts, less those of all contexts, drawn in towards 0.

    ``rate`` is the toxic share of all contexts, ``share`` the prior's mean for this token.
    """
    a1, a0 = c1 + PRIOR * share, c0 + PRIOR * (1 - share)
    odds = math.log(a1 / a0) - math.log(rate / (1 - rate))
    return math.copysign(max(0.0, abs(odds) - DRAWN_IN * math.sqrt(1 / a1 + 1 / a0)), odds)


def affix_rates(rows: list[tuple[str, float, float]], n1: float, n0: float) -> dict[str, tuple[float, float]]:
    """From (affix, toxic tokens, other tokens) and the totals: the significant affixes with (z-score, share of toxic tokens)."""
    rate = n1 / (n1 + n0)
    found = {}
    for affix, k1, k0 in rows:
        expected = (k1 + k0) * rate
        ratio = 2 * sum(k * math.log(k / e) for k, e in ((k1, expected), (k0, k1 + k0 - expected)) if k > 0)
        z = math.copysign(math.sqrt(max(0.0, ratio)), k1 - expected)
        if abs(z) >= SIGNIFICANT:
            found[affix] = z, (k1 + AFFIX_PRIOR * rate) / (k1 + k0 + AFFIX_PRIOR)
    return found


@dataclass
class Weigher:
    """A token's weight from its counts; ``affixes`` as affix_rates gives them."""

    affixes: dict[str, tuple[float, float]]
    rate: float

    def __call__(self, token: str, c1: float = 0, c0: float = 0) -> float:
        known = [self.affixes[a] for a in affixes_of(token) if a in self.affixes]
        share = max(known, key=lambda x: (abs(x[0]), x[1]))[1] if known else self.rate
        return log_odds(c1, c0, share, self.rate)


class _Weights(dict):
    """token -> its weight less DRIFT; starts anew when full."""

    def __init__(self, known: dict[str, float], weigher: Weigher | None):
        super().__init__()
        self.known, self.weigher = known, weigher

    def __missing__(self, token: str) -> float:
        weight = self.known.get(token)
        if weight is None:
            weight = self.weigher(token) if self.weigher else 0.0
        if len(token) <= 64:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = weight - DRIFT
        return weight - DRIFT

    def __reduce__(self):
        return _Weights, (self.known, self.weigher)


@dataclass
class ToxicModel:
    """Tokens whose weight is not what ``weigher`` gives an unknown one, the extreme-value parameters and the logistic curve."""

    known: dict[str, float]
    weigher: Weigher | None = None
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -1.0
    weights: _Weights = field(init=False)

    def __post_init__(self) -> None:
        self.weights = _Weights(self.known, self.weigher)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments; a token that only repeats the one before it says nothing new and costs DRIFT."""
        scores = [*map(self.weights.__getitem__, words)]
        for i in range(1, len(words)):
            if words[i] == words[i - 1]:
                scores[i] = -DRIFT
        return maximal_segments(scores) if scores and max(scores) > 0 else []

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """The segments (first token, end, score) of which fewer than EXPECTED are expected by chance."""
        n = max(len(words), 1)
        return [x for x in self.segments(words) if self.log_k + math.log(n) - self.rate * x[2] < math.log(EXPECTED)]

    def evidence(self, passages: list[tuple[int, int, float]], n: int) -> float:
        """What the passages say against chance, in nats; 0 without any."""
        if not passages:
            return 0.0
        return max(0.0, self.rate * sum(s for _, _, s in passages) - self.log_k - math.log(max(n, 1)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * evidence + self.offset))))


def karlin_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the tokens of other texts; 1 if there is none below 50."""
    excess = lambda x: float((shares * np.exp(np.minimum(x * scores, 600))).sum() - 1)
    if not len(scores) or scores.max() <= 0 or excess(1e-6) >= 0 or excess(50.0) < 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> ToxicModel:
    """Fit on about ``per_class`` documents of either class.

    A token counts once for each different context (the tokens beside it), so
    that a passage copied into many documents teaches no more than one of them.
    Labels other than 0 and 1 teach nothing, of several of a document 1 holds; null texts teach nothing; without
    both classes every text scores the same, below 0.7. What the driver holds is bounded by the sample: the
    affixes of at least 4 tokens, and the tokens whose weight is not an unknown one's.
    """
    sample = labelled_sample(docs, labels.filter("toxic in (0, 1)"), F.col("toxic"), per_class)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for text, grade in zip(b.column("text").to_pylist(), b.column("grade").to_pylist(), strict=True):
                w = ["", *tokens(text), ""]
                out.update((w[i], grade, f"{w[i - 1]} {w[i + 1]}") for i in range(1, len(w) - 1))
            rows = [*out]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["token", "grade", "context"])

    counted = (
        sample.mapInArrow(contexts, "token string, grade int, context string")
        .select("token", "grade", F.xxhash64("context").alias("context")).distinct()
        .groupBy("token").agg(F.sum("grade").cast("long").alias("c1"), F.sum(1 - F.col("grade")).cast("long").alias("c0"))
    )
    counted = durable(counted)
    n1, n0 = counted.agg(F.coalesce(F.sum("c1"), F.lit(0)), F.coalesce(F.sum("c0"), F.lit(0))).first()
    if not n1 or not n0:
        return ToxicModel({})
    # each token counts once among those with an affix, in part as toxic: a frequent token says nothing of its kin
    toxic = F.col("c1") / (F.col("c1") + F.col("c0"))
    ends = [F.when(F.length("token") > k, F.concat(F.lit(mark), cut(k))) for mark, cut in (("^", lambda k: F.left("token", F.lit(k))), ("$", lambda k: F.right("token", F.lit(k)))) for k in AFFIXES]
    by_affix = (
        counted.select(F.explode(F.filter(F.array(*ends), lambda x: x.isNotNull())).alias("affix"), toxic.alias("k1"))
        .groupBy("affix").agg(F.sum("k1").alias("k1"), F.sum(1 - F.col("k1")).alias("k0")).filter("k1 + k0 >= 4")
    )
    k1, k0 = counted.agg(F.sum(toxic), F.sum(1 - toxic)).first()
    spark = docs.sparkSession
    weigher = Weigher(affix_rates([(r[0], round(r[1], 9), round(r[2], 9)) for r in by_affix.collect()], k1, k0), n1 / (n1 + n0))
    weigh = spark.sparkContext.broadcast(weigher)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [(weigh.value(*r), weigh.value(r[0])) for r in zip(*(b.column(c).to_pylist() for c in ("token", "c1", "c0")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("c0"), pa.array([x for x, _ in w], pa.float64()), pa.array([x != y for x, y in w], pa.bool_())], names=["token", "c0", "score", "own"])

    tokens_ = durable(counted.mapInArrow(weighed, "token string, c0 long, score double, own boolean"))
    model = ToxicModel({r[0]: r[1] for r in tokens_.filter("own").select("token", "score").collect()}, weigher)
    spread = tokens_.filter("c0 > 0").groupBy(F.round("score", 3).alias("score")).agg(F.sum("c0")).collect()
    # other texts may hold none of the toxic tokens: one more token is spread over these
    high = [x for x in model.known.values() if x > DRIFT]
    scores, n = np.array([(r[0] - DRIFT, r[1]) for r in spread] + [(x - DRIFT, 1 / len(high)) for x in high]).reshape(-1, 2).T
    model.rate = karlin_rate(scores, n / max(1.0, n.sum()))
    shared = spark.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = shared.value
        for b in batches:
            words = [tokens(t) for t in b.column("text").to_pylist()]
            scores = [[s for _, _, s in m.segments(w)] for w in words]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([len(w) for w in words], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["grade", "n", "scores"])

    seen = [(r[0], r[1], r[2]) for r in sample.select("text", "grade").mapInArrow(best, "grade int, n long, scores array<double>").collect()]
    calm = [model.rate * max(s, default=0.0) - math.log(max(n, 1)) for g, n, s in seen if not g]
    if calm:
        model.log_k = float(np.mean(calm)) - EULER
    points = []
    for g, n, s in seen:
        strong = [(0, 0, x) for x in s if model.log_k + math.log(max(n, 1)) - model.rate * x < math.log(EXPECTED)]
        points.append((model.evidence(strong, n), g))
    model.slope, model.offset = logistic(points)
    return model


def logistic(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (x, 0 or 1), with Platt's softened targets; Newton's method with a small ridge."""
    if not points:
        return 1.0, -1.0
    x = np.array([p[0] for p in points])
    y = np.array([p[1] for p in points], float)
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, high, low)
    scale = max(1.0, float(np.abs(x).max()) / 10)
    z = np.stack([np.minimum(x / scale, 3.0), np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (p - target) + 1e-2 * b
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), gradient)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-6) / scale), float(b[1])


def score_documents(docs: DataFrame, model: ToxicModel, with_passages: bool = True) -> DataFrame:
    """doc_id, score, predicted (1 from 0.7 on), n_passages and, if asked for, the passages' token spans and scores.

    Row by row: a null or empty text has no evidence and the score of none;
    repeated rows give repeated results; null doc_ids pass through; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double, predicted int, n_passages int"
    if with_passages:
        ddl += ", passages array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = shared.value
        for b in batches:
            scores, found = [], []
            for text in b.column("text").to_pylist():
                words = tokens(text or "")
                passages = m.passages(words)
                scores.append(m.score(m.evidence(passages, len(words))))
                found.append(passages)
            arrays = [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()), pa.array([len(f) for f in found], pa.int32())]
            names = ["doc_id", "score", "predicted", "n_passages"]
            if with_passages:
                arrays.append(pa.array([[{"start": a, "end": e, "score": s} for a, e, s in f] for f in found], kind))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, ddl)
