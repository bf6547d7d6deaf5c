"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - eta) with eta the mean weight of the
text's hashed features: one set of weights, ordered thresholds. The expected
grade ranks documents; the probability of a grade of at least SELECT selects them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64
from .sampling import labelled_sample
from .words import PUNCTUATION, Words, text_bytes

#: Hash buckets of the features, and documents of each grade that are learnt from.
BUCKETS, SAMPLE = 1 << 16, 3000
#: Documents are selected by P(grade >= SELECT) >= AT_LEAST.
SELECT, AT_LEAST = 1, 0.5
STEPS, RIDGE, SCALE = 150, 1e-6, 8.0
#: Byte classes of shapes: capitals, small letters (and all beyond ASCII), digits; other bytes stand for themselves.
CLASSES = np.array([ord("A") if chr(c).isupper() and c < 128 else ord("0") if chr(c).isdigit() and c < 128 else ord("a") if c >= 128 or chr(c).islower() else c for c in range(256)], np.uint8)
#: Buckets of the features of a whole text: its share of tokens that equal the one before; that it has no tokens.
REPEATED, EMPTY = BUCKETS - 1, BUCKETS - 2


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor; 1: good but toxic; 2: good. Null where the quality is unknown."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, F.when(F.col(toxic) == 1, 1).otherwise(2))


def shapes(column: pa.Array) -> pa.Array:
    """The texts with each byte's class for the byte and runs of a class as one."""
    data, offsets = text_bytes(column)
    data = CLASSES[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    keep = np.ones(len(data), bool)
    np.not_equal(data[1:], data[:-1], out=keep[1:])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])


class Features:
    """Hashed features of whole texts: their words (runs without ASCII punctuation), the shapes of their tokens, tokens that equal the one before."""

    def __init__(self) -> None:
        self.words, self.tokens = Words(separators=PUNCTUATION), Words(lower=False)

    def of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, bucket, share) triples of ever more rows; a text's shares of each kind add up to SCALE."""
        for kind, hasher, texts in ((1, self.words, column), (2, self.tokens, shapes(column)), (3, self.tokens, column)):
            row = 0
            for n, hashes, counts in hasher.of(texts):
                owner = row + np.repeat(np.arange(n), counts)
                share = np.repeat(SCALE / np.maximum(counts, 1), counts)
                if kind == 3:
                    again = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) else np.empty(0, bool)
                    none = row + np.flatnonzero(counts == 0)
                    yield np.append(owner[again], none), np.append(np.full(again.sum(), REPEATED), np.full(len(none), EMPTY)), np.append(share[again], np.full(len(none), SCALE))
                else:
                    yield owner, ((hashes ^ U64(kind)) % U64(BUCKETS - 2)).astype(np.int64), share
                row += n


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, eta: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(min(30.0, max(-30.0, t - eta)))) for t in self.thresholds]

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> OrdinalModel:
        """Adam on the mean negative log likelihood with a ridge; thresholds are a first one and positive steps."""
        weights, cuts = np.zeros(BUCKETS), np.array([0.0, *[1.0] * (levels - 2)])
        if not rows:
            return cls(weights, np.cumsum(cuts))
        share = np.bincount(grades, minlength=levels) + 1.0
        tail = 1 - np.cumsum(share / share.sum())[:-1]
        start = -np.log(tail / (1 - tail))
        cuts = np.array([start[0], *np.log(np.maximum(np.diff(start), 1e-3))])
        ids = np.concatenate([r[0] for r in rows])
        values = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        used, at = np.unique(ids, return_inverse=True)
        p = np.concatenate([np.zeros(len(used)), cuts])
        m, v = np.zeros_like(p), np.zeros_like(p)
        n = len(rows)
        for step in range(1, STEPS + 1):
            w, c = p[: len(used)], p[len(used) :]
            steps = np.concatenate([c[:1], np.exp(np.clip(c[1:], -10, 10))])
            edges = np.concatenate([[-np.inf], np.cumsum(steps), [np.inf]])
            eta = np.bincount(owner, values * w[at], n)
            low, high = edges[grades] - eta, edges[grades + 1] - eta
            a, b = 1 / (1 + np.exp(-np.clip(low, -35, 35))), 1 / (1 + np.exp(-np.clip(high, -35, 35)))
            a, b = np.where(np.isneginf(low), 0.0, a), np.where(np.isposinf(high), 1.0, b)
            chance = np.maximum(b - a, 1e-12)
            da, db = a * (1 - a) / chance, b * (1 - b) / chance
            by_doc = (db - da) / n  # of the loss, by eta
            g = np.zeros_like(p)
            g[: len(used)] = np.bincount(at, values * by_doc[owner], len(used)) + RIDGE * w
            for k in range(1, levels):
                by_edge = (da[grades == k].sum() - db[grades == k - 1].sum()) / n
                g[len(used)] += by_edge
                for j in range(1, k):
                    g[len(used) + j] += by_edge * steps[j]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights[used] = p[: len(used)]
        c = p[len(used) :]
        return cls(weights, np.cumsum([c[0], *np.exp(np.clip(c[1:], -10, 10))]))


def learn(docs: DataFrame, labels: DataFrame, rating: Column | None = None, levels: int = 3, per_grade: int = SAMPLE) -> OrdinalModel:
    """Fit on about ``per_grade`` documents of each grade; the driver holds their hashed features.

    Labels with a null grade or doc_id, and null texts, teach nothing; of several labels of a document the highest grade holds, and rows
    that repeat a doc_id are all taught with it, whatever their texts; an empty text is one without tokens. Without rows all weights are 0. Columns other than doc_id and text are ignored.
    """
    sample = labelled_sample(docs, labels, grade() if rating is None else rating, per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            owner, bucket, share = (np.concatenate(x) for x in zip(*features.of(b.column("text")), strict=True))
            keys, at = np.unique(owner * BUCKETS + bucket, return_inverse=True)
            sums, cuts = np.bincount(at, share, len(keys)), np.searchsorted(keys, np.arange(len(b) + 1) * BUCKETS)
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((keys % BUCKETS).astype(np.int32)))
            shares = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sums.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), ids, shares], names=["doc_id", "grade", "ids", "shares"])

    rows = []
    for r in sample.mapInArrow(run, "doc_id long, grade int, ids array<int>, shares array<float>").toLocalIterator():
        rows.append((r[0], r[1], np.array(r[2], np.int32), np.array(r[3], np.float32)))
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))  # the sums below then come out alike in every run
    return OrdinalModel.fit([(r[2], r[3]) for r in rows], np.array([r[1] for r in rows], np.int64), levels)


def grade_documents(docs: DataFrame, model: OrdinalModel, select: int = SELECT, at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of at least ``select``) and selected, row by row.

    A null or empty text has one feature, that of no tokens, whose weight is 0 unless
    training saw such texts; repeated rows give repeated results; null doc_ids pass through; a probability that ties with
    ``at_least`` is kept; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: OrdinalModel = shared.value
        features = Features()
        for b in batches:
            eta = np.zeros(len(b))
            for owner, bucket, share in features.of(b.column("text")):
                eta += np.bincount(owner, share * m.weights[bucket], len(b))
            tails = [m.tails(x) for x in eta.tolist()]
            expected, tail = [sum(t) for t in tails], [t[select - 1] for t in tails]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= at_least for t in tail], pa.bool_())], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
