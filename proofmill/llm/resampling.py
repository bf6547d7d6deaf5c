"""Importance resampling of documents towards a target distribution.

Words are hashed into buckets. The gain of a bucket is the logarithm of its
share in the target over its share in the corpus; a document's weight is the
mean gain of its words, read from one array. Gumbel noise that depends on the
seed and doc_id alone turns weights into scores, so that the highest scores are a
weighted draw without replacement.

The draw is exact and no task sees all of it: eligible rows are sorted runs, one for
each partition; sampled splitters cut every run into slices; the slices of a
range meet in one task, which merges them by a tournament tree. Ranges are
counted first, so each knows the rank that it starts with, those behind the
last rank are never moved, and the range that holds it stops there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release_memory
from .runs import crc32, find_runs

#: Eligible rows that a range should hold, and how many ranges there are at least and at most (the driver holds their bounds).
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 100_000, 512, 16_384
#: Sampled keys for each range.
OVERSAMPLING = 24
SPREAD = 1 << 40
LAST = (1 << 63) - 1
#: Bytes of words: digits, small letters, all that is not ASCII.
MEMBER = np.array([chr(c).isdigit() or chr(c).islower() or c >= 0x80 if c < 0x80 else True for c in range(256)])


def _buckets(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of the runs of 1 to ``longest`` words, piece by piece; the words themselves come first in each piece."""
    for found in find_runs(column, lambda b: MEMBER[b], whole=longest > 1):
        state = crc32(found)
        rows, hashes = [found.rows], [state]
        for k in range(1, longest):
            # one word more, behind a space: each step goes on from the CRC of the run so far
            head = state[: len(state) - 1]
            same = found.rows[k:] == found.rows[: len(found.rows) - k]
            space = found._replace(data=np.array([32], np.uint8), starts=np.zeros(len(head), np.int64), ends=np.ones(len(head), np.int64))
            state = crc32(found._replace(starts=found.starts[k:], ends=found.ends[k:]), crc32(space, head))
            rows.append(found.rows[k:][same])
            hashes.append(state[same])
        yield np.concatenate(rows), np.concatenate(hashes) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of ``texts`` (text) fall into each bucket; ``buckets`` bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, hashed in _buckets(b.column("text"), longest, buckets):
                total += np.bincount(hashed, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])
        release_memory()

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, one added to each count."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log(float((b + 1) * (s + buckets)) / float((a + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc, n_words, n_features, weight) of documents (doc, text): the floored mean of their features' gains, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = len(b)
            words, n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for at, hashed in _buckets(b.column("text"), longest, len(gain)):
                n += np.bincount(at, minlength=rows)
                np.add.at(total, at, gain[hashed])
            if longest == 1:
                words = n
            else:
                for found in find_runs(b.column("text"), lambda x: MEMBER[x]):
                    words += np.bincount(found.rows, minlength=rows)
            mean = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(words), pa.array(n), pa.array(mean)], names=["doc", "n_words", "n_features", "weight"])
        release_memory()

    return docs.mapInArrow(weigh, "doc long, n_words long, n_features long, weight long")


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and doc_id alone; a null doc_id counts as the text "null"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


class Tournament:
    """A tree of losers over sorted runs of keys: ``take`` gives the run whose head is least, after one match a level."""

    END = b"\xff" * 32

    def __init__(self, runs: list[list[bytes]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [r[0] if r else self.END for r in runs] + [self.END] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first = a if self.heads[a] <= self.heads[b] else b
            winners[node], self.losers[node] = first, a + b - first
        self.winner = winners[1] if self.size > 1 else 0

    def take(self) -> tuple[int, int]:
        """(run, index) of the least key that is left; there must be one."""
        run = self.winner
        index = self.at[run]
        self.at[run] = index + 1
        self.heads[run] = self.runs[run][index + 1] if index + 1 < len(self.runs[run]) else self.END
        now, node = run, (self.size + run) >> 1
        while node:
            other = self.losers[node]
            if self.heads[other] < self.heads[now]:
                self.losers[node], now = now, other
            node >>= 1
        self.winner = now
        return run, index


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """The order of the draw as 24 bytes for each row: score from the top, then doc_id (null last), then the row."""
    parts = np.empty((len(b), 3), ">u8")
    score, doc, row = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("score", "doc", "row"))
    # ~x turns the order round; the sign bit makes the order of the bytes that of the numbers
    for k, x in enumerate((~score, doc, row)):
        parts[:, k] = x.view(np.uint64) ^ np.uint64(1 << 63)
    return parts.reshape(-1).view("S24") if len(b) else np.empty(0, "S24")


def _packed(keys: np.ndarray) -> bytes:
    return keys.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(score, doc) of packed keys."""
    x = (np.frombuffer(data, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 3)
    return ~x[:, 0], x[:, 1]


def _bounds(eligible: DataFrame, n: int) -> np.ndarray:
    """Sampled splitters: the first key of each range but the first."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n // ROWS_PER_RANGE)))
    chance = min(1.0, ranges * OVERSAMPLING / max(n, 1))
    drawn = eligible.filter(F.pmod(F.xxhash64("doc", "row"), F.lit(SPREAD)) < int(chance * SPREAD))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(_keys(b))], pa.binary())], names=["keys"])

    found = np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in drawn.mapInArrow(keys, "keys binary").collect()), "S24"))
    return np.unique(found[(np.arange(1, ranges) * len(found)) // ranges]) if len(found) else found


def _counted(eligible: DataFrame, bounds: np.ndarray) -> np.ndarray:
    """Exact counts of the ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(bounds, _keys(b), side="right"), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["range", "n"])

    out = np.zeros(len(bounds) + 1, np.int64)
    for k, n in eligible.mapInArrow(count, "range int, n long").groupBy("range").agg(F.sum("n")).collect():
        out[k] = n
    return out


def _slices(eligible: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Each partition is sorted, a run, and cut at the bounds: (range, run, part, keys, more), keys in order over the parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for part, b in enumerate(batches):
            keys = _keys(b)
            more = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("n_features", "weight")], axis=1)
            edges = [0, *np.searchsorted(keys, bounds, side="left").tolist(), len(keys)]
            rows = [(k, run, part, _packed(keys[x:y]), more[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)] if rows else
                [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())],
                names=["range", "run", "part", "keys", "more"],
            )

    return durable(eligible.sortWithinPartitions(F.desc("score"), "doc", "row").mapInArrow(cut, "range int, run int, part int, keys binary, more binary"))


def _merged(slices: DataFrame, before: list[int], take: int) -> DataFrame:
    """The rows of the slices with their ranks: ``before`` says how many rows lie ahead of each range; from rank ``take`` on the merge stops and ranks are null."""
    schema = "doc long, n_features long, weight long, score long, rank long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        keys: dict[int, list[bytes]] = {}
        more: dict[int, list[bytes]] = {}

        def rows() -> pa.RecordBatch:
            packed = [b"".join(k) for k in keys.values()]
            runs = [np.frombuffer(p, "V24").tolist() for p in packed]
            places = np.cumsum([0, *map(len, runs)])
            tree = Tournament(runs)
            rank = np.zeros(places[-1], np.int64)
            for r in range(before[now] + 1, min(before[now] + int(places[-1]), take) + 1):
                run, index = tree.take()
                rank[places[run] + index] = r
            score, doc = _unpacked(b"".join(packed))
            values = np.frombuffer(b"".join(x for m in more.values() for x in m), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(values[:, 0]), pa.array(values[:, 1]), pa.array(score), pa.array(rank, mask=rank == 0)], names=["doc", "n_features", "weight", "score", "rank"])

        for b in batches:
            for k, run, key, rest in zip(*(b.column(c).to_pylist() for c in ("range", "run", "keys", "more")), strict=True):
                if k != now:
                    if keys:
                        yield rows()
                        keys.clear()
                        more.clear()
                    now = k
                keys.setdefault(run, []).append(key)
                more.setdefault(run, []).append(rest)
        if keys:
            yield rows()
        keys.clear()
        more.clear()
        release_memory()

    parts = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slices.repartition(parts, "range").sortWithinPartitions("range", "run", "part").mapInArrow(merge, schema)


def resample(docs: DataFrame, target: DataFrame, num: int = 10, den: int = 100, seed: int = 2024, least_words: int = 20, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the N documents with ``least_words`` words the floor(num * N / den) of the highest scores, in that order.

    Words are runs of digits, letters a to z (A to Z count as those) and characters beyond ASCII; features are all runs of 1 to
    ``longest`` words joined by a space. A null or empty text, in ``docs`` or ``target``, has none: weight 0, never
    eligible where ``least_words`` is above 0. Scores that tie go by doc_id, the smaller first, a null doc_id last; rows that repeat a
    doc_id and text have one score and get ranks of their own. An empty target or table is fine. Columns other than
    doc_id and text are ignored.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(source, longest, buckets), bucket_counts(target, longest, buckets))
    score = F.col("weight") + noise(F.nullif("doc", F.lit(LAST)), seed)
    scored = durable(weights(source, gain, longest).withColumn("score", score).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    eligible = scored.filter(enough)
    n = eligible.count()
    take = num * n // den
    bounds = _bounds(eligible, n)
    counts = _counted(eligible, bounds)
    before = np.cumsum([0, *counts.tolist()])
    # ranges from this one on hold no rank
    stop = int(np.searchsorted(before, take, side="left"))
    beyond = F.lit(True) if stop == 0 else F.lit(False)
    if 0 < stop <= len(bounds):
        s, d, r = (int(x) for x in ((np.frombuffer(bounds[stop - 1].ljust(24, b"\0"), ">u8").astype(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))
        beyond = (F.col("score") < ~s) | ((F.col("score") == ~s) & ((F.col("doc") > d) | ((F.col("doc") == d) & (F.col("row") >= r))))
    columns = ("doc", "n_features", "weight", "score")
    rest = scored.filter(~enough | beyond).select(*columns, F.lit(None).cast("long").alias("rank"))
    out = _merged(_slices(eligible.filter(~beyond), bounds[:stop]), before.tolist(), take).unionByName(rest) if stop else rest
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_features", "weight", "score", "rank")
