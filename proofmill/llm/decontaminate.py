"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item leaks into a document if some stretch of the document's words is
within RATE edited words of the item. CGK random walks map edit distance to
Hamming distance; windows of the item's size whose embeddings agree with the
item's at a few sampled steps are candidates; repetitions with other walks and steps
bring the recall to TARGET; an exact edit distance decides.

A window within d edits of an item holds one of the item's d + 1 pieces
unchanged, so only windows around such a piece are embedded; no other could match.
Walks over the windows at every word would take hours a GB: README has the figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_position, durable, mix64, stream64
from .words import PUNCTUATION, Words

#: Edits allowed for each word of an item, and the recall that the repetitions aim at.
RATE, TARGET = 0.2, 0.995
#: Steps that are sampled for each hash, and the most repetitions.
SAMPLED, MOST = 2, 96
#: Words of items that are searched for at once: what is broadcast is bounded by this.
BLOCK_WORDS = 2_000_000
PAD = U64(0)


def edits_allowed(n: int) -> int:
    return int(RATE * n)


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK walks over the windows words[start:end], all in step: the symbols put out, a row for each step.

    At step j a walk puts out the word that it is at, and goes on to the next if the coin of (j, word) says so.
    """
    at, out = starts.copy(), np.zeros((steps, len(starts)), U64)
    coins = stream64(seed, steps)
    for j in range(steps):
        inside = at < ends
        w = np.where(inside, words[np.minimum(at, len(words) - 1)], PAD)
        out[j] = w
        at += inside & ((mix64(w ^ coins[j]) >> U64(63)) == 1)
    return out


def sample_hash(symbols: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The symbols at SAMPLED steps, hashed; the steps lie in the part of the walk that a window of that size takes to cross."""
    h = np.full(len(sizes), U64(seed + 1))
    for k, r in enumerate(stream64(seed ^ 0x5EED, SAMPLED)):
        step = ((r >> U64(40)) * (2 * sizes).astype(U64) >> U64(24)).astype(np.int64)
        h = mix64(h * U64(0x9E3779B97F4A7C15) + symbols[np.minimum(step, len(symbols) - 1), np.arange(len(sizes))] + U64(k))
    return h


def approximate_find(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` nearest to ``item`` in edits; the one that ends first, the shortest of those."""
    distance, end = _ends(item, text, free=True)
    _, back = _ends(item[::-1], text[:end][::-1], free=False)
    return distance, end - back, end


def _ends(item: np.ndarray, text: np.ndarray, free: bool) -> tuple[int, int]:
    index = np.arange(len(text) + 1)
    row = np.zeros_like(index) if free else index.copy()
    for w in item:
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(best - index) + index
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Items:
    """A block of benchmark items and the index of their pieces."""

    ids: list[int | None]
    words: list[np.ndarray]
    repetitions: int = 1
    #: Whether TARGET was out of reach, so that the exact distance decides every seed.
    every: bool = False

    def __post_init__(self) -> None:
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            n, d = len(w), edits_allowed(len(w))
            for k in range(d + 1):
                a, b = k * n // (d + 1), (k + 1) * n // (d + 1)
                pieces.setdefault(b - a, []).append((i, a, b))
        #: By length of piece: sorted hashes, the items and offsets, a bitmap of the hashes' low bits.
        self.index = {}
        for n, found in pieces.items():
            h = np.array([int(run_hashes(self.words[i][a:b], n)[0]) for i, a, b in found], U64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 16, bool)
            bits[(h & U64(0xFFFF)).astype(np.int64)] = True
            self.index[n] = h[order], np.array([found[k][0] for k in order]), np.array([found[k][1] for k in order]), bits
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, U64)
        self.sizes = np.array([*map(len, self.words)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first word, item, its offset in the item) of every piece in a row of words."""
        out = []
        for n, (keys, item, offset, bits) in self.index.items():
            h = run_hashes(hashes, n)
            near = np.flatnonzero(bits[(h & U64(0xFFFF)).astype(np.int64)])
            low, high = np.searchsorted(keys, h[near], side="left"), np.searchsorted(keys, h[near], side="right")
            count = high - low
            near, low, count = near[count > 0], low[count > 0], count[count > 0]
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((np.repeat(near, count), item[which], offset[which]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.empty(0, np.int64),) * 3

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each item within its edits in each text; its nearest stretch, in words."""
        at, item, offset = self.hits(hashes)
        if not len(at):
            return []
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, at, side="right")
        seeds = np.unique(np.stack([text, item, at - offset], axis=1), axis=0)
        text, item, origin = seeds.T
        begin, end, d = (ends - counts)[text], ends[text], (RATE * self.sizes[item]).astype(np.int64)
        windows = 2 * d + 1
        owner = np.repeat(np.arange(len(seeds)), windows)
        shift = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) - d[owner]
        start = np.maximum(origin[owner] + shift, begin[owner])
        stop = np.minimum(start + self.sizes[item[owner]], end[owner])
        keep = start < stop
        owner, start, stop = owner[keep], start[keep], stop[keep]
        candidate = self._candidates(hashes, start, stop, item[owner], text[owner], owner, len(seeds))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in np.flatnonzero(candidate).tolist():
            t, i, o, slack = int(text[k]), int(item[k]), int(origin[k]), int(2 * d[k])
            a, b = max(int(begin[k]), o - slack), min(int(end[k]), o + int(self.sizes[i]) + slack)
            if a >= b:
                continue
            distance, x, y = approximate_find(self.words[i], hashes[a:b])
            if distance <= d[k]:
                best = distance, a + x - int(begin[k]), a + y - int(begin[k])
                if best < found.get((t, i), (1 << 60,)):
                    found[t, i] = best
        return [(t, i, *best) for (t, i), best in sorted(found.items())]

    def _candidates(self, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, text: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Whether any window of each seed collides with its item in any repetition."""
        if self.every:
            return np.ones(n, bool)
        found = np.zeros(n, bool)
        for r in range(self.repetitions):
            # what has collided is settled: the exact distance decides it
            todo = ~found[owner]
            start, stop, item, owner = start[todo], stop[todo], item[todo], owner[todo]
            if not len(start):
                break
            for a in range(0, len(start), 20_000):
                x, y, i, o = start[a : a + 20_000], stop[a : a + 20_000], item[a : a + 20_000], owner[a : a + 20_000]
                used, back = np.unique(i, return_inverse=True)
                steps = 2 * int(self.sizes[used].max())
                want = sample_hash(embed(self.flat, self.starts[used], self.starts[used] + self.sizes[used], steps, r), self.sizes[used], r)
                got = sample_hash(embed(hashes, x, y, steps, r), self.sizes[i], r)
                found[o[got == want[back]]] = True
        return found

    def calibrate(self, trials: int = 400) -> None:
        """As many repetitions as TARGET takes, by the collision rate of items with all their edits made at random places.

        Should MOST not reach it, every seed goes to the exact distance.
        """
        rng = np.random.default_rng(5)
        known = [i for i in range(len(self.words)) if edits_allowed(len(self.words[i]))]
        if not known:
            return
        texts, which = [], []
        for _ in range(trials):
            i = known[rng.integers(len(known))]
            w = list(self.words[i])
            for _ in range(edits_allowed(len(w))):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[at : at + (kind != 1)] = [] if kind == 2 else [U64(rng.integers(1, 1 << 62))]
            texts.append(np.array(w, U64))
            which.append(i)
        flat = np.concatenate(texts)
        size = np.array([*map(len, texts)])
        begin = np.cumsum(size) - size
        item = np.array(which)
        missed = np.ones(trials, bool)
        for r in range(MOST):
            self.repetitions = r + 1
            if missed.mean() <= 1 - TARGET:
                break
            d = (RATE * self.sizes[item]).astype(np.int64)
            for shift in range(-int(d.max()), int(d.max()) + 1):
                start = np.maximum(begin + shift, begin)
                stop = np.minimum(start + self.sizes[item], begin + size)
                steps = 2 * int(self.sizes[item].max())
                want = sample_hash(embed(self.flat, self.starts[item], self.starts[item] + self.sizes[item], steps, r), self.sizes[item], r)
                got = sample_hash(embed(flat, start, stop, steps, r), self.sizes[item], r)
                missed &= ~((got == want) & (abs(shift) <= d))
        self.every = bool(missed.mean() > 1 - TARGET)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row."""
    h = np.zeros(max(0, len(words) - n + 1), U64)
    for k in range(n):
        h *= U64(0xD6E8FEB86659FD93)
        h += words[k : k + len(h)]
    return mix64(h ^ U64(n))


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items with at least one word, in blocks of BLOCK_WORDS words at most (or one item)."""
    hasher = Words(separators=PUNCTUATION)
    ids: list[int | None] = []
    words: list[np.ndarray] = []
    filled = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        w = np.concatenate([h for _, h, _ in hasher.of(pa.array([r[1]]))])
        if not len(w):
            continue
        if words and filled + len(w) > BLOCK_WORDS:
            yield Items(ids, words)
            ids, words, filled = [], [], 0
        ids.append(r[0])
        words.append(w)
        filled += len(w)
    if words:
        yield Items(ids, words)


def _announced(blocks: Iterator[Items]) -> Iterator[tuple[Items, bool]]:
    """Each block, and whether it is the only one."""
    first, second = next(blocks, None), next(blocks, None)
    if first is not None:
        yield first, second is None
    while second is not None:
        yield second, False
        second = next(blocks, None)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that leaks into it: doc_id, item_id, item_words, distance, start_word, end_word.

    Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case;
    an item of n words allows int(RATE * n) inserted, deleted or replaced
    words, below 1 / RATE words none. The stretch given is the nearest,
    the first of equals. Items or texts that are null or without words match
    nothing; repeated rows on either side give repeated results; null ids pass
    through. Every document is read once for each block of BLOCK_WORDS item words; nothing is shuffled.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items, alone in _announced(_blocks(benchmark)):
        items.calibrate()
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            hasher = Words(separators=PUNCTUATION)
            for b in batches:
                at, rows = 0, []
                ids = b.column("doc_id").to_pylist()
                for n, hashes, counts in hasher.of(b.column("text")):
                    rows += [(ids[at + t], items.ids[i], len(items.words[i]), distance, a, e) for t, i, distance, a, e in items.find(hashes, counts)]
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["doc_id", "item_id", "item_words", "distance", "start_word", "end_word"])

        found = plain.mapInArrow(run, "doc_id long, item_id long, item_words long, distance long, start_word long, end_word long")
        if not alone:
            # one block at a time is held
            found = durable(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return plain.limit(0).selectExpr("doc_id", *(f"cast(null as long) {c}" for c in ("item_id", "item_words", "distance", "start_word", "end_word")))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, with all their columns; row by row, so nothing is joined or shuffled.

    Null and empty texts stay, as nothing leaks into them; repeated rows stay or go together; an empty benchmark, or one
    without words, drops nothing; an empty table stays empty; any column names beside doc_id and text go.
    """
    docs, names = by_position(docs, "doc_id", "text")
    for items, alone in _announced(_blocks(benchmark)):
        items.calibrate()
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            hasher = Words(separators=PUNCTUATION)
            for b in batches:
                at, clean = 0, np.ones(len(b), bool)
                for n, hashes, counts in hasher.of(b.column("text")):
                    for t, *_ in items.find(hashes, counts):
                        clean[at + t] = False
                    at += n
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if not alone:
            docs = durable(docs)
            shared.destroy()
    return docs.toDF(*names)
