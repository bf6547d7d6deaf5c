"""Spelling variants: words at distance one, grouped under their most frequent form.

The vocabulary is counted over whole texts. Its sorted words are cut into
shards, each a compact trie in flat arrays; shards are broadcast, a bounded
number of bytes at a time. Every word's Levenshtein automaton for distance one runs
against every trie depth-first, the automata of many words side by side: a state is
(word, node, characters read, edits made), and since tries are sorted, most
shards end an automaton within two characters. Neighbours are reduced to their number and
the best form where they are found, so pairs never leave a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32 as crc_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release_memory
from .runs import crc32, find_runs

#: Characters of a shard's words, at most (a longer word is a shard of its own).
SHARD_CHARS = 1 << 20
#: Bytes of shards that are broadcast at once; a shard has some 20 bytes a character.
BROADCAST_BYTES = 32 << 20
#: States of the automata that are taken on together.
STATES = 1 << 19
#: Different words that a task holds before it hands its counts on.
HELD = 200_000
#: A label takes so many bits, enough for any code point.
BITS = 21


def _letter(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which in UTF-8 are 0xC3 and the byte behind it."""
    lead = data == 0xC3
    out = lead | ((data | 32) - np.uint8(97) < 26)
    out[1:] |= lead[:-1]
    return out


def word_counts(docs: DataFrame, least_chars: int = 6, typo_every: int = 199) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z in lower case, of ``least_chars`` code points or more.

    One occurrence in ``typo_every`` loses a character first, chosen by the CRC-32 of "<doc_id>:<run>" (a null doc_id is
    empty there); 0 leaves all as they are. Null texts have no words; rows that repeat count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(held.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            prefix = np.array([crc_of(f"{'' if d is None else d}:".encode()) for d in b.column("doc").to_pylist()], np.uint32)
            for found in find_runs(b.column("text"), _letter):
                leads = np.cumsum(np.append(0, found.data == 0xC3))
                size = found.ends - found.starts - (leads[found.ends] - leads[found.starts])
                data = found.data.tobytes()
                plain = size >= least_chars
                if typo_every:
                    crc = crc32(found, prefix[found.rows])
                    hit = crc % np.uint32(typo_every) == 0
                    plain &= ~hit
                    for s, e, h in zip(found.starts[hit].tolist(), found.ends[hit].tolist(), crc[hit].tolist(), strict=True):
                        word = data[s:e].decode()
                        at = h % len(word)
                        if len(word) > least_chars:
                            held[(word[:at] + word[at + 1 :]).encode()] += 1
                held.update([data[s:e] for s, e in zip(found.starts[plain].tolist(), found.ends[plain].tolist(), strict=True)])
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()
        held.clear()
        release_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, one after another, and where each word's begin and end."""
    offsets = np.cumsum([0, *map(len, words)])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), offsets


class Trie:
    """Sorted different words as a compact trie: nodes in the order of their depth, so that a node's children lie side by side.

    ``first[node]`` to ``first[node + 1]`` are its children (less one), ``labels`` their characters, ``word`` the word that ends at a node, or -1.
    """

    def __init__(self, words: list[str]) -> None:
        codes, offsets = _codes(words)
        lengths = np.diff(offsets)
        node = np.zeros(len(words), np.int64)
        labels, parents, count = [], [], 1
        alive = np.arange(len(words))
        for depth in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > depth]
            label, parent = codes[offsets[alive] + depth], node[alive]
            new = np.append(True, (label[1:] != label[:-1]) | (parent[1:] != parent[:-1]))
            node[alive] = count - 1 + np.cumsum(new)
            labels.append(label[new])
            parents.append(parent[new])
            count += int(new.sum())
        self.labels = np.concatenate(labels).astype(np.uint32) if labels else np.empty(0, np.uint32)
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        self.first = np.searchsorted(parent, np.arange(count + 1)).astype(np.int32)
        self.word = np.full(count, -1, np.int32)
        self.word[node] = np.arange(len(words))

    def keys(self) -> np.ndarray:
        """(parent, label) of every node but the root as one number, sorted."""
        return (np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) << BITS) | self.labels


class Shard:
    """A trie made ready for automata, with its words and their counts."""

    def __init__(self, trie: Trie, words: list[str], counts: np.ndarray) -> None:
        self.trie, self.words, self.counts = trie, words, counts
        self.keys = trie.keys()

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node under a label, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(node), -1, np.int64)
        want = (node << BITS) | label
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at + 1, -1)

    def neighbours(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted different numbers (word << 32 | word of the shard) of all pairs at distance one.

        A stack of blocks of states is worked from its top, so what waits is bounded by the depth of the trie.
        """
        first, ends = self.trie.first.astype(np.int64), self.trie.word
        n = np.diff(offsets)
        found = [np.empty(0, np.int64)]
        zero = np.zeros(len(n), np.int64)
        stack = [(np.arange(len(n), dtype=np.int64), zero, zero, zero.astype(bool))]
        while stack:
            w, node, i, edited = stack.pop()
            if len(w) > STATES:
                half = len(w) // 2
                stack += [(w[half:], node[half:], i[half:], edited[half:]), (w[:half], node[:half], i[:half], edited[:half])]
                continue
            read = i == n[w]
            done = read & edited & (ends[node] >= 0)
            if done.any():
                found.append((w[done] << 32) | ends[node[done]])
            go = np.flatnonzero(~(read & edited))
            w, node, i, edited, read = w[go], node[go], i[go], edited[go], read[go]
            if not len(w):
                continue
            label = np.where(read, -1, codes[np.minimum(offsets[w] + i, max(len(codes) - 1, 0))] if len(codes) else -1)
            # a match; an automaton that has not edited yet may also leave a character out, put one in, or replace one
            same = np.where(read, -1, self.child(node, np.maximum(label, 0)))
            on = same >= 0
            fresh = np.flatnonzero(~edited)
            skip = fresh[~read[fresh]]
            kids = first[node[fresh] + 1] - first[node[fresh]]
            owner = np.repeat(fresh, kids)
            kid = np.repeat(first[node[fresh]], kids) + np.arange(len(owner)) - np.repeat(np.cumsum(kids) - kids, kids)
            swap = ~read[owner] & (self.trie.labels[kid] != label[owner])
            yes = np.ones
            stack.append((
                np.concatenate([w[on], w[skip], w[owner], w[owner[swap]]]),
                np.concatenate([same[on], node[skip], kid + 1, kid[swap] + 1]),
                np.concatenate([i[on] + 1, i[skip] + 1, i[owner], i[owner[swap]] + 1]),
                np.concatenate([edited[on], yes(len(skip) + len(owner) + int(swap.sum()), bool)]),
            ))
        return np.unique(np.concatenate(found))


def shards(words: DataFrame, chars: int = SHARD_CHARS) -> DataFrame:
    """(words, counts, size): the sorted vocabulary (word, n) in shards of at most ``chars`` characters; words as UTF-8 bytes with a line feed after each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["".join(f"{w}\n" for w in held).encode()], pa.binary()), pa.array([np.array(counts, np.int64).tobytes()], pa.binary()), pa.array([size], pa.int64())], names=["words", "counts", "size"])

        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if held and size + len(word) > chars:
                    yield out()
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield out()

    total = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    parts = max(1, -(-total // chars))
    return durable(words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(cut, "words binary, counts binary, size long"))


def _near_in(words: DataFrame, group: list[tuple[bytes, bytes]]) -> DataFrame:
    """(word, n_near, best_n, best): for each word with neighbours in some shards how many, and the best of them."""
    sent = words.sparkSession.sparkContext.broadcast(group)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = []
        for packed, counts in sent.value:
            held = packed.decode().split("\n")[:-1]
            tries.append(Shard(Trie(held), held, np.frombuffer(counts, np.int64)))
        for b in batches:
            column = b.column("word").to_pylist()
            codes, offsets = _codes(column)
            for s in tries:
                pairs = s.neighbours(codes, offsets)
                w, other = pairs >> 32, pairs & 0xFFFFFFFF
                # the largest count first, ties in the order of the words
                order = np.lexsort((other, -s.counts[other], w))
                w, other = w[order], other[order]
                lead = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
                yield pa.RecordBatch.from_arrays([
                    b.column("word").take(pa.array(w[lead])), pa.array(np.diff(np.append(lead, len(w)))), pa.array(s.counts[other[lead]]), pa.array([s.words[k] for k in other[lead].tolist()], pa.string()),
                ], names=["word", "n_near", "best_n", "best"])
        release_memory()

    out = durable(words.select("word").mapInArrow(near, "word string, n_near long, best_n long, best string"))
    sent.unpersist()
    return out


def neighbours(words: DataFrame, chars: int = SHARD_CHARS, most: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have others at distance one: how many, and the one of the largest n (ties: the smallest).

    Shards go through the driver in groups of at most ``most`` bytes, each group a job over all words.
    """
    cut = shards(words, chars)
    sized = [(r["words"], r["size"]) for r in cut.select(F.xxhash64("words").alias("words"), "size").orderBy("words").collect()]
    groups, room = [[]], most
    for k, size in sized:
        if groups[-1] and room < 20 * size:
            groups.append([])
            room = most
        groups[-1].append(k)
        room -= 20 * size
    found = []
    for group in groups:
        rows = cut.filter(F.xxhash64("words").isin(group)).select("words", "counts").collect() if group else []
        found.append(_near_in(words, [(bytes(r[0]), bytes(r[1])) for r in rows]))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without cycles: forms followed to the last one, in twice as long steps each time."""
    at = durable(links.select("word", F.col("form").alias("root")))
    while True:
        step = durable(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        at = step.drop("moved")


def spelling_variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, ratio: int = 5, typo_every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of at least ``least_chars`` code points that occur ``least_count`` times.

    A word's form is the word at distance one (a code point put in, left out or replaced) of the largest n, ties in code-point order,
    if its n is at least ``ratio`` times the word's; root follows forms to the last and is the word itself without one. A
    ``ratio`` of 2 or more makes n grow along forms, so there is no cycle. Null and empty texts have no words, rows that repeat count
    again, an empty table gives no rows, columns other than doc_id and text are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms would go in circles")
    words = durable(word_counts(docs, least_chars, typo_every).filter(F.col("n") >= least_count))
    near = durable(words.join(neighbours(words), "word", "left"))
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = near.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"))
    last = roots(formed.filter("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
