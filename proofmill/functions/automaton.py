"""Many literal patterns in one scan: an Aho-Corasick automaton in flat arrays over UTF-8 bytes.

Texts are cut into pieces that overlap by the longest pattern, and all pieces of a batch take
each step together, so the work is that of the texts' bytes, however many patterns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a text that go through the automaton in a row; longer texts are cut.
PIECE = 4096
#: Pieces that take a step together.
PIECES = 1 << 14
#: Hits that are kept before those that say the same are put together.
HITS = 1 << 18


class Automaton:
    """Different patterns, none of them empty; ``find`` gives their places in the list."""

    def __init__(self, patterns: list[bytes]) -> None:
        order = sorted(range(len(patterns)), key=patterns.__getitem__)
        data = np.frombuffer(b"".join(patterns[k] for k in order), np.uint8)
        sizes = np.array([len(patterns[k]) for k in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        # bytes that no pattern has share one class, in which every state falls back to the root
        used = np.unique(data)
        self.classes = np.zeros(256, np.intp)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.longest = int(sizes.max(initial=0))
        node = np.zeros(len(patterns), np.int64)
        alive = np.arange(len(patterns))
        levels, count = [], 1
        for depth in range(self.longest):
            alive = alive[sizes[alive] > depth]
            parent, label = node[alive], self.classes[data[starts[alive] + depth]]
            new = np.append(True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1]))
            node[alive] = count - 1 + np.cumsum(new)
            levels.append((parent[new], label[new], np.arange(count, count + int(new.sum()))))
            count += int(new.sum())
        self.step = np.zeros((count, len(used) + 1), np.int32)
        fail = np.zeros(count, np.int64)
        self.own, self.link = np.full(count, -1, np.int64), np.zeros(count, np.int64)
        self.own[node] = order
        if levels:
            self.step[0, levels[0][1]] = levels[0][2]
        for depth, (parent, label, nodes) in enumerate(levels):
            if depth:
                # read before the children stand in the parents' rows: those of the fallback's row are of a lesser depth
                fail[nodes] = self.step[fail[parent], label]
            self.step[nodes] = self.step[fail[nodes]]
            if depth + 1 < len(levels):
                below, letter, kids = levels[depth + 1]
                self.step[below, letter] = kids
            # the next state on the way of fallbacks in which a pattern ends
            back = fail[nodes]
            self.link[nodes] = np.where(self.own[back] >= 0, back, self.link[back])
        self.hit = (self.own >= 0) | (self.link > 0)

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern) of all different pairs of a text and a pattern that it holds, by row, then pattern; a null text holds none."""
        column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
        lengths = np.diff(offsets)
        pieces = -(-lengths // PIECE)
        row = np.repeat(np.arange(len(lengths)), pieces)
        begin = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        size = np.minimum(lengths[row] - begin, PIECE + max(0, self.longest - 1))
        begin = begin + offsets[:-1][row]
        found, more = [np.empty(0, np.int64)], 0
        for a in range(0, len(row), PIECES):
            order = a + np.argsort(-size[a : a + PIECES], kind="stable")
            at, left, state = begin[order], -size[order], np.zeros(len(order), np.int32)
            for j in range(int(-left[0]) if len(left) else 0):
                m = int(np.searchsorted(left, -j, side="left"))
                state[:m] = self.step[state[:m], self.classes[data[at[:m] + j]]]
                ends = np.flatnonzero(self.hit[state[:m]])
                if len(ends):
                    found.append(np.unique(row[order[ends]] * len(self.own) + state[ends]))
                    more += len(found[-1])
                    if more > max(HITS, len(found[0])):
                        found, more = [np.unique(np.concatenate(found))], 0
        pairs = np.unique(np.concatenate(found))
        text, state = pairs // len(self.own), pairs % len(self.own)
        out = [np.empty(0, np.int64)]
        n = int(self.own.max(initial=0)) + 1
        while len(state):
            ends = self.own[state] >= 0
            out.append(text[ends] * n + self.own[state[ends]])
            text, state = text[self.link[state] > 0], self.link[state[self.link[state] > 0]]
        both = np.unique(np.concatenate(out))
        return both // n, both % n
