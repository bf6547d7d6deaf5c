"""Words of whole texts as 64-bit hashes, computed on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import U64, mix64, stream64

#: Bytes that are hashed at once; working memory is some 40 times this.
CHUNK = 1 << 20
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words when punctuation counts for nothing: all of ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Bytes between runs of ASCII letters and digits.
NOT_ALNUM = np.array([not (c < 128 and chr(c).isalnum()) for c in range(256)])
#: A random number for each byte; capitals A to Z have those of the small letters.
BYTE_VALUE = stream64(7, 256)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """The powers of BASE and of its inverse, as many as are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(BASE, max(n, CHUNK)), powers(BASE_INVERSE, max(n, CHUNK))
        return self.up[:n], self.down[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


class Words:
    """Hashes words; holds the tables, one object for each task."""

    def __init__(self, lower: bool = True, separators: np.ndarray = SEPARATOR) -> None:
        self.values = LOWER_VALUE if lower else BYTE_VALUE
        self.separators = separators
        self.powers = Powers()

    def _hash(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some bytes whose texts begin at ``cuts``: the hash, the first byte and the end of each word."""
        n = len(data)
        word = ~self.separators[data]
        first = np.ones(n, bool)
        np.logical_not(word[:-1], out=first[1:])
        first[cuts[cuts < n]] = True
        starts = np.flatnonzero(word & first)
        last = np.ones(n, bool)
        last[:-1] = first[1:] | ~word[1:]
        ends = np.flatnonzero(word & last) + 1
        up, down = self.powers.upto(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(self.values[data] * up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix64(h ^ (ends - starts).astype(U64)), starts, ends

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rows, hashes, counts): for runs of rows in order, the words of all of them and how many each has."""
        data, offsets = text_bytes(column)
        row, rows = 0, len(column)
        while row < rows:
            end = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
            if end > row:
                a, b = offsets[row], offsets[end]
                cuts = offsets[row:end] - a
                hashes, starts, _ = self._hash(data[a:b], cuts)
                counts = np.diff(np.append(np.searchsorted(starts, cuts), len(starts)))
                # texts without bytes share their offset with the next one
                yield end - row, hashes, counts
                row = end
            else:
                hashes = self._long(data[offsets[row] : offsets[row + 1]])
                yield 1, hashes, np.array([len(hashes)])
                row += 1

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A text beyond CHUNK, cut at separators."""
        found, a = [], 0
        while a < len(data):
            b = min(len(data), a + CHUNK)
            while b < len(data):
                gaps = np.flatnonzero(self.separators[data[max(a, b - CHUNK) : b]])
                if len(gaps):
                    b = max(a, b - CHUNK) + int(gaps[-1]) + 1
                    break
                b = min(len(data), b + CHUNK)
            found.append(self._hash(data[a:b], np.zeros(1, np.int64))[0])
            a = b
        return np.concatenate(found) if found else np.empty(0, U64)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; all words as one where there are fewer; nothing without words."""
    ends = np.cumsum(counts)
    if len(hashes) >= k:
        windows = np.zeros(len(hashes) - k + 1, U64)
        for j in range(k):
            windows *= U64(0xD6E8FEB86659FD93)
            windows += hashes[j : j + len(windows)]
        windows = mix64(windows ^ U64(k))
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, U64)
            for x in hashes[a:b]:
                h = h * U64(0xD6E8FEB86659FD93) + x
            out.append(mix64(h ^ U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def hashes_of(words: list[str], lower: bool = True, separators: np.ndarray = SEPARATOR) -> np.ndarray:
    """The hash that Words gives each of many words, in their order."""
    found = [h for _, h, _ in Words(lower, separators).of(pa.array(words, pa.string()))]
    out = np.concatenate(found) if found else np.empty(0, U64)
    if len(out) != len(words):
        raise ValueError("not all of these are single words")
    return out


def found_in(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each hash its place in the sorted ``keys``, -1 if it is not among them."""
    bits = np.zeros(1 << 16, bool)
    bits[(keys & U64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), -1, np.int64)
    near = np.flatnonzero(bits[(hashes & U64(0xFFFF)).astype(np.int64)])
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes[near]), len(keys) - 1)
        same = keys[at] == hashes[near]
        out[near[same]] = at[same]
    return out
