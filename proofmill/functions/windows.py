"""Very many literal patterns in one scan: the windows of a text, of each length that patterns have, are looked up in a bitmap of the patterns' hashes.

Unlike an automaton the bitmap is small whatever the number of patterns, so one pass does. It only rules windows out: whoever asks
compares the windows that are left with the patterns themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are looked at together; a longer text is looked at alone.
SLICE = 1 << 22
#: Bytes of texts that one step of other passes works on or gives back; the batch that Spark hands over is 10,000 texts, whatever their length.
SPAN = 1 << 23
BASE = 0x9E3779B97F4A7C15 | 1
MIX = 0xD6E8FEB86659FD93


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a column of texts, nulls as empty ones; the offsets begin at 0."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows with at most SPAN bytes together, or of one row beyond it; the bytes of a null are none."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPAN, side="right")))
        yield first, past - first
        first = past


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def places(data: np.ndarray, at: np.ndarray, sizes: np.ndarray | int, bits: int, sums: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
    """The bit of 1 << ``bits`` for each window ``data[at : at + sizes]``."""
    sums = prefix(data) if sums is None else sums
    back = powers(pow(BASE, -1, 1 << 64), len(data) + 1) if back is None else back
    h = (sums[at + sizes] - sums[at]) * back[at]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(BASE) >> np.uint64(64 - bits)).astype(np.int64)


def prefix(data: np.ndarray) -> np.ndarray:
    return np.append(np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64))


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE bytes together."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield a, b
        a = b


def held(column: pa.Array, lengths: list[int], alphabet: np.ndarray, bitmap: np.ndarray, bits: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(windows, texts): different windows of ``lengths`` (sorted) that may be patterns, and how many of the texts hold each; several rounds, each of other texts.

    ``alphabet`` says of each byte whether a pattern has it: windows lie inside runs of such bytes.
    """
    data, offsets = bytes_of(column)
    for a, b in slices(np.diff(offsets)):
        at, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        inside = alphabet[at]
        before, after = np.append(False, inside[:-1])[: len(at)], np.append(inside[1:], False)[: len(at)]
        full = ends[1:] > ends[:-1]
        before[ends[:-1][full]], after[ends[1:][full] - 1] = False, False
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        long = end - begin >= lengths[0]
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            continue
        first = np.cumsum(size) - size
        runs = at[np.repeat(begin - first, size) + np.arange(int(size.sum()))]
        row = np.repeat(np.searchsorted(ends, begin, side="right") - 1, size)
        left = np.repeat(first + size, size) - np.arange(len(runs))
        sums, back = prefix(runs), powers(pow(BASE, -1, 1 << 64), len(runs) + 1)
        start, found, rows = np.arange(len(runs)), [], []
        for n in lengths:
            start = start[left[start] >= n]
            if not len(start):
                break
            p = places(runs, start, n, bits, sums, back)
            hit = start[(bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
            if len(hit):
                found.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(hit), [None, pa.py_buffer(np.ascontiguousarray(runs[hit[:, None] + np.arange(n)]))]).cast(pa.binary()))
                rows.append(row[hit])
        if found:
            coded = pa.concat_arrays(found).dictionary_encode()
            k = len(coded.dictionary)
            pairs = np.unique(np.concatenate(rows) * k + coded.indices.to_numpy().astype(np.int64))
            yield coded.dictionary, np.bincount(pairs % k, minlength=k)
