"""Runs of member bytes in whole texts, many texts at once, and their CRC-32."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .words import text_bytes

#: Bytes that are looked at together; working memory is some 40 times this.
CHUNK = 1 << 20
#: Runs up to this many bytes go through the table side by side; longer ones are few.
LONG = 64
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


TABLE = _table()


class Found(NamedTuple):
    """Runs of some bytes (A-Z in lower case): where each begins and ends, and the row of the column that it stands in, in order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def find_runs(column: pa.Array, member: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> Iterator[Found]:
    """The maximal runs of bytes for which ``member`` holds, texts in order; nulls have none.

    Texts come in pieces of about CHUNK bytes. A longer text is cut between runs, unless ``whole`` asks for each text in one piece.
    """
    data, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= CHUNK or whole:
            yield _runs(data[a:b], offsets[row : end + 1] - a, row, member)
        else:
            while a < b:
                cut = _cut(data, a, b, member)
                yield _runs(data[a:cut], np.array([0, cut - a]), row, member)
                a = cut
        row = end


def _cut(data: np.ndarray, a: int, b: int, member: Callable[[np.ndarray], np.ndarray]) -> int:
    """Some CHUNK bytes after a, behind a byte that is in no run; b if there is none."""
    end = a + CHUNK
    while end < b:
        gaps = np.flatnonzero(~member(data[max(a, end - CHUNK) : end]))
        # the first byte of a window may belong to a run that its member rule cannot see
        if len(gaps) and gaps[-1] > 0:
            return max(a, end - CHUNK) + int(gaps[-1]) + 1
        end += CHUNK
    return b


def _runs(data: np.ndarray, offsets: np.ndarray, row: int, member: Callable[[np.ndarray], np.ndarray]) -> Found:
    small = SMALL[data]
    inside = member(small)
    begins = np.ones(len(data), bool)
    np.logical_not(inside[:-1], out=begins[1:])
    ends = np.ones(len(data), bool)
    np.logical_not(inside[1:], out=ends[:-1])
    # a text's end cuts a run
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts], ends[cuts - 1] = True, True
    starts = np.flatnonzero(begins & inside)
    # texts without bytes share their offset with the next one
    rows = row + np.searchsorted(offsets, starts, side="right") - 1
    return Found(small, starts, np.flatnonzero(ends & inside) + 1, rows)


def crc32(found: Found, after: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each run, continued from the CRC-32 ``after`` which it comes."""
    n = len(found.starts)
    before = np.zeros(n, np.uint32) if after is None else after.astype(np.uint32)
    lengths = found.ends - found.starts
    order = np.argsort(-lengths, kind="stable")
    first = int(np.searchsorted(-lengths[order], -LONG, side="left"))
    out = np.empty(n, np.uint32)
    for k in order[:first].tolist():
        out[k] = zlib.crc32(found.data[found.starts[k] : found.ends[k]], int(before[k]))
    rest = order[first:]
    at, c, left = found.starts[rest], ~before[rest], -lengths[rest]
    for j in range(int(-left[0]) if len(rest) else 0):
        m = int(np.searchsorted(left, -j, side="left"))
        head = c[:m]
        c[:m] = TABLE[(head ^ found.data[at[:m] + j]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
    out[rest] = ~c
    return out
