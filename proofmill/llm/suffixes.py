"""Removal of repeated byte strings: suffix-array dedup by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.
Every such string (window) is led by an anchor, the least-hashed q-gram in it,
so that equal windows have equal anchors and meet in one bucket:

1. Windows in a row with the same anchor are one run. Each task compares the bytes of
   its runs of one hash before the shuffle and sends one run of each class of equal
   ones: so a passage that many documents share costs one run for each task.
2. Where an anchor has several runs, each sends its bytes. Runs of equal bytes are one
   class again; where an anchor has several classes, the
   suffixes of their first runs are sorted to LENGTH bytes: initial q-gram buckets are refined by
   sorting on the bucket pointers of later offsets, each pass using the
   pointers of the one before. Equal windows end in one bucket; all but the
   earliest are repeats. So hashes only bring windows together; bytes decide.
3. The repeats go back to their documents, which drop what they cover.

The second step counts the runs of each anchor, over all documents. Should any have very many,
the first step is taken again with the windows of such anchors dealt by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, by_position, durable, mix64
from .words import BYTE_VALUE, Powers, text_bytes

LENGTH, ANCHOR = 100, 32
#: Bytes of text that are scanned at once.
CHUNK = 1 << 20
#: Runs that a task gathers before it sends them.
FLUSH = 1_000_000
#: Runs in a bucket bin, bytes of text in a document bin, bins in a partition, and the most partitions; beyond them a partition holds more bins.
BIN_RUNS, BIN_BYTES, BINS, MOST_PARTITIONS = 60_000, 2 << 20, 8, 50_000
#: An anchor of more runs than this, of those that tasks send on, is dealt by window. From so many packed bytes on the runs of such anchors are only counted.
HOT_CLASSES, COUNTED_FROM = 60_000, 64 << 20
#: Bytes that are compared at once.
COMPARED = 1 << 22
FIRST_DOC = -(1 << 63)

RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("dh", "<u8"), ("lo", "<u8"), ("len", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("dh", "<u8"), ("lo", "<u8"), ("len", "<u2")])
COUNT = np.dtype([("key", "<u8"), ("n", "<i8")])
#: What a run finder gives: RUN rows, the bytes that were scanned, and where in them each run begins.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def pack(table: np.ndarray) -> bytes:
    """Rows as byte planes under zstd, which shortens the leading zeros of numbers to nothing."""
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(table), -1).T)
    return len(table).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


class Runs:
    """Finds the runs of texts; holds the tables, one object for each task."""

    def __init__(self, length: int, hot: np.ndarray):
        self.length, self.q, self.hot, self.powers = length, min(ANCHOR, length), hot, Powers()

    def of(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, dh: np.ndarray) -> Iterator[Found]:
        """All windows of the texts data[offsets[i] : offsets[i + 1]], some texts or a part of a long one at a time."""
        row, rows = 0, len(doc)
        while row < rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            a, b = int(offsets[row]), int(offsets[end])
            if end > row + 1 or b - a <= CHUNK:
                yield self._scan(data[a:b], offsets[row : end + 1] - a, doc[row:end], dh[row:end], 0)
            else:
                for at in range(a, b - self.length + 1, CHUNK):
                    part = data[at : min(b, at + CHUNK + self.length - 1)]
                    yield self._scan(part, np.array([0, len(part)]), doc[row:end], dh[row:end], at - a)
            row = end

    def _scan(self, data: np.ndarray, cuts: np.ndarray, doc: np.ndarray, dh: np.ndarray, base: int) -> Found:
        length, q, n = self.length, self.q, len(data)
        if n < length:
            return np.empty(0, RUN), data[:0], np.empty(0, np.int64)
        up, down = self.powers.upto(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
        grams = mix64((sums[q:] - sums[:-q]) * down[: n - q + 1])
        # the least of the gram hashes in each window, the leftmost of equal ones
        least = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
        span, width = 1, length - q + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(doc)), np.diff(cuts))[: len(anchor)]
        starts = np.flatnonzero(np.arange(len(anchor)) + length <= cuts[owner + 1])
        if not len(starts):
            return np.empty(0, RUN), data[:0], np.empty(0, np.int64)
        anchor, owner = anchor[starts], owner[starts]
        key = grams[anchor]
        split = np.isin(key, self.hot) if len(self.hot) else np.zeros(len(starts), bool)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | split[1:] | split[:-1]
        at = np.flatnonzero(new)
        lo, hi = starts[at], starts[np.append(at[1:], len(starts)) - 1]
        out = np.empty(len(at), RUN)
        around = mix64((sums[hi + length] - sums[lo]) * down[lo] ^ U64(0x5851F42D4C957F2D))
        out["key"] = np.where(split[at], mix64(around ^ U64(1)), key[at])
        out["ctx"] = mix64(around + ((anchor[at] - lo) * 1024 + (hi - lo)).astype(U64) * ~split[at])
        out["doc"], out["dh"] = doc[owner[at]], dh[owner[at]]
        out["lo"], out["len"] = (lo - cuts[owner[at]] + base), hi - lo + 1
        return out, data, lo


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are the same, for each a, b and size (above 0)."""
    out, ends, i = np.ones(len(a), bool), np.cumsum(sizes), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + COMPARED, side="right")))
        n = sizes[i:j]
        start = np.cumsum(n) - n
        along = np.arange(int(n.sum())) - np.repeat(start, n)
        out[i:j] = ~np.logical_or.reduceat(data[np.repeat(a[i:j], n) + along] != data[np.repeat(b[i:j], n) + along], start)
        i = j
    return out


def distinct_places(runs: np.ndarray) -> np.ndarray:
    """``runs`` in the order of (key, ctx, place), without those that give the same place again; as indices."""
    order = np.lexsort((runs["lo"], runs["dh"], runs["doc"], runs["ctx"], runs["key"]))
    new = np.ones(len(order), bool)
    for name in ("key", "ctx", "doc", "dh", "lo"):
        column = runs[name][order]
        new[1:] &= column[1:] == column[:-1]
    new[1:] = ~new[1:]
    return order[new]


def settle(runs: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest run of each class, the other runs), as indices, of runs whose bytes begin ``at`` places in ``data``.

    Equal hashes propose, bytes decide: a run that differs from the first of its hash stays. A place given twice counts once.
    """
    order = distinct_places(runs)
    sorted_, at = runs[order], at[order]
    first = np.ones(len(order), bool)
    first[1:] = (sorted_["key"][1:] != sorted_["key"][:-1]) | (sorted_["ctx"][1:] != sorted_["ctx"][:-1]) | (sorted_["len"][1:] != sorted_["len"][:-1])
    rest = np.flatnonzero(~first)
    head = _heads(first[1:], len(order))[rest]
    first[rest[~equal_bytes(data, at[rest], at[head], sorted_["len"][rest].astype(np.int64) + length - 1)]] = True
    return order[first], order[~first]


def crowded(runs: np.ndarray) -> np.ndarray:
    """Whether each run's anchor has several of them."""
    _, which, n = np.unique(runs["key"], return_inverse=True, return_counts=True)
    return n[which] > 1


def spans_of(runs: np.ndarray) -> np.ndarray:
    out = np.empty(len(runs), SPAN)
    for name in SPAN.names:
        out[name] = runs[name]
    return out


def repeated_windows(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, dh: np.ndarray, lo: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of contexts laid end to end (their sizes in bytes, their places): SPAN rows of the windows that also start earlier.

    Bucket-pointer refinement: ``pointer`` holds for each suffix where its
    bucket begins in the sorted order. Buckets of one suffix are left alone.
    """
    n = len(data)
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(n)  # bytes from here to the context's end
    depth = 4
    pointer = np.full(n, -1, np.int64)
    alive = np.flatnonzero(left >= min(depth, length))
    depth = min(depth, length)
    gram = np.zeros(len(alive), np.uint32)
    for k in range(depth):
        gram = (gram << np.uint32(8)) | data[alive + k]
    order = np.argsort(gram, kind="stable")
    alive, gram = alive[order], gram[order]
    begin = _heads(gram[1:] != gram[:-1], len(alive))
    pointer[alive] = begin
    while True:
        # suffixes alone in their bucket are settled: nothing equals them
        crowd = np.ones(len(alive), bool)
        if len(alive):
            same = begin[1:] == begin[:-1]
            crowd = np.append(same, False) | np.append(False, same)
        alive, begin = alive[crowd], begin[crowd]
        if depth == length or not len(alive):
            break
        step = min(depth, length - depth)
        enough = left[alive] >= depth + step
        alive, begin = alive[enough], begin[enough]
        later = pointer[alive + step]
        order = np.lexsort((later, begin))
        alive, begin, later = alive[order], begin[order], later[order]
        new = (begin[1:] != begin[:-1]) | (later[1:] != later[:-1])
        heads = _heads(new, len(alive))
        base = _heads(begin[1:] != begin[:-1], len(alive))
        begin = begin + (heads - base)
        pointer[alive] = begin
        depth += step
    if not len(alive):
        return np.empty(0, SPAN)
    context = np.searchsorted(np.cumsum(sizes), alive, side="right")
    place = lo[context] + (alive - (np.cumsum(sizes) - sizes)[context]).astype(U64)
    order = np.lexsort((place, dh[context], doc[context], begin))
    begin, context, place = begin[order], context[order], place[order]
    d, h = doc[context], dh[context]
    same = begin[1:] == begin[:-1]
    # a window that is the bucket's first place is no repeat, however often it was given
    first = _heads(~same, len(begin))
    repeat = (d != d[first]) | (h != h[first]) | (place != place[first])
    out = np.empty(int(repeat.sum()), SPAN)
    out["doc"], out["dh"], out["lo"], out["len"] = d[repeat], h[repeat], place[repeat], 1
    return out


def _heads(new: np.ndarray, n: int) -> np.ndarray:
    """For each of n sorted items the index where its group begins; ``new``: whether an item from the second on begins one."""
    at = np.zeros(n, np.int64)
    if n:
        at[1:] = np.where(new, np.arange(1, n), 0)
    return np.maximum.accumulate(at)


def merged(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte ranges that a document's spans cover."""
    if not len(spans):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo = spans["lo"].astype(np.int64)
    order = np.argsort(lo, kind="stable")
    lo = lo[order]
    hi = np.maximum.accumulate(lo + spans["len"][order].astype(np.int64) + length - 1)
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], hi[np.append(new[1:], True)]


def _by_bin(df: DataFrame, bins: int, use: Callable[[list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], ddl: str | StructType, shrink: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]] | None = None) -> DataFrame:
    """Gather the (bin, kind, data) rows of each bin and hand them to ``use``; one bin is in memory at a time.

    ``shrink`` makes the rows of a bin smaller each time that they have grown by COUNTED_FROM bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, grown = None, [], 0
        for b in batches:
            for i, bin_ in enumerate(b.column("bin").to_pylist()):
                if bin_ != now:
                    if held:
                        yield from use(held)
                    now, held, grown = bin_, [], 0
                held.append((b.column("kind")[i].as_py(), b.column("data")[i].as_py()))
                grown += len(held[-1][1])
                if shrink and grown > COUNTED_FROM:
                    held, grown = shrink(held), 0
        if held:
            yield from use(held)

    return df.repartition(min(MOST_PARTITIONS, max(1, bins // BINS)), "bin").sortWithinPartitions("bin").mapInArrow(run, ddl)


BINNED = "bin int, kind int, data binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bin", "kind", "data"])


def _dealt(table: np.ndarray, by: np.ndarray, bins: int, kind: int) -> list[tuple[int, int, bytes]]:
    """``table`` cut by ``by`` modulo ``bins``, each part packed."""
    if not len(table):
        return []
    bin_ = (by % U64(bins)).astype(np.int64)
    order = np.argsort(bin_, kind="stable")
    table, bin_ = table[order], bin_[order]
    cuts = np.append(np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1])), len(table))
    return [(int(bin_[a]), kind, pack(table[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _doc_bin(doc: np.ndarray) -> np.ndarray:
    return mix64(doc.view(U64) ^ U64(0x2545F4914F6CDD1D))


def _keys(b: pa.RecordBatch, several: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, doc, dh) of a batch of (doc, text, ...). dh tells texts under the same doc_id apart, where there are such."""
    data, offsets = text_bytes(b.column("text"))
    doc = b.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
    if several:
        dh = np.array([int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little") for x, y in zip(offsets[:-1], offsets[1:], strict=True)], U64)
    else:
        dh = np.zeros(len(doc), U64)
    return data, offsets, doc, dh


def _runs(plain: DataFrame, length: int, several: bool, hot: np.ndarray, bins: int) -> DataFrame:
    """(bin, kind, data): kind 0, RUN rows by anchor; kind 1, SPAN rows of repeats that a task has found on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, held, n = Runs(length, hot), [], 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(part) for _, part, _ in held)])
            at = np.concatenate([x + b for (_, _, x), b in zip(held, base[:-1], strict=True)])
            runs = np.concatenate([x for x, _, _ in held])
            one, others = settle(runs, np.concatenate([part for _, part, _ in held]), at, length)
            first, spans = runs[one], spans_of(runs[others])
            return _rows(_dealt(first, first["key"], bins, 0) + _dealt(spans, _doc_bin(np.ascontiguousarray(spans["doc"])), bins, 1))

        for b in batches:
            for found in finder.of(*_keys(b, several)):
                held.append(found)
                n += len(found[0])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return plain.select("doc", "text").mapInArrow(run, BINNED)


def _counted(held: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """``held`` with the runs of anchors beyond HOT_CLASSES as counts: the step will be taken again, so only their number matters."""
    parts = [unpack(d, RUN) for k, d in held if k == 0]
    counts = [unpack(d, COUNT) for k, d in held if k == 3]
    if not parts:
        return held
    runs = np.concatenate(parts)
    keys, which, n = np.unique(runs["key"], return_inverse=True, return_counts=True)
    hot = n > HOT_CLASSES
    hot |= np.isin(keys, np.concatenate(counts)["key"]) if counts else False
    out = np.empty(int(hot.sum()), COUNT)
    out["key"], out["n"] = keys[hot], n[hot]
    return [x for x in held if x[0] != 0] + [(kind, pack(t)) for kind, t in ((0, runs[~hot[which]]), (3, out)) if len(t)]


def _hot_anchors(matched: DataFrame) -> np.ndarray:
    """The anchors with more than HOT_CLASSES runs over all documents; there are few by their definition."""
    found = [unpack(r[0], COUNT)["key"] for r in matched.filter("kind = 3").select("data").toLocalIterator()]
    return np.unique(np.concatenate(found)) if found else np.empty(0, U64)


def _matched(runs: DataFrame, bins: int, doc_bins: int) -> DataFrame:
    """(bin, kind, data) by document: kind 1, repeats; kind 2, the runs of each anchor that has several; kind 3, COUNT rows of hot anchors."""

    def use(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        spans = [unpack(d, SPAN) for k, d in held if k == 1]
        parts = [unpack(d, RUN) for k, d in held if k == 0]
        rows: list[tuple[int, int, bytes]] = []
        if parts:
            all_runs = np.concatenate(parts)
            all_runs = all_runs[distinct_places(all_runs)]
            several = all_runs[crowded(all_runs)]
            rows += [(0, 3, d) for k, d in _counted([(0, pack(several))]) if k == 3] if len(several) > HOT_CLASSES else []
            rows += [(0, 3, d) for k, d in held if k == 3]
            rows += _dealt(several, _doc_bin(np.ascontiguousarray(several["doc"])), doc_bins, 2)
        if spans:
            all_spans = np.concatenate(spans)
            rows += _dealt(all_spans, _doc_bin(np.ascontiguousarray(all_spans["doc"])), doc_bins, 1)
        if rows:
            yield _rows(rows)

    return _by_bin(runs, bins, use, BINNED, _counted)


def _packed_docs(docs: DataFrame, several: bool, doc_bins: int) -> DataFrame:
    """(bin, kind 0, data): documents by the bin of their doc_id, as compressed Arrow batches (doc, dh, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            _, _, doc, dh = _keys(b, several)
            bins = (_doc_bin(doc) % U64(doc_bins)).astype(np.int64)
            whole = pa.RecordBatch.from_arrays([b.column("doc"), pa.array(dh.view(np.int64)), b.column("row")], names=["doc", "dh", "row"])
            order = np.argsort(bins, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(bins[order]) != 0)), len(order))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.take(pa.array(order[x:y]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield _rows([(int(bins[order[x]]), 0, sink.getvalue().to_pybytes())])

    return docs.mapInArrow(run, BINNED)


def _documents(held: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for kind, data in held:
        if kind == 0:
            for b in pa.ipc.open_stream(data):
                yield b.column("doc").to_numpy(zero_copy_only=False), b.column("dh").to_numpy(zero_copy_only=False).view(U64), b


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = b.column("row")
    return text_bytes(rows.field(rows.type.get_field_index("text")))


def _contexts(packed: DataFrame, matched: DataFrame, length: int, doc_bins: int, bins: int) -> DataFrame:
    """(bin, kind, data) by anchor: the runs of kind 2 with their bytes."""

    def use(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        wanted = [unpack(d, RUN) for k, d in held if k == 2]
        if not wanted:
            return
        runs = np.concatenate(wanted)
        runs = runs[np.lexsort((runs["lo"], runs["dh"], runs["doc"]))]
        left: dict[tuple[int, int], tuple[int, int]] = {}
        cuts = np.append(np.flatnonzero(np.append(True, (runs["doc"][1:] != runs["doc"][:-1]) | (runs["dh"][1:] != runs["dh"][:-1]))), len(runs))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left[int(runs["doc"][a]), int(runs["dh"][a])] = a, b
        out: dict[int, list[bytes]] = {}
        for doc, dh, batch in _documents(held):
            data, offsets = _texts(batch)
            for i, place in enumerate(zip(doc.tolist(), dh.tolist(), strict=True)):
                at = left.pop(place, None)
                if at is None:
                    continue
                mine = runs[at[0] : at[1]]
                for r, bin_ in zip(mine, (mine["key"] % U64(bins)).tolist(), strict=True):
                    x = int(offsets[i]) + int(r["lo"])
                    out.setdefault(bin_, []).append(r.tobytes() + data[x : x + int(r["len"]) + length - 1].tobytes())
        if out:
            bodies = {bin_: b"".join(parts) for bin_, parts in out.items()}
            yield _rows([(bin_, 0, len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)) for bin_, body in bodies.items()])

    both = packed.unionByName(matched.filter("kind = 2"))
    return _by_bin(both, doc_bins, use, BINNED)


def _refined(contexts: DataFrame, length: int, bins: int, doc_bins: int) -> DataFrame:
    """(bin, kind 1, data) by document: the repeats among the contexts."""

    def use(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        for _, packed in held:
            n = int.from_bytes(packed[:8], "little")
            body, at = pa.decompress(packed[8:], n, "zstd", asbytes=True), 0
            while at < n:
                head = np.frombuffer(body, RUN, 1, at)
                size = int(head["len"][0]) + length - 1
                heads.append(head)
                bodies.append(body[at + RUN.itemsize : at + RUN.itemsize + size])
                at += RUN.itemsize + size
        runs, sizes = np.concatenate(heads), np.array([*map(len, bodies)])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        one, others = settle(runs, data, np.cumsum(sizes) - sizes, length)
        several = np.zeros(len(runs), bool)
        several[one[crowded(runs[one])]] = True
        # only windows with the same anchor can be equal; sorting all of the bin at once finds the same
        left = runs[several]
        found = np.concatenate([spans_of(runs[others]), repeated_windows(data[np.repeat(several, sizes)], sizes[several], left["doc"], left["dh"], left["lo"], length)])
        if len(found):
            yield _rows(_dealt(found, _doc_bin(np.ascontiguousarray(found["doc"])), doc_bins, 1))

    return _by_bin(contexts, bins, use, BINNED)


Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]], pa.RecordBatch]


def remove_repeats(docs: DataFrame, finish: Finish, ddl: str | StructType, length: int = LENGTH) -> DataFrame:
    """Find in every text the byte ranges covered by windows that also start earlier, and hand them to ``finish``.

    ``finish`` gets some documents (their columns), the bytes and offsets of
    their texts, and for each the starts and ends of the ranges; it returns a batch of type ``ddl``.

    Earlier: in a document of smaller doc_id, or in the same one further left. A
    null doc_id comes first. Rows that repeat a doc_id and text are one document and
    get the same result; rows of one doc_id with different texts are ordered by
    a hash of the text. A null text is empty; texts below ``length`` lose nothing.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC)).alias("doc"), F.col("text").cast("string").alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    several = not plain.groupBy("doc").count().filter("count > 1").isEmpty()
    bins = max(16, -(-total // (ANCHOR * BIN_RUNS)))
    doc_bins = max(16, -(-total // BIN_BYTES))
    matched = durable(_matched(_runs(plain, length, several, np.empty(0, U64), bins), bins, doc_bins))
    hot = _hot_anchors(matched)
    if len(hot):
        matched = durable(_matched(_runs(plain, length, several, hot, bins), bins, doc_bins))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC)).alias("doc"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    packed = _packed_docs(rows, several, doc_bins)
    refined = durable(_refined(_contexts(packed, matched, length, doc_bins, bins), length, bins, doc_bins))

    def use(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(d, SPAN) for k, d in held if k == 1]
        by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if parts:
            spans = np.concatenate(parts)
            spans = spans[np.lexsort((spans["lo"], spans["dh"], spans["doc"]))]
            cuts = np.append(np.flatnonzero(np.append(True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["dh"][1:] != spans["dh"][:-1]))), len(spans))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                by[int(spans["doc"][a]), int(spans["dh"][a])] = merged(spans[a:b], length)
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        for doc, dh, batch in _documents(held):
            data, offsets = _texts(batch)
            ranges = [by.get(place, none) for place in zip(doc.tolist(), dh.tolist(), strict=True)]
            yield finish(pa.RecordBatch.from_struct_array(batch.column("row")), data, offsets, ranges)

    both = packed.unionByName(matched.filter("kind = 1")).unionByName(refined)
    return _by_bin(both, doc_bins, use, ddl)


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of each document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes, removed, shas, spans = np.diff(offsets), [], [], []
        for a, b, (lo, hi) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ranges, strict=True):
            sha = hashlib.sha256()
            at = a
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                sha.update(data[at : a + x])
                at = a + y
            sha.update(data[at:b])
            shas.append(sha.hexdigest())
            removed.append(int((hi - lo).sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return remove_repeats(plain, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", length)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without their repeats; n_chars, if there is such a column, counts what is left.

    Only whole characters go: a range that begins or ends inside one leaves it. A null text stays null. Of windows
    under the same doc_id the one further left stays; null doc_ids and repeated rows are as in remove_repeats. An
    empty table gives no rows; other columns, whatever their names, come back as they were.
    """

    def finish(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        texts: list[str | None] = []
        nulls = batch.column("text").is_null().to_pylist()
        for a, b, (lo, hi), null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ranges, nulls, strict=True):
            kept, at = [], a
            for x, y in zip((lo + a).tolist(), (hi + a).tolist(), strict=True):
                while x < y and data[x] & 0xC0 == 0x80:
                    x += 1
                while y > x and y < b and data[y] & 0xC0 == 0x80:
                    y -= 1
                kept.append(data[at:x].tobytes())
                at = y
            kept.append(data[at:b].tobytes())
            texts.append(None if null else b"".join(kept).decode("utf-8"))
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) if t is not None else old for t, old in zip(texts, columns["n_chars"].to_pylist(), strict=True)], pa.int64()).cast(columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    docs, names = by_position(docs, "doc_id", "text", "n_chars")
    return remove_repeats(docs, finish, docs.schema, length).toDF(*names)
