"""MinHash near-duplicates.

Texts become sets of word shingles; equal sets are one class. Many universal
hash minima of each class, banded, send similar classes into common buckets.
Inside a bucket pivots are compared with the members; signatures rule most
false pairs out, full sets confirm the others; components by alternating
stars. In buckets that still hold several components, blocks of members are
compared set by set inside a task, which gives out one link for each pair of
components that it joins. The sets there are the full ones, so what a block
links is confirmed, no pair of a bucket is lost, and near copies of
one text cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, by_position, durable, mix64, release_memory, stream64
from .components import connected_components, merge_components
from .words import Words, shingles

#: Bands and rows: a pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Pairs whose signatures agree less than this below the threshold are not alike: more than five standard deviations.
SLACK = 0.17
#: A chunk of a bucket has about so many members and shingles at most; a block is two chunks.
CHUNK_MEMBERS, CHUNK_ITEMS = 128, 1_000_000
#: Columns of a block's incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Ids up to this many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Shingles that are hashed at once.
BLOCK = 1 << 16
LAST = (1 << 63) - 1


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """For each set (not empty) n minima of universal hashes (a * x + b) >> 32."""
    a, b = stream64(11, n) | U64(1), stream64(13, n)
    out = np.empty((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):
        end, filled = at, 0
        while end < len(sets) and (end == at or filled + len(sets[end]) <= BLOCK):
            filled += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end]) >> U64(32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        t = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=t)
            t += b[k]
            out[at:end, k] = (np.minimum.reduceat(t, starts) >> U64(32)).astype(np.uint32)
        at = end
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one = int(np.bitwise_xor.reduce(mix64(s))) if len(s) else 0
    two = int(np.add.reduce(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)))) if len(s) else 0
    return one - (1 << 64) if one >= 1 << 63 else one, two - (1 << 64) if two >= 1 << 63 else two


def _node(doc: Column, h: Column) -> Column:
    """A class's name: its least doc_id, then its digest, as 16 bytes that sort so."""
    # an offset of 2 ** 63 makes the order of the bytes that of the numbers
    return F.unhex(F.concat(F.lpad(F.hex(doc.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lpad(F.hex(h), 16, "0")))


def _doc_of(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where den * |A n B| >= num * |A u B|.

    A text's set holds its distinct shingles of ``words`` words (bytes other
    than space and 0x09-0x0D, A-Z in lower case), or all its words as one
    shingle if they are fewer. A null text, or one without words, has an empty
    set and is linked with nothing. component_id is the least doc_id
    reachable; a null doc_id comes after all others and is null again in the
    result. Rows that repeat a doc_id and text are all kept or all dropped.
    Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    return _classified(docs, words, num, den, bands, rows).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns: of each group the document of the least doc_id.

    Nulls, empty texts, ties and repeated rows are as there: a null or empty text is a copy of nothing and stays, a
    null doc_id comes after all others, repeated rows stay or go together. An empty table stays empty; any column names go.
    """
    docs, names = by_position(docs, "doc_id", "text")
    dropped = durable(_classified(docs, words, num, den, BANDS, ROWS).filter("not kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_hash").distinct())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    keyed = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text_hash": F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(dropped, ["doc", "text_hash"], "left_anti").select(*docs.columns).toDF(*names)


def _classified(docs: DataFrame, words: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    n_hashes = bands * rows

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for b in batches:
            at = 0
            for n, hashes, counts in hasher.of(b.column("text")):
                sets = shingles(hashes, counts, words)
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full, n_hashes)) if full else iter(())
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc").slice(at, n), b.column("text_hash").slice(at, n), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], names=["doc", "text_hash", "n", "h", "g", "sig"])
                at += n
        release_memory()

    signed = durable(plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sets_of, "doc long, text_hash long, n long, h long, g long, sig binary"))
    classes = durable(
        signed.filter("n > 0").groupBy("h", "g", "n").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"))
        .select(_node(F.col("doc"), F.col("h")).alias("node"), "h", "g", "n", "sig")
    )
    buckets = _buckets(classes, bands, rows)
    fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    leaders = durable(buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("p")).select("bucket", F.col("p.node").alias("x"), F.col("p.n").alias("nx")))
    star = (
        buckets.join(leaders, "bucket").select("node", "x", F.col("n").alias("na"), F.col("nx").alias("nb")).filter(f"x <> node and {fits}")
        .select(F.col("x").alias("a"), F.col("node").alias("b")).distinct()
    )
    label = durable(connected_components(_confirmed(_agreeing(durable(star), classes, num, den, n_hashes), plain, words, num, den)))
    # a leader's pairs are all known; what is left of a bucket is open if it is in several components
    rest = buckets.join(leaders.select("bucket", F.col("x").alias("node")), ["bucket", "node"], "left_anti")
    more = _block_links(rest.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), plain, words, num, den)
    label = durable(merge_components(label, more))
    found = classes.select("h", "g", "n", "node").join(label, "node", "left").withColumn("node", F.coalesce("component", "node")).select("h", "g", "n", _doc_of(F.col("node")).alias("component"))
    return (
        signed.select("doc", "text_hash", "n", "h", "g").join(found, ["h", "g", "n"], "left")
        .withColumn("component", F.coalesce("component", "doc"))
        .select(
            F.nullif("doc", F.lit(LAST)).alias("doc_id"), F.col("n").alias("n_shingles"),
            F.nullif("component", F.lit(LAST)).alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"), "text_hash",
        )
    )


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n) of the buckets that at least two classes share."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(len(part), bands, rows)
                h = np.zeros((len(part), bands), U64) + np.arange(1, bands + 1, dtype=U64)
                for k in range(rows):
                    h = mix64(h ^ sig[:, :, k]) * U64(0x9E3779B97F4A7C15)
                index = pa.array(np.repeat(np.arange(len(part)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), part.column("node").take(index), part.column("n").take(index)], names=["bucket", "node", "n"])

    banded = classes.select("node", "n", "sig").mapInArrow(band, "bucket long, node binary, n long")
    # counts are summed before the shuffle, and the join can split a hot bucket
    shared = banded.groupBy("bucket").count().filter("count > 1").select("bucket")
    return durable(banded.join(shared, "bucket"))


def _agreeing(pairs: DataFrame, classes: DataFrame, num: int, den: int, n_hashes: int) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule them out."""
    limit = int(n_hashes * (num / den - SLACK))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(len(b), n_hashes) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= limit))

    sigs = classes.select("node", "sig")
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return durable(both.mapInArrow(agree, "a binary, b binary"))


def _sets(nodes: DataFrame, plain: DataFrame, words: int) -> DataFrame:
    """(node, items): the full sets of some classes, from the texts of their first documents."""
    wanted = durable(nodes.distinct().withColumn("doc", _doc_of(F.col("node"))))
    ids = wanted.select("doc").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for b in batches:
            at = 0
            for n, hashes, counts in hasher.of(b.column("text")):
                sets = shingles(hashes, counts, words)
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(at, n), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "h", "items"])
                at += n
        release_memory()

    found = plain.join(ids, "doc", "left_semi").mapInArrow(full, "doc long, h long, items binary").select(_node(F.col("doc"), F.col("h")).alias("node"), "items")
    return durable(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, plain: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are alike."""
    sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), plain, words)

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column("ia"), b.column("ib"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), U64), np.frombuffer(two.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    return durable(both.mapInArrow(jaccard, "a binary, b binary"))


def links_in_block(items: list[np.ndarray], labels: list[bytes], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets that are alike and lie in different components: enough of them to join all components that any such pair joins.

    Members on sides 0 and 1 are compared across; those on side 2 with one another.
    """
    m = len(items)
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(m), [*map(len, items)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    # a shingle that one member has alone is in no intersection
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((m, m), np.float32)
    for a in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((m, COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        common += part @ part.T
    sizes = np.array([*map(len, items)], np.int64)
    both = np.rint(common).astype(np.int64)
    alike = np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1)
    root = {c: c for c in labels}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
        if side[i] != side[j] or side[i] == 2:
            a, b = find(labels[i]), find(labels[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _size_class(n: Column, num: int, den: int) -> Column:
    """Sets that can be alike are in the same class or in neighbouring ones: a class is a little wider than den / num."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num * 1.000001))).cast("int")


def _open_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """The members (bucket, node, n, c) of buckets that hold several components.

    A bucket of more than one chunk becomes a bucket for each size class: there the main component's members of that class meet
    the others of that class and of the neighbouring ones. Members whose sizes alone rule a link out are not compared, and most members get one row.
    """
    each = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items"))
    sizes = durable(
        each.groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.sum("items").alias("items"))
        .filter("parts > 1").select("bucket", "main", "k", "items")
    )
    size_class = _size_class(F.col("n"), num, den)
    of = lambda *classes: F.array(*(F.xxhash64("bucket", x) for x in classes))
    large = (F.col("k") > CHUNK_MEMBERS) | (F.col("items") > CHUNK_ITEMS)
    buckets = F.when(~large, F.array("bucket")).when(F.col("c") == F.col("main"), of(size_class)).otherwise(of(size_class - 1, size_class, size_class + 1))
    return durable(members.join(sizes, "bucket").select(F.explode(buckets).alias("bucket"), "node", "n", "c"))


def _block_links(members: DataFrame, plain: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) across components inside buckets, from members (bucket, node, n, c).

    A bucket is cut into chunks by hash, those of its main component apart from the others. Blocks are pairs of
    chunks, but for two of the main component, between which no link is missing.
    """
    members = _open_members(members, num, den)
    each = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items"))
    shape = each.groupBy("bucket").agg(
        F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts"),
        F.max(F.struct("k", "c", "items")).alias("top"), F.sum("k").alias("k"), F.sum("items").alias("items"),
    ).filter("parts > 1")
    chunks = lambda k, items: F.ceil(F.greatest(k / F.lit(float(CHUNK_MEMBERS)), items / F.lit(float(CHUNK_ITEMS)))).cast("int")
    # a table of its own: adaptive execution can split a large bucket where an exchange alone feeds the join
    shape = durable(shape.select("bucket", "main", chunks(F.col("top.k"), F.col("top.items")).alias("mains"), chunks(F.col("k") - F.col("top.k"), F.col("items") - F.col("top.items")).alias("others")))
    open_ = members.join(shape, "bucket").withColumn("is_main", F.col("c") == F.col("main"))
    draw = F.xxhash64("node")
    # chunks 0 .. others - 1 are the others', then come the main component's
    chunk = F.when(F.col("is_main"), F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others"))).cast("int")
    partners = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    placed = durable(open_.withColumn("chunk", chunk).select("bucket", "node", "c", "chunk", F.explode(partners).alias("partner")))
    if placed.isEmpty():
        return placed.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = _sets(placed.select("node"), plain, words)
    block = F.xxhash64("bucket", F.least("chunk", "partner"), F.greatest("chunk", "partner"))
    side = F.when(F.col("chunk") == F.col("partner"), 2).when(F.col("chunk") < F.col("partner"), 0).otherwise(1)
    rows = placed.select("node", "c", block.alias("block"), side.alias("side")).join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            found = links_in_block([np.frombuffer(h[2], U64) for h in held], [h[1] for h in held], [h[3] for h in held], num, den)
            return pa.RecordBatch.from_arrays([pa.array([min(held[i][0], held[j][0]) for i, j in found], pa.binary()), pa.array([max(held[i][0], held[j][0]) for i, j in found], pa.binary())], names=["a", "b"])

        for b in batches:
            node, c, items = b.column("node"), b.column("c"), b.column("items")
            for i, (block, part) in enumerate(zip(b.column("block").to_pylist(), b.column("side").to_pylist(), strict=True)):
                if block != now:
                    if held:
                        yield links()
                    now, held = block, []
                held.append((node[i].as_py(), c[i].as_py(), items[i].as_py(), part))
        if held:
            yield links()
        held.clear()
        release_memory()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(compare, "a binary, b binary").distinct())
