"""Sharding by sampled splitters.

Size-weighted samples of the keys give quantile boundaries; records are
range-partitioned by them; overfull ranges are subdivided. Inside the ranges
exact prefix sums then place each record, so the shards' sizes do not depend
on the luck of the sample, which only spreads the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Rows that a range should hold, and how many ranges there are at least and at most (the driver holds the boundaries).
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 1_000_000, 48, 4096
#: Samples for each range.
OVERSAMPLING = 24
#: A group of equal texts stays in one shard up to this share of a shard's bytes.
WHOLE_GROUP = 0.01


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Deal documents into ``shards`` shards of nearly equal bytes, equal texts side by side.

    Law ``bytes``: records lie in the order of (MD5 of the text, doc_id); shard
    s takes those that start in the s-th of ``shards`` equal parts of all bytes.
    A record's size is its UTF-8 bytes plus 16. A group of equal texts goes
    where its first record goes as long as it is at most WHOLE_GROUP of a
    shard; a larger one is cut between records.

    A null text counts as empty; a null doc_id sorts first; repeated rows each
    get a slot of their own; an empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
    ))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total = max(total, 1)
    whole = int(total / shards * WHOLE_GROUP)
    # at most shards / WHOLE_GROUP keys can be that heavy
    heavy = {bytes(r[0]) for r in rows.groupBy("key").agg(F.sum("size").alias("g")).filter(F.col("g") > whole).select("key").collect()}
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n // ROWS_PER_RANGE)))
    placed, stats = _ranged(rows, heavy, total, ranges)

    ids = sorted(stats)
    starts = np.cumsum([0, *(stats[i] for i in ids)])[:-1].tolist()
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(zip(ids, starts, strict=True)), "range int, range_start long")
    order = [F.col("key"), F.col("doc_id")]
    by_range = Window.partitionBy("range").orderBy(*order)
    group = Window.partitionBy("range", "key")
    is_heavy = F.col("heavy")
    at = F.when(is_heavy, F.col("start")).otherwise(F.min("start").over(group))
    dealt = durable(
        placed.join(F.broadcast(offsets), "range")  # at most MOST_RANGES rows and their subdivisions
        .withColumn("start", F.col("range_start") + F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("at", at)
        .withColumn("shard", F.expr(f"cast(least(at * {shards} div {total}, {shards - 1}) as int)"))
        .select("doc_id", "size", "text_crc32", "key", "range", "shard")
    )
    counts = sorted(tuple(r) for r in dealt.groupBy("range", "shard").count().collect())
    filled: dict[int, int] = {}
    slots = []
    for range_id, shard, k in counts:
        slots.append((range_id, shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + k
    slots = spark.createDataFrame(slots, "range int, shard int, first_slot long")
    part = Window.partitionBy("range", "shard").orderBy(*order)
    return (
        dealt.join(F.broadcast(slots), ["range", "shard"])  # at most a row for each range and shard cut
        .withColumn("slot", F.col("first_slot") + F.row_number().over(part) - 1)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _composite(key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Keys as 24 bytes that sort as (key, doc_id)."""
    out = np.zeros((len(key), 24), np.uint8)
    out[:, :16] = np.frombuffer(b"".join(key), np.uint8).reshape(-1, 16)
    out[:, 16:] = (doc_id.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S24")


def _sample(rows: DataFrame, bytes_per_sample: float, heavy: set[bytes]) -> list[bytes]:
    """Boundary candidates: a row is drawn with a chance in proportion to its size, the same rows in every run."""
    chance = F.col("size") / F.lit(float(bytes_per_sample))
    draw = (F.xxhash64("key", "doc_id").bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    drawn = rows.filter(draw < chance).select("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    lowest = (0).to_bytes(8, "big")
    found = []
    for r in drawn.toLocalIterator():
        key = bytes(r[0])
        # boundaries fall between groups, and inside a group only if it is heavy
        found.append(key + ((r[1] + (1 << 63)).to_bytes(8, "big") if key in heavy else lowest))
    return sorted(found)


def _ranged(rows: DataFrame, heavy: set[bytes], total: int, ranges: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows with their range and whether their group is heavy, and the bytes of each range."""
    sample = _sample(rows, total / (ranges * OVERSAMPLING), heavy)
    bounds = sorted(set(sample[OVERSAMPLING // 2 :: OVERSAMPLING]))
    limit = 3 * total / ranges
    for _ in range(3):
        placed = _place(rows, bounds, heavy)
        stats = {r[0]: (r[1], r[2]) for r in placed.groupBy("range").agg(F.sum("size"), F.countDistinct("key", "doc_id")).collect()}
        over = [i for i, (size, keys) in stats.items() if size > limit and keys > 1]
        if not over:
            break
        more = _sample(placed.filter(F.col("range").isin(over)), limit / OVERSAMPLING / 3, heavy)
        grown = sorted({*bounds, *more[OVERSAMPLING // 2 :: OVERSAMPLING]})
        if grown == bounds:
            break
        bounds = grown
    else:
        placed = _place(rows, bounds, heavy)
        stats = {r[0]: (r[1], 0) for r in placed.groupBy("range").agg(F.sum("size")).collect()}
    return placed, {i: size for i, (size, _) in stats.items()}


def _place(rows: DataFrame, bounds: list[bytes], heavy: set[bytes]) -> DataFrame:
    edges = np.frombuffer(b"".join(bounds), "S24") if bounds else np.empty(0, "S24")
    heavy_keys = frozenset(heavy)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            ids = np.array([-(1 << 63) if x is None else x for x in b.column("doc_id").to_pylist()], np.int64)
            at = np.searchsorted(edges, _composite(keys, ids), side="right").astype(np.int32) if keys else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at), pa.array([k in heavy_keys for k in keys], pa.bool_())],
                names=[*b.schema.names, "range", "heavy"],
            )

    return rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key binary, range int, heavy boolean")
