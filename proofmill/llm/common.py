"""What the operators of this subpackage share: reading, scratch tables, splitmix hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="proofmill-"))
        where = context.getCheckpointDir()
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it again.

    It cuts the lineage, so that a lost executor costs a read and not a
    recomputation, and lets several later steps share one pass. The table stays
    until drop_scratch or the folder's own cleaning: results read from it are lazy.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written by ``durable``; for when its results are written too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_position(df: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns ``own`` (those that it has) under these names and all others named by their place, and the old names for ``toDF``.

    So no name of the caller's, with dots, backticks or in other letters, meets one that is used inside. Of
    names that differ by case alone the exact one is meant, else the first.
    """
    names = df.columns
    folded = [c.lower() for c in names]
    at = {(names.index(name) if name in names else folded.index(name.lower())): name for name in own if name.lower() in folded}
    return df.toDF(*(at.get(k, f"_column{k}") for k in range(len(names)))), names


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, and its executor's memory is counted with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
