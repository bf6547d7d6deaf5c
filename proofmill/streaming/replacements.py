"""Replacement pages as they arrive: the streaming counterpart of the batch merge.

The state of a document is the pages that still wait for text and, for each page that has
one, the version that holds. It is kept by key, so a document is worked on where its state is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: State of every size needs a store on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = StructType([StructField("doc_id", LongType()), StructField("page", LongType()), StructField("version", LongType()), StructField("text", StringType()), StructField("waiting", LongType())])


class Merge(StatefulProcessor):
    """Takes text for pages that are required; the highest version of a page holds, of equal ones the smaller text, whatever comes first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value for each document: it is read once and written once for all rows that come together
        self.required = handle.getValueState("required", StructType([StructField("page", ArrayType(LongType())), StructField("version", ArrayType(LongType())), StructField("text", ArrayType(StringType()))]))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        pages = [int(page) for page in initialState["page"]]
        self.required.update((pages, [-1] * len(pages), [""] * len(pages)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = self.required.get()
        if state is None:
            return
        held = {page: (version, text) for page, version, text in zip(*state, strict=True)}
        taken: dict[int, tuple[int, str]] = {}
        for frame in rows:
            for page, version, text in zip(frame["page"], frame["version"], frame["text"], strict=True):
                place, now = int(page), held.get(int(page))
                if text is None or now is None:
                    continue
                if int(version) > now[0] or (int(version) == now[0] and text < now[1]):
                    held[place] = taken[place] = (int(version), text)
        if not taken:
            return
        self.required.update(([*held], [v for v, _ in held.values()], [t for _, t in held.values()]))
        waiting = sum(1 for version, _ in held.values() if version < 0)
        yield pd.DataFrame([(key[0], page, version, text, waiting) for page, (version, text) in taken.items()], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def merged_stream(replacements: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, page, version, text, waiting): each replacement (doc_id, page, version, text) of a stream that holds when it comes, and how many pages of its document still wait.

    ``required``: (doc_id, page) of a table, the initial state; text for other pages, and null text, is passed over. Versions are not negative. A
    page may come out again with a later version: ``settled`` keeps the last. The session needs the store STORE.
    """
    first = required.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page")).distinct().groupBy("doc_id")
    rows = replacements.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("version").cast("long").alias("version"), F.col("text").cast("string").alias("text"))
    return rows.groupBy("doc_id").transformWithStateInPandas(Merge(), OUTPUT, "Append", "None", initialState=first)


def settled(merged: DataFrame) -> DataFrame:
    """(doc_id, page, text) that hold at the end of a stream, from all that came out of it."""
    return merged.groupBy("doc_id", "page").agg(F.min(F.struct((-F.col("version")).alias("v"), F.col("text").alias("t"))).alias("_b")).select("doc_id", "page", F.col("_b.t").alias("text"))
