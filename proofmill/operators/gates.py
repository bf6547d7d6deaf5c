"""Gates over texts and file lists: markers, their order, mutation, purity, revalidation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.automaton import Automaton
from ..functions.text import missing_markers, present_markers
from .locate import pattern_blocks

#: Pairs of a text and a marker that are looked at together.
MOST_CELLS = 1 << 22


def marker_gate(text: Column, required: Sequence[str], forbidden: Sequence[str] = ()) -> tuple[Column, Column, Column]:
    """(missing, present but forbidden, passed)."""
    missing, unwanted = missing_markers(text, required), present_markers(text, forbidden)
    return missing, unwanted, (F.size(missing) == 0) & (F.size(unwanted) == 0)


def missing_rows(texts: DataFrame, markers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, marker) of required markers (marker) that a text lacks, whatever their number: one scan of the texts for each block of markers. A null text is not judged."""
    kind = texts.schema[key].dataType
    out = None
    for block in pattern_blocks(markers.select("marker")):

        def run(batches: Iterator[pa.RecordBatch], block: list[str] = block) -> Iterator[pa.RecordBatch]:
            automaton, names = Automaton([m.encode() for m in block]), pa.array(block, pa.string())
            for b in batches:
                rows = max(1, MOST_CELLS // len(block))
                for at in range(0, len(b), rows):
                    part = b.slice(at, rows)
                    lacks = np.ones((len(part), len(block)), bool)
                    lacks[automaton.find(part.column("t"))] = False
                    lacks[part.column("t").is_null().to_numpy(zero_copy_only=False)] = False
                    row, which = np.nonzero(lacks)
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row)), names.take(pa.array(which))], names=[key, "marker"])

        found = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, StructType([StructField(key, kind), StructField("marker", StringType())]))
        out = found if out is None else out.unionByName(found)
    return texts.select(key, F.lit("").alias("marker")).limit(0) if out is None else out


def mutants(texts: DataFrame, markers: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """(key, marker, mutant, caught): each text without the lines that hold a marker; the gate must miss just that marker's lines."""
    lines = F.split(text, "\n")
    one = lambda m: F.struct(F.lit(m).alias("marker"), F.array_join(F.filter(lines, lambda x: F.instr(x, F.lit(m)) == 0), "\n").alias("mutant"))
    return texts.select(key, F.inline(F.array(*map(one, markers)))).withColumn("caught", F.array_contains(missing_markers(F.col("mutant"), markers), F.col("marker")))


def impure_paths(files: DataFrame, forbidden: Sequence[str], path: str = "path") -> DataFrame:
    """Paths of an install tree that must not be there: test folders, test files, forbidden names."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return files.filter(F.array_contains(parts, "tests") | name.rlike("^test_.*\\.py$") | name.isin(*forbidden))


def install_errors(files: DataFrame, forbidden: Sequence[str], required: Sequence[str], path: str = "path", tree: str = "tree") -> DataFrame:
    """(tree, path, error) of install trees (tree, path): what must not be there, and what must: a file, or with "/" at its end a folder that holds something."""
    impure = impure_paths(files, forbidden, path).select(tree, path, F.lit("must not be there").alias("error"))
    has = lambda r: F.bool_or(F.startswith(F.col(path), F.lit(r)) if r.endswith("/") else F.col(path) == r)
    lacks = files.groupBy(tree).agg(F.filter(F.array(*(F.when(~F.coalesce(has(r), F.lit(False)), F.lit(r)) for r in required)), lambda x: x.isNotNull()).alias("_l"))
    return impure.unionByName(lacks.select(tree, F.explode("_l").alias(path), F.lit("missing").alias("error")))


def retry_verdicts(attempts: DataFrame, by: Sequence[str], limit: int = 2) -> DataFrame:
    """(by, status, decision, used, ignored): what ordered attempts at a frozen revision (by, ord, status, transport, contaminated, inputs) amount to.

    An attempt in a contaminated setup, or with other inputs than the first clean one, does not count. The first
    verdict stays: a FAIL_PRODUCER, PASS, NOT_TESTED or INVALID_TEST_EXECUTION is never overwritten. BLOCKED by
    the transport may be tried again ``limit`` times, BLOCKED by anything else not at all. decision: STOP, RETRY, or START where no attempt
    counts (CASE_NOT_STARTED). used: attempts that count up to the end; ignored: all others.

    ``ord`` is different for each attempt of a key. Windows stream over the sorted attempts of a key, however many there are.
    """
    order = Window.partitionBy(*by).orderBy("ord")
    clean = ~F.coalesce("contaminated", F.lit(False))
    frozen = F.first(F.when(clean, F.struct("inputs")), ignorenulls=True).over(order)["inputs"]
    marked = attempts.withColumn("_counts", clean & frozen.eqNullSafe(F.col("inputs")))
    again = F.col("_counts") & (F.col("status") == "BLOCKED") & F.coalesce("transport", F.lit(False))
    marked = marked.withColumns({"_again": again, "_tries": F.sum(again.cast("int")).over(order)})
    ends = F.col("_counts") & (~F.col("_again") | (F.col("_tries") > limit))
    over = F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumns({"_ends": ends, "_live": F.col("_counts") & (F.coalesce(over, F.lit(0)) == 0)})
    grouped = marked.groupBy(*by).agg(
        F.min_by("status", F.when(F.col("_ends"), F.col("ord"))).alias("_final"), F.max_by("status", F.when(F.col("_live"), F.col("ord"))).alias("_last"),
        F.count_if("_live").alias("used"), F.count_if(~F.col("_live")).alias("ignored"),
    )
    decision = F.when(F.col("_final").isNotNull(), "STOP").when(F.col("_last").isNotNull(), "RETRY").otherwise("START")
    return grouped.select(*by, F.coalesce("_final", "_last", F.lit("CASE_NOT_STARTED")).alias("status"), decision.alias("decision"), "used", "ignored")


def absolute_error(path: Column) -> Column:
    return F.when(~path.startswith("/"), F.lit("path must be absolute"))


def revalidation(cases: DataFrame, changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(case_id, decision): run again where a runtime dependency changed, judge the old evidence again where only a judging one did, else reuse a pass.

    ``cases``: case_id, passed; ``dependencies``: case_id, path, kind ("runtime" or "judge"); ``changes``: path.
    """
    hit = dependencies.join(changes.select("path").distinct(), "path", "left_semi").groupBy("case_id").agg(F.bool_or(F.col("kind") == "runtime").alias("_run"), F.bool_or(F.col("kind") == "judge").alias("_judge"))
    decision = F.when(F.coalesce("_run", F.lit(False)) | ~F.coalesce("passed", F.lit(False)), "EXECUTE_CURRENT").when(F.coalesce("_judge", F.lit(False)), "REJUDGE_PRIOR_EVIDENCE").otherwise("REUSE_PRIOR_PASS")
    return cases.join(hit, "case_id", "left").select("case_id", decision.alias("decision"))


def outer_status(started: Column, verdict: Column) -> Column:
    """The case's outer state: before any evidence exists it is no verdict on the product."""
    return F.when(~F.coalesce(started, F.lit(False)), "CASE_NOT_STARTED").otherwise(verdict)
