"""Sinks: sidecars, debug tables, verdict files. A batch is checked whole before anything is written."""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(ValueError):
    """A batch with errors; nothing was written."""


def sidecar_path(analysis: Column, kind: str = "future_work") -> Column:
    return F.concat(analysis, F.lit(f".{kind}.json"))


def cache_metadata_path(cache: Column) -> Column:
    return F.concat(cache, F.lit(".meta.json"))


def require_clean(df: DataFrame, error: str = "error") -> DataFrame:
    """``df`` without its error column; Rejected with the first errors if there are any."""
    found = df.filter(F.col(error).isNotNull()).groupBy(error).count().orderBy(F.desc("count"), error).limit(5).collect()
    if found:
        raise Rejected("; ".join(f"{r[0]} ({r[1]})" for r in found))
    return df.drop(error)


def write_table(df: DataFrame, path: str, error: str | None = "error") -> None:
    """Write one artifact table as Parquet, all or nothing; refuse a batch with errors."""
    (require_clean(df, error) if error and error in df.columns else df).write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_in_order(steps: list[tuple[str, DataFrame]], root: str, batch: str | None = None) -> list[str]:
    """Check every step, write them one after another (analysis, sidecar, facts) and publish them together; what is published is returned.

    Tables go to a folder of the batch under ``root``, then a manifest with their paths and row counts is
    put in place by a rename, the last step. Readers (``published``) see published batches alone, so one that
    fails on the way leaves the state before it. A batch that is published already is not written again.
    """
    spark = steps[0][1].sparkSession
    batch = batch or uuid.uuid4().hex
    files, at = _folder(spark, f"{root}/manifests")
    clean = [(name, require_clean(df) if "error" in df.columns else df) for name, df in steps]
    known = _manifests(spark, root)
    if done := next((m for m in known if m["batch"] == batch), None):
        return [t["name"] for t in done["tables"]]
    tables = []
    for name, df in clean:
        path = f"{root}/data/{batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        tables.append({"name": name, "path": path, "rows": spark.read.schema(df.schema).parquet(path).count()})
    files.mkdirs(at)
    number = max((m["number"] for m in known), default=0) + 1
    draft, final = (spark._jvm.org.apache.hadoop.fs.Path(at, name) for name in (f"_draft-{batch}", f"{number:012d}.json"))
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"number": number, "batch": batch, "tables": tables}, ensure_ascii=False).encode()))
    out.close()
    # a rename does not replace a manifest that another writer has put there meanwhile
    if files.exists(final) or not files.rename(draft, final):
        raise Rejected(f"manifest {number} is there already: another batch was published meanwhile")
    return [t["name"] for t in tables]


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the last published batch that has it; Rejected if there is none, or rows of it are gone."""
    for manifest in reversed(_manifests(spark, root)):
        for t in manifest["tables"]:
            if t["name"] == name:
                found = spark.read.parquet(t["path"])
                if found.count() != t["rows"]:
                    raise Rejected(f"{name}: {t['rows']} rows were published")
                return found
    raise Rejected(f"{name} is not published")


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, root: str) -> list[dict]:
    """All manifests in their order; each is one small file."""
    files, at = _folder(spark, f"{root}/manifests")
    if not files.exists(at):
        return []
    names = [s.getPath().toString() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")]
    return sorted((json.loads(r[0]) for r in spark.read.text(names, wholetext=True).collect()), key=lambda m: m["number"]) if names else []


def verdict_json(verdict: DataFrame) -> DataFrame:
    """(run_id, json, exit_code): verdicts as indented JSON, other scripts kept, with nulls."""
    body = [c for c in verdict.columns if c not in ("run_id", "exit_code")]
    return verdict.select("run_id", F.concat(F.to_json(F.struct(*body), {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n")).alias("json"), "exit_code")
