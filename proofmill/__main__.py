"""Command line: ``python -m proofmill COMMAND ... --output PATH``; reads and writes through Spark, the exit code tells the result.

Tables are Parquet. A command that checks a batch writes nothing and returns 1 if any row has an error; the errors go to standard error.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evidence, pages, topology, workflows
from .sources import inputs, sinks

#: Worst first: the exit code of a batch is that of its worst verdict.
SEVERITY = ("INVALID_TEST_EXECUTION", "BLOCKED", "FAIL_PRODUCER", "NOT_TESTED", "PASS")


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Verdicts for response files under one contract, each printed with its status on standard error; the exit code of the worst."""
    runs = inputs.read_whole(spark, args.responses).select(F.col("path").alias("run_id"), F.col("text").alias("response"))
    contract = "\n".join(r[0] for r in spark.read.text(args.contract, wholetext=True).limit(1).collect())
    found = topology.verdicts(runs, contract, args.contract_id).persist()
    sinks.write_json_lines(sinks.verdict_json(found), args.output)
    # one at a time: the driver holds no batch
    for r in sinks.verdict_json(found).join(found.select("run_id", "producer_status"), "run_id").orderBy("run_id").toLocalIterator():
        print(r["json"], end="")
        print(f"producer_status: {r['producer_status']}", file=sys.stderr)
    counts = {r[0]: r[1] for r in found.groupBy("producer_status").count().collect()}
    worst = next((s for s in SEVERITY if s in counts), "INVALID_TEST_EXECUTION")
    return topology.EXIT_CODES[worst]


def normalize(spark: SparkSession, args: argparse.Namespace) -> int:
    """Canonical form of normalised inputs; nothing is written if one of them is bad."""
    files = inputs.read_whole(spark, args.inputs).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    try:
        sinks.write_table(inputs.normalized_inputs(files, args.kind), args.output)
    except sinks.Rejected as wrong:
        print(wrong, file=sys.stderr)
        return 1
    return 0


def candidates(spark: SparkSession, args: argparse.Namespace) -> int:
    """Candidate sentences of a table of pages (doc_id, page, text), and a short summary on standard output."""
    made = pages.page_candidates(spark.read.parquet(args.pages).select("doc_id", "page", "text"))
    sinks.write_table(made, args.output)
    n, docs = spark.read.parquet(args.output).agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    print(json.dumps({"candidate_count": n, "documents": docs}))
    return 0


def _written(df: DataFrame, path: str) -> int:
    """Write a checked batch and say how many rows it has; 1 if it was refused."""
    try:
        sinks.write_table(df.persist(), path)
    except sinks.Rejected as wrong:
        print(json.dumps({"ok": False, "errors": str(wrong)}), file=sys.stderr)
        return 1
    finally:
        df.unpersist()
    print(json.dumps({"ok": True, "rows": df.sparkSession.read.parquet(path).count()}))
    return 0


def prepare(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whole preparation of a table of pages (doc_id, page, text), with all views of it if a debug folder is named; prints a summary."""
    made = workflows.prepare(spark.read.parquet(args.pages).select("doc_id", "page", "text"), last=args.last_pages).persist()
    sinks.write_table(made, args.output)
    if args.debug_dir:
        workflows.write_debug(made, args.debug_dir)
    n, docs, required = workflows.prepared_summary(made).agg(F.sum("candidate_count"), F.count(F.lit(1)), F.sum(F.size("ocr_required_pages"))).first()
    print(json.dumps({"result": "ok", "candidate_count": n or 0, "documents": docs, "ocr_required_pages": required or 0}))
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Items (item_id, doc_id, quote, page, source) proved in prepared documents' pages."""
    source = spark.read.parquet(args.prepared).select("doc_id", F.inline("source_pages"))
    return _written(workflows.prove_items(spark.read.parquet(args.items), source), args.output)


def finalize(spark: SparkSession, args: argparse.Namespace) -> int:
    """Analyses (analysis, markdown, evidence_level, fingerprint) with the section and sidecar of their items (analysis, ord, id, quote, translation_zh, source, page, error)."""
    return _written(workflows.finalize(spark.read.parquet(args.analyses), spark.read.parquet(args.items), args.heading, args.before), args.output)


def upgrade(spark: SparkSession, args: argparse.Namespace) -> int:
    """Sidecars for analyses (analysis, doc_id, markdown, evidence_level, fingerprint) from the items in their own Markdown, proved in prepared documents' pages."""
    source = spark.read.parquet(args.prepared).select("doc_id", F.inline("source_pages"))
    return _written(workflows.upgrade(spark.read.parquet(args.analyses), source, args.heading, args.before), args.output)


def facts_validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Field names of drafts (analysis, draft); with --nested the kinds of all fields inside too."""
    drafts = spark.read.parquet(args.drafts)
    if args.nested:
        found = evidence.shape_errors(drafts.select("analysis", "draft"), evidence.DRAFT_SHAPE)
        return _written(found.select("analysis", "draft", F.nullif(F.array_join("errors", "; "), F.lit("")).alias("error")), args.output)
    return _written(drafts.select("analysis", "draft", evidence.schema_errors(F.col("draft")).alias("error")), args.output)


def facts_finalize(spark: SparkSession, args: argparse.Namespace) -> int:
    """Facts files from drafts (analysis, evidence_level, draft) and sidecars; the fingerprint is that of --inputs (analysis, content), else the drafts bring it (input_fingerprint)."""
    sources = spark.read.parquet(args.inputs) if args.inputs else None
    return _written(workflows.finish_facts(spark.read.parquet(args.drafts), spark.read.parquet(args.sidecars), args.kind, args.format_version, sources), args.output)


def merge_ocr(spark: SparkSession, args: argparse.Namespace) -> int:
    """Pages (doc_id, page, text) with replacement text for those of a bad tier (quality: doc_id, page, tier); refused if a required page lacks one."""
    all_pages, tiers, new = (spark.read.parquet(x) for x in (args.pages, args.quality, args.replacements))
    required = pages.ocr_required(pages.page_selection(all_pages), tiers)
    lacking = pages.unsupplied(required, new).withColumn("_lacks", F.lit(True))
    merged = pages.merge_replacements(all_pages, tiers, required, new).join(lacking, ["doc_id", "page"], "left")
    return _written(merged.withColumn("error", F.when(F.col("_lacks"), "required page without text")).drop("_lacks"), args.output)


def update_ocr_cache(spark: SparkSession, args: argparse.Namespace) -> int:
    """Page caches (path, pdf_sha256, page, text) after an update; stale pages never join in."""
    return _written(evidence.update_cache(spark.read.parquet(args.caches), spark.read.parquet(args.new)), args.output)


def validate_ocr_cache(spark: SparkSession, args: argparse.Namespace) -> int:
    """A checked copy of page caches (path, pdf_sha256, page, text) against sources (path, source_sha256)."""
    return _written(workflows.validated_cache(spark.read.parquet(args.caches), spark.read.parquet(args.sources)), args.output)


def update_fulltext_cache(spark: SparkSession, args: argparse.Namespace) -> int:
    """Full-text caches (path, text) with metadata for their sources (path, source_sha256)."""
    return _written(workflows.update_fulltext_cache(spark.read.parquet(args.new), spark.read.parquet(args.sources)), args.output)


def validate_fulltext_cache(spark: SparkSession, args: argparse.Namespace) -> int:
    """A checked copy of full-text caches (path, text) with metadata (path, json) against sources (path, source_sha256)."""
    return _written(workflows.validated_fulltext_cache(*(spark.read.parquet(x) for x in (args.caches, args.metadata, args.sources))), args.output)


def quality(spark: SparkSession, args: argparse.Namespace) -> int:
    """A quality report on a table of pages (doc_id, page, text): scores, threshold and summary of each document."""
    return _written(inputs.quality_report(spark.read.parquet(args.pages), "doc_id"), args.output)


#: Commands with what they read, and their options.
COMMANDS: tuple[tuple[Callable[[SparkSession, argparse.Namespace], int], tuple[str, ...], dict[str, dict]], ...] = (
    (verify, ("responses", "contract", "contract_id"), {}), (normalize, ("inputs",), {"--kind": {"required": True}}), (candidates, ("pages",), {}),
    (prepare, ("pages",), {"--last-pages": {"type": int, "default": pages.LAST_PAGES}, "--debug-dir": {}}), (validate, ("items", "prepared"), {}),
    (finalize, ("analyses", "items"), {"--heading": {"required": True}, "--before": {"required": True}}), (upgrade, ("analyses", "prepared"), {"--heading": {"required": True}, "--before": {"required": True}}),
    (facts_validate, ("drafts",), {"--nested": {"action": "store_true"}}), (facts_finalize, ("drafts", "sidecars"), {"--inputs": {}, "--kind": {"default": workflows.FACTS_KIND}, "--format-version": {"default": workflows.FACTS_VERSION}}), (merge_ocr, ("pages", "quality", "replacements"), {}),
    (update_ocr_cache, ("caches", "new"), {}), (validate_ocr_cache, ("caches", "sources"), {}), (update_fulltext_cache, ("new", "sources"), {}), (validate_fulltext_cache, ("caches", "metadata", "sources"), {}),
    (quality, ("pages",), {}),
)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="proofmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for f, reads, options in COMMANDS:
        p = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for o in reads:
            p.add_argument(o)
        for o, how in options.items():
            p.add_argument(o, **how)
        p.add_argument("--output", required=True)
        p.set_defaults(run=f)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
