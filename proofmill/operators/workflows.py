"""Whole steps put together from the operators: finish an analysis, upgrade it, finish its facts, copy a checked cache.

A row that fails keeps its first error and gets no output (fail closed); the
others of the batch are not held back, unless a sink refuses the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import fingerprint, occurrences, page_marker, source_label, with_quote_id
from ..sources.inputs import fulltext_caches, markdown_items, page_quality
from ..sources.sinks import cache_metadata_path
from . import evidence, locate
from .pages import KEYWORDS, LAST_PAGES, ocr_required, page_candidates, page_selection


#: The format that a facts file names unless the caller says otherwise: its kind is our choice, its version a fixed value.
FACTS_KIND, FACTS_VERSION = "analysis-facts", "facts-v1"


def candidates_markdown(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown): a debug view of the candidates (key, page, ord, quote) with a marker before each page."""
    by_page = candidates.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("ord", "quote"))).alias("_q"))
    block = F.concat(page_marker(F.col("page")), F.lit("\n"), F.array_join(F.transform("_q", lambda x: F.concat(F.lit("- "), x["quote"])), "\n"))
    pages = by_page.select(key, F.struct("page", block.alias("t")).alias("_b")).groupBy(key).agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    return pages.select(key, F.array_join(F.transform("_b", lambda x: x["t"]), "\n\n").alias("markdown"))


def prove_items(items: DataFrame, pages: DataFrame, candidates: DataFrame | None = None, limit: int = evidence.MAX_QUOTE_CHARS, exclusions: DataFrame | None = None) -> DataFrame:
    """``items`` (item_id, doc_id, quote, page or null, source) proved against pages (doc_id, page, text) whose text may be evidence.

    (item_id, doc_id, quote, id, page, end_page, source, error): the page where the span starts, the
    source with a page range where it crosses a page end. Errors in this order: exceeds, sentences, not in source.
    A candidate proved at the same place gives its quote and id. ``exclusions`` (layout.edge_exclusions) are left out over a page end.
    """
    # a blank quote stands everywhere and proves nothing
    spans = locate.within_document(items.filter("quote rlike '(?U)\\\\S'").select("item_id", "doc_id", "quote", F.col("page").cast("long").alias("page")), pages, exclusions).drop("start_offset", "end_offset")
    joined = with_quote_id(items.drop("page"), "quote", "id").join(spans, ["item_id", "doc_id"], "left")
    if candidates is not None:
        joined = locate.canonical(joined, candidates)
    error = (
        F.when(F.length("quote") > limit, "exceeds").when(evidence.sentence_errors(F.col("quote")).isNotNull(), evidence.sentence_errors(F.col("quote")))
        .when(F.col("start_page").isNull(), "not in source")
    )
    label = F.when(F.col("start_page").isNotNull(), source_label(F.col("source"), F.col("start_page"), F.col("end_page"))).otherwise(F.col("source"))
    return joined.select("item_id", "doc_id", "quote", "id", F.col("start_page").alias("page"), "end_page", label.alias("source"), error.alias("error"))


def finalize(analyses: DataFrame, items: DataFrame, heading: str, before: str) -> DataFrame:
    """(analysis, markdown, path, json, items, error): the patched Markdown and the sidecar of each analysis.

    ``analyses``: analysis, markdown, evidence_level, fingerprint; ``items``: analysis, ord, id, quote,
    translation_zh, source, page, error. An analysis with any bad item, an id twice, or without the
    anchor ``before`` exactly once gets its error and null outputs. Without items the section and the list are empty.
    """
    item = F.struct("ord", "id", "quote", "translation_zh", "source", "page")
    # items with an error are not gathered: an analysis that has one gets no output
    by = items.groupBy("analysis").agg(
        F.array_sort(F.collect_list(F.when(F.col("error").isNull(), item))).alias("_items"), F.coalesce(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))), F.min("error")).alias("_bad"),
    )
    ids = F.filter(F.transform("_items", lambda x: x["id"]), lambda x: x.isNotNull())
    joined = analyses.join(by, "analysis", "left").withColumn("_items", F.coalesce("_items", F.array().cast(by.schema["_items"].dataType)))
    patched = evidence.patch_section(F.col("markdown"), heading, before, evidence.render_items(F.col("_items")))
    anchors = F.when(F.coalesce(F.size(F.split("markdown", r"\Q" + before + r"\E")) != 2, F.lit(True)) | patched.isNull(), "anchors")
    error = F.coalesce("_bad", F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate id"), anchors)
    fine = F.col("error").isNull()
    return joined.withColumns({"error": error, "_p": patched, "_j": evidence.sidecar_body(F.col("_items"))}).select(
        "analysis", F.when(fine, F.col("_p")).alias("markdown"), F.when(fine, F.concat(F.col("analysis").cast("string"), F.lit(".future_work.json"))).alias("path"), F.when(fine, F.col("_j")).alias("json"),
        F.when(fine, F.size("_items")).alias("items"), "error",
    )


def upgrade(analyses: DataFrame, pages: DataFrame, heading: str, before: str, candidates: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """``finalize`` for analyses (with doc_id) whose items stand in their own Markdown under ``heading``: each is read, proved in the pages and numbered anew."""
    found = markdown_items(analyses.select("analysis", "doc_id", F.col("markdown").alias("text")), ["analysis", "doc_id"], heading=heading, before=before)
    keyed = found.withColumn("item_id", F.xxhash64("analysis", "doc_id", "ord"))
    proved = prove_items(keyed.select("item_id", "doc_id", "quote", "page", "source"), pages, candidates, exclusions=exclusions)
    named = keyed.select("item_id", "doc_id", "analysis", "ord", "translation_zh").join(proved, ["item_id", "doc_id"])
    return finalize(analyses.drop("doc_id"), named.select("analysis", "ord", "id", "quote", "translation_zh", "source", "page", "error"), heading, before)


def finish_facts(drafts: DataFrame, sidecars: DataFrame, kind: str = FACTS_KIND, version: str = FACTS_VERSION, sources: DataFrame | None = None) -> DataFrame:
    """(analysis, path, json, input_fingerprint, error): drafts (analysis, evidence_level, draft) checked, then joined with their sidecar, whose ids go in.

    The fingerprint is that of the input's bytes now: ``sources`` (analysis, content); without them the drafts bring it as ``input_fingerprint``.
    A draft without a source has the error "no input". The ids come from the sidecar alone: a draft that brings its own has an unknown field.
    ``kind`` and ``version`` name the file's format.
    """
    if sources is not None:
        prints = sources.select("analysis", fingerprint(F.col("content")).alias("input_fingerprint"))
        drafts = drafts.drop("input_fingerprint").join(prints, "analysis", "left")
    joined = evidence.facts_join(drafts, sidecars)
    error = F.coalesce(evidence.schema_errors(F.col("draft")), F.when(F.col("input_fingerprint").isNull() & F.lit(sources is not None), "no input"), F.col("error"))
    body = F.to_json(F.struct(
        F.lit(1).alias("schema"), F.lit(kind).alias("kind"), F.lit(version).alias("generator_version"), "analysis", "evidence_level", "input_fingerprint", F.lit("ok").alias("status"),
        "future_work_ids", V.parse(F.col("draft")).alias("facts"),
    ))
    fine = F.col("error").isNull()
    return joined.withColumns({"error": error, "_j": body}).select(
        "analysis", F.when(fine, F.concat(F.col("analysis").cast("string"), F.lit(".facts.json"))).alias("path"), F.when(fine, F.col("_j")).alias("json"), F.when(fine, F.col("input_fingerprint")).alias("input_fingerprint"), "error",
    )


def validated_cache(caches: DataFrame, sources: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(path, page, text, error): a checked copy of caches (path, pdf_sha256, page, text); a bad cache gives one row with its error and no text.

    ``sources``: path, source_sha256; ``expected``: (path, page) that a cache must hold. Errors: no source, metadata is missing, stale, missing pages.
    """
    states = evidence.cache_errors(caches.groupBy("path").agg(F.max("pdf_sha256").alias("cache_sha256")), sources).select("path", "error")
    if expected is not None:
        lacking = expected.join(caches, ["path", "page"], "left_anti").select("path", F.lit(True).alias("_lacks")).distinct()
        states = states.join(lacking, "path", "left").select("path", F.coalesce("error", F.when(F.col("_lacks"), "missing pages")).alias("error"))
    good = caches.join(states.filter("error is null").select("path"), "path", "left_semi").select("path", "page", "text", F.lit(None).cast("string").alias("error"))
    bad = states.filter("error is not null").select("path", F.lit(None).cast(caches.schema["page"].dataType).alias("page"), F.lit(None).cast("string").alias("text"), "error")
    return good.unionByName(bad)


def prepare(pages: DataFrame, fingerprints: DataFrame | None = None, toc: DataFrame | None = None, quality: DataFrame | None = None, keywords: tuple[str, ...] = KEYWORDS, last: int = LAST_PAGES) -> DataFrame:
    """Everything that reading a document needs, a row for each: doc_id, pdf_sha256, toc, page_quality, selection, candidates, source_pages, ocr_required_pages.

    ``pages``: doc_id, page, text; ``fingerprints``: doc_id, pdf_sha256; ``toc``: doc_id, ord, level, title, page;
    ``quality``: doc_id, page, tier (default: page_quality). Lists are in the order of pages, the table of contents in its own; a
    document without entries has empty lists. A page of the table of contents that the document lacks stays in ``toc`` and is not selected.
    """
    tiers = (page_quality(pages) if quality is None else quality).select("doc_id", "page", "tier")
    chosen = page_selection(pages, None if toc is None else toc.select("doc_id", "page"), keywords, last)
    listed = lambda df, name, *columns: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    numbers = lambda df, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias(name))
    parts = [
        listed(tiers, "page_quality", "page", "tier"), numbers(chosen, "_chosen"), numbers(ocr_required(chosen, tiers), "ocr_required_pages"),
        listed(page_candidates(pages.select("doc_id", "page", "text")), "candidates", "page", "ord", "quote", "id"),
    ]
    if toc is not None:
        parts += [listed(toc, "toc", "ord", "level", "title", "page"), numbers(toc.join(pages, ["doc_id", "page"], "left_semi"), "_toc_pages")]
    out = listed(pages, "source_pages", "page", "text")
    for p in parts:
        out = out.join(p, "doc_id", "left")
    if fingerprints is not None:
        out = out.join(fingerprints.select("doc_id", "pdf_sha256"), "doc_id", "left")
    else:
        out = out.withColumn("pdf_sha256", F.lit(None).cast("string"))
    if toc is None:
        number = dict(pages.dtypes)["page"]
        out = out.withColumns({"toc": F.array().cast(f"array<struct<ord:int,level:int,title:string,page:{number}>>"), "_toc_pages": F.array().cast(f"array<{number}>")})
    full = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.select(
        "doc_id", "pdf_sha256", F.transform(full("toc"), lambda x: x.dropFields("ord")).alias("toc"), full("page_quality").alias("page_quality"),
        F.struct(full("_chosen").alias("pages"), full("_toc_pages").alias("toc_pages")).alias("selection"), full("candidates").alias("candidates"), "source_pages", full("ocr_required_pages").alias("ocr_required_pages"),
    )


def prepared_summary(prepared: DataFrame) -> DataFrame:
    """Of ``prepare``'s rows what a reader wants first, without candidate text."""
    return prepared.select(
        "doc_id", F.lit("ok").alias("result"), "pdf_sha256", F.size("candidates").alias("candidate_count"), F.array_sort(F.array_distinct("candidates.page")).alias("candidate_pages"), "ocr_required_pages",
    )


def write_debug(prepared: DataFrame, path: str) -> None:
    """The whole rows as JSON lines, the candidates as a table, and the candidates as Markdown with a marker before each page."""
    each = prepared.select("doc_id", F.inline("candidates"))
    prepared.select(F.to_json(F.struct(*prepared.columns)).alias("json")).write.mode("overwrite").text(f"{path}/prepare")
    each.write.mode("overwrite").parquet(f"{path}/candidates")
    candidates_markdown(each).write.mode("overwrite").parquet(f"{path}/candidates_markdown")


def update_fulltext_cache(new: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, text, metadata_path, metadata, error): full-text caches (path, text) stamped with the fingerprint that their source (path, source_sha256) has now; without a source nothing is stamped."""
    joined = new.select("path", "text").join(sources.select("path", "source_sha256"), "path", "left")
    stamp = F.to_json(F.struct(F.lit(1).alias("schema"), F.col("source_sha256").alias("pdf_sha256")))
    known = F.col("source_sha256").isNotNull()
    return joined.select(
        "path", F.when(known, F.col("text")).alias("text"), F.when(known, cache_metadata_path(F.col("path"))).alias("metadata_path"),
        F.when(known, stamp).alias("metadata"), F.when(~known, "no source").alias("error"),
    )


def validated_fulltext_cache(caches: DataFrame, metadata: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, text, pdf_sha256, error): a checked copy of full-text caches; a bad one keeps no text. Errors: no source, metadata is missing, stale."""
    found = fulltext_caches(caches, metadata)
    states = evidence.cache_errors(found.select("path", "cache_sha256"), sources)
    fine = F.col("error").isNull()
    return found.select("path", "text").join(states, "path").select("path", F.when(fine, F.col("text")).alias("text"), F.when(fine, F.col("source_sha256")).alias("pdf_sha256"), "error")


def run_programs(files: DataFrame, steps: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """``files`` with ``result`` and ``error``: the stored rewrite program that each row names, run over its text.

    ``steps``: program, ord, mode (once, all, keep, drop), old, new. "once" and "all" replace; "keep" and "drop"
    are gates: the text must hold ``old``, or must not. The steps of a program travel as one array and are folded over the text;
    the first error ends the run. A program without steps, an unknown mode and an empty ``old`` are errors; a null text has neither result nor error.
    """
    step = F.struct("ord", "mode", "old", F.coalesce("new", F.lit("")).alias("new"))
    listed = steps.groupBy(F.col("program").alias("_program")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    joined = files.join(listed, F.col(program).eqNullSafe(F.col("_program")), "left")

    def run(state: Column, x: Column) -> Column:
        now = state["text"]
        n = occurrences(now, x["old"])
        # the array is in order, and a step's number is its place in it
        problem = (
            F.when(F.coalesce(x["old"] == "", F.lit(True)), "nothing to look for").when((x["mode"] == "once") & (n != 1), F.concat(F.lit("expected once, found "), n.cast("string")))
            .when((x["mode"] == "keep") & (n == 0), "missing").when((x["mode"] == "drop") & (n > 0), "left over").when(~x["mode"].isin("once", "all", "keep", "drop"), "unknown mode")
        )
        done = F.when(x["mode"].isin("once", "all"), F.replace(now, x["old"], x["new"])).otherwise(now)
        fresh = F.struct(
            F.when(problem.isNull(), done).otherwise(now).alias("text"), F.when(problem.isNotNull(), F.concat(F.lit("step "), (state["k"] + 1).cast("string"), F.lit(": "), problem)).alias("error"), (state["k"] + 1).alias("k"),
        )
        return F.when(state["error"].isNull(), fresh).otherwise(state)

    start = F.struct(F.col(text).alias("text"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("k"))
    ran = joined.withColumn("_ran", F.aggregate("_steps", start, run))
    error = F.when(F.col(text).isNotNull(), F.coalesce(F.when(F.col("_steps").isNull(), F.concat(F.lit("no program "), F.coalesce(F.col(program), F.lit("null")))), F.col("_ran.error")))
    return ran.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), F.col("_ran.text"))).drop("_ran", "_steps", "_program")
