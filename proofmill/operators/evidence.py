"""Evidence records: validation with error codes, joins by identity and fingerprint, sidecars, Markdown sections.

Nothing here raises for bad data: a row gets the first error that applies in an
``error`` column, and whoever writes checks the whole batch first (fail closed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import in_order, occurrences, sentences, with_quote_id

#: Our choice: the longest quote that is accepted, in code points.
MAX_QUOTE_CHARS = 2000
MAX_SENTENCES = 2
#: Different drafts up to this many are walked once each, and broadcast.
EQUAL_DRAFTS = 20_000
#: Fixed value: the version of a sidecar's format.
SIDECAR_VERSION = "future-work-v1"
#: The field names of a facts file.
FACT_FIELDS = ("paper", "research_problem", "research_object", "approach", "findings", "contributions", "topic_terms", "limitations", "source_anchors", "confidence")
#: The kinds of a draft's fields; names and kinds are fixed values, that all of a paper's own fields may be null is our choice.
PAPER_FIELDS = ("title", "authors", "year", "venue", "doi")
DRAFT_SHAPE: tuple[tuple[str, str, bool], ...] = (
    ("paper", "OBJECT", True), *((f"paper.{f}", "ARRAY|NULL" if f == "authors" else "NUMBER|NULL" if f == "year" else "STRING|NULL", f == "title") for f in PAPER_FIELDS), ("paper.authors[]", "STRING", False),
    *((f, "STRING", True) for f in ("research_problem", "research_object", "approach")), *((f, "ARRAY", True) for f in ("findings", "contributions", "topic_terms", "limitations")),
    *((f"{f}[]", "STRING", False) for f in ("findings", "contributions", "topic_terms", "limitations")),
    ("source_anchors", "OBJECT", True), *((f"source_anchors.{f}{e}", k, False) for f in ("research_problem", "research_object", "approach", "findings", "contributions", "limitations") for e, k in (("", "ARRAY"), ("[]", "STRING"))), ("confidence", "NUMBER", True),
)


def item_errors(items: DataFrame, candidates: DataFrame, limit: int = MAX_QUOTE_CHARS) -> DataFrame:
    """``items`` (item_id, doc_id, quote, page, id or null) with ``error``: exact membership in the prepared candidates.

    In this order: exceeds (too long), prepared candidate (no such quote in the
    document), quote and page (not on that page), does not match (a given id that is
    not the quote's). A shortened quote is another quote, so it is no candidate.
    """
    # quotes meet by their digests, so that no text is shuffled for the candidates; one aggregate knows all pages of a quote
    digest = F.unhex(F.md5(F.col("quote").cast("binary")))
    known = candidates.select("doc_id", digest.alias("_key"), "page").groupBy("doc_id", "_key").agg(F.collect_set("page").alias("_pages"))
    # what is too long is rejected whatever it says: it gets no id and meets no candidates
    long = F.coalesce(F.length("quote") > limit, F.lit(False))
    fitting = with_quote_id(items.filter(~long), "quote", "_id").withColumns({"_key": digest, "_foreign": F.col("id").isNotNull() & (F.col("id") != F.col("_id"))})
    joined = fitting.join(known, ["doc_id", "_key"], "left")
    error = (
        F.when(F.col("_pages").isNull(), "prepared candidate")
        .when(~F.coalesce(F.array_contains("_pages", F.col("page")), F.lit(False)), "quote and page").when(F.col("_foreign"), "does not match")
    )
    rejected = items.filter(long).select(*items.columns, F.lit(None).cast("string").alias("quote_id"), F.lit("exceeds").alias("error"))
    return joined.select(*items.columns, F.col("_id").alias("quote_id"), error.alias("error")).unionByName(rejected)


def sentence_errors(quote: Column, most: int = MAX_SENTENCES) -> Column:
    """A quote of more sentences is rejected, never cut."""
    return F.when(F.size(sentences(quote)) > most, F.lit("sentences"))


def abstract_errors(level: Column, source: Column) -> Column:
    """Abstract-level input may cite the abstract alone."""
    return F.when((level == "abstract") & ~F.lower(source).startswith("abstract"), F.lit("source beyond the abstract"))


def duplicate_ids(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, id, n): ids that one sidecar holds more than once."""
    return items.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def schema_errors(draft: Column, allowed: Sequence[str] = FACT_FIELDS, required: Sequence[str] = FACT_FIELDS) -> Column:
    """Of a JSON text: "not an object", "unknown fields: ..." or "missing fields: ..."."""
    keys = F.array_sort(F.json_object_keys(draft))
    unknown = F.array_except(keys, F.array(*map(F.lit, allowed)))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    return (
        F.when(keys.isNull(), "not an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
    )


def shape_errors(drafts: DataFrame, shape: Sequence[tuple[str, str, bool]], draft: str = "draft", depth: int = 3) -> DataFrame:
    """``drafts`` with ``errors``: all that is wrong with a JSON text under a shape (path, kind, required), sorted; null for a null text.

    Paths are dotted names; those of a list's elements end in "[]". Kinds are those of ``variants.kind``, several as "STRING|NULL". A
    name that the shape lacks is unknown, one under an unknown or wrong one is not looked at. A required
    name is missed where its parent is an object. ``depth`` levels are walked, each once: it is a column of its own.
    """
    kinds = F.create_map(*(F.lit(x) for path, kind, _ in shape for x in (path, F.array(*map(F.lit, kind.split("|"))))))
    kept = lambda x: F.struct(x["path"].alias("path"), x["v"].alias("v"), V.kind(x["v"]).alias("kind"), F.element_at(kinds, x["path"]).alias("may"))
    fits = lambda x: F.coalesce(F.array_contains(x["may"], x["kind"]), F.lit(False))
    under = lambda x: F.when(x["path"] == "", "").otherwise(F.concat(x["path"], F.lit(".")))
    place = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    inside = lambda x: (
        F.when(x["kind"] == "OBJECT", F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: place(F.concat(under(x), e["key"]), e["value"])))
        .when(x["kind"] == "ARRAY", F.transform(V.elements(x["v"]), lambda e: place(F.concat(x["path"], F.lit("[]")), e)))
    )
    whole = F.array(place(F.lit(""), F.col("_v")))
    walked = drafts.withColumn("_v", V.parse(F.col(draft))).withColumn("_0", F.transform(whole, lambda x: F.struct(x["path"].alias("path"), x["v"].alias("v"), V.kind(x["v"]).alias("kind"), F.array(F.lit("OBJECT")).alias("may"))))
    for k in range(depth):
        # what fits is opened, then each part is told its kind
        opened = F.flatten(F.transform(F.filter(f"_{k}", lambda x: fits(x) & x["kind"].isin("OBJECT", "ARRAY")), inside))
        walked = walked.withColumn("_in", opened).withColumn(f"_{k + 1}", F.transform("_in", kept)).drop("_in")
    slim = lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"), x["may"].isNotNull().alias("known"), fits(x).alias("fits"))
    seen = walked.withColumn("_seen", F.concat(*(F.transform(f"_{k}", slim) for k in range(depth + 1)))).drop("_v", *(f"_{k}" for k in range(depth + 1)))
    wrong = F.transform(F.filter("_seen", lambda x: ~x["fits"] & (x["path"] != "")), lambda x: F.when(x["known"], F.concat(x["path"], F.lit(": "), F.lower(x["kind"]))).otherwise(F.concat(F.lit("unknown: "), x["path"])))
    listed = seen.withColumns({"_wrong": wrong, "_paths": F.transform("_seen", lambda x: x["path"]), "_open": F.transform(F.filter("_seen", lambda x: x["kind"] == "OBJECT"), lambda x: x["path"])})
    needed = [F.when(F.array_contains("_open", p.rpartition(".")[0]) & ~F.array_contains("_paths", p), F.lit(f"missing: {p}")) for p, _, required in shape if required]
    lacks = F.filter(F.array(*needed), lambda x: x.isNotNull()) if needed else F.array().cast("array<string>")
    errors = F.when(F.col(draft).isNotNull(), F.when(~F.array_contains("_open", ""), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.array_distinct(F.concat("_wrong", lacks)))))
    return listed.withColumn("errors", errors).drop("_seen", "_wrong", "_paths", "_open")


def shape_errors_of_equal(drafts: DataFrame, shape: Sequence[tuple[str, str, bool]], draft: str = "draft", most: int = EQUAL_DRAFTS) -> DataFrame:
    """``shape_errors``, each different text walked once where there are at most ``most`` of them; the errors are brought back to every row that has the text. More are walked row by row."""
    texts = drafts.select(F.col(draft).alias("_text")).distinct()
    if texts.limit(most + 1).count() > most:
        return shape_errors(drafts, shape, draft)
    judged = shape_errors(texts.repartition(drafts.sparkSession.sparkContext.defaultParallelism), shape, "_text")
    return drafts.join(F.broadcast(judged), F.col(draft).eqNullSafe(F.col("_text")), "left").drop("_text")


def facts_join(facts: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Facts (analysis, evidence_level, input_fingerprint) with their future-work sidecar (analysis, evidence_level, source_pdf_fingerprint, status, future_work_ids).

    ``error``: no sidecar, status, evidence level, fingerprint (null at full text is a mismatch too), in this order; ids only without error.
    """
    side = sidecars.select("analysis", F.col("evidence_level").alias("_level"), "source_pdf_fingerprint", "status", "future_work_ids", F.lit(True).alias("_found"))
    error = (
        F.when(F.col("_found").isNull(), "no sidecar").when(~F.coalesce(F.col("status") == "ok", F.lit(False)), "status")
        .when(~F.col("_level").eqNullSafe(F.col("evidence_level")), "evidence level")
        .when(~F.coalesce(F.col("source_pdf_fingerprint") == F.col("input_fingerprint"), (F.col("evidence_level") != "fulltext") & F.col("source_pdf_fingerprint").isNull()), "fingerprint")
    )
    joined = facts.join(side, "analysis", "left").withColumn("error", error)
    return joined.select(*facts.columns, F.when(F.col("error").isNull(), F.col("future_work_ids")).alias("future_work_ids"), "error")


def ordered_ids(items: DataFrame, by: str, order: str = "ord", value: str = "id") -> DataFrame:
    """(by, future_work_ids): ids in the items' order."""
    return items.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("future_work_ids"))


def cache_errors(caches: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, cache_sha256, source_sha256, error) of caches (path, cache_sha256 or null) against sources (path, source_sha256): no source, metadata is missing, stale."""
    error = F.when(F.col("source_sha256").isNull(), "no source").when(F.col("cache_sha256").isNull(), "metadata is missing").when(F.col("cache_sha256") != F.col("source_sha256"), "stale")
    return caches.join(sources, "path", "left").select("path", "cache_sha256", "source_sha256", error.alias("error"))


def update_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cached pages (pdf_sha256, page, text) after an update: new pages over old ones of the same fingerprint; pages of other fingerprints of ``new``'s paths never join in.

    ``old`` and ``new`` also carry ``path``; a path keeps the fingerprint of its new pages alone. New pages of one path
    under several fingerprints get the ``error`` "several fingerprints" and change nothing.
    """
    by_path = new.groupBy("path").agg(F.min("pdf_sha256").alias("_sha"), F.max("pdf_sha256").alias("_other"))
    checked = new.join(by_path, "path").withColumn("error", F.when(F.col("_sha") != F.col("_other"), "several fingerprints")).drop("_sha", "_other")
    now = by_path.filter("_sha = _other").drop("_other")
    kept = old.join(now, "path", "left").filter("_sha is null or _sha = pdf_sha256").drop("_sha")
    fine = checked.filter("error is null")
    return kept.join(fine, ["path", "pdf_sha256", "page"], "left_anti").withColumn("error", F.lit(None).cast("string")).unionByName(checked)


def digest_error(given: Column, prepared: Column) -> Column:
    return F.when(~F.coalesce(given == prepared, given.isNull()), F.lit("foreign digest"))


def anchor_error(markdown: Column, first: str, second: str) -> Column:
    fine = (occurrences(markdown, first) == 1) & (occurrences(markdown, second) == 1) & in_order(markdown, first, second)
    return F.when(~fine, F.lit("anchors"))


def patch_section(markdown: Column, heading: str, before: str, rendered: Column) -> Column:
    """The section under ``heading`` replaced up to ``before``, or put in ahead of ``before``; the rest untouched. Null if ``before`` is missing.

    Both are whole lines, white space at their ends aside: a longer heading with the same beginning is another one.
    """
    line = lambda h: f"\\n(?=\\Q{h}\\E[ \\t]*(\\r?\\n|$))"
    parts = F.split(F.concat(F.lit("\n"), markdown), line(before), 2)
    # each line, the first one too, has a line end before it: the one put in front goes again
    ahead = F.concat(F.get(F.split(parts[0], line(heading), 2), F.lit(0)), F.lit("\n"))
    return F.when(F.size(parts) == 2, F.concat(F.substring(ahead, F.lit(2), F.length(ahead)), F.lit(heading + "\n"), rendered, F.lit("\n"), F.get(parts, F.lit(1))))


def render_items(items: Column) -> Column:
    """Bullets of array<struct<quote, translation_zh, source>>."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- 原文："), x["quote"], F.lit("\n  译："), x["translation_zh"], F.lit("\n  出处："), x["source"])), "\n")


def sidecar_body(items: Column, version: str = SIDECAR_VERSION) -> Column:
    """The JSON text of a sidecar from columns analysis, evidence_level, fingerprint and its items, array<struct<id, quote, translation_zh, source, page, ...>> in their order."""
    kept = F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in ("id", "quote", "translation_zh", "source", "page"))))
    return F.to_json(F.struct(
        F.lit(1).alias("schema"), F.lit(version).alias("extractor_version"), "analysis", "evidence_level", F.col("fingerprint").alias("source_pdf_fingerprint"), F.lit("ok").alias("status"), kept.alias("items"),
    ))


def sidecar(items: DataFrame, errors: DataFrame, version: str = SIDECAR_VERSION) -> DataFrame:
    """(analysis, path, json): a sidecar for each analysis without any error in the batch; items in their order.

    ``items``: analysis, evidence_level, fingerprint, ord, id, quote, translation_zh, source, page.
    """
    clean = items.join(errors.filter("error is not null").select("analysis").distinct(), "analysis", "left_anti")
    item = F.struct("ord", "id", "quote", "translation_zh", "source", "page")
    grouped = clean.groupBy("analysis", "evidence_level", "fingerprint").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select("analysis", F.concat("analysis", F.lit(".future_work.json")).alias("path"), sidecar_body(F.col("_items"), version).alias("json"))


def first_candidates(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first candidate by list order in each group."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).filter("_r = 1").drop("_r")
