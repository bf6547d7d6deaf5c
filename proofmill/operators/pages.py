"""Operators over pages (doc_id, page, text): candidates, selection, quality, replacement text, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, sha256_hex, with_nfkc

#: Tiers whose text is no evidence.
BAD_TIERS = ("untrusted", "empty")
#: Our choices where the behaviour is open: words that mark a page, and how many last pages are read.
KEYWORDS = ("future work", "future research", "in the future", "limitations", "conclusion")
LAST_PAGES = 3


def page_candidates(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page"), text: str = "text") -> DataFrame:
    """(keys, ord, quote, id): every sentence of every page in order; the id is the SHA-256 of its normal form.

    Rows only: no shuffle. The order within a page is ``ord``, from 0.
    """
    listed = pages.select(*keys, F.posexplode(sentences(F.col(text))).alias("ord", "quote"))
    normal = with_nfkc(listed, "quote", "_n")
    return normal.withColumn("id", sha256_hex(F.trim(F.regexp_replace("_n", "(?U)\\s+", " ")))).drop("_n")


def page_selection(pages: DataFrame, toc: DataFrame | None = None, keywords: Sequence[str] = KEYWORDS, last: int = LAST_PAGES) -> DataFrame:
    """(doc_id, page) worth reading: listed in ``toc`` (doc_id, page), with a keyword, or among the last pages.

    A hint for readers; it never limits where a quote may be proved.
    """
    end = pages.groupBy("doc_id").agg(F.max("page").alias("_end"))
    marked = F.lit(False)
    for k in keywords:
        marked = marked | F.contains(F.lower("text"), F.lit(k))
    near = pages.join(end, "doc_id").filter(marked | (F.col("page") > F.col("_end") - last)).select("doc_id", "page")
    if toc is not None:
        near = near.unionByName(toc.join(pages, ["doc_id", "page"], "left_semi").select("doc_id", "page"))
    return near.distinct()


def ocr_required(selection: DataFrame, quality: DataFrame) -> DataFrame:
    """Selected pages of a bad tier; a bad page that is not selected is not required."""
    return quality.filter(F.col("tier").isin(*BAD_TIERS)).join(selection, ["doc_id", "page"], "left_semi").select("doc_id", "page")


def trusted_pages(pages: DataFrame, quality: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Pages whose text may be evidence: not of a bad tier, or resolved by replacement text."""
    bad = quality.filter(F.col("tier").isin(*BAD_TIERS)).select("doc_id", "page")
    if resolved is not None:
        bad = bad.join(resolved, ["doc_id", "page"], "left_anti")
    return pages.join(bad, ["doc_id", "page"], "left_anti")


def merge_replacements(pages: DataFrame, quality: DataFrame, required: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, page, text, resolved): replacement text for required or bad pages only; the other pages as they were."""
    bad = quality.filter(F.col("tier").isin(*BAD_TIERS)).select("doc_id", "page").unionByName(required.select("doc_id", "page")).distinct().withColumn("_may", F.lit(True))
    new = replacements.select("doc_id", "page", F.col("text").alias("_new"))
    use = F.col("_may") & F.col("_new").isNotNull()
    return (
        pages.join(bad, ["doc_id", "page"], "left").join(new, ["doc_id", "page"], "left")
        .select("doc_id", "page", F.when(use, F.col("_new")).otherwise(F.col("text")).alias("text"), F.coalesce(use, F.lit(False)).alias("resolved"))
    )


def unsupplied(required: DataFrame, replacements: DataFrame) -> DataFrame:
    """Required pages without replacement text: any row here fails a merge."""
    return required.join(replacements.filter("text is not null"), ["doc_id", "page"], "left_anti")


def merge_state(required: Column, resolved: Column, supplied: Column) -> tuple[Column, Column]:
    """(still required, resolved so far) after a merge; both arrays sorted. Merging the same pages again changes nothing."""
    return F.array_sort(F.array_except(required, supplied)), F.array_sort(F.array_union(resolved, F.array_intersect(required, supplied)))


def refresh_candidates(candidates: DataFrame, replaced: DataFrame) -> DataFrame:
    """Candidates with those of replaced pages made anew; the others are kept, not recomputed."""
    kept = candidates.join(replaced.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return kept.unionByName(page_candidates(replaced))


def summary(candidates: DataFrame, by: str = "doc_id") -> DataFrame:
    """Candidate count and candidate pages of each document; no candidate text."""
    return candidates.groupBy(by).agg(F.count(F.lit(1)).alias("candidate_count"), F.sort_array(F.collect_set("page")).alias("candidate_pages"))


def adjacent(pages: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """Each page with the next physical page of the same document: (key, page, text, next_page, next_text). A gap in the numbers ends a pair."""
    w = Window.partitionBy(key).orderBy(page)
    return pages.select(key, page, "text", F.lead(page).over(w).alias("next_page"), F.lead("text").over(w).alias("next_text")).filter(F.col("next_page") == F.col(page) + 1)
