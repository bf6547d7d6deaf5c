"""Sources: normalised inputs, text and Markdown files, JSON documents, caches, PDF through a pluggable reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import DOCUMENT_MARKER, PAGE_MARKER, fingerprint, page_marker, section


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content, fingerprint)."""
    return spark.read.format("binaryFile").load(paths).select("path", "content", fingerprint(F.col("content")).alias("fingerprint"))


def normalized_inputs(files: DataFrame, kind: str, path: str = "path", text: str = "text") -> DataFrame:
    """(path, output, error) from JSON texts of the caller's ``kind``: output is the canonical JSON (ok, schema, level, metadata, abstract) without provenance."""
    v = V.parse(F.col(text))
    get = lambda p: V.lookup(v, p)
    words = lambda p: V.text(get(p))
    error = (
        F.when(~F.col(path).startswith("/"), "path must be absolute").when(v.isNull(), "unreadable").when(V.kind(v) != "OBJECT", "not an object")
        .when(~F.coalesce(words("kind") == kind, F.lit(False)), "kind")
        .when(~F.coalesce(F.try_variant_get(v, "$.schema", "int") == 1, F.lit(False)), "schema").when(~F.coalesce(words("level") == "abstract", F.lit(False)), "level")
        .when(F.coalesce(F.trim(words("abstract")) == "", F.lit(True)), "abstract")
    )
    meta = F.struct(words("metadata.title").alias("title"), F.try_variant_get(v, "$.metadata.authors", "array<string>").alias("authors"), F.try_variant_get(v, "$.metadata.year", "int").alias("year"), words("metadata.venue").alias("venue"), words("metadata.doi").alias("doi"))
    out = F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(1).alias("schema"), F.lit("abstract").alias("level"), meta.alias("metadata"), words("abstract").alias("abstract")))
    return files.select(path, error.alias("error"), out.alias("_o")).select(path, F.when(F.col("error").isNull(), F.col("_o")).alias("output"), "error")


def text_papers(files: DataFrame, text: str = "text") -> DataFrame:
    """Header lines TITLE, AUTHORS, YEAR, VENUE, DOI, a line of three hyphens, the body: columns of ``files`` and title, authors, year, venue, doi, body. Without a header the whole text is the body."""
    parts = F.split(text, "\n---\n", 2)
    header = F.when(F.size(parts) == 2, parts[0])
    field = lambda name: F.nullif(F.trim(F.regexp_extract(header, f"(?m)^{name}:[ \\t]*(.*)$", 1)), F.lit(""))
    return files.select("*", *(field(n).alias(n.lower()) for n in ("TITLE", "AUTHORS")), field("YEAR").try_cast("int").alias("year"), *(field(n).alias(n.lower()) for n in ("VENUE", "DOI")), F.element_at(parts, -1).alias("body"))


def json_files(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with ``v`` (VARIANT) and ``error`` for what is no JSON: a row, not a failed job."""
    return files.withColumn("v", V.parse(F.col(text))).withColumn("error", F.when(F.col("v").isNull(), F.lit("unreadable JSON")))


def items_of(v: Column) -> Column:
    """Items of a file that is a list or an object with ``items``."""
    return F.coalesce(V.elements(v), V.elements(V.lookup(v, "items")))


def has_source_pages(v: Column) -> Column:
    """Whether a prepared file is of the kind with source pages, which switches to literal proof."""
    return F.coalesce(V.kind(V.lookup(v, "source_pages")) == "ARRAY", F.lit(False))


def page_cache(caches: DataFrame, text: str = "text") -> DataFrame:
    """(path, pdf_sha256, page, text) from page caches {schema, pdf_sha256, pages: {"n": text}}."""
    parsed = F.from_json(F.col(text), "schema int, pdf_sha256 string, pages map<string,string>")
    return caches.select("path", parsed.alias("c")).filter("c.schema = 1").select("path", F.col("c.pdf_sha256").alias("pdf_sha256"), F.explode("c.pages").alias("p", "text")).select("path", "pdf_sha256", F.col("p").try_cast("int").alias("page"), "text")


#: Fixed value: the bullets of one item; the second and third line are bullets of their own or go on under the first.
ITEM = r"(?m)^- 原文：([^\n]*)\n(?:- |[ \t]+)译：([^\n]*)\n(?:- |[ \t]+)出处：([^\n]*)"


def markdown_items(files: DataFrame, keys: list[str], text: str = "text", heading: str | None = None, before: str | None = None) -> DataFrame:
    """(keys, ord, quote, translation_zh, source, page) from bullets; the page comes out of the source's suffix.

    With ``heading`` the bullets of that section alone (text.section), whatever other sections hold.
    """
    suffix = "\\s*[（(]p\\.\\s*([0-9]+)[^）)]*[）)]\\s*$"
    part = lambda k: F.regexp_replace(F.trim(F.regexp_extract("block", ITEM, k)), "\r$", "")
    body = F.col(text) if heading is None else section(F.col(text), heading, before)
    return (
        files.select(*keys, F.posexplode(F.regexp_extract_all(body, F.lit(ITEM), 0)).alias("ord", "block"))
        .select(*keys, "ord", part(1).alias("quote"), part(2).alias("translation_zh"), F.regexp_replace(part(3), suffix, "").alias("source"), F.nullif(F.regexp_extract(part(3), suffix, 1), F.lit("")).cast("int").alias("page"))
    )


def extract_pages(documents: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, fingerprint, page, text) of binary documents (path, content, fingerprint) through ``reader``, which gives the text of each page.

    No PDF library comes with this package: pass a reader that runs on the executors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, x, k, t) for p, c, x in zip(f["path"], f["content"], f["fingerprint"], strict=True) for k, t in enumerate(reader(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "fingerprint", "page", "text"])

    return documents.select("path", "content", "fingerprint").mapInPandas(run, "path string, fingerprint string, page int, text string")


def extract_toc(documents: DataFrame, reader: Callable[[bytes], list[tuple[int, str, int]]]) -> DataFrame:
    """(path, fingerprint, ord, level, title, page): tables of contents through ``reader``, which gives (level, title, page) in order; a document without one gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, x, k, *entry) for p, c, x in zip(f["path"], f["content"], f["fingerprint"], strict=True) for k, entry in enumerate(reader(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "fingerprint", "ord", "level", "title", "page"])

    return documents.select("path", "content", "fingerprint").mapInPandas(run, "path string, fingerprint string, ord int, level int, title string, page int")


def toc_rows(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, ord, level, title, page) from JSON lists of [level, title, page]; entries without a number for level or page are left out, what is no list gives no rows."""
    entries = V.elements(V.parse(F.col(text)))
    at = lambda k, kind: F.try_variant_get("e", f"$[{k}]", kind)
    return files.select(key, F.posexplode(entries).alias("ord", "e")).select(key, "ord", at(0, "int").alias("level"), at(1, "string").alias("title"), at(2, "int").alias("page")).filter("level is not null and page is not null")


def render_pages(documents: DataFrame, renderer: Callable[[bytes, float], list[bytes]], scale: float = 1.0) -> DataFrame:
    """(path, fingerprint, page, image): pages as pictures through ``renderer``, which gives the picture of each page at a scale. No renderer comes with this package."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, x, k, image) for p, c, x in zip(f["path"], f["content"], f["fingerprint"], strict=True) for k, image in enumerate(renderer(bytes(c), scale), 1)]
            yield pd.DataFrame(rows, columns=["path", "fingerprint", "page", "image"])

    return documents.select("path", "content", "fingerprint").mapInPandas(run, "path string, fingerprint string, page int, image binary")


def fulltext_caches(caches: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, text, cache_sha256) from full-text caches (path, text) and their metadata files (path of the cache, json): the fingerprint is null where the metadata is missing, of another schema or no JSON."""
    parsed = F.from_json(F.col("json"), "schema int, pdf_sha256 string")
    known = metadata.select("path", parsed.alias("_m")).select("path", F.when(F.col("_m.schema") == 1, F.col("_m.pdf_sha256")).alias("cache_sha256"))
    return caches.select("path", "text").join(known, "path", "left")


def marked_text(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): the pages of each document in order, a marker before each."""
    one = F.struct("page", F.concat(page_marker(F.col("page")), F.lit("\n"), F.col("text")).alias("t"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("text"))


def read_marked(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, page, text, and the folders' partition columns) of files that have a marker before each page, as ``marked_text`` and a text writer leave them.

    The marker's opening is the record separator, so a large file is split by bytes at page starts, and no task reads it
    whole. Each page ends with one line feed that is not its own. What stands before the first marker is no page.
    """
    opening, closing = PAGE_MARKER.split("%d")
    files = spark.read.option("lineSep", opening).text(paths)
    head = rf"^([0-9]+)\Q{closing}\E\r?\n"
    others = [c for c in files.columns if c != "value"]
    found = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", head, 1).alias("_n"), F.regexp_replace("value", head, "").alias("_t"), *others).filter("_n <> ''")
    return found.select("path", F.col("_n").cast("int").alias("page"), F.regexp_replace("_t", r"\r?\n\z", "").alias("text"), *others)


def write_marked(pages: DataFrame, path: str, key: str = "path") -> None:
    """``marked_text`` of all documents under ``path``, many in a file, each behind a line that names it: the number of files does not grow with that of documents."""
    name = F.format_string(DOCUMENT_MARKER + "\n", F.col(key).cast("string"))
    marked_text(pages, key).select(F.concat(name, F.col("text"))).write.text(path)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, page, text) of files that ``write_marked`` left; the key as a string.

    The line that names a document is the record separator, so files are split by bytes at document starts, and a record is one document. No text may hold one of the markers.
    """
    (opening, closing), page = DOCUMENT_MARKER.split("%s"), PAGE_MARKER.split("%d")
    records = spark.read.option("lineSep", opening).text(paths).filter(F.contains("value", F.lit(closing + "\n")))
    parts = F.split("value", rf"\Q{page[0]}\E")
    named = records.select(F.substring_index("value", closing + "\n", 1).alias("key"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("_p"))
    head = rf"^([0-9]+)\Q{page[1]}\E\n"
    # what stands before the first marker is no page; each page ends with one line feed that is not its own
    return named.select("key", F.regexp_extract("_p", head, 1).alias("_n"), F.regexp_replace("_p", head, "").alias("_t")).filter("_n <> ''").select("key", F.col("_n").cast("int").alias("page"), F.regexp_replace("_t", r"\n\z", "").alias("text"))


#: Our choices: the least share of letters and white space in a page's characters that makes it evidence.
LEAST_LETTERS = 0.5


def page_quality(pages: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """``pages`` with a ``tier``. Our own default: empty without a letter, untrusted where under LEAST_LETTERS of the characters are letters or spaces; a pandas scorer may replace it."""
    if scorer is not None:
        return pages.withColumn("tier", F.pandas_udf(scorer, "string")("text"))
    return page_scores(pages).drop("score")


def page_scores(pages: DataFrame, least: float = LEAST_LETTERS) -> DataFrame:
    """``pages`` with ``score``, the share of letters and white space (0 without a letter), and the ``tier`` that it gives."""
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    share = F.length(F.regexp_replace("text", "[^\\p{L}\\s]", "")) / F.length("text")
    scored = pages.withColumn("score", F.when(lettered, share).otherwise(0.0))
    return scored.withColumn("tier", F.when(~lettered, "empty").when(F.col("score") < least, "untrusted").otherwise("ok"))


def quality_report(pages: DataFrame, key: str = "path", least: float = LEAST_LETTERS) -> DataFrame:
    """(key, pages, ok, untrusted, empty, least_score, threshold, page_scores): a summary for each document, its pages' scores in order."""
    one = F.struct("page", "score", "tier")
    tier = lambda t: F.count_if(F.col("tier") == t).alias(t)
    return page_scores(pages, least).groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), tier("ok"), tier("untrusted"), tier("empty"), F.min("score").alias("least_score"), F.lit(least).alias("threshold"),
        F.array_sort(F.collect_list(one)).alias("page_scores"),
    )
