"""Text functions over columns: normal forms, identifiers, sentences, slices, rewriting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .windows import spans

#: Control characters that stand for a sentence break and a protected full stop while a text is split.
BREAK, DOT = "\x01", "\x02"
#: Abbreviations whose stops do not end a sentence. Our choice beyond "i.e."; pass others where needed.
ABBREVIATIONS = ("i.e.", "e.g.")
PAGE_MARKER = "<!-- PDF_PAGE: %d -->"
#: Our choice: the line before each document where a file holds several.
DOCUMENT_MARKER = "<!-- DOCUMENT: %s -->"


#: A character that NFKC may change, or join with one before it. The ranges left out hold none: ASCII, letters (Latin, Greek, Cyrillic, Hebrew), dashes and quotation marks, kana, Han, Hangul syllables.
#: A text without such a character is in NFKC already. The look ahead, a single range, spares most characters the test of all ranges, which takes Java eight times as long.
UNSTABLE = (
    r"(?=[^\x00-\x9F])[^\x00-\x9F\u00BF-\u0131\u014A-\u017E\u0180-\u01C3\u01F4-\u02AF\u0388-\u03CF\u03FA-\u0482\u048A-\u052F\u05D0-\u05EA\u1E00-\u1E99\u1EA0-\u1EF9"
    r"\u2012-\u2016\u2018-\u2023\u3001-\u3029\u303B-\u3096\u30A0-\u30FE\u4E00-\u9FFF\uAC00-\uD7A3]"
)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """The NFKC form of texts that are in another one, else null. Python strings are made of a span of the texts at a time."""
    form = lambda t: None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([form(t.as_py()) for t in texts.slice(k, n)], pa.string()) for k, n in spans(pc.binary_length(texts)))])


def with_nfkc(df: DataFrame, source: str, target: str) -> DataFrame:
    """``target`` is the NFKC form of ``source``, in one pass. Only texts with a character that NFKC may change go through Python, nulls in place of the others."""
    beyond = (F.octet_length(source) > F.char_length(source)) & F.col(source).rlike(UNSTABLE)
    return df.withColumn(target, F.coalesce(_nfkc(F.when(beyond, F.col(source))), F.col(source)))


def collapse_space(text: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def dehyphenate(text: Column) -> Column:
    """Join words that a hyphen splits over a line end; hyphens inside a line stay."""
    return F.regexp_replace(text, "(?<=\\p{L})-[ \\t]*\\r?\\n[ \\t]*(?=\\p{L})", "")


def comparison_view(text: Column) -> Column:
    """What quotes and pages are compared in, for text in NFKC already."""
    return collapse_space(dehyphenate(text))


def normalized_quote(df: DataFrame, source: str, target: str) -> DataFrame:
    return with_nfkc(df, source, target).withColumn(target, collapse_space(F.col(target)))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def with_quote_id(df: DataFrame, source: str, target: str) -> DataFrame:
    """``target`` identifies a quote: SHA-256 of its normal form."""
    return normalized_quote(df, source, target).withColumn(target, sha256_hex(F.col(target)))


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def sentences(text: Column, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """All sentences in order: array<string>.

    A stop ends a sentence before white space or before Han, Hiragana or Katakana;
    an ideographic stop always does; so does a blank line; an abbreviation does not.
    """
    marked = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", DOT))), abbreviations, text)
    marked = F.regexp_replace(marked, "\\n\\s*\\n", BREAK)
    marked = F.regexp_replace(marked, "([.!?])\\s+", f"$1{BREAK}")
    marked = F.regexp_replace(marked, "([.!?])([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}])", f"$1{BREAK}$2")
    marked = F.regexp_replace(marked, "([。！？])\\s*", f"$1{BREAK}")
    parts = F.transform(F.split(marked, BREAK), lambda s: F.btrim(F.translate(s, DOT, "."), F.lit(" \t\r\n")))
    return F.filter(parts, lambda s: s != "")


def occurrences(text: Column, needle: str | Column) -> Column:
    """How often ``needle`` (not empty) occurs in ``text`` without overlaps."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def replace_once(text: Column, old: str, new: str) -> tuple[Column, Column]:
    """(the text with ``old`` replaced, an error unless it occurs exactly once)."""
    n = occurrences(text, old)
    return F.when(n == 1, F.replace(text, F.lit(old), F.lit(new))), F.when(n != 1, F.concat(F.lit("expected once, found "), n.cast("string")))


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def apply_steps(text: Column, steps: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Run (mode, old, new) steps in order, mode "once" or "all": (the result, the first error). An error leaves no result."""
    error: Column = F.lit(None).cast("string")
    for k, (mode, old, new) in enumerate(steps):
        if mode == "once":
            done, problem = replace_once(text, old, new)
            error = F.coalesce(error, F.when(problem.isNotNull(), F.concat(F.lit(f"step {k + 1}: "), problem)))
            text = F.coalesce(done, text)
        else:
            text = replace_all(text, old, new)
    return F.when(error.isNull(), text), error


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit("\n \t"))


def slice_between(text: Column, start: str, end: str) -> Column:
    """From the first ``start`` up to the next ``end``; null if either is missing."""
    a = F.locate(start, text)
    rest = F.substring(text, a, F.length(text))
    b = F.locate(end, rest, len(start) + 1)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b - 1))


def section(text: Column, heading: str, before: str | None = None) -> Column:
    """The lines under ``heading``, a whole line but for white space at its end: up to the next heading of its level or a higher one, or the line ``before``. Null without the heading."""
    level = len(heading) - len(heading.lstrip("#"))
    ends = [r"\z", *([rf"^#{{1,{level}}}[ \t]"] if level else []), *([rf"^\Q{before}\E[ \t]*\r?$"] if before else [])]
    found = F.regexp_extract_all(text, F.lit(rf"(?ms)^\Q{heading}\E[ \t]*\r?$(.*?)(?={'|'.join(ends)})"), 1)
    return F.get(found, F.lit(0))


def in_order(text: Column, first: str, second: str) -> Column:
    a, b = F.locate(first, text), F.locate(second, text)
    return (a > 0) & (b > 0) & (a < b)


def missing_markers(text: Column, markers: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.instr(text, m) == 0)


def present_markers(text: Column, markers: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.instr(text, m) > 0)


def split_frontmatter(text: Column) -> tuple[Column, Column, Column]:
    """(head, body, error): a file split by exactly one separator line of three hyphens."""
    parts = F.split(text, "\n---\n", -1)
    whole = F.size(parts) == 2
    return F.when(whole, parts[0]), F.when(whole, F.get(parts, F.lit(1))), F.when(~whole, F.concat(F.lit("separators: "), (F.size(parts) - 1).cast("string")))


def join_frontmatter(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("\n---\n"), body)


def frontmatter_scalar(head: Column, key: str) -> tuple[Column, Column]:
    """(value, error) of the one ``key: value`` line. Single quotes around a value go; double quotes, '' and open quotes are errors."""
    lines = F.filter(F.split(head, "\n"), lambda x: x.startswith(f"{key}:"))
    raw = F.trim(F.substring(F.get(lines, F.lit(0)), len(key) + 2, 1 << 20))
    quoted = raw.startswith("'")
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    error = (
        F.when(F.size(lines) != 1, F.concat(F.lit("lines: "), F.size(lines).cast("string")))
        .when(raw.startswith('"'), F.lit("double quotes"))
        .when(quoted & ((F.length(raw) < 2) | ~raw.endswith("'")), F.lit("open quote"))
        .when(quoted & F.contains(inner, F.lit("'")), F.lit("quote inside"))
    )
    return F.when(error.isNull(), F.when(quoted, inner).otherwise(raw)), error


def page_marker(page: Column) -> Column:
    return F.format_string(PAGE_MARKER, page)


def source_label(source: Column, start_page: Column, end_page: Column) -> Column:
    """The label without a model's page suffix; a quote over two pages gets their range."""
    bare = F.regexp_replace(source, "\\s*[（(]p\\.\\s*\\d+(?:\\s*[–-]\\s*\\d+)?[)）]\\s*$", "")
    return F.when(end_page > start_page, F.concat(bare, F.lit("（p."), start_page.cast("string"), F.lit("–"), end_page.cast("string"), F.lit("）"))).otherwise(bare)


def view_with_offsets(text: str) -> tuple[str, list[int]]:
    """The comparison view of any text, and for each of its characters where it begins in the text."""
    out: list[str] = []
    at: list[int] = []
    i, n = 0, len(text)
    broken = re.compile(r"-[ \t]*\r?\n[ \t]*")
    while i < n:
        c = text[i]
        if c == "-" and i and text[i - 1].isalpha() and (m := broken.match(text, i)) and m.end() < n and text[m.end()].isalpha():
            i = m.end()
            continue
        j = i + 1
        # marks and conjoining vowels belong to the character before them
        while j < n and (unicodedata.combining(text[j]) or "ᅠ" <= text[j] <= "ᇿ"):
            j += 1
        for x in unicodedata.normalize("NFKC", text[i:j]):
            if x.isspace():
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
            else:
                out.append(x)
                at.append(i)
        i = j
    if out and out[-1] == " ":
        out.pop(), at.pop()
    return "".join(out), at
