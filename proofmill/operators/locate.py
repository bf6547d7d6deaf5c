"""Proof that a quote is a contiguous span of its source.

Quotes and pages meet in the comparison view (NFKC, white space collapsed, line-end
hyphens joined). Candidates come from an equi-join: by document where the
quote names one, else from one scan for all quotes or by a quote's rarest anchor, and a literal containment decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import windows
from ..functions.automaton import Automaton
from ..functions.text import comparison_view, view_with_offsets, with_nfkc
from .layout import source_bounds

#: Words of an anchor. The first and the last word of a quote may be cut, so a quote needs two more words to have whole ones.
ANCHOR = 8
#: Quotes that are broadcast at most.
BROADCAST_QUOTES = 100_000
#: Bytes of the patterns that one pass over the texts looks for: they bound the automaton of a task (some 400 bytes for each of its states).
PATTERN_BYTES = 1 << 18
#: The bitmap of ``holders`` has 64 bits for each pattern, and 2 to this power at most (16 MB); beyond, it lets more windows pass.
MOST_BITS = 27
#: Quotes of so many bytes together are all looked for by scans; more are joined by anchors.
SCANNED_BYTES = 4 * PATTERN_BYTES


def with_view(df: DataFrame, source: str = "text", target: str = "view") -> DataFrame:
    return with_nfkc(df, source, target).withColumn(target, comparison_view(F.col(target)))


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_QUOTES + 1).count() <= BROADCAST_QUOTES


def containing(quotes: DataFrame, sources: DataFrame, quote: str = "quote", text: str = "view") -> DataFrame:
    """All (quote row, source row) with the quote literally inside the source's view; columns of both sides.

    Quotes of at most SCANNED_BYTES together, and all those of fewer than ANCHOR + 2 words, are found by one scan of the texts
    (``holding``). More of them meet their sources by the rarest of their anchors (``_anchored``). Quotes are broadcast
    up to BROADCAST_QUOTES rows; beyond, they are joined by a shuffle.
    """
    total = quotes.agg(F.coalesce(F.sum(F.octet_length(quote)), F.lit(0))).first()[0]
    side = F.broadcast(quotes) if _small(quotes) else quotes
    scanned = quotes if total <= SCANNED_BYTES else quotes.filter(F.size(_words(F.col(quote))) < ANCHOR + 2)
    found = holding(sources, scanned.select(quote), text, "_quote").join(side, F.col("_quote") == F.col(quote)).drop("_quote")
    if total <= SCANNED_BYTES:
        return found
    return found.unionByName(_anchored(quotes.filter(F.size(_words(F.col(quote))) >= ANCHOR + 2), sources, quote, text))


def _grams(words: Column) -> Column:
    """Hashes of all runs of ANCHOR words in a column with hashes of words."""
    n = F.size(words) - ANCHOR + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, ANCHOR)))).otherwise(F.array().cast("array<bigint>"))


def _anchored(quotes: DataFrame, sources: DataFrame, quote: str, text: str) -> DataFrame:
    """Pairs of quotes of ANCHOR + 2 words or more and the sources that hold them, by the rarest anchor of each quote.

    The words of a quote but for the first and the last stand as whole words in any source that holds it, so each
    run of ANCHOR of them is an anchor that no such source lacks. In how many sources each anchor stands is counted first; the
    rarest one alone joins, so a phrase that many quotes and sources share brings none of them
    together. Rows carry digests and anchors; texts are looked at for candidate pairs alone.
    """
    hashed = lambda df, c: df.withColumn("_h", F.transform(_words(F.col(c)), lambda w: F.xxhash64(w)))
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    own = hashed(quotes.select(F.col(quote).alias("_q")).distinct(), "_q").withColumn("_h", F.slice("_h", F.lit(2), F.size("_h") - 2))
    anchors = own.select(digest("_q").alias("_key"), F.explode(F.array_distinct(_grams(F.col("_h")))).alias("_anchor"))
    standing = hashed(sources.select(text), text).select(digest(text).alias("_text"), F.explode(F.array_distinct(_grams(F.col("_h")))).alias("_anchor"))
    light = lambda df: F.broadcast(df) if _small(df) else df
    counts = standing.join(light(anchors.select("_anchor").distinct()), "_anchor", "left_semi").groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    # an anchor that stands nowhere rules its quote out
    rarest = anchors.join(counts, "_anchor", "left").groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_anchor"))).alias("_a")).filter("_a.n > 0").select("_key", F.col("_a._anchor").alias("_anchor"))
    candidates = standing.join(light(rarest), "_anchor").select("_text", "_key").distinct()
    named = quotes.withColumn("_key", digest(quote))
    held = sources.withColumn("_text", digest(text)).join(light(candidates), "_text")
    return held.join(F.broadcast(named) if _small(quotes) else named, "_key").filter(F.contains(F.col(text), F.col(quote))).drop("_text", "_key")


def holding(sources: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """``sources`` with a column ``pattern``: a row for each different pattern (the first column of ``patterns``) that the text holds literally.

    An automaton of all patterns reads each text once; patterns beyond PATTERN_BYTES go in blocks, a pass each. Null patterns are none; an empty one is in every text that is not null.
    """
    schema = StructType([*sources.schema.fields, StructField(pattern, StringType())])
    found = sources.limit(0).withColumn(pattern, F.lit(None).cast("string"))
    for block in pattern_blocks(patterns):

        def run(batches: Iterator[pa.RecordBatch], block: list[str] = block) -> Iterator[pa.RecordBatch]:
            automaton, names = Automaton([p.encode() for p in block]), pa.array(block, pa.string())
            for b in batches:
                yield from _held(b, automaton, names, text, pattern)

        found = found.unionByName(sources.mapInArrow(run, schema))
    if patterns.filter(F.col(patterns.columns[0]) == "").isEmpty():
        return found
    return found.unionByName(sources.filter(F.col(text).isNotNull()).withColumn(pattern, F.lit("")))


def _held(batch: pa.RecordBatch, automaton: Automaton, names: pa.Array, text: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with each pattern that they hold, by spans of its rows and of the found ones: a text with many patterns is copied for each of them."""
    for k, n in windows.spans(pc.binary_length(batch.column(text))):
        part = batch.slice(k, n)
        row, which = automaton.find(part.column(text))
        row, which = pa.array(row), pa.array(which)
        for i, m in windows.spans(pc.binary_length(part.column(text)).take(row)):
            yield pa.RecordBatch.from_arrays([*part.take(row.slice(i, m)).columns, names.take(which.slice(i, m))], names=[*batch.schema.names, pattern])


def holders(sources: DataFrame, patterns: DataFrame, text: str, pattern: str, count: str = "documents") -> DataFrame:
    """(pattern, count): how many of the ``sources`` hold each different pattern (the first column of ``patterns``) literally; none that no source holds.

    One pass over the texts, however many patterns there are, and no pattern goes through the driver but as bits: windows of
    the texts that a bitmap does not rule out are counted, then joined with the patterns. Meant for patterns of few lengths inside short runs of
    their own bytes, as words are; the work is that of the windows in such runs. Null patterns are none; an empty one is in every text that is not null.
    """
    named = patterns.select(F.col(patterns.columns[0]).alias(pattern)).filter(F.col(pattern).isNotNull()).distinct()
    binary = named.select(F.col(pattern).cast("binary").alias("p"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = windows.bytes_of(b.column("p"))
            sizes, used = np.unique(np.diff(offsets), return_counts=True), np.unique(data, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sizes[0], -1 - used[0].astype(np.int64)])), pa.array(np.concatenate([sizes[1], used[1]]).astype(np.int64))], names=["v", "n"])

    # lengths, and bytes as negative numbers: a few hundred rows
    seen = {r["v"]: r["n"] for r in binary.mapInArrow(shapes, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    lengths = sorted(v for v in seen if v > 0)
    everywhere = sources.filter(F.col(text).isNotNull()).select(F.lit("").alias(pattern)).groupBy(pattern).agg(F.count(F.lit(1)).alias(count))
    if not lengths:
        return everywhere if 0 in seen else everywhere.limit(0)
    alphabet = np.zeros(256, bool)
    alphabet[[-1 - v for v in seen if v < 0]] = True
    bits = min(MOST_BITS, max(15, (64 * sum(seen[v] for v in lengths)).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = windows.bytes_of(b.column("p"))
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(windows.places(data, offsets[:-1][sizes > 0], sizes[sizes > 0], bits)) + 1)], names=["place"])

    place = F.col("place")
    parts = binary.mapInArrow(marks, "place long").groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for k, m in parts:
        bitmap[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = sources.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found, n in windows.held(b.column(text), lengths, alphabet, shared.value, bits):
                yield pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], names=["_p", count])

    counted = sources.select(text).mapInArrow(run, f"_p binary, `{count}` long").groupBy("_p").agg(F.sum(count).alias(count))
    found = counted.join(named, F.col("_p") == F.col(pattern).cast("binary")).select(pattern, count)
    return found.unionByName(everywhere) if 0 in seen else found


def pattern_blocks(patterns: DataFrame) -> Iterator[list[str]]:
    """The different patterns that are not empty, in lists of about PATTERN_BYTES bytes, one at a time."""
    named = patterns.select(F.col(patterns.columns[0]).alias("p")).filter("p <> ''").distinct()
    total = named.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0))).first()[0]
    blocks = -(-total // PATTERN_BYTES)
    for k in range(blocks):
        if block := [r[0] for r in named.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k).collect()]:
            yield block


def within_document(quotes: DataFrame, pages: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Quotes (item_id, doc_id, quote, page or null) located in pages (doc_id, page, text) of their document.

    (item_id, doc_id, start_page, start_offset, end_page, end_offset), the first by page and offset; one row for each quote that is found. Where
    the quote names a page, only a span that starts there counts. A span may reach over into the
    next physical page if both pages give it some text. Offsets are code points of the page's own text.

    ``exclusions``: (doc_id, page, edge_exclusions), the proven furniture of pages. Over a page end the bodies are
    joined, without it; a page with a non-outer exclusion is joined to none. Inside a page all of its text counts.
    """
    q = with_view(quotes, "quote", "_q").select("item_id", "doc_id", F.col("page").alias("_page"), "_q")
    seen = with_view(pages, "text", "_v").select("doc_id", "page", "text", "_v")
    if exclusions is None:
        seen = seen.withColumns({"_from": F.lit(0), "_body": F.col("text"), "_b": F.col("_v")})
    else:
        spans = exclusions.select("doc_id", "page", "edge_exclusions")
        joint = seen.join(spans, ["doc_id", "page"], "left")
        begin, end, error = source_bounds(F.col("text"), F.coalesce("edge_exclusions", F.array().cast(spans.schema["edge_exclusions"].dataType)))
        cut = joint.withColumns({"_from": begin, "_to": end, "_error": error})
        seen = with_view(cut.withColumn("_body", F.when(F.col("_error").isNull(), F.expr("substr(text, _from + 1, greatest(_to - _from, 0))"))), "_body", "_b").drop("edge_exclusions", "_to", "_error")
    w = Window.partitionBy("doc_id").orderBy("page")
    both = seen.withColumns({"_next": F.lead("page").over(w), "_nfrom": F.lead("_from").over(w), "_nbody": F.lead("_body").over(w), "_nb": F.lead("_b").over(w)})
    near = q.join(both, "doc_id").filter(F.col("_page").isNull() | (F.col("_page") == F.col("page")))
    inside = F.expr("instr(_v, _q)")
    # over the page end: a hyphen there joins the word halves, else a space stands between
    hyphen = F.expr("endswith(_b, '-') and _nb rlike '^\\\\p{L}'")
    joined = F.when(hyphen, F.concat(F.expr("left(_b, length(_b) - 1)"), "_nb")).otherwise(F.concat(F.col("_b"), F.lit(" "), F.col("_nb")))
    kept = F.when(hyphen, F.length("_b") - 1).otherwise(F.length("_b"))
    placed = near.withColumns({"_in": inside, "_join": F.when(F.col("_next") == F.col("page") + 1, joined), "_kept": kept})
    over = F.when((F.col("_in") == 0), F.expr("instr(substr(_join, greatest(1, _kept - length(_q) + 2)), _q) + greatest(1, _kept - length(_q) + 2) - 1"))
    placed = placed.withColumn("_over", F.when(F.expr("instr(substr(_join, greatest(1, _kept - length(_q) + 2)), _q) > 0") & (F.col("_in") == 0), over))
    crossing = F.expr("_over is not null and _over <= _kept and _over + length(_q) - 1 > _kept")
    hit = placed.filter((F.col("_in") > 0) | crossing).withColumn("_at", F.when(F.col("_in") > 0, F.col("_in")).otherwise(F.col("_over")))
    first = hit.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("page", "_at"))).filter("_rank = 1")
    found = first.withColumns({"_one": F.col("_in") > 0, "_gap": F.when(hyphen, 0).otherwise(1), "_last": F.col("_at") + F.length("_q") - 2})
    # the map of each page that a span touches is made once, however many quotes lie there; over a page end it is the body's
    touched = found.select("doc_id", F.inline(F.filter(F.array(
        F.struct("page", F.col("_one").alias("whole"), F.when(F.col("_one"), F.col("text")).otherwise(F.col("_body")).alias("t")),
        F.struct(F.col("_next").alias("page"), F.lit(False).alias("whole"), F.when(~F.col("_one"), F.col("_nbody")).alias("t")),
    ), lambda x: x["t"].isNotNull())))
    maps = touched.dropDuplicates(["doc_id", "page", "whole"]).select("doc_id", "page", "whole", offset_map(F.col("t")).alias("_map"))
    here = maps.select("doc_id", "page", F.col("whole").alias("_one"), F.col("_map").alias("_here"))
    there = maps.filter("not whole").select("doc_id", F.col("page").alias("_next"), F.col("_map").alias("_there"))
    placed = found.drop("text", "_body", "_nbody", "_v", "_b", "_nb").join(here, ["doc_id", "page", "_one"]).join(there, ["doc_id", "_next"], "left")
    one = F.col("_one")
    return placed.select(
        "item_id", "doc_id", F.col("page").alias("start_page"), (text_position("_here", F.col("_at") - 1) + F.when(one, 0).otherwise(F.col("_from"))).cast("int").alias("start_offset"),
        F.when(one, F.col("page")).otherwise(F.col("_next")).alias("end_page"),
        (F.when(one, text_position("_here", F.col("_last"))).otherwise(F.col("_nfrom") + text_position("_there", F.col("_last") - F.col("_kept") - F.col("_gap"))) + 1).cast("int").alias("end_offset"),
    )


@F.arrow_udf(StructType([StructField("view", ArrayType(IntegerType())), StructField("text", ArrayType(IntegerType()))]))
def offset_map(texts: pa.Array) -> pa.Array:
    """The breakpoints of texts' comparison views: from each view position on, until the next, view and text go on character by character."""
    view, text = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for t in texts:
        at = np.array(view_with_offsets(t.as_py())[1], np.int32)
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)[: len(at)])
        view.append(cuts.astype(np.int32))
        text.append(at[cuts])
    offsets = np.cumsum([len(x) for x in view], dtype=np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in (view, text)], names=["view", "text"])


def text_position(offsets: str, position: Column) -> Column:
    """Where the character at a ``position`` of the view begins in the text, by binary search in the column ``offsets`` (offset_map)."""
    view, text = F.col(f"{offsets}.view"), F.col(f"{offsets}.text")
    half = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    step = lambda a, _: F.when(F.get(view, half(a)) <= position, F.struct(half(a).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), half(a).alias("hi")))
    # after as many halvings as the length has bits lo is the last breakpoint at or before the position
    bits = F.when(F.size(view) > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.size(view))).cast("int"))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(bits, F.struct(F.lit(0).alias("lo"), F.size(view).alias("hi")), lambda a, k: F.when(a["hi"] - a["lo"] > 1, step(a, k)).otherwise(a), lambda a: a["lo"])
    return F.transform(F.array(last), lambda k: F.get(text, k) + position - F.get(view, k))[0]


def first_source(pairs: DataFrame, item: str, source: str, at: Column) -> DataFrame:
    """Of each item's pairs the one of the least source, then the least place: (item, source, at).

    A min over a struct: summed before the shuffle, so an item found everywhere is no hot key.
    """
    return pairs.groupBy(item).agg(F.min(F.struct(F.col(source), at.alias("at"))).alias("_f")).select(item, F.col(f"_f.{source}").alias(source), F.col("_f.at").alias("at"))


def canonical(located: DataFrame, candidates: DataFrame) -> DataFrame:
    """``located`` (item_id, doc_id, start_page, quote, id) with quote and id of the first candidate (by ``ord``) that is proved at the same place.

    ``candidates``: (doc_id, page, ord, quote, id), those of the place's page whose view is the quote's.
    """
    mine = with_view(located, "quote", "_v")
    theirs = with_view(candidates.select("doc_id", F.col("page").alias("start_page"), "ord", F.col("quote").alias("c_quote"), F.col("id").alias("c_id")), "c_quote", "_v")
    best = theirs.groupBy("doc_id", "start_page", "_v").agg(F.min(F.struct("ord", "c_quote", "c_id")).alias("_c"))
    return mine.join(best, ["doc_id", "start_page", "_v"], "left").withColumns({"quote": F.coalesce("_c.c_quote", "quote"), "id": F.coalesce("_c.c_id", "id")}).drop("_c", "_v")
