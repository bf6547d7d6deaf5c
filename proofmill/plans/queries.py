"""Registered queries of the evidence operators.

The operators come without tables of their own; these stand in: a document is a
row of ``documents``, a page a turn of ``conversations``, a quote an item of ``benchmark``,
page quality ``labels.quality`` (0: untrusted), edges ``nation`` and ``lineitem``,
JSON ``events.props``, markup ``pages.html``. What the tables lack is put into their rows (``derived``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variants as V
from ..operators import evidence, gates, layout, locate, pages, topology, workflows
from ..sources import inputs, sinks
from . import samples
from .registry import QUERIES, query  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """More tasks where a table comes as fewer row groups than there are cores: heavy text work follows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")


def conversation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier for every page of each labelled conversation."""
    tier = F.when(F.col("quality") == 0, "untrusted").otherwise("ok")
    return table(spark, sf_dir, "labels").select("doc_id", tier.alias("tier")).join(conversation_pages(spark, sf_dir).select("doc_id", "page"), "doc_id").select("doc_id", "page", "tier")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = locate.with_view(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", "quote").select("item_id", "quote")
    docs = locate.with_view(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "view")
    return locate.containing(quotes, docs)


@query
def locate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote's first place: the least document, the first offset in its comparison view."""
    pairs = _pairs(spark, sf_dir)
    first = locate.first_source(pairs, "item_id", "doc_id", F.expr("instr(view, quote) - 1").cast("int"))
    return first.select("item_id", "doc_id", F.col("at").alias("view_offset"))


@query
def locate_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("item_id", "doc_id").distinct()


@query
def unmatched_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that no document holds: they fail closed."""
    return table(spark, sf_dir, "benchmark").join(_pairs(spark, sf_dir).select("item_id").distinct(), "item_id", "left_anti").select("item_id")


@query
def quality_gated_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in documents that are not of a bad tier."""
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return _pairs(spark, sf_dir).select("item_id", "doc_id").distinct().join(bad, "doc_id", "left_anti").select("item_id", "doc_id")


@query
def sentence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pages.page_candidates(docs, keys=("doc_id",)).select("doc_id", F.col("ord").cast("int").alias("ord"), "quote", "id")


@query
def quote_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_quote_id(table(spark, sf_dir, "benchmark"), "text", "id").select("item_id", "id")


@query
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are the first or last of at least two documents."""
    lines = F.split("text", "\n")
    edge = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.inline(F.array(F.struct(F.lit("top").alias("edge"), lines[0].alias("line")), F.struct(F.lit("bottom").alias("edge"), F.element_at(lines, -1).alias("line")))))
    return layout.repeated_edge_lines(edge, ["edge"])


@query
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.adjacent(conversation_pages(spark, sf_dir)).select("doc_id", "page", "next_page")


def _broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as pages; a third of them end inside a word, with a hyphen, and the next page goes on with its other half."""
    all_pages = conversation_pages(spark, sf_dir).drop("role")
    head = F.when(F.col("page") % 3 == 1, F.lit("rupted ")).otherwise("")
    return all_pages.withColumn("text", F.concat(head, F.col("text"), F.when(F.col("page") % 3 == 0, F.lit(" inter-")).otherwise("")))


@query
def stitched_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes made of the last twelve words of a page and the first twelve of the next, over every page end: where they begin and end in the raw pages."""
    pages_ = _broken_pages(spark, sf_dir)
    two = locate.with_view(pages.adjacent(pages_), "text", "a").withColumnRenamed("next_text", "nt")
    two = locate.with_view(two, "nt", "b")
    last = F.expr("array_join(slice(split(a, ' '), greatest(1, size(split(a, ' ')) - 11), 12), ' ')")
    first = F.expr("array_join(slice(split(b, ' '), 1, 12), ' ')")
    joined = F.when(F.col("page") % 3 == 0, F.concat(F.regexp_replace(last, "-$", ""), first)).otherwise(F.concat_ws(" ", last, first))
    quotes = two.select((F.col("doc_id") * 1000 + F.col("page")).alias("item_id"), "doc_id", joined.alias("quote"), F.col("page"))
    return locate.within_document(quotes, pages_)


@query
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-of-contents pages (here the system's and page 0), pages with a keyword, the last two."""
    all_pages = conversation_pages(spark, sf_dir)
    return pages.page_selection(all_pages, toc=all_pages.filter("page = 0"), keywords=("tion the", "license"), last=2)


@query
def ocr_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ocr_required(page_selection(spark, sf_dir), conversation_quality(spark, sf_dir))


@query
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement text for every page that is not the user's; only required or bad pages take it."""
    all_pages, quality = conversation_pages(spark, sf_dir), conversation_quality(spark, sf_dir)
    new = all_pages.filter("role <> 'user'").select("doc_id", "page", F.concat(F.lit("ocr "), F.replace("text", F.lit("e"), F.lit("3"))).alias("text"))
    return pages.merge_replacements(all_pages.drop("role"), quality, ocr_required(spark, sf_dir), new)


@query
def ocr_unsupplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = conversation_pages(spark, sf_dir).filter("role <> 'user'").select("doc_id", "page", "text")
    return pages.unsupplied(ocr_required(spark, sf_dir), new)


@query
def refreshed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after the merge: kept for untouched pages, made anew for replaced ones."""
    before = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    replaced = ocr_merge(spark, sf_dir).filter("resolved").select("doc_id", "page", "text")
    return pages.refresh_candidates(before, replaced).select("doc_id", "page", F.col("ord").cast("int").alias("ord"), "quote")


@query
def prepare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    return pages.summary(made).select("doc_id", "candidate_count", F.array_join("candidate_pages", ",").alias("candidate_pages"))


@query
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences as items, with one mistake or another by doc_id."""
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    k = F.col("doc_id") % 5
    return made.select(
        ((F.col("doc_id") * 1000 + F.col("page")) * 1000 + F.col("ord")).alias("item_id"), "doc_id",
        F.when(k == 1, F.expr("left(quote, length(quote) - 1)")).when(k == 4, F.repeat("quote", 400)).otherwise(F.col("quote")).alias("quote"),
        F.when(k == 2, F.col("page") + 1000).otherwise(F.col("page")).alias("page"), F.when(k == 3, F.lit("0" * 64)).otherwise(F.col("id")).alias("id"),
    )


@query
def item_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    return evidence.item_errors(_items(spark, sf_dir), made).select("item_id", "error")


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a document holds more than once."""
    return evidence.duplicate_ids(sentence_candidates(spark, sf_dir), ["doc_id"])


@query
def sentence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", evidence.sentence_errors(F.col("text")).alias("error"))


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar for each labelled document; ids are those of its sentences."""
    ids = evidence.ordered_ids(sentence_candidates(spark, sf_dir), "doc_id")
    k = F.col("doc_id") % 7
    docs = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").join(ids, "doc_id", "left").select(
        F.col("doc_id").alias("analysis"), F.when(k == 1, "abstract").otherwise("fulltext").alias("evidence_level"),
        F.when(k == 2, F.lit(None)).when(k == 3, F.lit("sha256:0")).otherwise(T.fingerprint(F.col("text"))).alias("source_pdf_fingerprint"),
        F.when(F.col("quality") == 0, "error").otherwise("ok").alias("status"), "future_work_ids",
    )


@query
def facts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("analysis"), F.lit("fulltext").alias("evidence_level"), T.fingerprint(F.col("text")).alias("input_fingerprint"))
    return evidence.facts_join(facts, _sidecars(spark, sf_dir)).select("analysis", "error", F.array_join("future_work_ids", ",").alias("future_work_ids"))


@query
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of conversations without any bad item: path and size of the item list."""
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    checked = evidence.item_errors(_items(spark, sf_dir), made).withColumn("analysis", F.col("doc_id").cast("string"))
    # an item with an error is in no sidecar, so its quote need not travel
    items = checked.filter("error is null").select("analysis", F.lit("fulltext").alias("evidence_level"), F.lit("sha256:0").alias("fingerprint"), F.col("item_id").alias("ord"), F.col("quote_id").alias("id"), "quote", F.lit("").alias("translation_zh"), F.lit("§").alias("source"), "page")
    written = evidence.sidecar(items, checked)
    return written.select("path", F.size(V.elements(V.lookup(F.parse_json("json"), "items"))).alias("items"))


@query
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sources = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))
    k = F.col("doc_id") % 3
    caches = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(k == 0, F.lit(None)).when(k == 1, F.lit("0")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("cache_sha256"))
    return evidence.cache_errors(caches, sources).select("path", "error")


@query
def fulltext_cache_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text caches of all documents; sources are the labelled ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    sources = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))
    return workflows.update_fulltext_cache(docs, sources).select("path", F.md5("text").alias("text"), "metadata_path", "metadata", "error")


@query
def fulltext_cache_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata missing, of another schema, stale or good by doc_id; sources are the labelled documents."""
    k = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    stamp = F.to_json(F.struct(F.when(k == 1, 2).otherwise(1).alias("schema"), F.when(k == 2, "0").otherwise(F.col("sha")).alias("pdf_sha256")))
    metadata = docs.filter(k != 0).select("path", F.when(k == 3, "{").otherwise(stamp).alias("json"))
    sources = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("path", F.col("sha").alias("source_sha256"))
    return workflows.validated_fulltext_cache(docs, metadata, sources).select("path", F.md5("text").alias("text"), "pdf_sha256", "error")


@query
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole preparation of every conversation; the table of contents names the system's pages and one that no conversation has."""
    all_pages = conversation_pages(spark, sf_dir)
    entry = lambda k, page: F.struct(F.lit(k).alias("ord"), F.lit(1).alias("level"), F.col("role").alias("title"), page.alias("page"))
    toc = all_pages.filter("role = 'system'").select("doc_id", F.inline(F.array(entry(0, F.col("page")), entry(1, F.lit(10**6).cast("long")))))
    fingerprints = all_pages.filter("page = 0").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("pdf_sha256"))
    made = workflows.prepare(all_pages.drop("role"), fingerprints, toc, conversation_quality(spark, sf_dir), keywords=("tion the",), last=2)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made.select(
        "doc_id", "pdf_sha256", F.size("toc").alias("toc_entries"), F.size("page_quality").alias("tiers"), joined("selection.pages").alias("selected"), joined("selection.toc_pages").alias("toc_pages"),
        F.size("candidates").alias("candidates"), F.md5(F.array_join("candidates.id", ",")).alias("ids"), F.size("source_pages").alias("pages"), joined("ocr_required_pages").alias("required"),
    )


@query
def quality_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every conversation's pages, digits and marks counting against them."""
    found = inputs.quality_report(conversation_pages(spark, sf_dir), "doc_id", least=0.97)
    return found.select("doc_id", "pages", "ok", "untrusted", "empty", F.round("least_score", 9).alias("least_score"), "threshold")


@query
def json_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON files, one in seven cut short."""
    props = table(spark, sf_dir, "events").select("event_id", F.expr("if(event_id % 7 = 0, left(props, length(props) - 1), props)").alias("text"))
    return inputs.json_files(props).select("event_id", "error")


def _bullet(quote: Column, source: Column, bulleted: Column) -> Column:
    """One item in either form of its second and third line."""
    lead = F.when(bulleted, "- ").otherwise("  ")
    return F.concat(F.lit("- 原文："), quote, F.lit("\n"), lead, F.lit("译：x\n"), lead, F.lit("出处："), source)


def _analyses(spark: SparkSession, sf_dir: str, quote: Column) -> DataFrame:
    """(doc_id, markdown): an item for each page under "## Next", in both forms of bullets, and bullets of another section before and behind it."""
    source = F.concat(F.lit("Turn（p."), F.col("page").cast("string"), F.lit("）"))
    item = F.struct("page", _bullet(quote, source, F.col("page") % 2 == 1).alias("b"))
    other = F.lit("- 原文：elsewhere\n  译：x\n  出处：y\n")
    grouped = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"]), "\n").alias("items"))
    return grouped.select("doc_id", F.concat(F.lit("# T\n## Before\n"), other, F.lit("## Next\n"), F.col("items"), F.lit("\n## Notes\n"), other).alias("markdown"))


@query
def markdown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of all pages as items; the bullets of other sections are none."""
    files = _analyses(spark, sf_dir, F.split("text", "\n")[0])
    return inputs.markdown_items(files, ["doc_id"], "markdown", heading="## Next")


@query
def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.marked_text(conversation_pages(spark, sf_dir).withColumn("page", F.col("page") + 1), "doc_id")


@query
def page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.page_quality(conversation_pages(spark, sf_dir)).select("doc_id", "page", "tier")


@query
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("receiver")).distinct()


@query
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.lit(1).alias("run_id"), F.col("n_regionkey").alias("sender"), F.col("n_nationkey").alias("receiver"))
    return topology.child_counts(edges, ["run_id"]).select("sender", "children")


@query
def edge_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_dedup(spark, sf_dir).agg(F.count(F.lit(1)).alias("relations"))


@query
def ownership_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("run_id"), F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("receiver"))
    return topology.ownership_conflicts(edges, ["run_id"]).select("receiver", "senders")


@query
def topology_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each customer: the customer spawns one worker, which spawns the customer's orders (twice, as started and completed)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    event = lambda method, sender, receiver: F.struct(F.struct(F.lit(method).alias("method"), F.struct(F.struct(F.lit(topology.ITEM_TYPE).alias("type"), F.lit("spawnAgent").alias("tool"), sender.alias("senderThreadId"), F.array(receiver).alias("receiverThreadIds")).alias("item")).alias("params")).alias("message"))
    root, worker = F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("w"), F.col("c_custkey"))
    nested = orders.select("c_custkey", F.explode(F.array(*(event(m, worker, F.concat(F.lit("o"), F.col("o_orderkey"))) for m in ("item/started", "item/completed")))).alias("e")).groupBy("c_custkey").agg(F.collect_list("e").alias("nested"))
    runs = table(spark, sf_dir, "customer").select("c_custkey").join(nested, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("run_id"),
        F.to_json(F.struct(F.lit(True).alias("passed"), F.lit("1").alias("version"), F.struct(root.alias("thread_id"), F.concat(F.array(event("item/completed", root, worker)), F.coalesce("nested", F.array().cast(nested.schema["nested"].dataType))).alias("app_server_events")).alias("output"))).alias("response"),
    )
    # small tables come as few tasks, and reading a log is heavy
    logs = runs.unionByName(_odd_logs(spark, sf_dir)).repartition(spark.sparkContext.defaultParallelism)
    return topology.verdicts(logs, samples.CONTRACT, samples.CONTRACT_ID).select("run_id", "producer_status", "nested_direct_child_count", "formal_spawn_relation_count", "exit_code")


def _odd_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each event with a mistake by its id: cut short, no log at all, no version, and events that break one rule each."""
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    item = lambda sender, receivers, method="item/completed": F.format_string('{"message": {"method": "%s", "params": {"item": {"type": "%s", "tool": "spawnAgent", "senderThreadId": %s, "receiverThreadIds": %s}}}}', F.lit(method), F.lit(topology.ITEM_TYPE), F.to_json(F.array(sender)).substr(F.lit(2), F.length(F.to_json(F.array(sender))) - 2), receivers)
    child = F.concat(F.lit('["w'), name, F.lit('"]'))
    rules = (
        F.lit("7"), F.lit('{"message": []}'), F.lit('{"message": {"method": ["x"]}}'), F.lit('{"message": {"method": "item/started"}}'), item(F.lit(""), child), item(name, F.lit("[]")), item(name, F.lit("[3]")),
        F.concat(item(name, child), F.lit(", "), item(F.lit("other"), child)), item(name, F.lit("null"), "item/started"),
    )
    events = F.lit("")
    for k, text in enumerate(rules):
        events = F.when(F.col("event_id") % 12 == k, text).otherwise(events)
    version = F.when(F.col("event_id") % 12 == 9, "null").otherwise('"1"')
    whole = F.concat(F.lit('{"passed": true, "version": '), version, F.lit(', "output": {"thread_id": "'), name, F.lit('", "app_server_events": ['), events, F.lit("]}}"))
    k = F.col("event_id") % 12
    return spread(table(spark, sf_dir, "events")).select(name.alias("run_id"), F.when(k == 10, F.expr("left(props, length(props) - 1)")).when(k == 11, F.col("props")).otherwise(whole).alias("response"))


@query
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.lookup(V.parse(F.col("props")), "k")
    return table(spark, sf_dir, "events").select(F.try_variant_get(v, "$", "long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def marker_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing, unwanted, passed = gates.marker_gate(F.col("html"), ["<title>", "</html>", "<nav>", "href="], ["%%%", "track(1)"])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(missing, "|").alias("missing"), F.array_join(unwanted, "|").alias("unwanted"), passed.alias("passed"))


@query
def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = spark.createDataFrame([(m,) for m in ("<table>", "<nav>", "utm_source", "</p>")], "marker string")
    return gates.missing_rows(table(spark, sf_dir, "pages").select("page_id", "html"), markers, "page_id", "html")


@query
def short_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the benchmark below ten words, and the documents that hold it."""
    listed = pages.page_candidates(table(spark, sf_dir, "benchmark").select("item_id", "text"), keys=("item_id",))
    quotes = locate.with_view(listed.filter(F.size(F.split("quote", "\\s+")) < 10), "quote", "short").select("short").distinct()
    docs = locate.with_view(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "view")
    return locate.containing(quotes, docs, quote="short").groupBy("short").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query
def word_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number of markers in one scan: all words of at least eight letters in the conversations, and how many documents hold each."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), 0)
    markers = conversation_pages(spark, sf_dir).select(F.explode(words).alias("marker")).distinct()
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return locate.holders(docs, markers, "text", "marker")


@query
def ordered_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.in_order(F.col("html"), "<nav>", "</nav>").alias("nav"), T.in_order(F.col("html"), "</body>", "<body>").alias("reversed"))


@query
def mutation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.mutants(table(spark, sf_dir, "documents"), ["License", "under the"], "doc_id").select("doc_id", "marker", F.length("mutant").alias("left"), "caught")


@query
def replace_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, error = T.replace_once(F.col("html"), "<body>", "<main>")
    twice, problem = T.replace_once(F.col("html"), "<li>", "<dd>")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(done).alias("done"), error.alias("error"), F.md5(twice).alias("done_li"), problem.alias("error_li"))


@query
def rewrite_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, error = T.apply_steps(F.col("html"), [("once", "<title>", "<h1>"), ("once", "</title>", "</h1>"), ("all", "<a href=", "<A HREF="), ("once", "</nav>", "")])
    return table(spark, sf_dir, "pages").select("page_id", F.md5(result).alias("result"), error.alias("error"))


@query
def patch_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags on lines of their own stand in for headings."""
    lines = F.replace(F.replace("html", F.lit("<nav>"), F.lit("\n<nav>\n")), F.lit("</nav>"), F.lit("\n</nav>\n"))
    patched = evidence.patch_section(lines, "<nav>", "</nav>", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(patched).alias("patched"), evidence.anchor_error(F.col("html"), "<nav>", "</nav>").alias("error"))


@query
def html_title_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices between markers and text without tags (a stand-in for file headers)."""
    bare = F.regexp_replace(F.regexp_replace("html", "<script>[^\\n]*?</script>|<style>[^\\n]*?</style>", ""), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.substring(T.slice_between(F.col("html"), "<title>", "</title>"), 8, 1 << 20).alias("title"), F.md5(T.strip_left(bare)).alias("body"))


@query
def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", sinks.sidecar_path(path).alias("sidecar"), sinks.sidecar_path(path, "facts").alias("facts"), sinks.cache_metadata_path(path).alias("metadata"), gates.absolute_error(F.col("source")).alias("error"))


@query
def finalized_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with a new section for conversations whose items are all good."""
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    checked = evidence.item_errors(_items(spark, sf_dir), made)
    items = checked.select(F.col("doc_id").alias("analysis"), F.col("item_id").alias("ord"), F.col("quote_id").alias("id"), "quote", F.lit("").alias("translation_zh"), F.lit("§").alias("source"), "page", "error")
    written = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n## Next\nold\n## Notes\nkept\n"))
    analyses = conversation_pages(spark, sf_dir).select("doc_id").distinct().select(F.col("doc_id").alias("analysis"), written.alias("markdown"), F.lit("fulltext").alias("evidence_level"), F.lit("sha256:0").alias("fingerprint"))
    return workflows.finalize(analyses, items, "## Next", "## Notes").select("analysis", F.md5("markdown").alias("markdown"), "items", "error")


@query
def upgraded_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words of each page as items in its conversation's Markdown; in one conversation of three those of the first page have a word more that is not there."""
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " "), 1, 5), " ")
    quote = F.when((F.col("doc_id") % 3 == 0) & (F.col("page") == 0), F.concat(words, F.lit(" zzz"))).otherwise(words)
    analyses = _analyses(spark, sf_dir, quote).withColumns({"analysis": F.col("doc_id").cast("string"), "evidence_level": F.lit("fulltext"), "fingerprint": F.lit("sha256:0")})
    found = workflows.upgrade(analyses, conversation_pages(spark, sf_dir).select("doc_id", "page", "text"), "## Next", "## Notes")
    starts = F.transform(V.elements(V.lookup(V.parse(F.col("json")), "items")), lambda x: F.try_variant_get(x, "$.page", "string"))
    return found.select("analysis", "items", F.array_join(starts, ",").alias("starts"), F.md5("markdown").alias("markdown"), "error")


@query
def finished_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft for every document; short documents have a list for one, one in eleven has no input. The fingerprint is that of the text now."""
    whole = F.to_json(F.struct(*(F.lit("x").alias(f) for f in evidence.FACT_FIELDS)))
    docs = table(spark, sf_dir, "documents").withColumn("analysis", F.col("doc_id"))
    drafts = docs.select("analysis", F.lit("fulltext").alias("evidence_level"), F.when(F.col("n_chars") < 300, "[]").otherwise(whole).alias("draft"))
    found = workflows.finish_facts(drafts, _sidecars(spark, sf_dir), sources=docs.filter("doc_id % 11 <> 5").select("analysis", F.col("text").alias("content")))
    return found.select("analysis", "path", "json", "input_fingerprint", "error")


@query
def validated_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page caches, stale where the quality is 0 and lacking a page where toxic."""
    labels = table(spark, sf_dir, "labels").withColumn("path", F.col("doc_id").cast("string"))
    caches = conversation_pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit("x").alias("pdf_sha256"), "page", "text")
    sources = labels.select("path", F.when(F.col("quality") == 0, "y").otherwise("x").alias("source_sha256"))
    copied = workflows.validated_cache(caches, sources, labels.filter("toxic = 1").select("path", F.lit(999).cast("long").alias("page")))
    return copied.select("path", "page", F.md5("text").alias("text"), "error")


@query
def candidates_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.page_candidates(conversation_pages(spark, sf_dir).drop("role"))
    return workflows.candidates_markdown(made).select("doc_id", F.md5("markdown").alias("markdown"))


from . import derived  # noqa: E402, F401
