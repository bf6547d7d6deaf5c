"""Operators beyond what the registered queries show."""

import itertools
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.functions import automaton
from proofmill.functions.text import view_with_offsets
from proofmill.operators import gates, locate, topology
from proofmill.plans import samples
from proofmill.sources import inputs, sinks
from proofmill.streaming import events


def verdict(spark, response, contract=samples.CONTRACT):
    rows = spark.createDataFrame([("x", response)], "run_id string, response string")
    return topology.verdicts(rows, contract, samples.CONTRACT_ID).first()


def test_verdict_fields(spark):
    r = verdict(spark, samples.log(samples.LOGS and [samples.spawn("root", ["outer"]), samples.spawn("outer", ["c", "a", "b"])]))
    assert (r.schema, r.producer_status, r.root_thread_id, r.root_direct_child_count, r.outer_thread_id) == (2, "PASS", "root", 1, "outer")
    assert r.nested_child_thread_ids == ["a", "b", "c"] and r.formal_spawn_relation_count == 4 and r.reasons == [] and r.exit_code == 0
    assert r.provenance.eval_version == "v1" and r.provenance.contract_id == samples.CONTRACT_ID


def test_blocked_by_version_names_no_thread(spark):
    r = verdict(spark, samples.log([], version=None))
    assert r.producer_status == "BLOCKED" and r.root_thread_id is None and r.provenance.eval_version is None and r.exit_code == 2


def test_problems_come_in_order_with_their_index(spark):
    r = verdict(spark, samples.log(["x", samples.spawn("root", ["a"]), {"message": 1}]))
    assert r.reasons == ["event 0: event: not an object", "event 2: message: not an object"]


@pytest.mark.parametrize("change", [{"contract_id": "other"}, {"app_server_event_envelope": 1}, {"dispatch_evidence_item_types": []}, {"raw_identity_path": {}}, {"delegation": {}}])
def test_contracts_fail_closed(spark, change):
    contract = json.dumps(json.loads(samples.CONTRACT) | change)
    assert verdict(spark, samples.log([]), contract).producer_status == "INVALID_TEST_EXECUTION"


def test_unreadable_contract(spark):
    assert verdict(spark, samples.log([]), "{").producer_status == "INVALID_TEST_EXECUTION"


def test_verdict_json(spark):
    rows = spark.createDataFrame([("x", samples.log([]))], "run_id string, response string")
    r = sinks.verdict_json(topology.verdicts(rows, samples.CONTRACT, samples.CONTRACT_ID)).first()
    assert json.loads(r.json)["outer_thread_id"] is None and r.json.endswith("\n")


@pytest.mark.parametrize("scanned", [locate.SCANNED_BYTES, 0])
@pytest.mark.parametrize("limit", [locate.BROADCAST_QUOTES, 0])
def test_anchored_join_equals_brute_force(spark, monkeypatch, limit, scanned):
    """Long and short quotes, broadcast or not, by scans or by anchors: the same pairs as a nested loop."""
    monkeypatch.setattr(locate, "BROADCAST_QUOTES", limit)
    monkeypatch.setattr(locate, "SCANNED_BYTES", scanned)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    quotes = []
    for k, n in enumerate(itertools.islice(itertools.cycle([1, 2, 3, 9, 10, 11, 25]), 60)):
        d = rng.choice(docs)[1].split()
        a = rng.randrange(len(d) - n)
        q = " ".join(d[a : a + n])
        quotes.append((k, q[1:] if k % 2 and len(q) > 3 else q))
    found = locate.containing(spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, view string"))
    got = sorted({(r.item_id, r.doc_id) for r in found.collect()})
    assert got == sorted((k, i) for k, q in quotes for i, t in docs if q in t)


def test_a_phrase_in_all_quotes_and_texts_is_no_anchor(spark, monkeypatch):
    """Quotes and texts that share their opening meet by what is rare in them; no row of a join on anchors carries a text."""
    monkeypatch.setattr(locate, "SCANNED_BYTES", 0)
    opening = " ".join(f"same{k}" for k in range(12))
    docs = [(k, f"{opening} " + " ".join(f"w{k}x{j}" for j in range(20)) + " end") for k in range(60)]
    quotes = [(k, docs[k][1].rsplit(" ", 3)[0]) for k in range(0, 60, 2)] + [(100, f"{opening} and never more of the words that stand there")]
    sources = spark.createDataFrame(docs, "doc_id int, view string")
    asked = spark.createDataFrame(quotes, "item_id int, quote string")
    assert sorted((r.item_id, r.doc_id) for r in locate.containing(asked, sources).collect()) == [(k, k) for k in range(0, 60, 2)]
    joined = locate._anchored(asked, sources, "quote", "view")._jdf.queryExecution().optimizedPlan().toString()
    for line in joined.split("\n"):
        if "Join" in line and "_anchor" in line:
            assert "view" not in line


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.lists(st.none() | st.text(alphabet="abéc", max_size=50), max_size=8), st.sampled_from([5, 4096]))
def test_automaton_finds_what_is_there(patterns, texts, piece):
    before, automaton.PIECE = automaton.PIECE, piece
    try:
        rows, which = automaton.Automaton([p.encode() for p in patterns]).find(pa.array(texts, pa.string()))
    finally:
        automaton.PIECE = before
    assert list(zip(rows.tolist(), which.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t is not None and p in t]


def test_patterns_in_blocks(spark, monkeypatch):
    """Several passes, empty and null patterns, null texts, markers that all texts lack."""
    texts = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (4, "twofold é")], "k int, t string")
    patterns = spark.createDataFrame([("two",), ("é",), ("one two",), ("none",), ("",), (None,), ("two",)], "marker string")
    for size in (1, 1 << 18):
        monkeypatch.setattr(locate, "PATTERN_BYTES", size)
        got = {(r.k, r.p) for r in locate.holding(texts, patterns, "t", "p").collect()}
        assert got == {(1, "two"), (1, "one two"), (4, "two"), (4, "é"), (1, ""), (2, ""), (4, "")}
        lacking = {tuple(r) for r in gates.missing_rows(texts, patterns, "k", "t").collect()}
        assert lacking == {(1, "é"), (1, "none"), (2, "two"), (2, "é"), (2, "one two"), (2, "none"), (4, "one two"), (4, "none")}
    assert gates.missing_rows(texts, patterns.limit(0), "k", "t").collect() == [] and locate.holding(texts.limit(0), patterns, "t", "p").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé-\n \tﬁ①é", max_size=40))
def test_view_offsets_point_into_the_text(text):
    view, at = view_with_offsets(text)
    assert len(view) == len(at) and at == sorted(at) and all(0 <= i < len(text) for i in at)
    assert "  " not in view and view == view.strip()


def test_selection_hints_do_not_bound_proofs(spark):
    pages = spark.createDataFrame(samples.SPAN_PAGES, "doc_id long, page long, text string")
    quotes = spark.createDataFrame(samples.SPAN_QUOTES, "item_id long, doc_id long, quote string, page long")
    assert sorted(map(tuple, locate.within_document(quotes, pages).collect())) == sorted(samples.SPAN_PLACES)


def test_quotes_over_page_ends_with_furniture(spark):
    from proofmill.operators.workflows import prove_items

    rows = spark.createDataFrame(samples.EDGE_PAGES, "doc_id long, page long, text string")
    quotes = spark.createDataFrame(samples.EDGE_QUOTES, "item_id long, doc_id long, quote string, page long")
    spans = spark.createDataFrame(samples.EDGE_SPANS, samples.EDGE_SPAN_SCHEMA)
    assert sorted(map(tuple, locate.within_document(quotes, rows, spans).collect())) == samples.EDGE_PLACES
    proved = prove_items(quotes.filter("item_id = 1").withColumn("source", F.lit("Method")), rows, exclusions=spans).first()
    assert (proved["page"], proved["end_page"], proved["error"]) == (7, 8, None)


def test_mixed_and_stacked_edges_are_peeled(spark):
    from proofmill.operators import layout

    found = layout.edge_exclusions(spark.createDataFrame(samples.MIXED_BLOCKS, samples.BLOCK_SCHEMA))
    assert sorted((r.page, x.start, x.end, x.text, x.edge) for r in found.collect() for x in r.edge_exclusions) == samples.MIXED_SPANS


def test_runs_take_the_white_space_between_and_around(spark):
    """The reference's case: a page number, then a header, both after the body, and white space at the end."""
    from proofmill.operators import layout

    text = "Body text.\n  1\n\nRunning header\n "
    shape = [("Body text.", None, 0.1, 0.2), ("1", "bottom", 0.95, 0.96), ("Running header", "top", 0.01, 0.02)]
    rows = [(1, page, k, edge, top, bottom, 0.01, text.index(t), text.index(t) + len(t) + 1, t) for page in (1, 2) for k, (t, edge, top, bottom) in enumerate(shape)]
    found = layout.edge_exclusions(spark.createDataFrame(rows, samples.BLOCK_SCHEMA)).withColumn("text", F.lit(text))
    for r in found.select("edge_exclusions", *(c.alias(n) for c, n in zip(layout.source_bounds(F.col("text"), F.col("edge_exclusions")), ("a", "b", "error"), strict=True))).collect():
        assert text[r.a : r.b] == "Body text.\n" and r.error is None
        assert r.edge_exclusions[0].end == r.edge_exclusions[1].start


def test_rejected_batches_write_nothing(spark, tmp_path):
    good = spark.createDataFrame([(1, None)], "n int, error string")
    bad = spark.createDataFrame([(1, "exceeds")], "n int, error string")
    with pytest.raises(sinks.Rejected):
        sinks.write_in_order([("analysis", good), ("sidecar", bad)], str(tmp_path))
    assert not list(tmp_path.iterdir())
    assert sinks.write_in_order([("analysis", good), ("sidecar", good)], str(tmp_path)) == ["analysis", "sidecar"]


def test_pluggable_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo")
    docs = inputs.read_bytes(spark, str(tmp_path))
    pages = inputs.extract_pages(docs, lambda data: data.decode().split("\x0c"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    assert inputs.marked_text(pages).first().text == "<!-- PDF_PAGE: 1 -->\none\n<!-- PDF_PAGE: 2 -->\ntwo"


def test_streamed_edges_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"run_id": "r", "ts": "2024-01-01T00:00:00", "sender": "a", "receiver": x} for x in ("b", "b", "c", "")]
    (tmp_path / "in" / "one.json").write_text("\n".join(map(json.dumps, rows)))
    q = events.distinct_edges(events.read_logs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.receiver for r in spark.table("edges").select("receiver").collect()) == ["b", "c"]


def test_nfkc_goes_through_python_for_other_scripts_only(spark):
    from proofmill.functions.text import with_nfkc

    df = with_nfkc(spark.createDataFrame([("a",), ("ﬁ",), (None,)], "t string"), "t", "n")
    assert sorted((r.n or "") for r in df.collect()) == ["", "a", "fi"]
    assert df.filter(F.col("n") == "fi").count() == 1


def test_blank_items_prove_nothing(spark):
    from proofmill.operators.workflows import prove_items

    items = spark.createDataFrame([(1, 1, "  ", None, "s"), (2, 1, None, None, "s"), (3, 1, "Later work.", None, "s"), (4, 1, "A b. C d. E f.", None, "s")], "item_id long, doc_id long, quote string, page long, source string")
    pages = spark.createDataFrame([(1, 1, "Later work. A b. C d. E f."), (1, 2, None)], "doc_id long, page long, text string")
    got = {r["item_id"]: (r["page"], r["error"]) for r in prove_items(items, pages).collect()}
    assert got == {1: (None, "not in source"), 2: (None, "not in source"), 3: (1, None), 4: (1, "sentences")}


def test_a_draft_with_ids_of_its_own_is_refused(spark):
    import json

    from proofmill.operators.evidence import FACT_FIELDS
    from proofmill.operators.workflows import finish_facts

    whole = dict.fromkeys(FACT_FIELDS, "x")
    drafts = spark.createDataFrame([("a", "fulltext", "f", json.dumps(whole)), ("b", "fulltext", "f", json.dumps(whole | {"future_work_ids": ["z"]})), ("c", "fulltext", "f", None)], "analysis string, evidence_level string, input_fingerprint string, draft string")
    sides = spark.createDataFrame([(a, "fulltext", "f", "ok", ["i"]) for a in "abc"], "analysis string, evidence_level string, source_pdf_fingerprint string, status string, future_work_ids array<string>")
    got = {r["analysis"]: r for r in finish_facts(drafts, sides).collect()}
    assert json.loads(got["a"]["json"])["future_work_ids"] == ["i"] and json.loads(got["a"]["json"])["facts"] == whole
    assert got["b"]["json"] is None and got["b"]["error"] == "unknown fields: future_work_ids" and got["c"]["error"] == "not an object"


def test_longer_headings_are_others(spark):
    from proofmill.operators.evidence import patch_section

    rows = [("# T\n## Next steps\na\n## Next \nb\n## Notes\nc",), ("## Next steps\na\n## Notes",), ("## Notes\nrest",), ("## Notes on x\n",), ("## Next\nb\n## Notes  \n😀 ## Next",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(patch_section(F.col("m"), "## Next", "## Notes", F.lit("new"))).collect()]
    assert got == ["# T\n## Next steps\na\n## Next\nnew\n## Notes\nc", "## Next steps\na\n## Next\nnew\n## Notes", "## Next\nnew\n## Notes\nrest", None, "## Next\nnew\n## Notes  \n😀 ## Next", None]


def test_pluggable_renderer_and_contents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo")
    docs = inputs.read_bytes(spark, str(tmp_path))
    images = inputs.render_pages(docs, lambda data, scale: [bytes([len(x)]) * int(scale) for x in data.split(b"\x0c")], 2.0)
    assert [(r.page, bytes(r.image)) for r in images.orderBy("page").collect()] == [(1, b"\x03\x03"), (2, b"\x03\x03")]
    toc = inputs.extract_toc(docs, lambda data: [(1, "One", 1), (2, "Two", 2)])
    assert [(r.ord, r.level, r.title, r.page) for r in toc.orderBy("ord").collect()] == [(0, 1, "One", 1), (1, 2, "Two", 2)]


def test_preparation_of_odd_pages(spark):
    from proofmill.operators.workflows import prepare

    made = prepare(spark.createDataFrame([(1, 1, None), (1, 2, ""), (2, 1, "A b. C d.")], "doc_id long, page long, text string"))
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got[1]["candidates"]) == 0 and [x["tier"] for x in got[1]["page_quality"]] == ["empty", "empty"] and got[1]["ocr_required_pages"] == [1, 2]
    assert [x["quote"] for x in got[2]["candidates"]] == ["A b.", "C d."] and got[2]["pdf_sha256"] is None
    assert prepare(spark.createDataFrame([], "doc_id long, page long, text string")).collect() == []


def test_items_of_a_section_in_both_forms(spark):
    """Second and third lines as bullets or indented, the named section alone, line ends of either kind."""
    indented = "# 题\n\n## 局限\n- 原文：not this\n  译：x\n  出处：y\n\n## 未来（F）\n- 原文：We plan more.\n  译：计划。\n  出处：Method\n\n## 评估\n- 原文：nor this\n  译：x\n  出处：y\n"
    rows = [
        (1, indented), (2, indented.replace("  译", "- 译").replace("  出处", "- 出处")), (3, indented.replace("\n", "\r\n")), (4, indented.replace("## 未来（F）", "## 未来（F） more")),
        (5, "## 未来（F）\n### part\n- 原文：One.\n\t译：一\n\t出处：S（p.3–4）\n# 题\n- 原文：out\n  译：x\n  出处：y"), (6, "## 未来（F）\n- 原文：no second line\n"), (7, None),
    ]
    found = inputs.markdown_items(spark.createDataFrame(rows, "n int, text string"), ["n"], heading="## 未来（F）").collect()
    assert sorted(map(tuple, found)) == [(k, 0, "We plan more.", "计划。", "Method", None) for k in (1, 2, 3)] + [(5, 0, "One.", "一", "S", 3)]
    assert inputs.markdown_items(spark.createDataFrame(rows[:1], "n int, text string"), ["n"]).count() == 3


def test_rendered_items_are_read_back(spark):
    from proofmill.operators.evidence import patch_section, render_items

    items = spark.createDataFrame([([("A b.", "甲", "S（p.1–2）"), ("C d.", "", "T")],)], "i array<struct<quote:string,translation_zh:string,source:string>>")
    text = items.select(patch_section(F.lit("# T\n## Next\nold\n## Notes\n- 原文：x\n  译：y\n  出处：z\n"), "## Next", "## Notes", render_items(F.col("i"))).alias("text"))
    got = inputs.markdown_items(text, [], heading="## Next", before="## Notes").collect()
    assert [tuple(r) for r in got] == [(0, "A b.", "甲", "S", 1), (1, "C d.", "", "T", None)]


def test_upgrade_reads_its_section_alone(spark):
    from proofmill.operators.workflows import upgrade

    bullets = lambda quote, source: f"- 原文：{quote}\n  译：x\n  出处：{source}\n"
    pages = spark.createDataFrame(samples.SPAN_PAGES, "doc_id long, page long, text string")
    rows = [
        ("a", 1, "# A\n## Next\n" + bullets("Later work.", "End") + bullets("at a page end and goes", "Section 5（p.2）") + "## Notes\n" + bullets("never said", "kept")),
        ("b", 1, "# B\n## Next\n" + bullets("never said", "End") + "## Notes\nkept\n"), ("c", 2, "# C\n## Notes\nkept\n"), ("d", 2, "# D\nno anchor\n"),
        ("e", 1, "# E\n## Next\n" + bullets("Later work.", "End") * 2 + "## Notes\nkept\n"),
    ]
    analyses = spark.createDataFrame(rows, "analysis string, doc_id long, markdown string").withColumns({"evidence_level": F.lit("fulltext"), "fingerprint": F.lit("sha256:0")})
    got = {r.analysis: r for r in upgrade(analyses, pages, "## Next", "## Notes").collect()}
    assert {k: (r.items, r.error) for k, r in got.items()} == {"a": (2, None), "b": (None, "not in source"), "c": (0, None), "d": (None, "anchors"), "e": (None, "duplicate id")}
    assert "出处：Section 5（p.2–3）\n## Notes\n" in got["a"].markdown and got["a"].markdown.endswith(bullets("never said", "kept"))
    body = json.loads(got["a"].json)
    assert body["extractor_version"] == "future-work-v1" and [i["page"] for i in body["items"]] == [2, 2] and list(body["items"][0]) == ["id", "quote", "translation_zh", "source", "page"]


def test_facts_file_names_its_format_and_input(spark):
    from proofmill.operators.evidence import FACT_FIELDS
    from proofmill.operators.workflows import finish_facts

    draft = json.dumps(dict.fromkeys(FACT_FIELDS, "x"))
    drafts = spark.createDataFrame([(a, "fulltext", draft) for a in "abc"], "analysis string, evidence_level string, draft string")

    def finish(content):
        sources = spark.createDataFrame([("a", content), ("b", b"other")], "analysis string, content binary")
        sides = sources.select("analysis", F.lit("fulltext").alias("evidence_level"), F.concat(F.lit("sha256:"), F.sha2(F.lit(content), 256)).alias("source_pdf_fingerprint"), F.lit("ok").alias("status"), F.array(F.lit("i")).alias("future_work_ids"))
        return {r["analysis"]: r for r in finish_facts(drafts, sides, kind="facts-of-a-paper", version="v9", sources=sources).collect()}

    one, two = finish(b"full text"), finish(b"changed")
    body = json.loads(one["a"]["json"])
    assert {k: body[k] for k in ("schema", "kind", "generator_version", "evidence_level", "status", "future_work_ids")} == {"schema": 1, "kind": "facts-of-a-paper", "generator_version": "v9", "evidence_level": "fulltext", "status": "ok", "future_work_ids": ["i"]}
    assert one["a"]["input_fingerprint"] == body["input_fingerprint"] != two["a"]["input_fingerprint"]
    assert one["b"]["error"] == "fingerprint" and one["c"]["error"] == "no input" and one["c"]["json"] is None


def test_exclusions_of_no_edge_are_never_peeled(spark, tmp_path):
    """A first line of half the text, and an exclusion right behind it that is of no edge."""
    from proofmill.plans.queries import QUERIES

    rows = [(4, "abcd\nx\ny"), (5, "abcd\nx\ny"), (8, "a\nx\nbcd"), (12, "abcde\nx\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["body_bounds"](spark, str(tmp_path)).collect()))
    assert got == [(4, None, None, "non-outer edge"), (5, 4, 7, None), (8, None, None, "non-outer edge"), (12, 5, 8, None)]


def test_rejected_quotes_do_not_travel(spark):
    """Quotes beyond the limit stay out of the shuffle, and items with an error out of the lists."""
    from proofmill.operators import evidence, workflows

    items = spark.range(400).selectExpr("id as item_id", "id % 4 as doc_id", "if(id % 4 = 0, repeat(sha2(string(id), 512), 200), sha2(string(id), 512)) as quote", "0L as page", "string(null) as id")
    candidates = items.selectExpr("doc_id", "quote", "page")
    checked = evidence.item_errors(items, candidates)
    assert sorted((r[0], r[1]) for r in checked.groupBy("doc_id", "error").count().collect()) == [(0, "exceeds"), (1, None), (2, None), (3, None)]
    analyses = spark.range(4).selectExpr("id as analysis", "'# T\n## Next\n## Notes\n' as markdown", "'fulltext' as evidence_level", "'x' as fingerprint")
    named = checked.selectExpr("doc_id as analysis", "if(error is null, item_id, null) as ord", "if(doc_id = 3, 'same', quote_id) as id", "quote", "'' as translation_zh", "'s' as source", "page", "error")
    got = sorted((r.analysis, r.items, r.error) for r in workflows.finalize(analyses, named, "## Next", "## Notes").collect())
    assert got == [(0, None, "exceeds"), (1, 100, None), (2, 100, None), (3, None, "duplicate id")]


def test_holders_take_one_pass(spark, monkeypatch):
    """More patterns than a block holds: still no block, and the counts of literal search."""
    from proofmill.operators import locate

    def no_blocks(*_):
        raise AssertionError("patterns went through the driver")

    monkeypatch.setattr(locate, "pattern_blocks", no_blocks)
    texts = ["abcdefghij abcdefgh", "xabcdefghx", None, "", "abcd efgh", "éabcdefghé", "été abcdefg"]
    patterns = ["abcdefgh", "bcdefghi", "abcdefghij", "zzzzzzzz", "été", "", None, "abcdefgh"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, locate.holders(docs, spark.createDataFrame([(p,) for p in patterns], "m string"), "text", "m").collect()))
    want = [(p, sum(p in t for t in texts if t is not None)) for p in sorted({p for p in patterns if p is not None})]
    assert got == [(p, n) for p, n in want if n]


def test_documents_share_files(spark, tmp_path):
    """Page-marked text of many documents in few files, read back whole."""
    from proofmill.sources import inputs

    rows = [(d, p, f"t{d}\n\n{p}\n" if p else "") for d in range(60) for p in range(3)]
    pages = spark.createDataFrame(rows, "path long, page int, text string")
    inputs.write_marked(pages, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) <= 8 and not list((tmp_path / "out").glob("path=*"))
    assert sorted((int(r.key), r.page, r.text) for r in inputs.read_documents(spark, str(tmp_path / "out")).collect()) == rows


def test_equal_drafts_are_walked_once(spark):
    from proofmill.operators import evidence

    drafts = spark.range(300).selectExpr("id", "case id % 4 when 0 then '[1]' when 1 then null when 2 then '{}' else '{\"title\": 1}' end as draft")
    shape = (("title", "STRING", True),)
    plain = sorted(map(str, evidence.shape_errors(drafts, shape).collect()))
    found = evidence.shape_errors_of_equal(drafts, shape)
    assert sorted(map(str, found.collect())) == plain == sorted(map(str, evidence.shape_errors_of_equal(drafts, shape, most=2).collect()))
    assert found.columns == ["id", "draft", "errors"]


def test_stable_characters_are_those_that_nfkc_leaves_alone():
    import re
    import sys
    import unicodedata

    from proofmill.functions.text import UNSTABLE

    joins = {int(x, 16) for c in range(sys.maxunicode + 1) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" for x in d.split()[1:]} | set(range(0x1160, 0x1200))
    stable = [c for c in map(chr, range(sys.maxunicode + 1)) if not re.match(UNSTABLE, c)]
    assert len(stable) > 30_000 and "é" in stable and "中" in stable and not {"ﬁ", "，", "́", "ﾊ"} & set(stable)
    assert not [c for c in stable if ord(c) in joins or unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c]


def test_only_changed_texts_come_back_from_python():
    from proofmill.functions import text, windows

    texts = ["é", "ﬁ", None, "é", "x" * windows.SPAN + "ﬁ", "ﬁ"]
    assert text._nfkc.func(pa.array(texts, pa.string())).to_pylist() == [None, "fi", None, "é", "x" * windows.SPAN + "fi", "fi"]
    assert text._nfkc.func(pa.array([], pa.string())).to_pylist() == []


def test_a_text_with_many_patterns_is_given_back_in_spans(monkeypatch):
    from proofmill.functions import windows

    monkeypatch.setattr(windows, "SPAN", 1000)
    patterns = [f"<{k}>" for k in range(40)]
    texts = [None, "", "".join(patterns) + "x" * 300, "<7>", "y" * 2000 + "<3>", *["<1><2>"] * 500]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    found = list(locate._held(batch, automaton.Automaton([p.encode() for p in patterns]), pa.array(patterns), "t", "p"))
    assert max(b.num_rows for b in found) <= 1000 // 6 and all(b.num_rows == 1 or sum(map(len, b["t"].to_pylist())) <= 1000 for b in found)
    assert sorted((k, p) for b in found for k, p in zip(b["k"].to_pylist(), b["p"].to_pylist())) == sorted((k, p) for k, t in enumerate(texts) for p in patterns if t and p in t)


def test_memory_of_a_scan_is_that_of_the_different_hits():
    import tracemalloc

    texts = pa.array(["a" * 4000] * 500, pa.string())
    scan = automaton.Automaton([b"a"])
    tracemalloc.start()
    rows, which = scan.find(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.tolist() == list(range(500)) and not which.any()
    assert peak < 12e6  # 2,000,000 hits of 8 bytes


def test_offset_maps_are_kept_as_arrays():
    import tracemalloc

    texts = pa.array(["a  " * 1000, "", "x-\ny ﬁ", *["b  c" * 700] * 300], pa.string())
    tracemalloc.start()
    got = locate.offset_map.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1].as_py() == {"view": [], "text": []} and got[2].as_py() == {"view": [0, 1, 4], "text": [0, 3, 5]}
    assert len(got) == 303 and all(len(got[k].as_py()["view"]) == 701 for k in (3, 302))
    assert peak < 8e6  # 420,000 numbers of 4 bytes, twice; as lists of Python numbers they took 15.6 MB
    assert locate.offset_map.func(pa.array([], pa.string())).to_pylist() == []
