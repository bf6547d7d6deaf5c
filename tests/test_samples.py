"""Operators on rows by hand, one case each."""

import json

import pytest
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import variants as V
from proofmill.operators import evidence, gates, layout, locate, pages, topology, workflows
from proofmill.plans import samples
from proofmill.sources import inputs, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_normal_forms(spark):
    got = rows(T.normalized_quote(made(spark, samples.NFKC, "n int, raw string"), "raw", "normal").select("n", "normal"))
    assert got == [(n, f) for (n, _), f in zip(samples.NFKC, samples.NFKC_FORMS, strict=True)]


def test_sentences_of_ideographs(spark):
    split = [["将来の課題である。", "次に進む。"], ["We stop here.", "次の文である.", "さらに続く。"], ["We use it, i.e. the first.", "Then the second."], ["One line", "another line.", "End"], ["本当！", "そうですか？", "はい"], []]
    got = made(spark, samples.CJK, "n int, t string").select("n", T.sentences(F.col("t"))).collect()
    assert [list(r[1]) for r in sorted(got)] == split


def test_hyphens(spark):
    got = rows(made(spark, samples.HYPHENS, "n int, t string").select("n", T.dehyphenate(F.col("t"))))
    assert got == [(1, "continent"), (2, "long- lasting"), (3, "in- line"), (4, "ab"), (5, "1-\n2"), (6, "end-"), (7, "éè")]


def test_edges_and_bounds(spark):
    found = layout.edge_exclusions(made(spark, samples.BLOCKS, samples.BLOCK_SCHEMA))
    assert "BatchEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.select("doc_id", "page", F.inline("edge_exclusions"))) == [(1, 1, 0, 8, "HEADER", "top"), (1, 1, 20, 23, "1", "bottom"), (1, 2, 0, 7, "HEADER", "top")]
    start, end, error = layout.source_bounds(F.col("t"), F.col("spans"))
    bounds = made(spark, samples.BOUNDS, "n int, t string, spans array<struct<start:int,end:int>>").select("n", F.when(error.isNull(), start), F.when(error.isNull(), end), error)
    assert rows(bounds) == [(1, 3, 8, None), (2, None, None, "non-outer edge"), (3, 0, 5, None), (4, 3, 0, None), (5, 3, 5, None)]


def test_unknown_positions_are_body(spark):
    shape = [(1, p, k, e, t, b, 0.02, 10 * k, 10 * k + 8, x) for p in (1, 2) for k, (e, t, b, x) in enumerate([("top", 0.02, 0.03, "Head"), (None, None, None, "body")])]
    assert layout.edge_exclusions(made(spark, shape, samples.BLOCK_SCHEMA)).collect() == []


def test_merges_and_caches(spark):
    left, done = pages.merge_state(F.col("required"), F.col("resolved"), F.col("supplied"))
    got = rows(made(spark, samples.MERGES, "n int, required array<int>, resolved array<int>, supplied array<int>").select("n", F.array_join(left, ","), F.array_join(done, ",")))
    assert got == [(1, "19", "18,22"), (2, "", "18,19,22"), (3, "", "18,19,22"), (4, "5", "1")]
    old, new = (made(spark, x, "path string, pdf_sha256 string, page int, text string") for x in (samples.CACHE_OLD, samples.CACHE_NEW))
    several = "several fingerprints"
    assert rows(evidence.update_cache(old, new).select("path", "pdf_sha256", "page", "text", "error")) == [
        ("p", "new", 2, "fresh", None), ("q", "same", 1, "one", None), ("q", "same", 2, "two again", None), ("r", "x", 1, "kept", None), ("s", "a", 1, "of a", several), ("s", "b", 2, "of b", several), ("s", "old", 1, "stays", None),
    ]
    assert rows(inputs.page_cache(made(spark, samples.PAGE_CACHES, "path string, text string"))) == [("a", "x", 1, "one"), ("a", "x", 12, "twelve")]


def test_contents_and_papers(spark):
    assert rows(inputs.toc_rows(made(spark, samples.TOCS, "path string, text string"))) == [("a", 0, 1, "Opening", 1), ("a", 1, 2, "Details", 2), ("b", 1, 1, "Numbered", 7)]
    assert rows(inputs.text_papers(made(spark, samples.TEXT_PAPERS, "n int, text string")).select("n", "title", "year", "body")) == [(1, "On x", 2021, "Body here."), (2, None, None, "No header at all"), (3, "t", None, "Body\n---\nmore")]
    found = rows(inputs.normalized_inputs(made(spark, samples.INPUTS, "path string, text string"), samples.INPUT_KIND).select("path", "error"))
    assert found == sorted([("/a.json", None), ("b.json", "path must be absolute"), ("/c.json", "kind"), ("/d.json", "abstract"), ("/e.json", "unreadable"), ("/f.json", "not an object"), ("/g.json", "schema"), ("/h.json", "level"), ("/i.json", "abstract")], key=repr)
    v = V.parse(F.col("text"))
    assert rows(made(spark, samples.PREPARED, "n int, text string").select("n", inputs.has_source_pages(v), F.size(inputs.items_of(v)))) == [(1, False, 2), (2, False, 1), (3, True, 0), (4, False, None)]


def test_drafts(spark):
    got = rows(made(spark, samples.DRAFTS, "n int, draft string").select("n", evidence.schema_errors(F.col("draft"), ("a", "b", "c"), ("a", "b"))))
    assert got == [(1, None), (2, "unknown fields: future_work_ids"), (3, "missing fields: b"), (4, "not an object"), (5, None)]


GOOD = {
    "paper": {"title": "T", "authors": ["A"], "year": 2026, "venue": None}, "research_problem": "p", "research_object": "o", "approach": "a", "findings": ["f"], "contributions": [], "topic_terms": ["t"], "limitations": [],
    "source_anchors": {"approach": ["§3"], "findings": []}, "confidence": 0.9,
}


@pytest.mark.parametrize(("change", "wrong"), [
    ({}, []), ({"invented": {"deep": [1]}}, ["unknown: invented"]), ({"paper": {"authors": ["A", 3, None], "doi": 5}}, ["missing: paper.title", "paper.authors[]: null", "paper.authors[]: number", "paper.doi: number"]),
    ({"paper": []}, ["paper: array"]), ({"findings": [["x"]], "confidence": "high"}, ["confidence: string", "findings[]: array"]), ({"source_anchors": {"approach": ["x", {}], "x": 1}}, ["source_anchors.approach[]: object", "unknown: source_anchors.x"]),
])
def test_shapes(spark, change, wrong):
    found = evidence.shape_errors(made(spark, [(json.dumps(GOOD | change),)], "draft string"), evidence.DRAFT_SHAPE)
    assert found.columns == ["draft", "errors"] and found.first()["errors"] == wrong


def test_shapes_of_what_is_no_draft(spark):
    found = evidence.shape_errors(made(spark, [(1, "[]"), (2, "{"), (3, None), (4, "{}"), (5, '"x"')], "n int, draft string"), [("a", "STRING", True), ("b", "OBJECT", False), ("b.c", "NUMBER", True)])
    assert {r["n"]: r["errors"] for r in found.collect()} == {1: ["not an object"], 2: ["not an object"], 3: None, 4: ["missing: a"], 5: ["not an object"]}


def test_labels_sources_digests(spark):
    labels = made(spark, samples.LABELS, "n int, source string, a int, b int").select("n", T.source_label(F.col("source"), F.col("a"), F.col("b")))
    assert rows(labels) == [(1, "Section 5"), (2, "Section 5（p.2–3）"), (3, "Section 5"), (4, "p.3 of the notes")]
    cited = made(spark, [(1, "abstract", "Abstract, last sentence"), (2, "abstract", "Section 5"), (3, "fulltext", "Section 5")], "n int, level string, source string")
    assert rows(cited.select("n", evidence.abstract_errors(F.col("level"), F.col("source")))) == [(1, None), (2, "source beyond the abstract"), (3, None)]
    given = made(spark, [(1, None, "a"), (2, "a", "a"), (3, "b", "a")], "n int, given string, prepared string")
    assert rows(given.select("n", evidence.digest_error(F.col("given"), F.col("prepared")))) == [(1, None), (2, None), (3, "foreign digest")]


def test_canonical_quotes(spark):
    located = made(spark, samples.LOCATED, "doc_id int, start_page int, quote string, id string")
    found = locate.canonical(located, made(spark, samples.CANDIDATES, "doc_id int, page int, ord int, quote string, id string"))
    assert rows(found.select("doc_id", "start_page", "quote", "id")) == [(1, 2, "We will\nextend it.", "first"), (1, 3, "We will extend it.", "new"), (2, 1, "Other.", "o")]


def test_proved_items(spark):
    quotes = made(spark, samples.SPAN_QUOTES, "item_id long, doc_id long, quote string, page long").withColumn("source", F.lit("Section 5（p.9）"))
    found = workflows.prove_items(quotes, made(spark, samples.SPAN_PAGES, "doc_id long, page long, text string")).select("item_id", "page", "end_page", "source", "error")
    assert rows(found) == sorted([(i, a, b, "Section 5" + (f"（p.{a}–{b}）" if b > a else ""), None) for i, _, a, _, b, _ in samples.SPAN_PLACES] + [(i, None, None, "Section 5（p.9）", "not in source") for i in (6, 7, 8)], key=repr)


def test_kinds(spark):
    deep = made(spark, samples.JSON_KINDS, "n int, t string").select("n", V.kind(V.lookup(V.parse(F.col("t")), "a.b")))
    assert rows(deep) == [(1, "NUMBER"), (2, "NULL"), (3, "MISSING"), (4, "STRING"), (5, "BOOLEAN"), (6, "ARRAY"), (7, "OBJECT"), (8, "MISSING"), (9, "MISSING")]
    tops = made(spark, [(1, "{}"), (2, "[]"), (3, "1.5"), (4, "null"), (5, '"1"'), (6, "1e400")], "n int, t string").select("n", V.kind(V.parse(F.col("t"))))
    assert rows(tops)[:5] == [(1, "OBJECT"), (2, "ARRAY"), (3, "NUMBER"), (4, "NULL"), (5, "STRING")]


def test_frontmatter(spark):
    head, body, error = T.split_frontmatter(F.col("t"))
    value, problem = T.frontmatter_scalar(head, "version")
    found = made(spark, samples.FRONTMATTER, "n int, t string").select("n", value, F.coalesce(error, problem), T.join_frontmatter(head, body) == F.col("t"))
    assert rows(found) == [(1, "1.2", None, True), (2, "1.2", None, True), (3, None, "lines: 2", True), (4, None, "open quote", True), (5, None, "quote inside", True), (6, None, "double quotes", True), (7, None, "separators: 0", None), (8, None, "separators: 2", None), (9, None, "lines: 0", True)]


def test_verdicts_by_hand(spark):
    runs = made(spark, [(name, response) for name, response, _ in samples.LOGS], "run_id string, response string")
    found = topology.verdicts(runs, samples.CONTRACT, samples.CONTRACT_ID)
    got = {r["run_id"]: r for r in found.collect()}
    assert {k: r["producer_status"] for k, r in got.items()} == {name: status for name, _, status in samples.LOGS}
    assert {name: " | ".join(got[name]["reasons"]) for name, _ in samples.REASONS} == dict(samples.REASONS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("try_variant_get") + plan.count("variant_get") < 300
    for _, contract, status in samples.CONTRACTS:
        assert topology.verdicts(runs.filter("run_id = 'healthy'"), contract, samples.CONTRACT_ID).first()["producer_status"] == status


def test_install_trees(spark):
    files = made(spark, [("t", p) for p in (*samples.PATHS, "GUIDE.md")] + [("u", "skill/scripts/run.py")], "tree string, path string")
    assert rows(gates.install_errors(files, ["conftest.py"], ["GUIDE.md", "skill/scripts/", "skill/scripts/run.py", "skill/run"])) == sorted(
        [("t", p, "must not be there") for p in ("skill/tests/x.py", "skill/scripts/test_run.py", "skill/conftest.py")] + [("t", "skill/run", "missing"), ("u", "GUIDE.md", "missing"), ("u", "skill/run", "missing")], key=repr)


def test_states_and_revalidation(spark):
    cases, changes, dependencies = samples.REVALIDATION
    found = gates.revalidation(made(spark, cases, "case_id int, passed boolean"), made(spark, changes, "path string"), made(spark, dependencies, "case_id int, path string, kind string"))
    assert rows(found) == [(1, "EXECUTE_CURRENT"), (2, "REJUDGE_PRIOR_EVIDENCE"), (3, "REUSE_PRIOR_PASS"), (4, "EXECUTE_CURRENT")]
    outer = made(spark, [(1, None, None), (2, False, "PASS"), (3, True, "PASS"), (4, True, "BLOCKED")], "n int, started boolean, verdict string")
    assert rows(outer.select("n", gates.outer_status(F.col("started"), F.col("verdict")))) == [(1, "CASE_NOT_STARTED"), (2, "CASE_NOT_STARTED"), (3, "PASS"), (4, "BLOCKED")]


def test_retries(spark):
    """Verdicts stay, transport faults are tried again a bounded number of times, other inputs and dirty setups do not count."""
    blocked, other = ("BLOCKED", True, False, "x"), ("BLOCKED", False, False, "x")
    clean = lambda s: (s, False, False, "x")
    cases = {
        "pass": ([clean("PASS"), clean("FAIL_PRODUCER")], ("PASS", "STOP", 1, 1)), "fail stays": ([blocked, clean("FAIL_PRODUCER"), clean("PASS")], ("FAIL_PRODUCER", "STOP", 2, 1)),
        "invalid stays": ([clean("INVALID_TEST_EXECUTION"), clean("PASS")], ("INVALID_TEST_EXECUTION", "STOP", 1, 1)), "not tested stays": ([clean("NOT_TESTED"), clean("PASS")], ("NOT_TESTED", "STOP", 1, 1)),
        "retry": ([blocked, blocked], ("BLOCKED", "RETRY", 2, 0)), "bounded": ([blocked] * 3 + [clean("PASS")], ("BLOCKED", "STOP", 3, 1)), "within": ([blocked, blocked, clean("PASS")], ("PASS", "STOP", 3, 0)),
        "no transport": ([other, clean("PASS")], ("BLOCKED", "STOP", 1, 1)), "dirty": ([("PASS", False, True, "x")], ("CASE_NOT_STARTED", "START", 0, 1)), "dirty, then clean": ([("FAIL_PRODUCER", False, True, "y"), clean("PASS")], ("PASS", "STOP", 1, 1)),
        "other inputs": ([blocked, ("PASS", False, False, "y"), clean("FAIL_PRODUCER")], ("FAIL_PRODUCER", "STOP", 2, 1)), "null inputs": ([("BLOCKED", True, False, None), ("PASS", False, False, None)], ("PASS", "STOP", 2, 0)),
    }
    data = [(name, k, *a) for name, (attempts, _) in cases.items() for k, a in enumerate(attempts)]
    found = gates.retry_verdicts(made(spark, data, "name string, ord int, status string, transport boolean, contaminated boolean, inputs string"), ["name"], limit=2)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {name: want for name, (_, want) in cases.items()}


def test_programs(spark):
    """Each row runs the program that it names; the first error ends a run."""
    steps = made(spark, [
        ("a", 1, "once", "x", "yy"), ("a", 2, "all", "y", "z"), ("a", 3, "keep", "zz", None), ("a", 4, "drop", "q", None), ("b", 1, "cut", "x", ""), ("c", 1, "all", "", "x"), ("d", 1, "all", "x", None), ("d", 2, "once", ".*", "$1"),
    ], "program string, ord int, mode string, old string, new string")
    files = made(spark, [(1, "a", "axb"), (2, "a", "xx"), (3, "a", "xq"), (4, "b", "x"), (5, "c", "x"), (6, "none", "x"), (7, None, "x"), (8, "a", None), (9, "d", "x.*"), (10, "a", "")], "n int, program string, text string")
    got = {r["n"]: (r["result"], r["error"]) for r in workflows.run_programs(files, steps).collect()}
    assert got == {
        1: ("azzb", None), 2: (None, "step 1: expected once, found 2"), 3: (None, "step 4: left over"), 4: (None, "step 1: unknown mode"), 5: (None, "step 1: nothing to look for"), 6: (None, "no program none"), 7: (None, "no program null"),
        8: (None, None), 9: ("$1", None), 10: (None, "step 1: expected once, found 0"),
    }


def test_a_batch_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A failure between the second and the third write leaves the state before; the batch is then written again, and only once."""
    root = str(tmp_path)
    tables = lambda n: [(name, made(spark, [(n,)], "n int")) for name in ("analysis", "sidecar", "facts")]
    with pytest.raises(sinks.Rejected):
        sinks.published(spark, root, "analysis")
    assert sinks.write_in_order(tables(1), root, "one") == ["analysis", "sidecar", "facts"]
    broken = tables(2)
    broken[2] = ("facts", broken[2][1].select(F.raise_error(F.lit("lost")).cast("int").alias("n")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_in_order(broken, root, "two")
    assert [sinks.published(spark, root, name).first()[0] for name in ("analysis", "sidecar", "facts")] == [1, 1, 1]
    for _ in range(2):
        sinks.write_in_order(tables(2), root, "two")
        assert [sinks.published(spark, root, name).first()[0] for name in ("analysis", "sidecar", "facts")] == [2, 2, 2]
    assert len(sinks._manifests(spark, root)) == 2
    sinks.write_in_order(tables(3)[:1], root)
    assert [sinks.published(spark, root, name).first()[0] for name in ("analysis", "facts")] == [3, 2]


def test_marked_text_is_read_back(spark, tmp_path):
    """Blank, many-lined and empty pages, text before the first marker, several files, a file cut by bytes."""
    data = [("a", 1, "one\ntwo"), ("a", 2, ""), ("a", 3, "\n\nthree\n"), ("b", 7, "x -->" * 40)]
    inputs.marked_text(made(spark, data, "key string, page int, text string"), "key").write.partitionBy("key").text(str(tmp_path / "files"))
    (tmp_path / "files" / "key=c").mkdir()
    (tmp_path / "files" / "key=c" / "raw.txt").write_text("cover\n<!-- PDF_PAGE: 4 -->\nlast page\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "16"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(inputs.read_marked(spark, str(tmp_path / "files")).select("key", "page", "text")) == sorted([*data, ("c", 4, "last page")], key=repr)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replacements_settle_whatever_comes_first(spark, tmp_path):
    from proofmill.streaming import replacements

    store = "spark.sql.streaming.stateStore.providerClass"
    required = made(spark, [(1, 1), (1, 2), (2, 5), (2, 5)], "doc_id long, page long")
    texts = [(1, 1, 1, "old"), (1, 1, 2, "new"), (1, 9, 1, "not required"), (2, 5, 1, "b"), (2, 5, 1, "a"), (1, 2, 1, None), (3, 1, 1, "no such document")]
    before = spark.conf.get(store)
    spark.conf.set(store, replacements.STORE)
    try:
        for order in (texts, texts[::-1]):
            at = tmp_path / str(order is texts)
            (at / "in").mkdir(parents=True)
            for k, row in enumerate(order):
                made(spark, [row], "doc_id long, page long, version long, text string").coalesce(1).write.mode("append").parquet(str(at / "in" / f"{k:03d}"))
            stream = spark.readStream.schema("doc_id long, page long, version long, text string").option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(at / "in"))
            running = replacements.merged_stream(stream, required).writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
            running.awaitTermination(120)
            assert rows(replacements.settled(spark.read.parquet(str(at / "out")))) == [(1, 1, "new"), (2, 5, "a")]
    finally:
        spark.conf.set(store, before)
