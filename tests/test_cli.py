"""The command line: exit codes, written tables, refused batches."""

import json

from proofmill.__main__ import main
from proofmill.plans import samples


def test_verify_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "contract.json").write_text(samples.CONTRACT)
    for name, wanted in (("PASS", 0), ("FAIL_PRODUCER", 1), ("BLOCKED", 2), ("INVALID_TEST_EXECUTION", 3), ("NOT_TESTED", 4)):
        log = next((r for r in samples.LOGS if r[2] == name and r[1] is not None), None)
        if log is None:
            continue
        (tmp_path / f"{name}.json").write_text(log[1])
        assert main(["verify", str(tmp_path / f"{name}.json"), str(tmp_path / "contract.json"), samples.CONTRACT_ID, "--output", str(tmp_path / f"out_{name}")]) == wanted
        said = capsys.readouterr()
        assert json.loads(said.out)["producer_status"] == name and said.err.strip().endswith(f"producer_status: {name}")
    assert main(["verify", str(tmp_path / "*.json"), str(tmp_path / "contract.json"), samples.CONTRACT_ID, "--output", str(tmp_path / "all")]) == 3
    capsys.readouterr()


def test_normalize_refuses_a_batch_with_an_error(spark, tmp_path, capsys):
    good, bad = (json.loads(samples.INPUTS[0][1]), "{")
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert main(["normalize", str(tmp_path / "a.json"), "--kind", samples.INPUT_KIND, "--output", str(tmp_path / "one")]) == 0
    assert json.loads(spark.read.parquet(str(tmp_path / "one")).first()["output"])["abstract"] == good["abstract"]
    (tmp_path / "b.json").write_text(bad)
    assert main(["normalize", str(tmp_path / "*.json"), "--kind", samples.INPUT_KIND, "--output", str(tmp_path / "two")]) == 1
    assert not (tmp_path / "two").exists() and "unreadable" in capsys.readouterr().err


def test_candidates_print_a_summary(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1, "One. Two."), (2, 1, None)], "doc_id long, page long, text string").write.parquet(str(tmp_path / "pages"))
    assert main(["candidates", str(tmp_path / "pages"), "--output", str(tmp_path / "made")]) == 0
    assert json.loads(capsys.readouterr().out) == {"candidate_count": 2, "documents": 1}


def test_prepare_to_facts(spark, tmp_path, capsys):
    """From pages to a prepared document, proved items, a finished analysis and its facts."""
    at = lambda name: str(tmp_path / name)
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(at(name))
    put("pages", [(1, k, f"Page {k} says nothing. And more.") for k in range(1, 8)] + [(1, 8, "Later we plan a longer study. The code is open.")], "doc_id long, page long, text string")
    assert main(["prepare", at("pages"), "--last-pages", "1", "--debug-dir", at("debug"), "--output", at("prepared")]) == 0
    assert json.loads(capsys.readouterr().out) == {"result": "ok", "candidate_count": 16, "documents": 1, "ocr_required_pages": 0}
    row = spark.read.parquet(at("prepared")).first()
    assert row["selection"]["pages"] == [8] and len(row["source_pages"]) == 8 and row["toc"] == []
    assert json.loads(spark.read.text(at("debug") + "/prepare").first()[0])["doc_id"] == 1
    assert "<!-- PDF_PAGE: 8 -->" in spark.read.parquet(at("debug") + "/candidates_markdown").first()["markdown"]

    item = "item_id long, doc_id long, quote string, page long, source string"
    put("items", [(1, 1, "Later we plan a longer study.", None, "End"), (2, 1, "Page 3 says nothing.", 3, "Body")], item)
    put("wrong", [(1, 1, "Later we plan a shorter study.", None, "End")], item)
    assert main(["validate", at("items"), at("prepared"), "--output", at("proved")]) == 0
    assert sorted((r["item_id"], r["page"]) for r in spark.read.parquet(at("proved")).collect()) == [(1, 8), (2, 3)]
    assert main(["validate", at("wrong"), at("prepared"), "--output", at("refused")]) == 1
    assert not (tmp_path / "refused").exists() and "not in source" in capsys.readouterr().err

    markdown = "# T\n## Next steps\nkept\n## Next\nold\n## Notes\nkept\n"
    put("analyses", [("a.md", markdown, "fulltext", "sha256:1")], "analysis string, markdown string, evidence_level string, fingerprint string")
    spark.read.parquet(at("proved")).selectExpr("'a.md' as analysis", "item_id as ord", "id", "quote", "'x' as translation_zh", "source", "page", "cast(null as string) as error").write.parquet(at("good"))
    assert main(["finalize", at("analyses"), at("good"), "--heading", "## Next", "--before", "## Notes", "--output", at("final")]) == 0
    done = spark.read.parquet(at("final")).first()
    assert done["markdown"].startswith("# T\n## Next steps\nkept\n## Next\n- ") and done["markdown"].endswith("\n## Notes\nkept\n") and "old" not in done["markdown"]
    spark.read.parquet(at("final")).selectExpr("analysis", "1L as doc_id", "markdown", "'fulltext' as evidence_level", "'sha256:1' as fingerprint").write.parquet(at("written"))
    assert main(["upgrade", at("written"), at("prepared"), "--heading", "## Next", "--before", "## Notes", "--output", at("upgraded")]) == 0
    assert spark.read.parquet(at("upgraded")).first()["json"] == done["json"]

    facts = json.dumps(dict.fromkeys(("paper", "research_problem", "research_object", "approach", "findings", "contributions", "topic_terms", "limitations", "source_anchors", "confidence"), "x"))
    put("drafts", [("a.md", "fulltext", "sha256:1", facts)], "analysis string, evidence_level string, input_fingerprint string, draft string")
    put("sidecars", [("a.md", "fulltext", "sha256:1", "ok", ["i"])], "analysis string, evidence_level string, source_pdf_fingerprint string, status string, future_work_ids array<string>")
    put("drafts_of_others", [("b.md", "fulltext", "sha256:1", "{}")], "analysis string, evidence_level string, input_fingerprint string, draft string")
    assert main(["facts-validate", at("drafts"), "--output", at("checked")]) == 0
    assert main(["facts-validate", at("drafts_of_others"), "--output", at("unchecked")]) == 1
    assert main(["facts-finalize", at("drafts"), at("sidecars"), "--output", at("facts")]) == 0
    assert json.loads(spark.read.parquet(at("facts")).first()["json"])["future_work_ids"] == ["i"]
    assert main(["facts-finalize", at("drafts_of_others"), at("sidecars"), "--output", at("no_facts")]) == 1
    capsys.readouterr()


def test_caches_and_replacements(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(at(name))
    cache = "path string, pdf_sha256 string, page long, text string"
    put("old", [("p", "x", 1, "one"), ("p", "x", 2, "two")], cache)
    put("new", [("p", "x", 2, "better")], cache)
    put("torn", [("p", "x", 2, "better"), ("p", "y", 3, "other")], cache)
    put("sources", [("p", "x")], "path string, source_sha256 string")
    put("changed", [("p", "z")], "path string, source_sha256 string")
    assert main(["update-ocr-cache", at("old"), at("new"), "--output", at("updated")]) == 0
    assert sorted(r["text"] for r in spark.read.parquet(at("updated")).collect()) == ["better", "one"]
    assert main(["update-ocr-cache", at("old"), at("torn"), "--output", at("torn_out")]) == 1
    assert main(["validate-ocr-cache", at("old"), at("sources"), "--output", at("copy")]) == 0
    assert main(["validate-ocr-cache", at("old"), at("changed"), "--output", at("stale")]) == 1

    put("texts", [("p", "whole text")], "path string, text string")
    assert main(["update-fulltext-cache", at("texts"), at("sources"), "--output", at("stamped")]) == 0
    row = spark.read.parquet(at("stamped")).first()
    assert row["metadata_path"] == "p.meta.json" and json.loads(row["metadata"]) == {"schema": 1, "pdf_sha256": "x"}
    put("meta", [("p", row["metadata"])], "path string, json string")
    put("none", [], "path string, json string")
    assert main(["validate-fulltext-cache", at("texts"), at("meta"), at("sources"), "--output", at("whole")]) == 0
    assert spark.read.parquet(at("whole")).first()["text"] == "whole text"
    for metadata, sources in (("meta", "changed"), ("none", "sources")):
        assert main(["validate-fulltext-cache", at("texts"), at(metadata), at(sources), "--output", at("bad")]) == 1
    assert "stale" in (err := capsys.readouterr().err) and "metadata is missing" in err

    put("pages", [(1, 1, "good text"), (1, 2, "#%!")], "doc_id long, page long, text string")
    put("tiers", [(1, 1, "ok"), (1, 2, "untrusted")], "doc_id long, page long, tier string")
    put("texts_of_pages", [(1, 2, "read again")], "doc_id long, page long, text string")
    put("nothing", [], "doc_id long, page long, text string")
    assert main(["merge-ocr", at("pages"), at("tiers"), at("texts_of_pages"), "--output", at("merged")]) == 0
    assert sorted(r["text"] for r in spark.read.parquet(at("merged")).collect()) == ["good text", "read again"]
    assert main(["merge-ocr", at("pages"), at("tiers"), at("nothing"), "--output", at("unmerged")]) == 1
    assert main(["quality", at("pages"), "--output", at("report")]) == 0
    assert [(r["pages"], r["ok"], r["empty"]) for r in spark.read.parquet(at("report")).collect()] == [(2, 1, 1)]
    capsys.readouterr()
