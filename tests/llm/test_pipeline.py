import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from proofmill.llm import queries
from proofmill.llm.suffixes import cut_repeats

from . import brute
from .data import AWKWARD, SCHEMA, table
from .test_decontaminate import brute as leak_brute


def write(spark, tmp_path, docs, labels, items):
    d = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "en", "s", len(r[1]) if r[1] is not None else None)[:5] for r in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def corpus():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(25))) for i in range(4)]
    shared = " ".join(word() for _ in range(30))
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(60, 150))]
        if i % 8 == 0:
            w[20:20] = items[i % 4][1].split()
        if i % 5 == 0:
            w[40:40] = shared.split()
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[i][1] + " tail") for i in range(10)]
    return docs + [(200, "too short"), (201, "again and " * 80), (202, None), (203, "é" * 400 + " " + " ".join(word() for _ in range(30))), (204, "é" * 401 + " " + " ".join(word() for _ in range(40)))], items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    d = write(spark, tmp_path, docs, [(1, 1, 0)], items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    left = [(i, t) for i, t in docs if i not in (200, 201, 202)]
    near = brute.near_duplicates(left, 5)
    left = [r for k, r in enumerate(left) if near[k][1] == r[0]]
    texts = {}
    for i, kept, _ in brute.repeated_bytes(left):
        # whole characters only: what the cut of a two-byte letter leaves over stays
        texts[i] = kept.decode("utf-8", "strict")
    leaking = {i for i, _, _ in leak_brute([*texts.items()], items)}
    want = {i: t for i, t in texts.items() if i not in leaking}
    assert set(got) == set(want) and leaking
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    for i, t in want.items():
        assert list(got[i].ids) == library.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus()
    d = write(spark, tmp_path, docs, [(1, 1, 0)], items)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, d)
        assert after.dtypes == now.dtypes
        now = after


def test_awkward_documents(spark, tmp_path):
    d = write(spark, tmp_path, AWKWARD, [], [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() <= len(AWKWARD)
    empty = write(spark, tmp_path / "e", [], [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_cuts_leave_whole_characters(spark):
    # the second text repeats the first from the second byte of its first letter on
    rows = [(1, "Ψ" + "é" * 50 + "a"), (2, "è" + "é" * 50 + "b"), (3, None)]
    got = {r.doc_id: r.text for r in cut_repeats(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "èb", 3: None}


def test_stages_take_any_column_names(spark, tmp_path):
    """Dots, backticks, a name that differs by case alone, and names that the stages use inside."""
    docs, items = corpus()
    d = write(spark, tmp_path, docs, [(1, 1, 0)], items)
    plain = spark.read.parquet(f"{d}/documents.parquet")
    odd = ["a.b", "c`d", "e f", "Text", "row", "doc", "text_hash", "Kept", "stratum", "n_words", "base_failed", "_w", "score_symbols", "cutoff_symbols", "_column2", "bin", "kind", "data", "h", "start"]
    wide = plain.select("*", *(F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(name) for k, name in enumerate(odd)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, wide, d)
        assert after.columns == wide.columns
        rows = after.collect()
        assert sorted((r[0], r[1]) for r in rows) == sorted((r.doc_id, r.text) for r in stage(spark, plain, d).collect())
        assert all(list(r)[len(plain.columns) :] == [f"{k}:{r[0]}" for k in range(len(odd))] for r in rows)


def test_queries_of_all_operators():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
