from collections import defaultdict

from proofmill.llm import sharding
from proofmill.llm.sharding import shard_documents

from .data import AWKWARD, table


def check(got, rows, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 16) for d, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sizes


def test_awkward(spark):
    check(shard_documents(table(spark, AWKWARD), 4).collect(), AWKWARD, 4)
    assert shard_documents(table(spark, []), 4).collect() == []


def test_hot_group_is_cut_and_small_groups_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 7)
    rows = [(i, "the same text again") for i in range(1500)] + [(2000 + i, f"text {i // 2} " * 3) for i in range(3000)]
    got = shard_documents(table(spark, rows), 10).collect()
    sizes = check(got, rows, 10)
    mean = sum(sizes.values()) / 10
    assert all(abs(s - mean) <= 0.03 * mean for s in sizes.values())
    where = defaultdict(set)
    texts = dict(rows)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where["the same text again"]) > 1
    assert all(len(s) == 1 for t, s in where.items() if t != "the same text again")


def test_one_row(spark):
    assert [(r.doc_id, r.shard, r.slot) for r in shard_documents(table(spark, [(9, "a")]), 40).collect()] == [(9, 0, 0)]
