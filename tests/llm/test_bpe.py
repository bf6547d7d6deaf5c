import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofmill.llm.bpe import Encoder, PairTable, WordBpe, encode_documents

from .data import AWKWARD, table

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = WordBpe.load(PATH)
LIBRARY = Tokenizer.from_file(PATH)
SAMPLES = ["", "Hello, world's end", "İstanbul ΣΑΣ ﬁ é ½ 三 ٣", "a<|endoftext|>B <|startoftext|>", "  　x y ", "🙂👩‍👩‍👧 don't I'LL", "Ǆ ß ẞ ꭰ Ꮜ", "ͅᾳ", "\x1c\x1f\x85"]


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert MODEL.encode(text) == want
    assert MODEL.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst", max_size=300))
def test_long_words(text):
    same(text)


def test_each_character():
    for block in range(0, 0x3000, 64):
        for c in map(chr, range(block, block + 64)):
            same(f"a{c}b {c}")


def test_documents(spark):
    got = encode_documents(table(spark, AWKWARD), PATH, outputs=("ids", "decoded", "digests")).collect()
    want = []
    for doc_id, text in AWKWARD:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), ids, decoded, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty(spark):
    assert encode_documents(table(spark, []), PATH).collect() == []


def test_trees_side_by_side():
    """Enough words of each size for the array form, against the library."""
    rng = random.Random(3)
    words = [w for size in (1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 64, 100, 128) for w in {"".join(rng.choice("aeinorstlé") for _ in range(size)) for _ in range(60)}]
    assert MODEL.encode_words(words) == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words] == [[*MODEL.encode_word(w)] for w in words]


def test_full_cache(monkeypatch):
    """What is forgotten, too long to keep, or met again comes out the same."""
    monkeypatch.setattr("proofmill.llm.bpe.CACHED_WORDS", 3)
    monkeypatch.setattr("proofmill.llm.bpe.GROUP", 20)
    texts = ["one two, three", "", "x" * 400, "two, three four five <|endoftext|> one", "İ two,", "x" * 400 + " one", "a\x1cb  two,"]
    encoder = Encoder(MODEL)
    for _ in range(2):
        got = [" ".join(e[1] for e in found if e[0]) for found in encoder.groups(texts)]
        assert got == [" ".join(map(str, LIBRARY.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_pair_table():
    pairs = [(a, a * 7 % 50) for a in range(50)] + [(3, 49), (49, 3)]
    t = PairTable(pairs, 50)
    rank = {p: k for k, p in enumerate(pairs)}
    left, right = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    assert t.of(left, right).tolist() == [rank.get((a, b), -1) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
