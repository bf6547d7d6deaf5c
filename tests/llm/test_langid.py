import math
import zlib

import numpy as np

from proofmill.llm.langid import ORDER, CharModels, _find, folded, gram_hashes, learn, predict
from proofmill.llm.sampling import held_out

from .data import AWKWARD, SCHEMA, table

TEXTS = {"en": "the cat sat on the mat and the dog ate the rat", "de": "der hund und die katze sind zu hause für immer", "fr": "le chat est sur la table avec été et où"}


def counts_of(text):
    codes = "   " + "".join(map(chr, folded(text)))
    out = {}
    for i in range(len(codes) - ORDER + 1):
        g = codes[i : i + ORDER]
        out[g] = out.get(g, 0) + 1
    return out


def brute_log_prob(counts, languages, language, gram):
    """Interpolated Kneser-Ney by its definition."""
    top = counts[language]
    vocabulary = 1 + len({g[-1] for c in counts.values() for g in c})

    def level(k):
        if k == ORDER:
            return top
        longer, out = level(k + 1), {}
        for g in longer:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    def p(g):
        if not g:
            return 1 / vocabulary
        c = level(len(g))
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total = sum(v for x, v in c.items() if x[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        kinds = sum(x[:-1] == g[:-1] for x in c)
        return max(c.get(g, 0) - d, 0) / total + d * kinds / total * p(g[1:])

    return math.log(p(gram))


def test_models_match_the_definition():
    counts = {x: counts_of(t) for x, t in TEXTS.items()}
    models = CharModels.fit(counts, sorted(TEXTS))
    text = "the katze où zzz été 7"
    entropies, sizes = models.entropies([text, "", None])
    assert sizes.tolist() == [len(text), 0, 0]
    padded = "   " + "".join(map(chr, folded(text)))
    for k, language in enumerate(models.languages):
        want = -sum(brute_log_prob(counts, models.languages, language, padded[i : i + ORDER]) for i in range(len(text))) / len(text)
        assert math.isclose(entropies[0, k], want, rel_tol=1e-9)


def test_long_texts_go_block_by_block(monkeypatch):
    from proofmill.llm import langid

    models = CharModels.fit({x: counts_of(t) for x, t in TEXTS.items()}, sorted(TEXTS))
    texts = ["the cat und der hund " * 40, "été", "x"]
    whole = models.entropies(texts)[0]
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert np.allclose(models.entropies(texts)[0], whole, rtol=1e-9)


def test_documents(spark):
    rows = [(100 + i, TEXTS[x] + f" {i}", x) for i in range(60) for x in TEXTS] + AWKWARD + [(50, "123 456 !", "en"), (51, "mat and dog", None)]
    docs = spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA)
    got = predict(docs, learn(docs.filter(~held_out("doc_id")))).withColumn("held_out", held_out("doc_id")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (50, "und"), (51, "en")} <= by
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {(r[0], r[1]): r[2] for r in rows if r[0] and r[0] >= 100}
    assert sum(r.lang_pred in {x for (d, _), x in truth.items() if d == r.doc_id} for r in got if r.doc_id and r.doc_id >= 100) == len(truth)


def test_nothing_to_learn(spark):
    got = predict(table(spark, AWKWARD), learn(table(spark, []))).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == len(AWKWARD)


def test_find_in_nothing():
    assert not _find(np.empty(0, np.uint64), gram_hashes(folded("abcd")))[0].any()


def test_a_large_alphabet_keeps_all_ngrams(spark):
    """Over a million different n-grams, nearly all seen once: none is left out of the model."""
    codes = np.random.default_rng(5).integers(0x4E00, 0x9FFF, 1_050_000)
    text = "".join(map(chr, codes.tolist()))
    m = learn(spark.createDataFrame([(1, text, "zh", None, None)], SCHEMA))
    grams = counts_of(text)
    assert len(grams) > 1_000_000 and len(m.grams[ORDER - 1][0]) == len(grams)


def test_decisions_by_hand(spark):
    """Prediction, score, temperature and rejection from plain log-probabilities of every n-gram."""
    languages = sorted(TEXTS)
    counts = {x: counts_of(TEXTS[x]) for x in languages}
    models = CharModels.fit(counts, languages)

    def entropies(text):
        grams = counts_of(text)
        return [-sum(n * brute_log_prob(counts, languages, x, g) for g, n in grams.items()) / sum(grams.values()) for x in languages]

    held = [("en", "the dog and the cat"), ("en", "a rat on the mat"), ("de", "die katze und der hund"), ("fr", "le chat et la table"), ("fr", "avec des chats")]
    models.calibrate([(x, entropies(t)) for x, t in held])
    losses = []
    for t in np.geomspace(0.5, 64, 60):
        loss = 0.0
        for x, text in held:
            e = entropies(text)
            loss += t * (e[languages.index(x)] - min(e)) + math.log(sum(math.exp(-t * (v - min(e))) for v in e))
        losses.append((loss / len(held), t))
    assert math.isclose(models.temperature, min(losses)[1])
    limits = {x: 1.25 * float(np.quantile([entropies(t)[languages.index(x)] for y, t in held if y == x], 0.999)) for x in languages}
    texts = ["the cat", "der hund", "été où", "xq zw vv kk", "dog und chat", "12"]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    for r in predict(docs, models).collect():
        if texts[r.doc_id] == "12":
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        e = entropies(texts[r.doc_id])
        best = min(e)
        assert r.lang_pred == languages[e.index(best)] and math.isclose(r.cross_entropy, best, abs_tol=1e-9)
        assert math.isclose(r.score, 1 / sum(math.exp(-models.temperature * (v - best)) for v in e), abs_tol=1e-9)
        assert r.accepted == (best <= limits[r.lang_pred] + 1e-12)
