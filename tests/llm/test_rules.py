import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from proofmill.llm import rules
from proofmill.llm.common import durable
from proofmill.llm.rules import BANDS, CONFIDENCE, RISK, RULES, binomial_tail, cutoffs, keep_good, quality_rules, with_features

from .data import AWKWARD, table


def features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    dups = len(lines) - len(set(lines))
    scores = {"symbols": symbols / chars if chars else 0, "repeats": len(covered) / n if n else 0, "dup_lines": dups / len(lines) if lines else 0, "capitals": len(re.findall("[A-Z]", text)) / chars if chars else 0}
    return (n, chars, symbols, dups, len(covered), n < 20 or 100 * len(covered) > 30 * n), scores, sum(n > b for b in BANDS)


def tail(x, n):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(RISK) + (n - i) * math.log(1 - RISK)) for i in range(x + 1))


def judge(rows, labels):
    """The verdicts by the definition."""
    good = {d for d, q in labels if q == 1 and d is not None}
    all_ = [(d, *features(t)) for d, t in rows]
    cut = {}
    for s in range(len(BANDS) + 1):
        held = [sc for d, _, sc, b in all_ if b == s and d in good]
        for r, grid in RULES.items():
            for c in grid:
                x = sum(sc[r] > c for sc in held)
                if not held or x >= len(held) * RISK or tail(x, len(held)) > CONFIDENCE / (len(RULES) * (len(BANDS) + 1)):
                    break
                cut[s, r] = c
    return [(d, *f, not f[-1] and not any((s, r) in cut and sc[r] > cut[s, r] for r in RULES)) for d, f, sc, s in all_]


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        n = rng.choice([10, 60, 90, 300])
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]
        kind = i % 10
        if kind == 0:
            words = [w + "$%&" for w in words]
        elif kind == 1:
            words = (words[: max(8, n // 5)] * 5)[:n]
        elif kind == 2:
            words = [w.upper() for w in words]
        text = " ".join(w + ("\n" if k % 9 == 8 else "") for k, w in enumerate(words))
        rows.append((i, text + ("\nsame\nsame" if kind == 3 else "")))
        labels.append((i, int(kind > 2)))
    return rows, labels


def test_against_definition(spark):
    rows, labels = corpus()
    rows += [r for r in AWKWARD if r[0] != 4] + [(3000, "\x0b\x0c\r "), (3001, "a b c d e f g h " * 9), (3002, "ü#ü " * 30)]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = [tuple(r) for r in quality_rules(table(spark, rows), lab).collect()]
    want = judge(rows, [*labels, (None, 1), (5, None), (7, 1)])
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(not r[-1] and not r[-2] for r in want) > 50


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules(table(spark, []), none).collect() == []
    rows = [(1, "word " * 3), (2, " ".join(f"w{i}$$" for i in range(50)))]
    assert sorted((r.doc_id, r.kept) for r in quality_rules(table(spark, rows), none).collect()) == [(1, False), (2, True)]
    kept = keep_good(table(spark, rows), none)
    assert kept.columns == table(spark, rows).columns and [r.doc_id for r in kept.collect()] == [2]


def test_binomial_tail(spark):
    cells = [(x, n) for n in (1, 5, 100, 3000, 200_000) for x in (0, 1, 7, 20, 1700) if x <= n]
    got = spark.createDataFrame(cells, "x long, n long").select("x", "n", binomial_tail(F.col("x"), F.col("n"), RISK).alias("p")).collect()
    for x, n, p in got:
        want = 1.0 if x >= n * RISK else tail(x, n)
        assert math.isclose(p, want, rel_tol=1e-7, abs_tol=1e-300)


def test_false_rejections_stay_below_the_risk(spark):
    """On fresh documents of the same kind the rejected share of good ones keeps to the sum of the rules' risks."""
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    # features are tables, as in the operator: else they are computed again for each rule and cutoff
    found = durable(cutoffs(durable(with_features(table(spark, rows))), lab))
    other = durable(table(spark, rows).withColumn("text", F.translate("text", "abcdefgh", "bcdefgha")))
    fresh = durable(rules.judged(durable(with_features(other)), found))
    good = fresh.join(lab.filter("quality = 1"), "doc_id", "left_semi").filter("not base_failed")
    assert good.filter("not kept").count() <= len(RULES) * RISK * good.count() + 5


def test_no_python_in_the_plan(spark):
    rows, labels = corpus()
    df = quality_rules(table(spark, rows[:20]), spark.createDataFrame(labels[:20], "doc_id long, quality int"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_columns_of_the_caller(spark):
    """Every name that the rules use inside comes back with the caller's values."""
    rows, labels = corpus()
    names = ["kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum", "row", "_w", "_l", "_h", "_g", "_s", "_p", "_caps", "_id", *(f"{k}_{r}" for k in ("score", "cutoff") for r in RULES)]
    df = table(spark, rows).drop("kept")
    for name in names:
        df = df.withColumn(name, F.lit(f"mine {name}"))
    got = keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert got.columns == df.columns
    found = got.collect()
    assert all(r[name] == f"mine {name}" for r in found for name in names)
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in judge(rows, labels) if r[-1])
