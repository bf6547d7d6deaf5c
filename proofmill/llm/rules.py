"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Fixed base rules come first. Then each score of a document is held against a
cutoff of its stratum. Cutoffs are learnt from the labelled holdout: a
candidate passes when the exact (Clopper-Pearson) upper bound of its false
rejection rate is at most RISK, which is to say P(Bin(n, RISK) <= x) is at
most the level; candidates are tried from the mildest on until one fails
(fixed-sequence testing), and the level is shared out over strata and rules
(Bonferroni). Strata or rules without enough labels get no cutoff.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_position, durable

#: False rejections that each rule may cause in each stratum, and the chance that any cutoff breaks that.
RISK, CONFIDENCE = 0.01, 0.05
#: Strata: documents by their number of words, up to these bounds.
BANDS = (100, 400, 1600)
#: Scores (the higher, the worse) with their candidate cutoffs, the mildest first.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03, 0.02),
    "repeats": (0.25, 0.2, 0.15, 0.1, 0.05),
    "dup_lines": (0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "capitals": (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1),
}
#: Words in a repeated window.
WINDOW = 8

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum and score_*.

    Row by row: no shuffle. A null text has no words. Arrays that a lambda
    looks into are columns of their own first, so that they are built once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    n_gaps = F.size("_w") - WINDOW
    base = (
        docs
        .withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN)))
        .withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR)))
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_g", F.when(n_gaps < 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_h") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))))
        .withColumn("_s", F.when(F.size("_g") == F.size(F.array_distinct("_g")), F.array().cast("array<struct<g:long,i:int>>")).otherwise(F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
        # windows that have an equal one beside them in the sorted order, by their place in the text
        .withColumn("_p", F.array_sort(F.transform(
            F.filter("_s", lambda x, k: F.get("_s", k + 1)["g"].eqNullSafe(x["g"]) | ((k > 0) & F.get("_s", F.greatest(k - 1, F.lit(0)))["g"].eqNullSafe(x["g"]))),
            lambda x: x["i"],
        )))
    )
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n")),
        lambda a: a["n"],
    )
    counted = (
        base
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("_caps", F.regexp_count(text, F.lit("[A-Z]")))
    )
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    return (
        counted
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("stratum", reduce(lambda s, b: s + (F.col("n_words") > b).cast("int"), BANDS, F.lit(0)))
        .withColumn("score_symbols", share(F.col("n_symbols"), F.col("word_chars")))
        .withColumn("score_repeats", share(F.col("n_repeat_words"), F.col("n_words")))
        .withColumn("score_dup_lines", share(F.col("n_dup_lines"), F.size("_l")))
        .withColumn("score_capitals", share(F.col("_caps"), F.col("word_chars")))
        .drop("_w", "_l", "_h", "_g", "_s", "_p", "_caps")
    )


def log_gamma(z: Column) -> Column:
    """ln gamma(z) for z >= 1: Stirling's series at z + 8."""
    y = z + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(reduce(lambda a, k: a * (z + float(k)), range(1, 8), z))


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x); 1 where x is not below its mean.

    The terms from x downwards fall off at least geometrically; 40 deviations hold all of them that count.
    """
    x, n = x.cast("double"), n.cast("double")
    first = log_gamma(n + 1.0) - log_gamma(x + 1.0) - log_gamma(n - x + 1.0) + x * F.log(F.lit(p)) + (n - x) * F.log(F.lit(1 - p))
    steps = F.least(x, F.ceil(40 * F.sqrt(n)) + 40).cast("int")
    terms = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda j: (x - j + 1.0) * (1 - p) / ((n - x + j) * p)
    total = F.aggregate(
        terms,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["sum"] + a["term"] * ratio(j)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def cutoffs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each stratum: stratum, and a cutoff_* for each rule (null: none is safe).

    The holdout is every labelled document; one is good if any of its labels
    says quality 1; labels with nulls are left out. Counts are summed before
    they are shuffled, so a stratum that holds most rows is no hot key.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    held = features.select("doc_id", "stratum", *(f"score_{r}" for r in RULES)).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    sums = [F.sum((F.col(f"score_{r}") > c).cast("long")).alias(f"{r}_{k}") for r, cs in RULES.items() for k, c in enumerate(cs)]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.lit(c).alias("cutoff"), F.col(f"{r}_{k}").alias("x"))
        for r, cs in RULES.items() for k, c in enumerate(cs)
    ))
    level = CONFIDENCE / (len(RULES) * (len(BANDS) + 1))
    in_order = Window.partitionBy("stratum", "rule").orderBy("k")
    safe = (
        counts.select("stratum", "n", F.inline(cells))
        .withColumn("safe", F.min((binomial_tail(F.col("x"), F.col("n"), RISK) <= level).cast("int")).over(in_order))
        .filter("safe = 1")
    )
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES))


def judged(features: DataFrame, found: DataFrame) -> DataFrame:
    """``features`` with ``kept``. ``found`` has a row for each of the len(BANDS) + 1 strata at most, so it is broadcast."""
    over = reduce(lambda a, r: a | F.coalesce(F.col(f"score_{r}") > F.col(f"cutoff_{r}"), F.lit(False)), RULES, F.lit(False))
    return features.join(F.broadcast(found), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on each document: doc_id, the features, base_failed, kept.

    A null or empty text has no words and fails the base rules; repeated rows
    are judged row by row; a null doc_id is judged but has no label; without
    labels only the base rules hold; columns other than doc_id and text are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = durable(with_features(plain).drop("text"))
    return judged(features, cutoffs(features, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns, whatever their names.

    Nulls, empty texts, repeated rows and missing labels are as there: a null or empty text goes, repeated rows stay or go together,
    a null doc_id has no label, and an empty table stays empty. Cutoffs are crossed above them, so a score that ties with one stays.
    Rows and features are written once and read for the cutoffs and the verdict.
    """
    docs, names = by_position(docs, "doc_id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = durable(with_features(rows).drop("text"))
    return judged(features, cutoffs(features, labels)).filter("kept").select("row.*").toDF(*names)
