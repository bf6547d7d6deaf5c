"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over normalised characters. All
models lie in sorted arrays of n-gram hashes with a column of log
probabilities for each language, so that one binary search serves every
language. The language of the lowest cross-entropy per character wins; a
temperature fitted on training documents turns the margins into a score, and
texts that fit no model are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64

ORDER = 4
#: About so many documents of each language are learnt from (all, if there are fewer), and so many serve to calibrate.
SAMPLE, CALIBRATION = 3000, 400
#: Characters that are scored at once.
BLOCK = 1 << 20
LETTER = regex.compile(r"\p{L}")


def _fold_table() -> np.ndarray:
    """A character's class of 16 bits: digits are one, white space is one, all beyond the basic plane is one, all else stands for itself."""
    table = np.arange(0x10000, dtype=np.uint16)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            if x.isspace():
                table[c] = 32
            elif x.isdigit():
                table[c] = 48
    return table


FOLD = _fold_table()


def folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return FOLD[np.minimum(codes, 0xFFFF)]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of the ORDER-gram that ends at each place from ORDER - 1 on: its classes side by side, the last one lowest.

    Four classes of 16 bits fill it, so that it has no collisions, and the hashes of a gram's suffix and context are masks and shifts of it.
    """
    h = np.zeros(max(0, len(codes) - ORDER + 1), U64)
    for k in range(ORDER):
        h <<= U64(16)
        h |= codes[k : k + len(h)]
    return h


@dataclass
class CharModels:
    """For each order k: sorted hashes of the k-grams and their log probabilities by language.

    ``back[k]``: sorted hashes of the contexts of length k with the log of the weight that goes to the lower order.
    """

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    temperature: float = 1.0
    #: Cross-entropy beyond which a text fits no model, by language.
    reject: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], languages: list[str]) -> CharModels:
        """From the counts of ORDER-grams (strings) of each language."""
        per = [_kneser_ney(counts.get(lang, {})) for lang in languages]
        vocabulary = 1 + len({g[-1] for c in counts.values() for g in c})
        unseen = np.full(len(languages), -math.log(vocabulary))
        probs: list[dict[str, np.ndarray]] = []
        backs = [{h: None for p in per for h in p[1][k]} for k in range(ORDER)]
        for k in range(ORDER):
            for h in backs[k]:
                backs[k][h] = np.array([math.log(p[1][k].get(h, 1.0)) for p in per])
        zero = np.zeros(len(languages))
        for k in range(1, ORDER + 1):
            level: dict[str, np.ndarray] = {}
            for g in {g for p in per for g in p[0][k - 1]}:
                lower = probs[-1].get(g[1:], unseen) if k > 1 else unseen
                # an n-gram's suffix was seen wherever the n-gram was
                base = np.exp(lower + backs[k - 1].get(g[:-1], zero))
                level[g] = np.log(base + np.array([p[0][k - 1].get(g, 0.0) for p in per]))
            probs.append(level)
        return cls(languages, [_sorted(level, k + 1) for k, level in enumerate(probs)], [_sorted(b, k) for k, b in enumerate(backs)], unseen)

    def sums(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log probabilities of the characters from ORDER - 1 on, summed from each start to the next: a row for each start."""
        h = gram_hashes(codes)
        keys, rows = self.grams[ORDER - 1]
        found, at = _find(keys, h)
        lost = np.flatnonzero(~found)
        at[lost] = len(keys)  # the row of zeros at the end
        out = np.stack([np.add.reduceat(column[at], starts) for column in rows], axis=1)
        if len(lost):
            part = np.searchsorted(starts, lost, side="right") - 1
            for k, values in enumerate(self.backed_off(h[lost]).T):
                out[:, k] += np.bincount(part, values, len(starts))
        return out

    def backed_off(self, h: np.ndarray) -> np.ndarray:
        """The log probabilities after ORDER-grams that no language has seen."""
        out = np.empty((len(h), len(self.languages)))
        weight = np.zeros_like(out)
        todo = np.arange(len(h))
        for k in range(ORDER - 1, -1, -1):
            # what the context of length k leaves for the lower order
            keys, rows = self.back[k]
            has, at = _find(keys, (h[todo] >> U64(16)) & _mask(k))
            weight[todo[has]] += rows[:, at[has]].T
            if k == 0:
                break
            keys, rows = self.grams[k - 1]
            has, at = _find(keys, h[todo] & _mask(k))
            done = todo[has]
            out[done] = rows[:, at[has]].T + weight[done]
            todo = todo[~has]
        out[todo] = self.unseen + weight[todo]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the cross-entropy per character in each language, and the number of characters."""
        pad = np.full(ORDER - 1, 32, np.uint16)
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts))
        block: list[np.ndarray] = []
        owner: list[tuple[int, int, int]] = []
        filled = 0

        def flush() -> None:
            nonlocal block, owner, filled
            if not block:
                return
            # grams that reach over from one part into the next make parts of their own, which are not used
            edges = np.array([x for i, a, b in owner for x in (a, b - ORDER + 1)])
            sums = self.sums(np.concatenate([*block, pad]), edges)[::2]
            for (i, a, b), row in zip(owner, sums, strict=True):
                total[i] += row
                sizes[i] += b - a - ORDER + 1
            block, owner, filled = [], [], 0

        for i, text in enumerate(texts):
            codes = folded(text or "")
            for a in range(0, len(codes), BLOCK):
                before = pad if a == 0 else codes[a - ORDER + 1 : a]
                part = np.concatenate([before, codes[a : a + BLOCK]])
                owner.append((i, filled, filled + len(part)))
                block.append(part)
                filled += len(part)
                if filled >= BLOCK:
                    flush()
        flush()
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def scores(self, entropies: np.ndarray) -> np.ndarray:
        """Of the best language: its share of the softmax at the calibrated temperature."""
        gaps = entropies - entropies.min(axis=1, keepdims=True)
        return 1 / np.exp(-gaps * self.temperature).sum(axis=1)

    def calibrate(self, held: list[tuple[str, list[float]]]) -> None:
        """The temperature of the least log loss; the cross-entropy that one in a thousand of a language's own texts exceeds, with a margin."""
        self.reject = np.full(len(self.languages), np.inf)
        if held:
            want = np.array([self.languages.index(x) for x, _ in held])
            entropies = np.array([e for _, e in held])
            gaps = entropies - entropies.min(axis=1, keepdims=True)
            own = gaps[np.arange(len(want)), want]
            losses = [(float(np.mean(t * own + np.log(np.exp(-t * gaps).sum(axis=1)))), t) for t in np.geomspace(0.5, 64, 60)]
            self.temperature = min(losses)[1]
            for k in range(len(self.languages)):
                if (want == k).any():
                    self.reject[k] = 1.25 * float(np.quantile(entropies[want == k, k], 0.999))


def _mask(k: int) -> np.uint64:
    return U64((1 << (16 * k)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _sorted(level: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and a row of values for each language with a zero after the last."""
    if not level:
        return np.empty(0, U64), np.empty((0, 1))
    keys = np.zeros(len(level), U64)
    codes = np.frombuffer("".join(level).encode("utf-16-le", "surrogatepass"), np.uint16).reshape(len(level), n)
    for k in range(n):
        keys = (keys << U64(16)) | codes[:, k]
    order = np.argsort(keys)
    values = np.array(list(level.values()))[order]
    return keys[order], np.ascontiguousarray(np.vstack([values, np.zeros((1, values.shape[1]))]).T)


def _kneser_ney(top: dict[str, int]) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """(discounted[k - 1][k-gram], weight[k][context]): p(g) = discounted(g) + weight(context) * p(g without its first character).

    The highest order counts occurrences; lower ones count the different characters before the n-gram.
    """
    levels = [top]
    for _ in range(ORDER - 1):
        lower: dict[str, int] = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)
    discounted, weight = [], []
    for counts in levels:
        once = sum(1 for c in counts.values() if c == 1)
        twice = sum(1 for c in counts.values() if c == 2)
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for g, c in counts.items():
            h = g[:-1]
            total[h] = total.get(h, 0) + c
            kinds[h] = kinds.get(h, 0) + 1
        discounted.append({g: (c - d) / total[g[:-1]] for g, c in counts.items()})
        weight.append({h: d * kinds[h] / t for h, t in total.items()})
    return discounted, weight


def learn(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> CharModels:
    """Models of every language in ``docs`` (text, lang, doc_id; a null lang, text or doc_id teaches nothing).

    Fitted on a bounded sample of labelled rows: rows come in the order of a
    hash of doc_id, about ``sample`` of each language to count n-grams and
    about ``calibration`` more to calibrate. Counting runs on the executors;
    the driver receives different n-grams, whose number the sample bounds.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("draw"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return CharModels([], [(np.empty(0, U64), np.empty((0, 1)))] * ORDER, [(np.empty(0, U64), np.empty((0, 1)))] * ORDER, np.empty(0), reject=np.empty(0))
    # a small table gives a tenth of its rows to the calibration
    spare = {x: min(calibration, n // 10) for x, n in sizes.items()}
    top = {x: min(1.0, (sample + spare[x]) / n) for x, n in sizes.items()}
    low = {x: spare[x] / n for x, n in sizes.items()}
    limits = docs.sparkSession.createDataFrame([(x, int(low[x] * (1 << 40)), int(top[x] * (1 << 40))) for x in languages], "lang string, low long, top long")
    drawn = rows.join(F.broadcast(limits), "lang").filter("draw < top")  # a row for each language

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                values, n = np.unique(gram_hashes(np.concatenate([np.full(ORDER - 1, 32, np.uint16), folded(text)])), return_counts=True)
                for v, k in zip(values.astype(np.int64).tolist(), n.tolist(), strict=True):
                    counts[lang, v] = counts.get((lang, v), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["lang", "gram", "n"])

    counted = drawn.filter("draw >= low").select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {x: {} for x in languages}
    for lang, gram, n in counted:
        counts[lang]["".join(chr((gram >> shift) & 0xFFFF) for shift in range(16 * (ORDER - 1), -1, -16))] = n
    models = CharModels.fit(counts, languages)
    models.calibrate(_entropies(drawn.filter("draw < low").select("lang", "text"), models))
    return models


def _entropies(rows: DataFrame, models: CharModels) -> list[tuple[str, list[float]]]:
    """(lang, cross-entropies) of each text with a letter; as many as the calibration takes."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(x, t) for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if LETTER.search(t)]
            found = shared.value.entropies([t for _, t in keep])[0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.string()), pa.array(found, pa.list_(pa.float64()))], names=["lang", "entropies"])

    return [(r[0], r[1]) for r in rows.mapInArrow(run, "lang string, entropies array<double>").collect()]


def predict(docs: DataFrame, models: CharModels) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted of each whole text, row by row.

    ``und`` with score 0 where the text is null or has no letter (or nothing
    was learnt); ties go to the first language in alphabetical order;
    ``accepted`` is false if the cross-entropy is beyond what the language's own
    texts have. Repeated rows give repeated results; null doc_ids pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: CharModels = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [bool(m.languages) and t is not None and LETTER.search(t) is not None for t in texts]
            langs, scores, best, fits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)
            at = [i for i, k in enumerate(known) if k]
            if at:
                entropies, _ = m.entropies([texts[i] for i in at])
                win = entropies.argmin(axis=1)
                for i, k, s, e in zip(at, win.tolist(), m.scores(entropies).tolist(), entropies.min(axis=1).tolist(), strict=True):
                    langs[i], scores[i], best[i], fits[i] = m.languages[k], s, e, bool(e <= m.reject[k])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64()), pa.array(fits, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")
