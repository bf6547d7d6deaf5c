"""BPE encoding and decoding with a public vocabulary.

Each word is encoded with a segment tree over its adjacent pairs. A leaf holds
a pair's rank and place, a node the least of its two children, so the root
names the leftmost pair of the lowest rank. A merge changes three leaves, and a
word of n symbols takes O(n log n). The trees of many words of one size are
kept side by side in arrays and go through their merges in step; a word
that is long, or has few of its size beside it, has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NO_PAIR = 1 << 60
#: Distinct words whose encoding a worker keeps, and the longest word that it keeps.
CACHED_WORDS, CACHED_LENGTH = 400_000, 128
#: Characters of text whose words are looked up together.
GROUP = 1 << 20
#: Trees go side by side if there are so many of one size at least, of so many leaves at most.
SIDE_BY_SIDE, MOST_LEAVES = 24, 128


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself where printable, else the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class PairTable:
    """(left id, right id) -> rank, for arrays of pairs: open addressing, at most an eighth full."""

    def __init__(self, pairs: list[tuple[int, int]], ids: int):
        self.ids = ids
        left, right = np.array(pairs, np.int64).reshape(-1, 2).T
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int32)
        todo, keys = np.arange(len(pairs)), left * ids + right
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            # of pairs that want one slot the last to be written has it
            self.keys[slot[free]], self.ranks[slot[free]] = keys[todo[free]], todo[free]
            placed = self.keys[slot] == keys[todo]
            todo, slot = todo[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys = left.astype(np.int64) * self.ids + right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.ranks[slot[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return out


def merge_side_by_side(symbols: np.ndarray, sizes: np.ndarray, table: PairTable, merged: np.ndarray) -> np.ndarray:
    """Carry out all merges of many words: ``symbols`` has a column for each, -1 below its ``sizes`` symbols.

    The rows number a power of two, and so do a tree's leaves. Symbols that went into the one before them become -1.
    """
    leaves, words = symbols.shape
    place = leaves.bit_length() - 1
    none = np.iinfo(np.int64).max
    rows = np.arange(leaves)[:, None]
    after = np.where(rows + 1 < sizes, rows + 1, -1)
    before = np.broadcast_to(rows - 1, symbols.shape).copy()
    tree = np.full((2 * leaves, words), none, np.int64)
    i, col = np.nonzero(after >= 0)
    rank = table.of(symbols[i, col], symbols[i + 1, col])
    tree[leaves + i, col] = np.where(rank < 0, none, rank << place | i)
    width = leaves // 2
    while width:
        np.minimum(tree[2 * width : 4 * width : 2], tree[2 * width + 1 : 4 * width : 2], out=tree[width : 2 * width])
        width //= 2
    # from here on places are flat: row * words + column
    sym, nxt, prv, flat = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()
    col = np.flatnonzero(tree[1] < none)
    while len(col):
        root = flat[words + col]
        i = root & (leaves - 1)
        at = i * words + col
        j = nxt[at]
        away = j * words + col
        k, p = nxt[away], prv[at]
        sym[at] = merged[root >> place]
        sym[away] = -1
        nxt[at] = k
        right, left = np.flatnonzero(k >= 0), np.flatnonzero(p >= 0)
        prv[k[right] * words + col[right]] = i[right]
        # the pairs that the new symbol begins and ends
        first, owner = np.concatenate([i[right], p[left]]), np.concatenate([col[right], col[left]])
        second = np.concatenate([k[right], i[left]])
        rank = table.of(sym[first * words + owner], sym[second * words + owner])
        flat[(leaves + i) * words + col] = none
        flat[(leaves + j) * words + col] = none
        flat[(leaves + first) * words + owner] = np.where(rank < 0, none, rank << place | first)
        node, owner = leaves + np.concatenate([i, j, p[left]]), np.concatenate([col, col, col[left]])
        for _ in range(place):
            node >>= 1
            child = 2 * node * words + owner
            flat[node * words + owner] = np.minimum(flat[child], flat[child + words])
        col = col[flat[words + col] < none]
    return sym.reshape(leaves, words)


class PairTree:
    """The tree of one word."""

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks, self.symbols, n = ranks, symbols, len(symbols)
        self.after = [*range(1, n), -1]
        self.before = [*range(-1, n - 1)]
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = [NO_PAIR] * (2 * self.leaves)
        for i in range(n - 1):
            self.tree[self.leaves + i] = self.pair(i)
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, at: int, leaf: int) -> None:
        tree, i = self.tree, at + self.leaves
        tree[i] = leaf
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def pair(self, at: int) -> int:
        """The leaf of the pair that begins at a symbol: its rank, then its place."""
        if at < 0 or self.after[at] < 0:
            return NO_PAIR
        found = self.ranks.get((self.symbols[at], self.symbols[self.after[at]]))
        return found[0] * self.leaves + at if found else NO_PAIR

    def merged(self) -> list[int]:
        symbols, after, before = self.symbols, self.after, self.before
        while self.tree[1] < NO_PAIR:
            i = self.tree[1] % self.leaves
            j = after[i]
            symbols[i] = self.ranks[symbols[i], symbols[j]][1]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            self.put(j, NO_PAIR)
            self.put(i, self.pair(i))
            if before[i] >= 0:
                self.put(before[i], self.pair(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out


#: Scripts whose character classes are the same in every Unicode version in use. Texts with other characters
#: are split by the tokenizers library, so that newly assigned letters count as it counts them.
SETTLED = re.compile(r"[\x00-\u024f\u0391-\u03a9\u03b1-\u03c9\u0400-\u04ff\u2010-\u2027\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Characters at which str.split cuts and the pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


@dataclass
class WordBpe:
    """A vocabulary file whose words end in a suffix: NFC, white space to one space, lower case, then a pattern's matches as words."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    special: dict[str, int]
    file: str
    library: Tokenizer | None = None

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as opened:
            file = opened.read()
        return cls.parse(file)

    @classmethod
    def parse(cls, file: str) -> WordBpe:
        spec = json.loads(file)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] is not None:
            raise ValueError("not a word-end vocabulary of the kind that this encoder knows")
        model = spec["model"]
        return cls(
            model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"],
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
            {t["content"]: t["id"] for t in spec["added_tokens"]}, file,
        )

    def __post_init__(self) -> None:
        # a pair of ids: its rank, and the id of what it merges to
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(self.merges)}
        self.table = PairTable([(self.vocab[a], self.vocab[b]) for a, b in self.merges], max(self.vocab.values()) + 1)
        self.made = np.array([self.vocab[a + b] for a, b in self.merges], np.int32)
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.find = regex.compile(self.pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in (self.vocab | self.special).items()}

    def chunks(self, text: str) -> list[str]:
        """The normalized text cut at its spaces, at which words end."""
        if not text.isascii():
            # lower case goes character by character: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if SEPARATORS.search(text):
            return regex.sub(r"\s+", " ", text).lower().split(" ")
        return text.lower().split()

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the tokenizers library finds them."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.file)
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def cut(self, text: str) -> tuple[list[str], bool]:
        """Pieces of the text in order, and whether they are words; if not, ``find`` gives the words of each.

        Special tokens are words of their own.
        """
        if any(s in text for s in self.special):
            return [w for k, part in enumerate(self.specials.split(text)) for w in ([part] if k % 2 else self.words(part))], True
        if text.isascii() or SETTLED.fullmatch(text):
            return self.chunks(text), False
        return self.plain_words(text), True

    def words(self, text: str) -> list[str]:
        pieces, whole = self.cut(text)
        return pieces if whole else [w for c in pieces for w in self.find(c)]

    def encode_word(self, word: str) -> tuple[int, ...]:
        if word in self.special:
            return (self.special[word],)
        data = word.encode("utf-8")
        return tuple(PairTree([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]], self.ranks).merged())

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """What encode_word gives for each of many words, none of them a special token."""
        out: list[list[int]] = [[]] * len(words)
        data = [w.encode("utf-8") for w in words]
        sizes = np.array([*map(len, data)], np.int64)
        inner, last = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        classes = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for c in np.unique(classes).tolist():
            mine = np.flatnonzero(classes == c)
            leaves = 1 << c
            if len(mine) < SIDE_BY_SIDE or leaves > MOST_LEAVES:
                for k in mine.tolist():
                    out[k] = list(self.encode_word(words[k]))
                continue
            n = sizes[mine]
            starts = np.cumsum(n) - n
            flat = np.frombuffer(b"".join([data[k] for k in mine.tolist()]), np.uint8)
            col = np.repeat(np.arange(len(mine)), n)
            symbols = np.full((leaves, len(mine)), -1, np.int32)
            symbols[np.arange(len(flat)) - starts[col], col] = inner[flat]
            symbols[n - 1, np.arange(len(mine))] = last[flat[starts + n - 1]]
            left = merge_side_by_side(symbols, n, self.table, self.made).T
            ends = np.cumsum((left >= 0).sum(axis=1)).tolist()
            ids = left[left >= 0].tolist()
            for k, a, b in zip(mine.tolist(), [0, *ends], ends, strict=False):
                out[k] = ids[a:b]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """The tokens with one space between; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


Encoding = tuple[int, str, str, bytes]


class Encoder:
    """A model with the encodings that it has met: number of ids, the ids in decimal, their decoding, the ids as 32-bit integers."""

    def __init__(self, model: WordBpe):
        self.model = model
        self.decimal = {i: str(i) for i in model.token}
        self.by_word: dict[str, Encoding] = {}
        self.by_chunk: dict[str, Encoding] = {}

    def _learn_words(self, words: set[str]) -> list[str]:
        """Encode those that are new; returns them."""
        special, token, decimal = self.model.special, self.model.token, self.decimal
        new = [*words.difference(self.by_word)]
        plain = [w for w in new if w not in special]
        for w, ids in [*zip(plain, self.model.encode_words(plain), strict=True), *((w, [special[w]]) for w in new if w in special)]:
            self.by_word[w] = len(ids), " ".join([decimal[i] for i in ids]), " ".join([token[i] for i in ids]), array("i", ids).tobytes()
        return new

    def of(self, texts: list[str]) -> Iterator[list[Encoding]]:
        """For each text the encodings of its pieces, in order."""
        if len(self.by_word) > CACHED_WORDS or len(self.by_chunk) > CACHED_WORDS:
            self.by_word.clear()
            self.by_chunk.clear()
        cut = [self.model.cut(t) for t in texts]
        find = self.model.find
        split = {c: find(c) for c in set().union(*(p for p, whole in cut if not whole)).difference(self.by_chunk)}
        new = self._learn_words(set().union(*split.values(), *(p for p, whole in cut if whole)))
        word = self.by_word.__getitem__
        for chunk, words in split.items():
            if len(words) == 1:
                self.by_chunk[chunk] = word(words[0])
            else:
                several = [*map(word, words)]
                self.by_chunk[chunk] = sum(e[0] for e in several), " ".join([e[1] for e in several]), " ".join([e[2] for e in several]), b"".join([e[3] for e in several])
        look = self.by_chunk.__getitem__
        for pieces, whole in cut:
            yield [*map(word if whole else look, pieces)]
        for known, fresh in ((self.by_word, new), (self.by_chunk, split)):
            for x in fresh:
                if len(x) > CACHED_LENGTH:
                    del known[x]

    def groups(self, texts: list[str | None]) -> Iterator[list[Encoding]]:
        """The same, for GROUP characters of the texts at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= GROUP:
                yield from self.of(held)
                held, size = [], 0
        yield from self.of(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """This process's encoder: a Python worker keeps it from task to task."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(WordBpe.parse(file))
    return _ENCODERS[file]


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text, decode the ids again.

    Returns doc_id, n_tokens and, as asked for in ``outputs``, ``ids``
    (array<int>), ``decoded`` (string), ``digests`` (ids_sha256 and
    decoded_sha256). Row by row, without a shuffle: nulls in text count as
    empty (no ids, an empty decoding), any doc_id passes through, repeated rows
    give repeated results, other columns are ignored.

    ``path`` is read on the driver; the vocabulary (under 2 MB) travels as a broadcast.
    """
    spark = docs.sparkSession
    model = WordBpe.load(path)
    shared = spark.sparkContext.broadcast(model.file)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    ddl = "doc_id long, n_tokens long"
    if "ids" in outputs:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if "decoded" in outputs:
        fields.append(("decoded", pa.string()))
        ddl += ", decoded string"
    if "digests" in outputs:
        fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        ddl += ", ids_sha256 string, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for b in batches:
            out: dict[str, list] = {name: [] for name, _ in fields}
            for found in encoder.groups(b.column("text").to_pylist()):
                ids = " ".join([f[1] for f in found if f[0]])
                decoded = " ".join([f[2] for f in found if f[0]])
                out["n_tokens"].append(sum([f[0] for f in found]))
                if "ids" in outputs:
                    out["ids"].append(b"".join([f[3] for f in found]))
                if "decoded" in outputs:
                    out["decoded"].append(decoded)
                if "digests" in outputs:
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            if "ids" in outputs:
                values = pa.array(np.frombuffer(b"".join(out["ids"]), np.int32))
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out["n_tokens"]]), pa.int32()), values)
            arrays = [b.column("doc_id") if name == "doc_id" else out[name] if name == "ids" else pa.array(out[name], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, ddl)
