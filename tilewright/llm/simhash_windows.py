"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of L words, the windows of L words of every document
are candidates. A window's SimHash is the sign of the weighted sum of its
words' random vectors, from running sums, so a window costs the same whatever
its length. Fingerprints are cut into radius + 1 blocks: two that differ in at
most `radius` bits agree in some block, so an index of the items' blocks finds
all of them. Candidates within the radius are verified by exact weighted
Jaccard similarity of five-word shingles.

Fingerprints are made only of windows that can pass that last test: of their
shingles, enough must occur in some item (3 in 4 at 80 percent). This loses nothing
(the proof is in `_Block.starts`) and leaves most documents without a window.
The benchmark is handled in blocks of bounded size, each with one scan of the
documents, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import words as W

SHINGLE = 5
RADIUS = 21
#: Items, and words in them, that are sent to the executors at once.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
_FILTER_BITS = 22


class _Held:
    """How many distinct texts of a benchmark hold each value, over all its blocks."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, texts: list[np.ndarray]) -> None:
        new, n = np.unique(np.concatenate([self.keys[:0], *(np.unique(x) for x in texts)]), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        self.keys = keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, keys)]


class _Counts:
    """The whole benchmark's distinct texts and their words and shingles, so that an answer doesn't depend on where a block ends."""

    def __init__(self, blocks: Iterable[list[tuple[int, np.ndarray]]]):
        self.words, self.shingles, self.texts = _Held(), _Held(), 0
        seen: set[bytes] = set()
        for block in blocks:
            new = []
            for _, w in block:
                digest = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    new.append(w)
            self.words.add(new)
            self.shingles.add([W.shingle(w, SHINGLE) for w in new])
        self.texts = len(seen)


class _Block:
    """The items of one block, as arrays. counts: those of the whole benchmark, if it has more blocks."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int, radius: int, counts: _Counts | None = None):
        counts = counts or _Counts([items])
        self.percent, self.radius = percent, radius
        self.own: dict[int, tuple] = {}  # what similarity needs of the items that it met
        self.ids = np.array([i for i, _ in items], np.int64)
        self.shingles = [W.shingle(w, SHINGLE) for _, w in items]
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *self.shingles]))
        self.holders = counts.shingles.of(self.known)
        # for each known shingle the items that have it, and the weight that they have in it
        has, weight, owner = [], [], []
        for i, x in enumerate(self.shingles):
            u, n = np.unique(x, return_counts=True)
            at = np.searchsorted(self.known, u)
            has.append(at)
            weight.append(n / self.holders[at])
            owner.append(np.full(len(u), i))
        has, weight, owner = (np.concatenate(x) if x else np.empty(0) for x in (has, weight, owner))
        order = np.argsort(has, kind="stable")
        self.owner, self.share = owner[order].astype(np.int64), weight[order]
        self.first = np.searchsorted(has[order], np.arange(len(self.known) + 1))
        self.whole = np.bincount(owner.astype(np.int64), weight, len(items))
        self.n_words = np.array([len(w) for _, w in items], np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self._bits(self.known)] = True
        self.words = np.unique(np.concatenate([np.empty(0, np.uint64), *(w for _, w in items)]))
        self.weights = np.array([self._rarity(counts.texts, k) for k in counts.words.of(self.words).tolist()], np.int64)
        self.rare = self._rarity(counts.texts, 0)
        lengths = np.array([len(w) for _, w in items], np.int64)
        # for each length: the items, their fingerprints, and for each block of bits and value of it the set of items that have it
        self.by_length: dict[int, tuple] = {}
        edges = np.linspace(0, 64, radius + 2).astype(np.uint64)
        self.shifts = edges[:-1]
        self.masks = (np.uint64(1) << (edges[1:] - edges[:-1])) - np.uint64(1)
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            prints = np.concatenate([self.fingerprints(self.running(items[i][1]), np.zeros(1, np.int64), n) for i in which])
            index = np.zeros((radius + 1, int(self.masks.max()) + 1, (len(which) + 63) // 64), np.uint64)
            for k, v in enumerate(self._values(prints)):
                index[np.arange(radius + 1), v, k // 64] |= np.uint64(1) << np.uint64(k % 64)
            self.by_length[n] = which, prints, index

    def _values(self, prints: np.ndarray) -> np.ndarray:
        """The value of each block of bits of each fingerprint."""
        return (prints[:, None] >> self.shifts & self.masks).astype(np.int64)

    @staticmethod
    def _bits(s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    @staticmethod
    def _rarity(n: int, holders: int) -> int:
        return round(16 * math.log2(2 + n / (1 + holders)))

    def running(self, words: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted vectors, from which every window's sum is a difference."""
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            weight = np.where(self.words[at] == words, self.weights[at], self.rare)
        else:
            weight = np.full(len(words), self.rare)
        bits = np.unpackbits(W.mix(words ^ np.uint64(0x5151)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        total = np.zeros((len(words) + 1, 64), np.int64)
        np.cumsum(bits * weight[:, None], axis=0, out=total[1:])
        return total

    @staticmethod
    def fingerprints(total: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """SimHashes of the n-word windows at starts."""
        return np.packbits(total[starts + n] > total[starts], axis=1).view(np.uint64).reshape(-1)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.maybe[self._bits(s)])
        if not len(at) or not len(self.known):
            return at[:0]
        k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[k] == s[at]]

    def starts(self, hit: np.ndarray, n: int) -> np.ndarray:
        """Windows of n words in which enough shingles are known. hit: running count of known shingles of one document.

        A shingle of the item weighs 1 / texts that hold it, any other the mean
        m of the item's. Let i be the weight shared and u the number of others
        in the window: i >= p * (m * (n - 4) + m * u) and i <= m * (n - 4) are
        needed, so u <= (n - 4) * (1 - p) / p, and the rest is known.
        """
        width = n - SHINGLE + 1
        if len(hit) <= width:
            return np.empty(0, np.int64)
        return np.flatnonzero((hit[width:] - hit[:-width]) * self.percent >= (2 * self.percent - 100) * width)

    def candidates(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) of n words with fingerprints within the radius."""
        which, own, index = self.by_length[n]
        sets = np.bitwise_or.reduce(index[np.arange(len(self.shifts)), self._values(prints)], axis=1)
        w, k = np.nonzero(np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little"))
        near = np.bitwise_count(prints[w] ^ own[k]) <= self.radius
        return w[near], which[k[near]]

    def longer(self, s: np.ndarray, n_words: int) -> np.ndarray:
        """Items of more words than a document that it may be most of: of their weight, percent / 100 or more is in shingles that it has."""
        u = np.unique(s)
        k = np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)
        k = k[self.known[k] == u]
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in zip(self.first[k].tolist(), self.first[k + 1].tolist()))])
        shared = np.bincount(self.owner[at], self.share[at], len(self.ids))
        return np.flatnonzero((self.n_words > n_words) & (shared * 100 >= self.percent * self.whole - 1e-9))

    def similarity(self, s: np.ndarray, item: int) -> float:
        if item not in self.own:
            b = Counter(self.shingles[item].tolist())
            w = (1 / self.holders[np.searchsorted(self.known, np.array(list(b), np.uint64))]).tolist()
            total = sum(x * n for x, n in zip(w, b.values()))
            self.own[item] = {e: (n, x) for (e, n), x in zip(b.items(), w)}, total, total / len(self.shingles[item])
        own, total, mean = self.own[item]
        shared = more = others = 0
        for e, n in Counter(s.tolist()).items():
            if e in own:
                m, x = own[e]
                shared += x * min(n, m)
                more += x * max(0, n - m)
            else:
                others += n
        return float(shared / (total + more + mean * others))

    def search(self, words: np.ndarray, s: np.ndarray, at: np.ndarray) -> list[tuple]:
        """(item, similarity, start, words) of one document: the best window of each item that passes."""
        known = np.zeros(len(s) + 1, np.int64)
        known[at + 1] = 1
        known = np.cumsum(known)
        best: dict[int, tuple] = {}
        found = [(n, starts) for n in self.by_length if len(starts := self.starts(known, n))]
        # a document shorter than an item is its own window
        if len(words) < int(self.n_words.max()):
            for k in self.longer(s, len(words)).tolist():
                if (x := self.similarity(s, k)) * 100 >= self.percent - 1e-9:
                    best[k] = x, 0, len(words)
        if not found:
            return self._rows(best)
        low = min(int(starts[0]) for _, starts in found)
        total = self.running(words[low : max(int(starts[-1]) + n for n, starts in found)])
        for n, starts in found:
            w, item = self.candidates(self.fingerprints(total, starts - low, n), n)
            for i, k in zip(starts[w].tolist(), item.tolist()):
                x = self.similarity(s[i : i + n - SHINGLE + 1], k)
                if x * 100 >= self.percent - 1e-9 and (k not in best or x > best[k][0]):
                    best[k] = x, i, n
        return self._rows(best)

    def _rows(self, best: dict[int, tuple]) -> list[tuple]:
        return [(int(self.ids[k]), round(x, 6), i, n) for k, (x, i, n) in sorted(best.items())]


_FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def _rows(block: _Block, texts: list[str | None]) -> Iterator[tuple]:
    """(place in texts, item, similarity, start, words), by place."""
    raws = W.encoded(texts)
    for a, b in W.chunks(raws):
        words, at = W.hash_words(raws[a:b])
        s = W.shingle_all(words, SHINGLE)
        hit = block.hits(s)
        if not len(hit):
            continue
        doc = np.searchsorted(at, hit, "right") - 1
        inside = hit + SHINGLE <= at[doc + 1]
        hit, doc = hit[inside], doc[inside]
        for d in np.unique(doc).tolist():
            x, y = int(at[d]), int(at[d + 1])
            for r in block.search(words[x:y], s[x : y - SHINGLE + 1], hit[doc == d] - x):
                yield (a + d, *r)


def _scan(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            cols = list(zip(*((ids[i], *r) for i, *r in _rows(block, batch.column(1).to_pylist())))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def _keep(block: _Block, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[i for i, *_ in _rows(block, batch.column(text).to_pylist())]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    block: list[tuple[int, np.ndarray]] = []
    n = 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        words, _ = W.hash_words(W.encoded([row["text"]]))
        if len(words) < SHINGLE:
            continue
        if block and (len(block) == BLOCK_ITEMS or n + len(words) > BLOCK_WORDS):
            yield block
            block, n = [], 0
        block.append((row["item_id"], words))
        n += len(words)
    if block:
        yield block


def _prepared(benchmark: DataFrame, percent: int, radius: int) -> Iterator[_Block]:
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = list(_blocks(items))
    counts = _Counts(blocks)
    return (_Block(block, percent, radius, counts) for block in blocks)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, similarity, start_word, n_words).

    A row for each document and item such that some window of the document, as
    long in words as the item, has weighted similarity of percent / 100 or
    more and a fingerprint within the radius; the most similar window, the
    first of equals. A document shorter than the item is compared as a whole. Items with null id or text or fewer than five words
    can't be told from ordinary language and match nothing, as do null texts.
    Repeated rows give repeated results; an empty table gives none. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = spark.createDataFrame([], _FOUND)
    for k, block in enumerate(_prepared(benchmark, percent, radius)):
        found = texts.mapInArrow(W.tidied(_scan(block)), _FOUND)
        out = found if not k else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that benchmark_leaks finds nothing in. Each row is judged by its own text, so null and repeated doc_ids make no difference; null texts stay."""
    for block in _prepared(benchmark, percent, radius):
        docs = docs.mapInArrow(W.tidied(_keep(block, docs.columns.index("text"))), docs.schema)
    return docs
