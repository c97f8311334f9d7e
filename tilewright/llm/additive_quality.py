"""Quality scores by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins and each chosen pair of features
one over the grid of theirs. The tables are sums of shallow trees, boosted in
cycles: each round gives every feature, one after another, a small tree on its
bins against the current residuals, at a low rate; then the pairs that explain
most of what is left are boosted the same way. A score is the sum of a text's
table entries, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import words as W

#: Labelled rows that a model is fitted on: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 200, 60, 6, 0.1, 4
_RIDGE = 1.0

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "stop", "comma", "loud", "bar", "symbol", "at_sign", "beyond_ascii", "line_words", "distinct_words", "commonest_word", "repeated_lines")
#: Byte classes, fixed: 1 upper case, 2 digits, 3 stops, 4 commas, 5 loud marks, 6 bars, 7 symbols, 8 at signs, 9 beyond ASCII, 10 newlines, 0 the rest.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"|", b"#$%&*^~+=<>{}[]\\/_", b"@", bytes(range(128, 256)), b"\n"), 1):
    _CLASS[list(_chars)] = _k
_KINDS = 11


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; null is empty."""
    plain = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in W.chunks(plain):
        part = plain[a:b]
        size = np.fromiter(map(len, part), np.int64, b - a)
        kinds = np.bincount(np.repeat(np.arange(b - a), size) * _KINDS + _CLASS[np.frombuffer(b"".join(part), np.uint8)], minlength=(b - a) * _KINDS).reshape(-1, _KINDS)
        words, at = W.hash_words([r.lower() for r in part])
        n_words, some = np.diff(at), np.maximum(size, 1)
        x = out[a:b]
        x[:, 0], x[:, 1], x[:, 2] = np.log1p(size), np.log1p(n_words), size / np.maximum(n_words, 1)
        x[:, 3:12] = kinds[:, 1:10] / some[:, None]
        x[:, 12] = n_words / (kinds[:, 10] + 1)
        for i in range(b - a):
            if n_words[i]:
                _, n = np.unique(words[at[i] : at[i + 1]], return_counts=True)
                x[i, 13], x[i, 14] = len(n) / n_words[i], n.max() / n_words[i]
            lines = [y for y in part[i].split(b"\n") if y]
            x[i, 15] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step function over bins in order: greedy splits, each where it gains most."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    parts = [(0, len(g))]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        l = (cg[k] - cg[a]) ** 2 / (ch[k] - ch[a] + _RIDGE)
        r = (cg[b] - cg[k]) ** 2 / (ch[b] - ch[k] + _RIDGE)
        j = int((l + r).argmax())
        return float(l[j] + r[j] - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + _RIDGE)), int(k[j])

    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + _RIDGE)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """On a grid: one split of the first axis and one of the second in each half (or the axes exchanged). Also its gain."""
    best, best_gain = np.zeros_like(g), 0.0
    for swap in (False, True):
        gg, hh = (g.T, h.T) if swap else (g, h)
        whole = gg.sum() ** 2 / (hh.sum() + _RIDGE)
        for k in range(1, len(gg)):
            out, total = np.zeros_like(gg), 0.0
            for rows in (slice(0, k), slice(k, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                step = _tree(a, b, 2)
                out[rows] = step
                total += float((step * a).sum())
            if total - whole > best_gain + 1e-12:
                best, best_gain = (out.T if swap else out).copy(), total - whole
    return best, best_gain


class AdditiveModel:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: a row of features for each text; y: 0 or 1. Without rows of both labels, every score is the share of ones (0.5 without rows)."""
        m = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return
        at = self.bins(x)
        f = np.full(len(y), self.start)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j in range(m):
                n = len(self.tables[j])
                if n < 2:
                    continue
                g, h = slopes()
                step = RATE * _tree(np.bincount(at[:, j], g, n), np.bincount(at[:, j], h, n), LEAVES)
                self.tables[j] += step
                f += step[at[:, j]]
        self.coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in self.tables]
        near = np.stack([c[at[:, j]] for j, c in enumerate(self.coarse)], axis=1)

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            return np.bincount(near[:, i] * PAIR_BINS + near[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

        g, h = slopes()
        gains = sorted(((_grid_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(m) for j in range(i + 1, m)), reverse=True)
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in gains[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h = slopes()
                step = RATE * _grid_tree(grid(i, j, g), grid(i, j, h))[0]
                table += step
                f += step[near[:, i], near[:, j]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        f = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            f += table[at[:, j]]
        for i, j, table in self.pairs:
            f += table[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-f))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))], names=["y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """docs(doc_id, text), labels(doc_id, quality 0/1) -> a model, from the `rows` labelled documents with the smallest hashes of doc_id.

    Several labels of one document: the smallest. Several rows of one doc_id:
    that with the smallest hash of its text. Null labels or ids are left out.
    Without labelled documents every score is 0.5.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    sample = marked.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows`
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    joined = joined.groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("r.y", "r.text")
    found = joined.mapInArrow(_featured, "y int, x array<double>").toPandas()
    x = np.stack(found["x"].to_list()) if len(found) else np.empty((0, len(FEATURES)))
    y = found["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return AdditiveModel(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score, predicted): score in 0..1, higher where label 1 is likelier; predicted is 1 from the threshold on. A row per row of docs, repeated ones too; null text is empty. An empty table gives no rows. Other columns are ignored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(model.score(features(batch.column(1).to_pylist())), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
