"""Best-fit packing of token sequences by a configuration linear program.

The program has one variable for each configuration (a multiset of lengths
that fits a sequence) and one constraint for each length. Its data are the
histogram of lengths, at most `capacity` numbers however large the corpus, so
it is solved on the driver: multiplicative weights price the lengths, a
knapsack dynamic program finds the best configuration at these prices, and
the fractional solution is rounded down. What is left is solved again, until
little is left, and that is packed largest first, best fit. Prices are a dual
solution too: no packing has fewer sequences than all lengths' price over that
of the best configuration. The plan says this bound, and how many of its
sequences come from the program.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bpe import default_path, encoder
from .scratch import Scratch

EPSILON, STEPS, PHASES = 0.1, 300, 3


def knapsack(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Of lengths (ascending), at most `most` copies each: a configuration of nearly the greatest total price (copies beyond `most` are cut off and the rest kept), and the greatest price of any number of copies."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if k:
            v = price[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c - 1]:
                best[c], pick[c] = v[j], j
                continue
        best[c], pick[c] = best[c - 1], -1
    found: Counter = Counter()
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            found[int(pick[c])] += 1
            c -= int(lengths[pick[c]])
    return {j: min(n, int(most[j])) for j, n in found.items() if most[j] > 0}, float(best[capacity])


def _fill(config: dict[int, int], left: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration with its free room given to the largest lengths left that fit."""
    room = capacity - sum(int(lengths[j]) * n for j, n in config.items())
    config = dict(config)
    for j in range(int(np.searchsorted(lengths, room, "right")) - 1, -1, -1):
        spare = int(left[j]) - config.get(j, 0)
        if spare > 0 and lengths[j] <= room:
            n = min(spare, room // int(lengths[j]))
            config[j] = config.get(j, 0) + n
            room -= n * int(lengths[j])
        if room < lengths[0]:
            break
    return config


def fractional(lengths: np.ndarray, count: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations and how often each is used, covering no length more than it occurs; and the greatest dual bound met."""
    bound = float((lengths * count).sum()) / capacity
    weight = lengths / capacity
    covered = np.zeros(len(lengths))
    used: list[tuple[dict[int, int], float]] = []
    for _ in range(STEPS):
        price = weight / weight.max() * lengths ** 0.02
        config, top = knapsack(price, lengths, count, capacity)
        if not config:
            break
        bound = max(bound, float((price * count).sum()) / top)
        js = np.fromiter(config, np.int64)
        a = np.fromiter(config.values(), np.float64)
        step = float((count[js] / a).min())
        used.append((config, step))
        covered[js] += a * step / count[js]
        weight[js] *= (1 - EPSILON) ** (a * step / count[js])
    if not used:
        return [], bound
    worst = covered.max()
    return [(c, x / worst) for c, x in used], bound


class Plan(list):
    """Configurations (length -> copies) and multiplicities. bound: no packing has fewer sequences; from_program: sequences that rounding the program gave."""

    bound = 0
    from_program = 0

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self)


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan that uses every length exactly as often as it occurs: of the program rounded down, the program rounded up as far as lengths are left, and the greedy rule alone, the one with the fewest sequences."""
    known: dict = {}
    plans = [_solve(histogram, capacity, 1, True, known), _solve(histogram, capacity, PHASES, False, known), _solve(histogram, capacity, 0)]
    best = min(plans, key=lambda p: (p.sequences, -p.from_program))
    best.bound = max(p.bound for p in plans)
    return best


def _solve(histogram: dict[int, int], capacity: int, phases: int, up: bool = False, known: dict | None = None) -> Plan:
    """known keeps the program's first solution for the next call."""
    known = {} if known is None else known
    left = {l: n for l, n in histogram.items() if n > 0}
    out, full = Plan(), left.pop(capacity, 0)
    if full:
        out.append(({capacity: 1}, full))
    out.bound = full + -(-sum(l * n for l, n in left.items()) // capacity)

    def arrays() -> tuple[np.ndarray, np.ndarray]:
        ls = np.array(sorted(left), np.int64)
        return ls, np.array([left[int(l)] for l in ls], np.int64)

    def use(config: dict[int, int], times: int, lengths: np.ndarray) -> None:
        named = {int(lengths[j]): n for j, n in config.items() if n}
        out.append((named, times))
        for l, n in named.items():
            left[l] -= n * times
            if not left[l]:
                del left[l]

    for phase in range(phases):
        if not left:
            break
        lengths, count = arrays()
        now = count.copy()
        used, bound = known.get(phase) or fractional(lengths, count, capacity)
        if not phase:
            known[phase] = used, bound
            out.bound = max(out.bound, full + math.ceil(bound - 1e-6))
        for config, x in sorted(used, key=lambda cx: -cx[1]):
            # of lengths that others have used up, none is left for this one
            fits = {j: n for j, n in config.items() if now[j] >= n}
            if len(fits) < len(config):
                continue
            most = min(int(now[j]) // n for j, n in fits.items())
            times = most if up else min(int(x), most)
            if times:
                use(fits, times, lengths)
                out.from_program += times
                for j, n in fits.items():
                    now[j] -= n * times
    while left:
        lengths, count = arrays()
        top = len(lengths) - 1
        config = _fill({top: 1}, count, lengths, capacity)
        room = capacity - sum(int(lengths[j]) * n for j, n in config.items())
        if room and len(lengths) > 1:
            exact = knapsack_exact(lengths, count, capacity, top)
            if exact:
                config = exact
        times = min(int(count[j]) // n for j, n in config.items())
        use(config, times, lengths)
    return out


def knapsack_exact(lengths: np.ndarray, count: np.ndarray, capacity: int, top: int) -> dict[int, int] | None:
    """The configuration with one of the longest length that fills the sequence best (subset sums over the counts, as bits)."""
    room = capacity - int(lengths[top])
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for j in range(top, -1, -1):
        l, n = int(lengths[j]), int(count[j]) - (j == top)
        if l > room or n <= 0:
            continue
        n, k = min(n, room // l), 1
        while n > 0:
            k = min(k, n)
            layers.append((j, k, reach))
            reach |= reach << (l * k) & mask
            n, k = n - k, k * 2
        if reach >> room & 1:
            break
    goal = reach.bit_length() - 1
    config = Counter({top: 1})
    for j, k, before in reversed(layers):
        if not before >> goal & 1:
            config[j] += k
            goal -= k * int(lengths[j])
    return dict(config)


def runs(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each configuration and length: ranks lo to hi of that length go to `times` sequences from `base`, `k` to each, from offset `first`."""
    rank: Counter = Counter()
    rows, base = [], 0
    for config, times in plan:
        first = 0
        for l, k in sorted(config.items(), reverse=True):
            rows.append((l, rank[l], rank[l] + k * times, base, k, first))
            rank[l] += k * times
            first += k * l
        base += times
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "base", "k", "first"]).astype("int64")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([t.astype("<u4"), end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                    seen[b - a] += 1
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A document's ids are those of the tokenizer and end_id; more than capacity
    are cut into pieces of capacity, of which the first may be shorter. Pieces
    of one length are numbered by the task that cut them and their order in
    it, so no group of equal lengths is sorted; numbers are mapped to places
    by ranges that the plan gives each configuration. Null text is empty.
    Repeated rows are packed each for itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table("pieces", texts.mapInArrow(W.tidied(_cut(tokenizer or default_path(), end_id, capacity)), _PIECES))
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = runs(solve(histogram, capacity))
    before = by_task.selectExpr("length", "part", "sum(n) over (partition by length order by part) - n as before")
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place(plan: pd.DataFrame):
    """Looks up each piece's place: the plan has at most `capacity` lengths times the configurations that hold them, whatever the corpus."""
    plan = plan.sort_values(["length", "lo"])
    length, lo, base, k, first = (plan[c].to_numpy() for c in ("length", "lo", "base", "k", "first"))
    begin = {int(l): int(i) for i, l in reversed(list(enumerate(length)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(own), np.int64)
            for l in np.unique(own).tolist():
                mine, i = own == l, begin[l]
                j = int(np.searchsorted(length, l, "right"))
                at[mine] = i + np.searchsorted(lo[i:j], rank[mine], "right") - 1
            past = rank - lo[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[at] + past // k[at]), pa.array(first[at] + past % k[at] * own)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run
