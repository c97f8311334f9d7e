"""Near-duplicate documents by an LSH forest over MinHash signatures.

The forest is TREES sorted orders of the signatures, each beginning with DEPTH
levels of one byte of its own and going on with those of the other trees. In
an order, a document's candidates are the neighbours with which it shares the
longest prefix: a region of the order is thus descended as deep as it is
dense, until few documents are left around each. Candidates whose sketches
agree enough are confirmed on full shingle sets.

1. One row per document: set size, 128-bit set fingerprint, signature.
   Documents with equal sets are one class from here on (grouped with
   map-side combining, so thousands of copies make one row).
2. The orders are range-partitioned, so a region of near copies may span
   partitions. Each task compares a window of neighbours; the few rows at
   partition borders are compared in a second, small pass. From each order a
   document proposes its best neighbour; documents that had more are `open`.
3. In a few rounds, the best proposal of each document that leads to another
   component is confirmed; then all proposals that are left between different
   components and, for open documents, every neighbour in another component.
   Links inside one component change nothing and aren't built, so a group of m
   near copies costs about m confirmations and never m squared.
4. Where more documents than a window holds share most levels of a tree (a
   template whose pages are less alike than the threshold), neighbours say
   little. Such documents are compared by an exact rule instead: of two that
   are alike enough, the smaller has one of its rarest ninth of shingles (at 80
   percent) among the rarest fifth of the other's. Documents of different
   components that share such a shingle are confirmed. Rarity is by counts of
   hash buckets; it decides how many pairs there are, not whether one is found.
   Documents of one shingle are compared within tasks, a crowd's in parts, by
   sketches whose bits are the parities of the shingles that fall on them: two
   sketches differ in no more bits than the sets in shingles, so a pair that
   differs in too many can be left out without a look at its sets. No other
   pair is left out, and pairs that are left out never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .scratch import Scratch, keep_ids

TREES, DEPTH = 16, 8
SKETCH = TREES * DEPTH
#: Neighbours on each side in each order.
WINDOW = 8
#: Candidates have an estimated similarity of at least this much less than the threshold: 4 standard errors.
SLACK = 0.15
#: Where more documents than a window holds share so many levels of a tree, they are dense.
CROWDED = 5
#: Buckets in which shingles of dense documents are counted.
BUCKETS = 1 << 16
#: Documents that share a rare shingle are dealt to tasks in parts of about so many, at most SALTS parts.
CROWD = 512
#: Bits of a parity sketch: about so many a shingle, within these bounds.
PARITY_BITS, LEAST_BITS, MOST_BITS = 4, 512, 8192
#: Pairs of sketches that are compared at once.
AT_ONCE = 1 << 16
#: An id with more than one in so many of all pairs is a hub, joined in so many parts.
HUB_SHARE, SALTS = 1024, 16
#: Rounds in which each document has one candidate confirmed, before all that are left.
ROUNDS = 3

_rng = np.random.default_rng(0xF0)
_A = _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bytes: of each minimum of a permuted 32-bit hash, one mixed byte."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(low, (x[a : a + 2048, None] * _A + _B).min(axis=0), out=low)
    low ^= low >> np.uint32(15)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text, sorted."""
    raws = W.encoded(texts)
    for a, b in W.chunks(raws):
        words, at = W.hash_words(raws[a:b])
        for i in range(b - a):
            s = np.sort(W.shingle(words[at[i] : at[i + 1]], n))
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


_SIGS = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h1, h2, sigs = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                sizes.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)))
                h2.append(int(W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = list(shingle_sets(part.column(1).to_pylist(), n))
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(s) for s in found], out=ends[1:])
                flat = np.concatenate(found) if found else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["doc_id", "shingles"])

    return run


_ORDERS = "tree int, id long, n long, comp long, sig binary"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each order for each of id, n, comp, sig; its signature begins with the tree's own bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            m = part.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(m, SKETCH)
            turned = np.concatenate([np.roll(sig, -DEPTH * k, axis=1) for k in range(TREES)])
            again = pa.array(np.tile(np.arange(m), TREES))
            ends = pa.array(np.arange(0, (m * TREES + 1) * SKETCH, SKETCH, dtype=np.int32))
            sigs = pa.Array.from_buffers(pa.binary(), m * TREES, [None, ends.buffers()[1], pa.py_buffer(turned.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), m)), *(part.column(j).take(again) for j in (0, 1, 2)), sigs], names=["tree", "id", "n", "comp", "sig"])


_FOUND = "a long, b long, est double, edge int, tree int, n long, comp long, sig binary"


def _neighbours(percent: int, best_only: bool):
    """Rows with edge = 0 are candidate pairs; with edge = 1, documents (in a) at a border of the partition; with edge = 2, open documents; with edge = 3, dense ones."""
    least = percent / 100 - SLACK

    def rows(a, b, est, edge, frame=None):
        m = len(a)
        none = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        rest = none if frame is None else [pa.array(frame["tree"], pa.int32()), pa.array(frame["n"], pa.int64()), pa.array(frame["comp"], pa.int64()), pa.array([x.tobytes() for x in frame["sig"]], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(est, pa.float64()), pa.array(np.full(m, edge, np.int32)), *rest], names=["a", "b", "est", "edge", "tree", "n", "comp", "sig"])

    def pairs(f: dict, new: int):
        """Of the rows from `new` on, with those before them."""
        m = len(f["id"])
        got = []
        for o in range(1, min(WINDOW, m - 1) + 1):
            i = np.arange(max(new, o), m)
            j = i - o
            same = (f["tree"][i] == f["tree"][j]) & (f["sig"][i, 0] == f["sig"][j, 0]) & (f["comp"][i] != f["comp"][j])
            n, k = f["n"][i], f["n"][j]
            i = i[same & (np.minimum(n, k) * 100 >= np.maximum(n, k) * percent)]
            if len(i):
                est = (f["sig"][i] == f["sig"][i - o]).mean(axis=1)
                ok = est >= least
                got.append((i[ok], i[ok] - o, est[ok]))
        if not got:
            return None
        i, j, est = (np.concatenate(x) for x in zip(*got))
        return (i, j, est) if len(i) else None

    def emit(f: dict, new: int):
        if best_only and len(f["id"]) > WINDOW:
            i = np.arange(max(new, WINDOW), len(f["id"]))
            j = i - WINDOW
            i = i[(f["tree"][i] == f["tree"][j]) & (f["sig"][i, :CROWDED] == f["sig"][j, :CROWDED]).all(axis=1)]
            if len(i):
                crowd = np.unique(np.concatenate([f["id"][i], f["id"][i - WINDOW]]))
                yield rows(crowd, crowd, np.ones(len(crowd)), 3)
        found = pairs(f, new)
        if found is None:
            return
        i, j, est = found
        if best_only:
            ends, other, e = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([est, est])
            at = np.lexsort((f["id"][other], -e, ends))
            first = np.append(True, ends[at][1:] != ends[at][:-1])
            many = ends[at][~first]
            if len(many):
                opened = np.unique(f["id"][np.concatenate([many, other[at][~first]])])
                yield rows(opened, opened, np.ones(len(opened)), 2)
            i, j, est = ends[at][first], other[at][first], e[at][first]
        x, y = f["id"][i], f["id"][j]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        _, at = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
        yield rows(lo[at], hi[at], est[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            f = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "id", "n", "comp")}
            f["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SKETCH)
            new = 0
            if held is None:
                head = {c: v[:WINDOW] for c, v in f.items()}
            else:
                new = len(held["id"])
                f = {c: np.concatenate([held[c], v]) for c, v in f.items()}
            yield from emit(f, new)
            held = {c: v[-WINDOW:] for c, v in f.items()}
        if held is not None:
            for edge in (head, held):
                yield rows(edge["id"], edge["id"], np.ones(len(edge["id"])), 1, edge)

    return run


def candidates(reps: DataFrame, percent: int, scratch: Scratch, name: str, best_only: bool) -> DataFrame:
    """reps(id, n, comp, sig) -> (a, b, est, edge): pairs of neighbours in some order, with edge = 0, and open documents, with edge = 2."""
    orders = reps.select("id", "n", "comp", "sig").mapInArrow(_orders, _ORDERS)
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = orders.repartitionByRange(parts, "tree", "sig", "id").sortWithinPartitions("tree", "sig", "id")
    found = scratch.table(name, sorted_.mapInArrow(W.tidied(_neighbours(percent, best_only)), _FOUND))
    border = found.where("edge = 1").select("tree", F.col("a").alias("id"), "n", "comp", "sig").distinct()
    # a few rows for each partition
    across = border.repartition("tree").sortWithinPartitions("tree", "sig", "id").mapInArrow(_neighbours(percent, best_only), _FOUND).where("edge != 1")
    return found.where("edge != 1").unionByName(across).select("a", "b", "est", "edge")


def _hubs(pairs: DataFrame) -> tuple[list[int], list[int]]:
    """Of each end, ids with a large share of all pairs: fewer than HUB_SHARE."""
    total = pairs.count()
    if total <= 64:
        return [], []
    size = pairs.select(F.posexplode(F.array("a", "b")).alias("end", "id")).groupBy("end", "id").agg(F.count("*").alias("n"))
    found = size.where(F.col("n") > max(64, total // HUB_SHARE)).select("end", "id").collect()
    return [r["id"] for r in found if r["end"] == 0], [r["id"] for r in found if r["end"] == 1]


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, hubs: list[int]) -> DataFrame:
    """pairs with the shingles of one end. The pairs of a hub are dealt out to SALTS tasks, to each of which its set goes."""
    named = sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"s{end}"))
    if not hubs:
        return pairs.join(named, end)
    hub, every = F.col(end).isin(hubs), F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = pairs.withColumn("salt", F.when(hub, F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(named.withColumn("salt", F.explode(F.when(hub, every).otherwise(F.array(F.lit(0))))), [end, "salt"]).drop("salt")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), a written table, those with 100 * intersection >= percent * union."""
    a, b = _hubs(pairs)
    both = _with_sets(_with_sets(pairs, sets, "b", b), sets, "a", a)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total")).where(f"100 * common >= {percent} * (total - common)").select("a", "b")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingles) -> (bucket, n), summed within the task."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=BUCKETS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])


def rarest(n: int, percent: int) -> tuple[int, int]:
    """Of n shingles, how many of the rarest hold one that a larger alike set shares, and one that a smaller does."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def parities(shingles: np.ndarray) -> bytes:
    """Of each bit, whether an odd number of shingles falls on it. The halves of a sketch, one xor the other, are the sketch of half as many bits."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (PARITY_BITS * len(shingles) - 1).bit_length()))
    at = (shingles.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _rarest(counts: np.ndarray, percent: int):
    """(id, comp, shingles) -> (id, comp, n, few, rare, bits): the rarest shingles in order, the most that an alike smaller set may need, and the parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, bits = [], [], []
            for i in range(batch.num_rows):
                s = batch.column(2)[i].values.to_numpy()
                few, most = rarest(len(s), percent)
                sizes.append((len(s), few))
                kept.append(s[np.lexsort((s, counts[_bucket(s)]))][:most])
                bits.append(parities(s))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in zip(*sizes)), pa.array(kept, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "comp", "n", "few", "rare", "bits"])

    return run


_ROW = ("id", "comp", "n", "place", "short", "home")


def _by_width(f: dict) -> dict[int, dict]:
    """Rows by the bytes of their sketches, these as words in a matrix."""
    size = np.array([len(x) for x in f["bits"]])
    out = {}
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        out[w] = {c: f[c][at] for c in _ROW} | {"bits": np.frombuffer(b"".join([f["bits"][i] for i in at]), np.uint64).reshape(len(at), w // 8)}
    return out


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _alike_parities(x: dict, y: dict, percent: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs in ok (rows of x by rows of y), those that may be alike enough if their key is the first shingle that they share."""
    n, m = x["n"][:, None], y["n"][None, :]
    ok = ok & (x["comp"][:, None] != y["comp"][None, :]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
    # the smaller has the key among its rarest, and what the two share lies from there on
    less = (n < m) | ((n == m) & (x["id"][:, None] < y["id"][None, :]))
    ok &= np.where(less, x["short"][:, None], y["short"][None, :])
    ok &= np.minimum(n - x["place"][:, None], m - y["place"][None, :]) * (100 + percent) >= percent * (n + m)
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j
    words = min(x["bits"].shape[1], y["bits"].shape[1])
    p, q = _folded(x["bits"], words), _folded(y["bits"], words)
    near = np.empty(len(i), bool)
    step = max(1, AT_ONCE * 16 // words)
    for a in range(0, len(i), step):
        u, v = i[a : a + step], j[a : a + step]
        apart = np.bitwise_count(p[u] ^ q[v]).sum(axis=1, dtype=np.int64)
        near[a : a + step] = apart * (100 + percent) <= (x["n"][u] + y["n"][v]) * (100 - percent)
    return i[near], j[near]


def _meet(percent: int):
    """Rows sorted by key, part and role -> (a, b): pairs of a part. Rows of role 0 meet each other (once in all parts: where the larger id is at home) and all rows of role 1."""

    def pairs(x: dict[int, dict], y: dict[int, dict], among: bool) -> Iterator[pa.RecordBatch]:
        for w, p in x.items():
            for v, q in y.items():
                if max(w, v) * percent > min(w, v) * 200:
                    continue  # sizes are too far apart
                step = max(1, AT_ONCE * 16 // len(q["id"]))
                for a in range(0, len(p["id"]), step):
                    part = {c: z[a : a + step] for c, z in p.items()}
                    ok = (part["id"][:, None] < q["id"][None, :]) & q["home"][None, :] if among else np.ones((len(part["id"]), len(q["id"])), bool)
                    i, j = _alike_parities(part, q, percent, ok)
                    if len(i):
                        one, two = part["id"][i], q["id"][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, {}, []

        def settle() -> Iterator[pa.RecordBatch]:
            """The rows of role 0 are complete."""
            nonlocal held
            if waiting:
                held = _by_width({c: np.concatenate([f[c] for f in waiting]) for c in (*_ROW, "bits")})
                waiting.clear()
                yield from pairs(held, held, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            f = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_ROW, "key", "part", "role")}
            f["bits"] = np.array(batch.column("bits").to_pylist() + [None], object)[:-1]
            new = np.append(True, (f["key"][1:] != f["key"][:-1]) | (f["part"][1:] != f["part"][:-1]) | (f["role"][1:] != f["role"][:-1]))
            begin = np.flatnonzero(new)
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows]):
                key = (f["key"][a], f["part"][a])
                if key != now:
                    yield from settle()
                    now, held = key, {}
                rows = {c: f[c][a:b] for c in (*_ROW, "bits")}
                if f["role"][a] == 0:
                    waiting.append(rows)
                else:
                    yield from settle()
                    yield from pairs(_by_width(rows), held, False)
        yield from settle()

    return run


def dense_pairs(dense: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """dense(id, comp, shingles) -> (a, b): all pairs of different components that may be alike enough."""
    counts = np.zeros(BUCKETS, np.int64)
    # at most BUCKETS rows
    for r in dense.select("shingles").mapInArrow(W.tidied(_count_buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = r["n"]
    order = scratch.table("rare", dense.select("id", "comp", "shingles").mapInArrow(W.tidied(_rarest(counts, percent)), "id long, comp long, n long, few long, rare array<long>, bits binary"))
    rows = order.select("id", "comp", "few", F.posexplode("rare").alias("place", "key")).selectExpr("key", "id", "comp", "place", "place < few as short")
    # a key's largest component needn't be compared with itself: the others are dealt to all parts of the key, its own documents to one
    own = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.count_if("short").alias("few"))
    keys = own.groupBy("key").agg(F.sum("size").alias("size"), F.sum("few").alias("few"), F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("top"))
    keys = scratch.table("met", keys.where("comps > 1 and few > 0").select("key", F.col("top.comp").alias("top"), F.least(F.lit(SALTS), F.ceil(F.col("size") / CROWD)).cast("int").alias("parts")))
    near = rows.join(keys, "key").select("key", "id", "place", "short", "parts", F.when(F.col("comp") == F.col("top"), 1).otherwise(0).alias("role"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("at"))
    near = near.join(order.select("id", "comp", "n", "bits"), "id")
    dealt = near.withColumn("part", F.explode(F.when(F.col("role") == 1, F.array("at")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).withColumn("home", F.col("part") == F.col("at"))
    dealt = dealt.select("key", "part", "role", "id", "comp", "n", F.col("place").cast("long").alias("place"), "short", "home", "bits")
    met = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "role")
    return met.mapInArrow(W.tidied(_meet(percent)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row per row of docs.

    n_shingles is the number of distinct word shingles (with fewer words than
    shingle_words, the whole sequence is one; without words or with null text,
    0, and the document is linked with nothing). component_id is the smallest
    doc_id reachable over links with 100 * |intersection| >= percent * |union|;
    kept says whether that is the document's own id. Repeated rows of one
    doc_id get one answer each, from the same component; if their texts differ,
    that with the fewest shingles stands for all in links that aren't of equal
    sets. With a null doc_id, component_id is null and kept is true. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = scratch.table("sigs", texts.mapInArrow(W.tidied(_signatures(shingle_words)), _SIGS))
    usable = sigs.where("doc_id is not null and n_shingles > 0")
    classes = scratch.table("classes", usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first("sig").alias("sig")))
    reps = classes.select("id", F.col("n_shingles").alias("n"), F.col("id").alias("comp"), "sig")

    cand = scratch.table("cand", candidates(reps, percent, scratch, "near1", True).groupBy("a", "b", "edge").agg(F.max("est").alias("est")))
    pairs = cand.where("edge = 0")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(cand.where("edge > 1").select(F.col("a").alias("doc_id"))).distinct()
    ends = scratch.table("ends", ends)
    sets = keep_ids(texts, ends, "doc_id").mapInArrow(W.tidied(_sets(shingle_words)), "doc_id long, shingles array<long>")
    one = F.min_by("shingles", F.struct(F.size("shingles"), F.xxhash64("shingles")))
    sets = scratch.table("sets", sets.groupBy("doc_id").agg(one.alias("shingles")))

    links, comp, done = None, None, None

    def apart(x: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        if comp is None:
            return x
        for side in ("a", "b"):
            x = x.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        return x.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def confirmed(x: DataFrame, step: str) -> None:
        nonlocal links, comp
        found = confirm(scratch.table(f"pairs{step}", x), sets, percent)
        links = scratch.table(f"links{step}", found if links is None else links.unionByName(found))
        comp = scratch.table(f"comp{step}", connected_components(links, scratch, f"cc{step}"))

    open_pairs = pairs.select("a", "b", "est")
    for step in range(ROUNDS):
        open_pairs = scratch.table(f"open{step}", apart(open_pairs))
        ways = open_pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "est").unionByName(open_pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "est"))
        best = ways.groupBy("u").agg(F.max(F.struct("est", (-F.col("v")).alias("v"))).alias("m")).select("u", (-F.col("m.v")).alias("v"))
        tried = scratch.table(f"tried{step}", best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        open_pairs = open_pairs.join(tried, ["a", "b"], "left_anti")
        done = tried if done is None else done.unionByName(tried)
        confirmed(tried, str(step))

    opened = cand.where("edge = 2").select(F.col("a").alias("id")).distinct()
    dense = reps.drop("comp").join(opened, "id").join(comp.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    more = candidates(dense, percent, scratch, "near2", False).where("edge = 0").select("a", "b").join(done, ["a", "b"], "left_anti")
    confirmed(apart(open_pairs.select("a", "b")).unionByName(more).distinct(), "last")

    crowded = scratch.table("crowded", cand.where("edge = 3").select(F.col("a").alias("doc_id")).distinct())
    if crowded.head(1):
        named = comp.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
        full = sets.join(crowded, "doc_id").join(named, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("comp", "doc_id").alias("comp"), "shingles")
        confirmed(dense_pairs(full, percent, scratch), "dense")

    named = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").where("component is not null or last != id")
    named = scratch.table("named", named.select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component")))
    scratch.drop("sets", "cand", "near1", "near2", "ends", "classes", "crowded", "rare", "met", *(f"{x}{k}" for x in ("open", "tried", "links", "comp", "pairs") for k in (*range(ROUNDS), "last", "dense")))
    out = sigs.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
