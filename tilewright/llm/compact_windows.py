"""Near-duplicate passages across documents by compact windows.

For a hash of word shingles, all passages of at least min_words words fall
into compact windows (l, c, r): the passages inside l..r that hold c, where
their smallest hash is. The centres c are the positions that are smallest in
some passage of the least length, and the nearest smaller value on either side
of a centre is a centre again; so a Cartesian tree over the few centres gives
every window exactly, about 2 n / min_words for a text of n words.

1. For each of BANDS pairs of hashes, the windows of both hashes in a document
   are joined by interval: a cell is a run of passages of the least length that
   lie in one window of each, so that they share both smallest shingles, the
   cell's signature. A cell has the place of its centre and hashes of what lies
   beside that and of all that its passages hold.
2. Cells are range-partitioned by signature and document, so a passage that a
   third of all documents hold spans many tasks. Cells of a signature that two
   documents have are live: in one band, their passages go to step 3. In all
   bands, each cell joins the first document of its signature, and the first
   with equal words to the right and to the left of the centre (stars, never
   all pairs), unless both cells hold the same. Leaders of signatures that
   cross partitions are joined by a grouped minimum. Documents with equal words
   join once, by their first.
3. All passages of live cells are sorted by content and document; the first
   document of equal ones is their source. Equal passages have equal
   signatures, so none is missed, however many documents hold them. Those that
   cross partitions get their source from the partitions' ends, two of each.
4. Joined cells are compared: of the stretches around the two centres that
   begin and end with shared shingles, those of min_words words or more with a
   multiset Jaccard similarity of percent / 100 or more are taken. What a
   comparison sees holds all passages of the least length around the centre;
   each passage of a longer stretch is in a cell of its own.

5. Where a signature has three contents or more, some may be alike to each
   other and not to a leader. The first two documents of each content meet all
   others of the signature inside tasks, a crowd's in parts (meet_all): what is
   left out is only what earlier finds already cover, so each word gets the
   source that comparing all pairs would give it.

A passage at similarity J shares a band's signature with a chance of J * J, so
at 0.8 none of four bands joins it with a chance of about 0.02.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, keep_ids, keep_lists

BANDS = 3
SHINGLE = 5
#: Shingles beside a centre that a cell shares with the leaders of its sides.
CONTEXT = 11
#: Cells of one document pair and diagonal are compared once in so many shingles; what a comparison sees overlaps the next.
BLOCK = 32
_SEEDS = W.mix(np.arange(1, 2 * 16 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_G = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def centres(v: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending (and values made unique by position), that are smallest in some window of `width` values; valid says where such a window may begin."""
    bits = np.uint64(max(1, int(len(v)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    u = (v & ~low) | np.arange(len(v), dtype=np.uint64)
    m, w = u, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if w < width:
        m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
    at = (m[valid[: len(m)]] & low).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, u[at]


def _smaller_beside(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest smaller ones before it (or -1) and after it (or len(value)) in its group: the links of a Cartesian tree, by its right spine."""
    before, after = [-1] * len(value), [len(value)] * len(value)
    now, spine, own = None, [], []  # places and values, ascending
    for i, (v, g) in enumerate(zip(value.tolist(), group.tolist())):
        if g != now:
            now, spine, own = g, [], []
        while own and own[-1] > v:
            own.pop()
            after[spine.pop()] = i
        if own:
            before[i] = spine[-1]
        spine.append(i)
        own.append(v)
    return np.array(before, np.int64), np.array(after, np.int64)


def tree_extents(at: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centre the places up to which it stays smallest, by the Cartesian tree of each document's centres. first, last: the document's bounds."""
    before, after = _smaller_beside(value, first)
    return np.where(before < 0, first, at[before] + 1), np.where(after == len(at), last, at[np.minimum(after, len(at) - 1)] - 1)


class Spans:
    """Hashes of the content of any span of an array, from running sums."""

    def __init__(self, s: np.ndarray, which: int = 0):
        up, self.down = self._of(len(s) + 1, which)
        self.total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(s * up[: len(s)], out=self.total[1:])

    @staticmethod
    def _of(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd number and of its inverse."""
        if which not in _powers or len(_powers[which][0]) < n:
            g = int(_G[which])
            size = 1 << max(16, n.bit_length())
            _powers[which] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, np.uint64(x)))) for x in (g, pow(g, -1, 1 << 64)))
        return _powers[which]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def compact_windows(s: np.ndarray, k: int, inside: np.ndarray, valid: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of hash k, ascending. first, last: of each position the bounds of its document's shingles."""
    v = (s ^ _SEEDS[k]) * (_SEEDS[-1 - k] | np.uint64(1))
    v[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    c, value = centres(v, valid, width)
    return c, *tree_extents(c, value, first[c], last[c])


def cells(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of the windows of two hashes -> (start, n, c1, c2): the n passages of `width` shingles from each start on have these centres."""
    (b1, e1), (b2, e2) = ((np.maximum(l, c - width + 1), np.minimum(c, r - width + 1)) for c, l, r in (one, two))
    start = np.sort(np.concatenate([b1, b2]), kind="stable")
    start = start[np.append(True, start[1:] != start[:-1])] if len(start) else start
    i, j = np.searchsorted(b1, start, "right") - 1, np.searchsorted(b2, start, "right") - 1
    return start, np.minimum(e1[i], e2[j]) + 1 - start, one[0][i], two[0][j]


#: kind 0, cells: spot is the start (32 bits), the centre from there (12) and the number of passages (20); ctx are hashes of the words to the right (24 bits) and left (24) of the centre and of all that the passages hold (16). kind 1, documents: spot is the number of words, key and ctx are hashes of them.
_CELLS = "kind int, key long, doc long, spot long, ctx long"
_NAMES = ["kind", "key", "doc", "spot", "ctx"]
#: A cell is cut where its start passes a multiple of so many words.
_LONGEST = 1 << 19


def _cells(min_words: int, bands: int):
    width = min_words - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raws = W.encoded(batch.column(1).to_pylist())
            for a, b in W.chunks(raws):
                words, at = W.hash_words(raws[a:b])
                yield from emit(words, at, ids[a:b])

    def emit(words: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_words = np.diff(at)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], n_words).astype(np.uint64)
        some = n_words > 0
        texts = []
        for seed in _SEEDS[:2]:
            h = np.zeros(len(ids), np.uint64)
            if some.any():
                h[some] = np.add.reduceat(W.mix(words + place * seed), at[:-1][some])
            texts.append(W.mix(h + n_words.astype(np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), np.int32)), pa.array(texts[0]), pa.array(ids), pa.array(n_words), pa.array(texts[1])], names=_NAMES)
        long = n_words >= min_words
        if not long.any():
            return
        s = W.shingle_all(words, SHINGLE)
        valid, inside = np.zeros(len(s), bool), np.zeros(len(s), bool)
        first, last = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for x, y in zip(at[:-1][long].tolist(), at[1:][long].tolist()):
            valid[x : y - min_words + 1] = True
            inside[x : y - SHINGLE + 1] = True
            first[x:y], last[x:y] = x, y - SHINGLE
        doc_of = np.repeat(np.arange(len(ids)), n_words)
        spans = Spans(s)
        windows = [compact_windows(s, k, inside, valid, first, last, width) for k in range(2 * bands)]
        for k in range(bands):
            start, n, c1, c2 = cells(windows[2 * k], windows[2 * k + 1], width)
            key = W.mix(W.mix(s[c1] + np.uint64(k)) * np.uint64(31) + s[c2]) & ~np.uint64(7) | np.uint64(k)
            # a cell goes on where a shingle is repeated
            own = first[start]
            part = own + (start - own) // _LONGEST
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            n = (start + n)[np.append(new[1:], len(start)) - 1] - start[new]
            start, c, key = start[new], c1[new], key[new]
            full = spans.of(start, start + n + width - 1)

            def side(sign: int) -> np.ndarray:
                ok = (c + CONTEXT <= last[c]) if sign > 0 else (c - CONTEXT >= first[c])
                p = c[ok]
                h = np.zeros(len(c), np.uint64)
                h[ok] = spans.of(p, p + CONTEXT + 1) if sign > 0 else spans.of(p - CONTEXT, p + 1)
                return (h >> np.uint64(40)) | ok.astype(np.uint64)

            ctx = side(1) << np.uint64(40) | side(-1) << np.uint64(16) | full >> np.uint64(48)
            spot = start - first[start] << 32 | c - start << 20 | n
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(c), np.int32)), pa.array(key.view(np.int64)), pa.array(ids[doc_of[start]]), pa.array(spot), pa.array(ctx.view(np.int64))], names=_NAMES)

    return run


_JOINED = "a long, pa long, b long, pb long, key long, side int, ctx long"
#: side of a joined row: a pair (key is 1 where meet_all compares it too); a live cell (document, start, passages); from _LEADER on, the first cell of a signature, or of its words to the right or left.
_PAIR, _LIVE, _LEADER = 0, 1, 2
#: side of the cells of a signature, the first two of each content (in ctx) that are of different documents.
_CONTENT = -1


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells sorted by key and document -> pairs, live cells of the first band, and leaders of the first and last key."""
    current, known, first_key, done_first = None, ({}, {}, {}), None, False
    contents: dict[int, list[tuple[int, int]]] = {}  # of the present key
    waiting: list[tuple] = []  # pairs of the cells in contents
    held = None  # the last row of the batch before

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["a", "pa", "b", "pb", "key", "side", "ctx"])

    def leaders() -> list[tuple]:
        return [(doc, p, doc, p, current, _LEADER + k, ctx) for k, own in enumerate(known) for ctx, (doc, p, _) in own.items()]

    def live(key: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
        m, none = len(key), np.zeros(len(key), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(spot >> 32), pa.array(spot & 0xFFFFF), pa.array(none), pa.array(key), pa.array(np.full(m, _LIVE, np.int32)), pa.array(none)], names=["a", "pa", "b", "pb", "key", "side", "ctx"])

    def close(out: list[tuple], edge: bool) -> None:
        """The present key is complete here. With two contents, the leader and its copies have met the others; with more, all that are kept meet in meet_all, and their pairs say so in key."""
        out += [(*pair, int(len(contents) > 2), _PAIR, 0) for *pair, _, _, _ in waiting]
        waiting.clear()
        if len(contents) > 2 or edge:
            out += [(d, p, d, p, current, _CONTENT, ctx) for ctx, own in contents.items() for d, p in own]

    def step(out: list[tuple], rows: list[np.ndarray]) -> None:
        nonlocal current, known, done_first, contents
        for k, d, spot, ctx in zip(*(x.tolist() for x in rows)):
            if k != current:
                close(out, current == first_key)
                if current == first_key and not done_first:
                    out += leaders()
                    done_first = True
                current, known, contents = k, ({}, {}, {}), {}
            p = (spot >> 32) + (spot >> 20 & 0xFFF)
            own = contents.setdefault(ctx, [])
            kept = not own or len(own) == 1 and own[0][0] != d
            _meet(waiting if kept else out, known, d, p, ctx)
            if kept:
                own.append((d, p))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("key", "doc", "spot", "ctx")]
        if held is not None:
            cols = [np.append(h, x) for h, x in zip(held, cols)]
        held = [x[-1:] for x in cols]
        key, doc = cols[:2]
        # the held row is seen again with the next batch, so that a key cut by a batch is whole
        m = len(key) - 1
        if first_key is None:
            first_key = int(key[0])
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(begin[1:], len(key))
        several = doc[begin] != doc[end - 1]  # documents of a key ascend
        several[-1] = True  # may go on in the next batch or partition
        several[0] |= current == int(key[0]) or first_key == int(key[0])
        at = np.flatnonzero(np.repeat(several, end - begin)[:m])
        out: list[tuple] = []
        step(out, [x[at] for x in cols])
        if out:
            yield table(out)
        at = at[key[at] & 7 == 0]
        if len(at):
            yield live(key[at], doc[at], cols[2][at])
    if held is not None:
        out = []
        step(out, held)
        close(out, True)
        if not done_first or current != first_key:
            out += leaders()
        yield table(out)
        if int(held[0][0]) & 7 == 0:
            yield live(*held[:3])


def _meet(out: list[tuple], known: tuple[dict, ...], d: int, p: int, ctx: int) -> None:
    """One cell meets the leaders of its key, or becomes one."""
    met, full = [], ctx & 0xFFFF
    for own, c in zip(known, (1, ctx >> 40 & 0xFFFFFF, ctx >> 16 & 0xFFFFFF)):
        leader = own.setdefault(c, (d, p, full)) if c else None
        if leader and leader[0] != d and leader[2] != full and leader not in met:
            out.append((leader[0], leader[1], d, p, 0, _PAIR, 0))
            met.append(leader)


_SEEN = "doc long, place long, h1 long, h2 long, begin long, around binary, what int, key long, lo long, hi long"
#: what a place is looked at for: its passages (n of them); a cell of a signature (key, lo, hi); either end of a pair, by the leader's (document, place) in key and lo.
_PASSAGES, _CELL, _END, _LEADS = 0, 1, 2, 3


def _look(width: int):
    """(doc_id, text, places), equal documents beside each other -> of live places the content hashes of the n passages that begin there; of others the shingles around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                if doc == done:
                    continue
                done = doc
                words, _ = W.hash_words(W.encoded([batch.column(1)[i].as_py()]))
                s = W.shingle(words, SHINGLE)
                own = batch.column(2)[i].values
                place, n, what, *keys = (own.field(k).to_numpy() for k in range(6))
                live = what == _PASSAGES
                starts = np.concatenate([np.empty(0, np.int64), *(np.arange(p, p + k) for p, k in zip(place[live].tolist(), n[live].tolist()))])
                if len(starts):
                    h = [pa.array(Spans(s, k).of(starts, starts + width).view(np.int64)) for k in (0, 1)]
                    m, none = len(starts), pa.nulls(len(starts), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, doc)), pa.array(starts), *h, none, pa.nulls(m, pa.binary()), pa.array(np.full(m, _PASSAGES, np.int32)), none, none, none], names=_SEEN_NAMES)
                at = np.flatnonzero(~live)
                if len(at):
                    # what lies around near places is much the same, and packs well beside each other
                    at = at[np.argsort(place[at], kind="stable")]
                    low = s.astype(np.uint32)
                    begin = np.maximum(0, place[at] - 2 * width)
                    around = [low[b : p + 2 * width + 1].tobytes() for b, p in zip(begin.tolist(), place[at].tolist())]
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(place[at]), none, none, pa.array(begin), pa.array(around, pa.binary()), pa.array(what[at]), *(pa.array(k[at]) for k in keys)], names=_SEEN_NAMES)

    return run


_SEEN_NAMES = ["doc", "place", "h1", "h2", "begin", "around", "what", "key", "lo", "hi"]
_HELD = "kind int, doc long, place long, source long, h1 long, h2 long"
#: kind of a row: a passage with its source; one whose content goes on in another partition; the first and last document (doc, source) of such a content.
_HOLDER, _OPEN, _ENDS = 0, 1, 2


def _first_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, place), sorted -> passages that several documents hold, each with the first of these."""
    now, first, last, several, opening = None, 0, 0, False, True
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(kind: int, doc, place, source, content) -> pa.RecordBatch:
        m = len(doc)
        h = [np.broadcast_to(np.asarray(x, np.int64), m) for x in content]
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *(pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(x, np.int64), m))) for x in (doc, place, source, *h))], names=["kind", "doc", "place", "source", "h1", "h2"])

    def go_on(doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More rows of the present content."""
        nonlocal several, last
        last = int(doc[-1])
        if opening:
            yield rows(_OPEN, doc, place, 0, now)
            return
        if not several and last == first:
            pending.append((doc, place))
            return
        several = True
        while pending:
            yield rows(_HOLDER, *pending.pop(), first, now)
        yield rows(_HOLDER, doc, place, first, now)

    def close(end: bool) -> Iterator[pa.RecordBatch]:
        if opening or end:
            yield rows(_ENDS, [first], [0], [last], now)
            for doc, place in pending:
                yield rows(_OPEN, doc, place, 0, now)
        pending.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, place = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "place"))
        begin = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        end = np.append(begin[1:], len(h1))
        k = 0
        if now is None or now == (h1[0], h2[0]):
            if now is None:
                now, first = (h1[0], h2[0]), int(doc[0])
            yield from go_on(doc[: end[0]], place[: end[0]])
            k = 1
        if k == len(begin):
            continue
        yield from close(False)
        opening = False
        # whole contents of this batch
        b, e = begin[k:-1], end[k:-1]
        many = doc[b] != doc[e - 1]
        n = (e - b)[many]
        at = np.flatnonzero(np.repeat(many, e - b)) + (b[0] if len(b) else 0)
        if len(at):
            yield rows(_HOLDER, doc[at], place[at], np.repeat(doc[b[many]], n), (0, 0))
        x = int(begin[-1])
        now, first, several = (h1[x], h2[x]), int(doc[x]), False
        yield from go_on(doc[x:], place[x:])
    if now is not None:
        yield from close(True)


def _crossing(held: DataFrame) -> dict[tuple[int, int], int]:
    """The first document of each content that is in several partitions or ends one: no more than two for each partition."""
    ends: dict[tuple[int, int], list[int]] = {}
    for r in held.where(f"kind = {_ENDS}").select("h1", "h2", "doc", "source").toLocalIterator():
        ends.setdefault((r["h1"], r["h2"]), []).extend((r["doc"], r["source"]))
    return {h: min(docs) for h, docs in ends.items() if min(docs) != max(docs)}


def _resolved(first: dict[tuple[int, int], int], min_words: int):
    """Holders -> spans; open ones get their source, or go if no other document has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, doc, place, source, h1, h2 = (batch.column(c).to_numpy() for c in ("kind", "doc", "place", "source", "h1", "h2"))
            source, keep = source.copy(), kind == _HOLDER
            opened = np.flatnonzero(kind == _OPEN)
            found = [first.get(h) for h in zip(h1[opened].tolist(), h2[opened].tolist())]
            known = np.array([x is not None for x in found], bool)
            source[opened[known]] = [x for x in found if x is not None]
            keep[opened[known]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, place, place + min_words, source)], names=["doc_id", "start", "stop", "source"])

    return run


def _runs(values: list[int], other: set[int]) -> list[tuple[int, int]]:
    """(first, last) of the maximal runs of values that are in other."""
    out, at = [], None
    for i, v in enumerate(values):
        if v in other:
            if at is None:
                at = i
        elif at is not None:
            out.append((at, i - 1))
            at = None
    if at is not None:
        out.append((at, len(values) - 1))
    return out


def alike(x: np.ndarray, cx: int, y: np.ndarray, cy: int, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """The longest stretches, as (first, last, first, last), around x[cx] and y[cy] that are long and alike enough.

    A stretch begins and ends with runs of shared shingles, as many on each
    side of the centre in x as in y: cutting a run short could only make it
    less alike.
    """
    if len(x) == len(y) and cx == cy and len(x) >= width and (x == y).all():
        return [(0, len(x) - 1, 0, len(y) - 1)]
    xs, ys = x.tolist(), y.tolist()
    rx, ry = _runs(xs, set(ys)), _runs(ys, set(xs))
    ax, ay = (next(k for k, (a, b) in enumerate(r) if a <= c <= b) for r, c in ((rx, cx), (ry, cy)))
    sx, sy = ([0, *accumulate(b - a + 1 for a, b in r)] for r in (rx, ry))
    tries = []
    for lo in range(min(ax, ay) + 1):
        for hi in range(min(len(rx) - ax, len(ry) - ay)):
            a, b, c, d = rx[ax - lo][0], rx[ax + hi][1], ry[ay - lo][0], ry[ay + hi][1]
            # as if all shingles of the runs were common
            if min(b - a, d - c) + 1 >= width and (100 + percent) * min(sx[ax + hi + 1] - sx[ax - lo], sy[ay + hi + 1] - sy[ay - lo]) >= percent * (b - a + d - c + 2):
                tries.append((a - b + c - d, a, b, c, d))
    found: list[tuple[int, int, int, int]] = []
    for _, a, b, c, d in sorted(tries):
        if any(p <= a and b <= q and u <= c and d <= v for p, q, u, v in found):
            continue
        p, q = xs[a : b + 1], ys[c : d + 1]
        u, v = set(p), set(q)
        common = len(u & v) if len(u) == len(p) or len(v) == len(q) else sum((Counter(p) & Counter(q)).values())
        if 100 * common >= percent * (len(p) + len(q) - common):
            found.append((a, b, c, d))
    return found


def _tries(back: np.ndarray, cx: np.ndarray, has: np.ndarray, cy: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, ...]:
    """Of many pairs what alike tries, from the places of x that y has (back) and those of y that x has -> first and last places of runs in x and y by their distance from the centre's, and which of (first, last) are tried."""
    # between runs there are shingles that aren't shared, as many runs on either side
    runs = max(back.shape[1], has.shape[1]) * (100 - percent) // (100 + percent) + 1
    xs, ys = _around_centre(back, cx, runs), _around_centre(has, cy, runs)
    k = min(xs[0].shape[1], ys[0].shape[1])
    (xa, xn, xb, xm), (ya, yn, yb, ym) = ([x[:, :k] for x in s] for s in (xs, ys))
    long = [b[:, None, :] - a[:, :, None] + 1 for a, b in ((xa, xb), (ya, yb))]
    common = np.minimum(xm[:, None, :] - xn[:, :, None], ym[:, None, :] - yn[:, :, None])
    tries = ((xa >= 0) & (ya >= 0))[:, :, None] & ((xb >= 0) & (yb >= 0))[:, None, :]
    tries &= (np.minimum(*long) >= width) & ((100 + percent) * common >= percent * (long[0] + long[1]))
    return xa, xb, ya, yb, tries


def _taken(at: np.ndarray, xa: np.ndarray, xb: np.ndarray, ya: np.ndarray, yb: np.ndarray, tries: np.ndarray, percent: int) -> list[list[tuple[int, int, int, int]]]:
    """What alike finds in many pairs that repeat no shared shingle. at: of each place of y that of its shingle in x; the rest is of _tries."""
    m, k = xa.shape
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(m)]
    rows = np.flatnonzero(tries.any(axis=(1, 2)))
    left = np.where(tries[rows], (xb + yb)[rows, None, :] - (xa + ya)[rows, :, None] + 2, 0)
    place = np.arange(at.shape[1])
    while len(rows):
        # the longest; of equal ones that which begins first
        pick = left[:, ::-1].reshape(len(rows), -1).argmax(axis=1)
        lo, hi = k - 1 - pick // k, pick % k
        a, b, c, d = own = xa[rows, lo], xb[rows, hi], ya[rows, lo], yb[rows, hi]
        x = at[rows]
        common = np.count_nonzero((x >= a[:, None]) & (x <= b[:, None]) & (place >= c[:, None]) & (place <= d[:, None]), axis=1)
        good = 100 * common >= percent * (b - a + d - c + 2 - common)
        for r, *found in zip(rows[good].tolist(), *(z[good].tolist() for z in own)):
            out[r].append(tuple(found))
        begins, ends = (xa[rows] >= a[:, None]) & (ya[rows] >= c[:, None]), (xb[rows] <= b[:, None]) & (yb[rows] <= d[:, None])
        left[(begins & good[:, None])[:, :, None] & ends[:, None, :]] = 0
        left[np.arange(len(rows)), lo, hi] = 0
        more = left.any(axis=(1, 2))
        rows, left = rows[more], left[more]
    return out


#: Shingles of pairs that are compared at once.
_AT_ONCE = 1 << 17


def alike_all(xs: list[np.ndarray], cx: list[int], ys: list[np.ndarray], cy: list[int], width: int, percent: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """alike of each pair, of many at once; pairs that repeat a shared shingle by alike itself."""
    step = max(1, _AT_ONCE // max(1, max(map(len, xs), default=0) + max(map(len, ys), default=0)))
    for n in range(0, len(xs), step):
        x, y, p, q = xs[n : n + step], ys[n : n + step], np.array(cx[n : n + step]), np.array(cy[n : n + step])
        found = dict(zip(*_alike_some(x, p, y, q, width, percent)))
        for k in range(len(x)):
            yield found[k] if k in found else alike(x[k], int(p[k]), y[k], int(q[k]), width, percent)


def _alike_some(x: list[np.ndarray], cx: np.ndarray, y: list[np.ndarray], cy: np.ndarray, width: int, percent: int) -> tuple[list[int], list[list[tuple[int, int, int, int]]]]:
    """alike of the pairs that repeat no shared shingle -> (their numbers, what is found)."""
    mx, my = max(map(len, x)), max(map(len, y))
    # each row sorted: shingle (33 bits: what fills up is in neither), side, place (16)
    v = np.empty((len(x), mx + my), np.uint64)
    for side, part, own in ((0, v[:, :mx], x), (1, v[:, mx:], y)):
        part[:] = (1 << 32) + side
        part[np.arange(part.shape[1]) < np.array([len(z) for z in own])[:, None]] = np.concatenate(own)
        part <<= np.uint64(17)
        part |= np.arange(part.shape[1], dtype=np.uint64) | np.uint64(side << 16)
    v.sort(axis=1)
    same = v[:, 1:] >> np.uint64(17) == v[:, :-1] >> np.uint64(17)
    turn = same & ((v[:, 1:] ^ v[:, :-1]) & np.uint64(1 << 16) > 0)
    repeats = (turn[:, 1:] & same[:, :-1]).any(axis=1) | (turn[:, :-1] & same[:, 1:]).any(axis=1)
    turn[repeats] = False
    row, k = np.nonzero(turn)
    at, back = np.full((len(x), my), mx, np.int32), np.zeros((len(x), mx), bool)
    of_x, of_y = ((v[row, k + s] & np.uint64(0xFFFF)).astype(np.int64) for s in (0, 1))
    at[row, of_y] = of_x
    back[row, of_x] = True
    clear = np.flatnonzero(~repeats)
    if not len(clear):
        return [], []
    at = at[clear]
    return clear.tolist(), _taken(at, *_tries(back[clear], cx[clear], at < mx, cy[clear], width, percent), percent)


#: Cells of a signature are compared with each other in tasks of about twice so many.
CROWD = 2048
_SIDES = "doc_id long, start long, stop long, source long"


def _around_centre(has: np.ndarray, centre: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each row the runs of shared shingles by their distance from the centre's, up to `most` of them -> first places and shared shingles before these; last places and shared shingles up to these. first and last are -1 where there is none."""
    m, n = has.shape
    sums = np.zeros((m, n + 1), np.int32)
    np.cumsum(has, axis=1, out=sums[:, 1:])
    edge = np.zeros((m, n + 1), np.int8)
    edge[:, :n] = has
    edge[:, 1:] -= has
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    count = np.bincount(row, minlength=m)
    own = np.bincount(row, first <= centre[row], minlength=m).astype(np.int64) - 1
    apart = np.arange(len(row)) - (np.cumsum(count) - count)[row] - own[row]
    k = min(most, int(np.abs(apart).max()) + 1)
    out = [np.full((m, k), -1, np.int32) for _ in range(4)]
    for sign, place, shift, to in ((-1, first, 0, out[:2]), (1, last, 1, out[2:])):
        at = np.flatnonzero((sign * apart >= 0) & (sign * apart < k))
        r, p = row[at], place[at]
        to[0][r, sign * apart[at]] = p
        to[1][r, sign * apart[at]] = sums[r, p + shift]
    return tuple(out)


def meet_all(doc: list[int], around: list[np.ndarray], centre: list[int], width: int, percent: int, group: list[int] | None = None) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
    """Cells of a signature, by document -> (i, j, stretch), i before j: what comparing all pairs finds, without what adds nothing.

    group: of many signatures at once, the one of each cell, ascending.
    A pair adds nothing if each stretch that alike would try and that has enough
    shared shingles lies in stretches found before: in j with documents up to
    that of i, in i with any, whose words then have a source no later than i.
    So pairs are taken by their first cell. A stretch that goes beyond those
    begins or ends there with a shared shingle: a cell without any that another
    cell has is compared only with cells that have some.
    """
    m, most = len(doc), max(map(len, around))
    size = np.array([len(x) for x in around])
    groups = np.array(group) if group else np.zeros(m, np.int64)
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    ends = np.append(starts[1:], m)
    # a shingle has one number in each group
    _, flat = np.unique(np.repeat(groups, size) << 32 | np.concatenate(around).astype(np.int64), return_inverse=True)
    none = int(flat.max()) + 1
    ids = np.full((m, most), none, np.int32)
    ids[np.arange(most) < size[:, None]] = flat
    cells = np.zeros(none + 1, np.int32)
    for j in range(m):
        cells[ids[j]] += 1
    cells[none] = 0
    outside = cells[ids] > 1  # shared by some, and not in a stretch found so far
    docs, c = np.array(doc), np.array(centre)
    ca, cb = c + 1, c - 1  # found so far: nothing
    place = np.full(none + 1, most, np.int32)
    least = -(-percent * width // 100)
    # cells that repeat a shingle that others have
    numbers = np.sort(ids, axis=1)
    repeats = ((numbers[:, 1:] == numbers[:, :-1]) & (cells[numbers[:, 1:]] > 1)).any(axis=1)

    # of all groups the first cells, then the second ones
    for step in range(int((ends - starts).max()) - 1):
        if step & (step - 1) == 0:
            active = outside.any(axis=1)
            if not active.any():
                return
        some = starts + step < ends - 1
        heads, n = starts[some] + step, (ends - starts)[some] - step - 1
        head = np.repeat(np.arange(len(heads)), n)
        rows = np.arange(len(head)) - (np.cumsum(n) - n)[head] + heads[head] + 1
        keep = (docs[rows] != docs[heads][head]) & (outside[heads].any(axis=1)[head] | active[rows])
        head, rows = head[keep], rows[keep]
        if not len(rows):
            continue
        own = ids[heads]
        place[own[:, ::-1]] = np.arange(most - 1, -1, -1)  # the first of equal ones
        place[none] = most
        first, at = place[own], place[ids[rows]]
        place[own] = most
        has = at < most
        keep = np.flatnonzero(np.count_nonzero(has, axis=1) >= least)
        head, rows, at, has = head[keep], rows[keep], at[keep], has[keep]
        back = np.zeros((len(rows), most + 1), bool)
        back[np.arange(len(rows))[:, None], at] = True
        back[:, most] = False
        back = np.take_along_axis(back, first[head], axis=1)
        keep = np.flatnonzero((has & outside[rows]).any(axis=1) | (back & outside[heads[head]]).any(axis=1))
        if not len(keep):
            continue
        head, rows, at, has, back = head[keep], rows[keep], at[keep], has[keep], back[keep]
        i_s = heads[head]
        xa, xb, ya, yb, tries = _tries(back, c[i_s], has, c[rows], width, percent)
        low, high = ya < ca[rows, None], yb > cb[rows, None]

        def beyond(a: int, b: int) -> np.ndarray:
            """Of rows a to b those with a try that goes beyond what is found."""
            more = tries[a:b] & ((low[a:b] | (xa[a:b] < ca[i_s[a:b], None]))[:, :, None] | (high[a:b] | (xb[a:b] > cb[i_s[a:b], None]))[:, None, :])
            return a + np.flatnonzero(more.any(axis=(1, 2)))

        every = beyond(0, len(rows))
        clear = every[~(repeats[i_s[every]] | repeats[rows[every]])]
        taken = dict(zip(clear.tolist(), _taken(at[clear], xa[clear], xb[clear], ya[clear], yb[clear], tries[clear], percent)))
        cuts = np.flatnonzero(np.append(True, head[every][1:] != head[every][:-1])) if len(every) else []
        for need in np.split(every, cuts[1:]) if len(every) else []:
            i, n = int(i_s[need[0]]), 0
            end = int(np.searchsorted(head, head[need[0]], "right"))
            while n < len(need):
                k = int(need[n])
                j, n, changed = int(rows[k]), n + 1, False
                for found in taken[k] if k in taken else alike(around[i], centre[i], around[j], centre[j], width, percent):
                    yield i, j, found
                    for x, a, b in ((i, *found[:2]), (j, *found[2:])):
                        if a < ca[x] or b > cb[x]:
                            ca[x], cb[x] = min(ca[x], a), max(cb[x], b)
                            outside[x, ca[x] : cb[x] + 1] = False
                            changed |= x == i
                if changed and n < len(need):
                    need, n = beyond(k + 1, end), 0


def _sides(found: list[tuple[int, ...]]) -> pa.RecordBatch:
    """(a, a0, a1, b, b0, b1) -> rows (doc_id, start, stop, source) in which each word has the first of the sources that these give it."""
    spans: dict[int, set[tuple[int, int, int]]] = {}
    for a, a0, a1, b, b0, b1 in found:
        spans.setdefault(a, set()).add((a0, a1, a))
        spans.setdefault(b, set()).add((b0, b1, a))
    rows = [(d, *s) for d, own in spans.items() for s in smallest_sources(list(own))]
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "start", "stop", "source"])


def _compare_all(width: int, percent: int):
    """(key, lo, hi, doc, place, begin, around), sorted -> of each key, lo and hi the sides of what meet_all finds: rows grow with its cells, not with its pairs."""

    def sides(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group, doc, place, begin, around = zip(*rows)
        found = meet_all(list(doc), [np.frombuffer(x, np.uint32) for x in around], [p - b for p, b in zip(place, begin)], width, percent, list(group))
        found = [(doc[i], begin[i] + f[0], begin[i] + f[1] + SHINGLE, doc[j], begin[j] + f[2], begin[j] + f[3] + SHINGLE) for i, j, f in found]
        if found:
            yield _sides(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, start, rows = None, 0, 0, []  # start: where the present group begins

        def close() -> None:
            if len(rows) > start and rows[start][1] == rows[-1][1]:
                del rows[start:]  # of one document

        for batch in batches:
            for *key, doc, place, begin, around in zip(*(batch.column(x).to_pylist() for x in ("key", "lo", "hi", "doc", "place", "begin", "around"))):
                if key != now:
                    close()
                    if len(rows) >= CROWD:
                        yield from sides(rows)
                        rows.clear()
                    now, group, start = key, group + 1, len(rows)
                if len(rows) == start or rows[-1][1:3] != (doc, place):
                    rows.append((group, doc, place, begin, around))
        close()
        if rows:
            yield from sides(rows)

    return run


def _dealt(cells: DataFrame) -> DataFrame:
    """(key, doc, place) -> (key, lo, hi, doc, place): any two cells of a key meet under some lo and hi; cells of a key with few are under one."""
    size = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    at = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc", "place"), F.col("parts")).cast("int")).otherwise(0)
    other = F.explode(F.when(F.col("parts") > 1, F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("at"))).otherwise(F.array(F.lit(0))))
    met = cells.join(size, "key").withColumn("at", at).withColumn("other", other)
    return met.select("key", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "doc", "place")


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, pa_, ba, xa, b, pb, bb, xb = (batch.column(c).to_pylist() for c in ("a", "pa", "ba", "xa", "b", "pb", "bb", "xb"))
            xs, ys = ([np.frombuffer(v, np.uint32) for v in x] for x in (xa, xb))
            every = alike_all(xs, [p - q for p, q in zip(pa_, ba)], ys, [p - q for p, q in zip(pb, bb)], width, percent)
            yield _sides([(a[k], ba[k] + f[0], ba[k] + f[1] + SHINGLE, b[k], bb[k] + f[2], bb[k] + f[3] + SHINGLE) for k, found in enumerate(every) for f in found])

    return run


def smallest_sources(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, stop, source) of one document -> disjoint ones, in order, in which each word has the smallest source of those that cover it."""
    spans = sorted(spans)
    edges = sorted({x for s in spans for x in s[:2]})
    out: list[tuple[int, int, int]] = []
    over: list[tuple[int, int]] = []
    i = 0
    for x, y in zip(edges, edges[1:]):
        while i < len(spans) and spans[i][0] <= x:
            heapq.heappush(over, (spans[i][2], spans[i][1]))
            i += 1
        while over and over[0][1] <= x:
            heapq.heappop(over)
        if not over:
            continue
        source = over[0][0]
        if out and out[-1][1] == x and out[-1][2] == source:
            out[-1] = out[-1][0], y, source
        else:
            out.append((x, y, source))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spans) -> rows of smallest_sources."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            own = batch.column(1)[i].values
            start, stop, source = (own.field(k).to_numpy() for k in range(3))
            at = np.lexsort((stop, start, source))
            start, stop, source = start[at], stop[at], source[at]
            # spans of one source that touch are one
            apart = np.append(True, source[1:] != source[:-1])
            group = np.cumsum(apart) - 1
            wide = int(stop.max()) + 1
            reach = np.maximum.accumulate(stop + group * wide) - group * wide
            apart[1:] |= start[1:] > reach[:-1]
            first = np.flatnonzero(apart)
            last = np.append(first[1:], len(start)) - 1
            d = batch.column(0)[i].as_py()
            rows += [(d, *r) for r in smallest_sources(list(zip(start[first].tolist(), reach[last].tolist(), source[first].tolist())))]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "stop", "source"])


def repeated_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start_word, n_words, source_id): each maximal stretch of a document with one source that is near copies of passages in other documents.

    Words are as in words.py, counted from 0. source_id is the first document
    (smallest doc_id) among those that a word's passages were joined with,
    itself included: the one where a deduplication keeps the word. Passages
    that overlap or touch are split where the source changes, so a stretch
    may be shorter than min_words. Equal passages are all found, each with the
    smallest document that has it; of edited ones, those that share a
    signature (see above) with one that they are alike to. Of documents
    with the same words, the first has the stretches that it shares with
    others, and all have their whole text, if it has min_words words. Null or
    shorter texts and rows with null doc_id give nothing; equal rows of one
    doc_id count as one document; a doc_id with different texts names no
    document and gives nothing. An empty table gives no rows. Other columns
    are ignored.
    """
    if not SHINGLE < min_words <= 4000:
        raise ValueError(f"min_words must be more than {SHINGLE} and at most 4000")
    spark, width = docs.sparkSession, min_words - SHINGLE + 1
    scratch = Scratch(spark, "passages")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = scratch.table("cells", texts.mapInArrow(W.tidied(_cells(min_words, bands)), _CELLS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    whole = found.where("kind = 1").select("key", "ctx", "doc", F.col("spot").alias("words"))
    unclear = whole.groupBy("doc").agg(F.min(F.struct("key", "ctx")).alias("x"), F.max(F.struct("key", "ctx")).alias("y")).where("x != y").select("doc")
    unclear = scratch.table("unclear", unclear)
    whole = keep_ids(whole.where(F.col("words") >= min_words).distinct(), unclear, "doc", "left_anti")
    copies = scratch.table("copies", whole.groupBy("key", "ctx").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last"))
    whole = scratch.table("whole", whole.join(copies, ["key", "ctx"]).selectExpr("doc as doc_id", "0L as start", "words as stop", "first as source"))
    passed = whole.where("doc_id != source").select(F.col("doc_id").alias("doc")).unionByName(unclear)

    ranged = keep_ids(found.where("kind = 0").select("key", "doc", "spot", "ctx"), passed, "doc", "left_anti")
    ranged = ranged.repartitionByRange(parts, "key", "doc").sortWithinPartitions("key", "doc", "spot")
    joined = scratch.table("joined", ranged.mapInArrow(W.tidied(_join_cells), _JOINED))
    scratch.drop("cells")
    edge = joined.where(f"side >= {_LEADER}")
    leader = edge.groupBy("key", "side", "ctx").agg(F.min(F.struct("a", "pa")).alias("m"))
    across = edge.join(leader, ["key", "side", "ctx"]).where("m.a != a").selectExpr("m.a as a", "m.pa as pa", "a as b", "pa as pb")
    every = joined.where(f"side = {_PAIR} and key = 0").select("a", "pa", "b", "pb").unionByName(across)
    pairs = every.groupBy("a", "b", F.expr("pa - pb").alias("diagonal"), F.expr(f"pa div {BLOCK}").alias("block")).agg(F.min("pa").alias("pa")).selectExpr("a", "pa", "b", "pa - diagonal as pb")
    pairs = scratch.table("pairs", pairs)

    # the cells of a key that spans partitions come from each
    contents = scratch.table("contents", joined.where(f"side = {_CONTENT}").selectExpr("key", "a as doc", "pa as place").distinct())
    contents = scratch.table("dealt", _dealt(contents))

    looks = [
        joined.where(f"side = {_LIVE}").selectExpr("a as doc_id", "pa as place", "b as n", f"{_PASSAGES} as what", "0L as key", "0L as lo", "0L as hi"),
        contents.selectExpr("doc as doc_id", "place", "0L as n", f"{_CELL} as what", "key", "cast(lo as long) as lo", "cast(hi as long) as hi"),
        pairs.selectExpr("b as doc_id", "pb as place", "0L as n", f"{_END} as what", "a as key", "pa as lo", "0L as hi"),
        pairs.select("a", "pa").distinct().selectExpr("a as doc_id", "pa as place", "0L as n", f"{_LEADS} as what", "a as key", "pa as lo", "0L as hi"),
    ]
    places = looks[0].unionByName(looks[1]).unionByName(looks[2]).unionByName(looks[3])
    places = scratch.table("places", places.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "what", "key", "lo", "hi")).alias("places")))
    # texts are dealt out by id at every size: lists of places grow with them
    near = texts.hint("merge").join(places, "doc_id").select("doc_id", "text", "places")
    seen = scratch.table("seen", near.mapInArrow(W.tidied(_look(width)), _SEEN))

    equal = seen.where(f"what = {_PASSAGES}").select("h1", "h2", "doc", "place").repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "place")
    held = scratch.table("held", equal.mapInArrow(W.tidied(_first_holders), _HELD))
    spans = held.where(f"kind != {_ENDS}").mapInArrow(_resolved(_crossing(held), min_words), "doc_id long, start long, stop long, source long")

    leads = seen.where(f"what = {_LEADS}").selectExpr("key as a", "lo as pa", "begin as ba", "around as xa")
    both = seen.where(f"what = {_END}").selectExpr("key as a", "lo as pa", "doc as b", "place as pb", "begin as bb", "around as xb").join(leads, ["a", "pa"])
    rest = seen.where(f"what = {_CELL}").select("key", "lo", "hi", "doc", "place", "begin", "around").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc", "place")
    sides = both.mapInArrow(W.tidied(_compare(width, percent)), _SIDES).unionByName(rest.mapInArrow(W.tidied(_compare_all(width, percent)), _SIDES))
    sides = scratch.table("near", sides.groupBy("doc_id", "start", "stop").agg(F.min("source").alias("source")))

    own = spans.unionByName(sides).unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "source")).alias("spans"))
    out = scratch.table("out", own.mapInArrow(W.tidied(_split), "doc_id long, start long, stop long, source long"))
    scratch.drop("joined", "contents", "dealt", "pairs", "places", "seen", "held", "near", "copies", "unclear", "whole")
    return out.selectExpr("doc_id", "start as start_word", "stop - start as n_words", "source as source_id")


def _without(columns: list[str]):
    """(columns..., cuts) -> the columns, texts without the words of their cuts; rows of which no word is left go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, n_chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
        for batch in batches:
            texts, cuts = batch.column(text).to_pylist(), batch.column(len(columns)).to_pylist()
            new: list[str | None] = []
            for t, cut in zip(texts, cuts):
                raw = t.encode("utf-8", "replace")
                begin, _ = W.spans(raw)
                begin = [*begin.tolist(), len(raw)]
                out, at, left = [], 0, len(begin) - 1
                for c in sorted(cut, key=lambda c: c["start_word"]):
                    a, b = c["start_word"], c["start_word"] + c["n_words"]
                    out.append(raw[at : begin[a]])
                    at, left = begin[b], left - (b - a)
                new.append(b"".join([*out, raw[at:]]).decode("utf-8", "replace") if left else None)
            cols = list(batch.columns[: len(columns)])
            cols[text] = pa.array(new, pa.string())
            if n_chars is not None:
                cols[n_chars] = pa.array([None if x is None else len(x) for x in new]).cast(cols[n_chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(cols[text].is_valid())

    return run


def cut_passages(docs: DataFrame, min_words: int = 50, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without the words whose passages an earlier document has; n_chars, if there, is counted anew.

    Rows of which no word is left go. Rows that repeated_passages says nothing
    of stay as they are: with null text or doc_id, or with a doc_id that has
    different texts.
    """
    spans = repeated_passages(docs.select("doc_id", "text"), min_words, percent).where("source_id != doc_id")
    name = "cuts"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    scratch = Scratch(docs.sparkSession, "cuts")
    cuts = scratch.table("cuts", spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias(name)))
    whole = keep_ids(docs, cuts.select("doc_id"), "doc_id", "left_anti")
    touched = keep_lists(docs, cuts, "doc_id", name).select(*docs.columns, name)
    return whole.unionByName(touched.mapInArrow(W.tidied(_without(docs.columns)), docs.schema))
