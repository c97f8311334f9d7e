"""Token ids in a binary format: shards in ascending doc_id order, each compressed by a Re-Pair grammar.

A shard is one binary value:

    magic TWR1, then eight little-endian uint32: terminals, rules, documents,
    symbols, bytes a symbol, tokens (low, high), 0
    rules        2 uint32 each: the pair that the nonterminal stands for
    lengths      1 uint32 each: ids in the rule's expansion
    symbol_at    documents + 1 uint64: where each document's symbols begin
    token_at     documents + 1 uint64: where each document's ids begin in the shard
    doc_ids      documents int64, then documents uint8: 1 if the id is null
    symbols      2, 3 or 4 bytes each

Symbols under `terminals` are ids; the others are rules in order. No rule
spans two documents, so a document is decoded from its own symbols, and the
lengths tell where an id inside it is without decoding what stands before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bpe import default_path, encoder
from .scratch import Scratch

MAGIC = b"TWR1"
SHARD_TOKENS = 1 << 20
#: Pairs that occur so often are frequent: a rule takes 12 bytes and saves 2 at each place.
LEAST_COUNT = 8
_BITS = 20
_MULS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def repair(ids: np.ndarray, at: np.ndarray, terminals: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, document offsets into symbols): frequent pairs become nonterminals, in rounds, until no pair of symbols occurs `least` times.

    Each round counts the pairs that may be frequent: in the first all, then
    those beside a new symbol and the frequent ones that are left; others can
    only have become rarer. Of frequent pairs that overlap the more frequent
    one is replaced; pairs that lose too many places to others wait.
    """
    seq = ids.astype(np.uint32)
    ends = np.zeros(len(seq), bool)
    ends[(at[1:] - 1)[at[1:] > at[:-1]]] = True
    rules: list[np.ndarray] = []
    n_rules = rounds = 0
    held = np.zeros(1 << _BITS, np.uint64)
    where = np.flatnonzero(~ends[:-1])
    while len(where):
        pair = seq.take(where).astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= seq.take(where + 1)
        # in a run of one symbol every other pair counts
        odd = np.zeros(len(where), bool)
        again = np.flatnonzero((pair[1:] == pair[:-1]) & (where[1:] == where[:-1] + 1)) + 1
        if len(again):
            n = np.arange(len(again))
            first = np.maximum.accumulate(np.where(np.append(True, again[1:] != again[:-1] + 1), n, 0))
            odd[again[(n - first) % 2 == 0]] = True
        if len(pair) > 1 << 14:
            # counted by hash bucket: one pair of each bucket now, others that may be frequent wait for another hash
            bits = min(_BITS, len(pair).bit_length())
            b = (pair * _MULS[rounds % 3] >> np.uint64(64 - bits)).view(np.int64)
            every = np.bincount(b, minlength=1 << bits)
            some = np.flatnonzero((every >= least).take(b))
            where, pair, b, odd = where.take(some), pair.take(some), b.take(some), odd.take(some)
            held[b] = pair
            hit = held.take(b) == pair
            counts = np.bincount(b.take(np.flatnonzero(hit & ~odd)), minlength=1 << bits)
            wait = where.take(np.flatnonzero((every - counts >= least).take(b) & ~hit))
            frequent = np.flatnonzero(counts >= least)
            number = np.full(1 << bits, -1, np.int32)
            number[frequent] = np.arange(len(frequent), dtype=np.int32)
            pair_of, counts, kind = held.take(frequent), counts.take(frequent), number.take(b)
            kind[~hit] = -1
        else:
            keys, b = np.unique(pair, return_inverse=True)
            counts = np.bincount(b[~odd], minlength=len(keys))
            wait, frequent = where[:0], np.flatnonzero(counts >= least)
            number = np.full(len(keys), -1, np.int32)
            number[frequent] = np.arange(len(frequent), dtype=np.int32)
            pair_of, counts, kind = keys.take(frequent), counts.take(frequent), number.take(b)
        rounds += 1
        some = np.flatnonzero(kind >= 0)
        where, kind, odd = where.take(some), kind.take(some), odd.take(some)
        if not len(where):
            where = wait
            continue
        weight = (counts * len(counts) + np.arange(len(counts))).take(kind)
        weight[odd] = -1
        beside = where[1:] == where[:-1] + 1
        keep = ~odd
        keep[1:] &= ~beside | (weight[1:] > weight[:-1])
        keep[:-1] &= ~beside | (weight[:-1] > weight[1:])
        win = np.bincount(kind.take(np.flatnonzero(keep)), minlength=len(counts)) >= least
        kept = np.flatnonzero(keep & win.take(kind))
        chosen, put = np.flatnonzero(win), where.take(kept)
        symbol = np.zeros(len(counts), np.uint32)
        symbol[chosen] = np.arange(terminals + n_rules, terminals + n_rules + len(chosen), dtype=np.uint32)
        rules.append(np.stack([pair_of[chosen] >> np.uint64(32), pair_of[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(chosen)
        seq[put] = symbol.take(kind.take(kept))
        ends[put] = ends.take(put + 1)
        left, may = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        left[put + 1] = False
        may[where] = True
        may[wait] = True
        before = put[1 if len(put) and not put[0] else 0 :] - 1
        may[before - ~left.take(before)] = True
        may &= ~ends
        stay = np.flatnonzero(left)
        seq, ends, where = seq.take(stay), ends.take(stay), np.flatnonzero(may.take(stay))
    symbol_at = np.zeros(len(at), np.int64)
    symbol_at[1:][at[1:] > at[:-1]] = np.flatnonzero(ends) + 1
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), np.maximum.accumulate(symbol_at)


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, begin, pool): symbol s stands for pool[begin[s] : begin[s] + size[s]]. Rules that refer to no rule among themselves, as those of one round, are expanded at once."""
    n = len(rules)
    size, begin = np.ones(terminals + n, np.int64), np.arange(terminals + n)
    pool, highest, i = np.arange(terminals, dtype=np.uint32), rules.max(axis=1, initial=0) if n else rules, 0
    while i < n:
        later = highest[i:] >= terminals + i
        j = i + int(later.argmax()) if later.any() else n
        if j == i:
            raise ValueError("a rule refers to itself or a later one")
        more, ends = _expand(rules[i:j].reshape(-1).astype(np.int64), size, begin, pool)
        ends = ends[1::2]
        begin[terminals + i : terminals + j] = len(pool) + np.append(0, ends[:-1])
        size[terminals + i : terminals + j] = np.diff(ends, prepend=0)
        pool, i = np.concatenate([pool, more]), j
    return size, begin, pool


def _expand(symbols: np.ndarray, size: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the symbols stand for, and where each ends in it."""
    n = size[symbols]
    ends = np.cumsum(n)
    return pool[np.repeat(begin[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def pack_shard(doc_ids: list[int | None], tokens: list[np.ndarray], terminals: int) -> bytes:
    at = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=at[1:])
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint32)
    seq, rules, symbol_at = repair(flat, at, terminals)
    size = expansions(rules, terminals)[0][terminals:]
    wide = next(k for k in (2, 3, 4) if terminals + len(rules) <= 1 << 8 * k)
    head = np.array([terminals, len(rules), len(tokens), len(seq), wide, at[-1] & 0xFFFFFFFF, at[-1] >> 32, 0], "<u4")
    return b"".join(
        [MAGIC, head.tobytes(), rules.astype("<u4").tobytes(), size.astype("<u4").tobytes(), symbol_at.astype("<u8").tobytes(), at.astype("<u8").tobytes(),
         np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()]
    )


class Shard:
    """Reads a shard; document(i) and slice(i, a, b) decode no more than they return, and a rule at either end."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.terminals, n_rules, n, n_symbols, wide, *_ = np.frombuffer(blob, "<u4", 8, 4).tolist()
        p = 36

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal p
            x = np.frombuffer(blob, kind, count, p)
            p += x.nbytes
            return x

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        sizes = take("<u4", n_rules)
        self.symbol_at, self.token_at = take("<u8", n + 1).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.doc_ids, self.null = take("<i8", n), take("u1", n)
        symbols = np.zeros((n_symbols, 4), np.uint8)
        symbols[:, :wide] = take("u1", n_symbols * wide).reshape(-1, wide)
        self.symbols = symbols.view("<u4").reshape(-1)
        if p != len(blob):
            raise ValueError("a token shard has a wrong length")
        self.size, self.begin, self.pool = expansions(self.rules, self.terminals)
        if (self.size[self.terminals :] != sizes).any():
            raise ValueError("a token shard's lengths differ from its rules")

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _expand(symbols.astype(np.int64), self.size, self.begin, self.pool)[0]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]])

    def slice(self, i: int, a: int, b: int) -> np.ndarray:
        """The ids a to b of document i."""
        s = self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]]
        ends = np.cumsum(self.size[s])
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b) + 1
        skip = a - (ends[lo - 1] if lo else 0)
        return self.expand(s[lo:hi])[skip : skip + max(0, b - a)]


_SHARDS = "part int, seq int, base long, n_docs long, n_tokens long, shard binary"


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        terminals = max(len(enc.bytes_of), end_id + 1)
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        n = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, base, n
            blob = pack_shard(ids, tokens, terminals)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "base", "n_docs", "n_tokens", "shard"])
            seq, base, n = seq + 1, base + n, 0
            ids.clear()
            tokens.clear()
            return row

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids.append(doc)
                tokens.append(np.concatenate([t.astype(np.uint32), end]))
                n += len(t) + 1
                if n >= SHARD_TOKENS:
                    yield shard()
        if ids:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """docs(doc_id, text) -> the written table of shards (part, seq, base, n_docs, n_tokens, shard) at path.

    Rows are range-partitioned by doc_id, so ascending (part, seq) is ascending
    doc_id (nulls first). Rows of one doc_id, or without one, go by a hash of
    their text, so they may fill many parts. base is the number of ids before
    the shard within its part. Null text is empty. An empty table gives no
    shards. Any byte-level vocabulary of the tokenizers library; end_id is
    appended to each document.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shards = ordered.mapInArrow(W.tidied(_write(tokenizer or default_path(), end_id)), _SHARDS)
    shards.write.mode("overwrite").parquet(path)
    return spark.read.schema(_SHARDS).parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Shards -> (doc_id, start, n_tokens, ids_crc32), decoded from the files.

    start counts all ids before the document: the totals of the parts (a
    number for each partition) are summed on the driver.
    """
    before, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, blob in zip(*(batch.column(j).to_pylist() for j in range(3))):
                s = Shard(blob)
                m = len(s.doc_ids)
                every = s.expand(s.symbols).astype("<u4", copy=False)
                crc = [zlib.crc32(every[a:b]) for a, b in zip(s.token_at.tolist(), s.token_at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids.tolist(), pa.int64(), mask=s.null.astype(bool)), pa.array(before[part] + base + s.token_at[:-1]), pa.array(np.diff(s.token_at)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "base", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the shards of docs to the shared folder and returns what read_tokens finds in them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, f"{scratch.base}/shards", tokenizer, end_id))
