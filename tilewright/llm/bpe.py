"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once per worker.

A byte-level BPE first splits a text into pieces and then encodes each piece
by itself, so the ids of a text are those of its pieces in order. Splitting
is done here on arrays of code points; the library encodes each piece that
the worker hasn't met yet. A text with the string of an added token in it is
encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

from . import words as W

#: Fixed value: the public split pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces that a worker remembers; beyond, it starts afresh.
REMEMBERED = 800_000
_SLOTS = 1 << 20
_CHARS = 1 << 19
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
_ODD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            table[ord(every[a]) : ord(every[b - 1]) + 1] = k
    table[0xD800:0xE000] = 0
    return table


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a character of the vocabulary is a byte of text
        self.forget()

    def forget(self) -> None:
        self.count = 0
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.uint32)  # of pieces, sorted by hash
        self.slot_hash, self.slot_at = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint32)
        self.pool, self.used = np.empty(1 << 16, np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32), 0
        self.begin, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.uint32)

    def _starts(self, code: np.ndarray, texts: list[str], at: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        kind = _classes()[code]
        space, blank = kind == 3, code == 32
        first = np.zeros(len(code) + 1, bool)
        first[at] = True
        first = first[:-1]
        last = np.append(first[1:], True)
        new = first.copy()
        before_space, before_blank, before_kind = (np.append(x[:1], x[:-1]) for x in (space, blank, kind))
        after_space = np.append(space[1:], True)
        new |= ~space & (kind != before_kind) & ~before_blank
        new |= space & (~before_space | (~after_space & ~last))
        for i, t in enumerate(texts):
            if "'" in t and _CONTRACTION.search(t):
                sizes = [len(x) for x in regex.findall(PATTERN, t)]
                new[at[i] : at[i] + len(t)] = False
                new[at[i] + np.cumsum([0, *sizes[:-1]])] = True
        return np.flatnonzero(new)

    def _learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        """pieces and their hashes, ascending, get the next numbers."""
        plain = [k for k, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        taken = set(plain)
        found: list = [None] * len(pieces)
        if plain:
            # such pieces in a row are split as they were, and ids tell how many bytes they take
            ids = np.array(self.tokenizer.encode("".join(pieces[k] for k in plain), add_special_tokens=False).ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[k].encode()) for k in plain])) + 1
            for k, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist()):
                found[k] = ids[a:b]
        rest = [k for k in range(len(pieces)) if k not in taken]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        need, n = self.used + int(sizes.sum()), self.count
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(need // 4 + need - self.used, self.pool.dtype)])
        if n + len(found) > len(self.begin):
            self.begin, self.size = (np.concatenate([x[:n], np.empty(n // 4 + len(found) + 1024, x.dtype)]) for x in (self.begin, self.size))
        self.pool[self.used : need] = np.concatenate(found)
        self.begin[n : n + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(found)] = sizes
        self.used = need
        self.count = n + len(found)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.numbers = np.insert(self.numbers, at, np.arange(n, self.count))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(lens) - lens
        whole = "".join(texts)
        if not whole:
            return np.empty(0, self.pool.dtype), np.zeros(len(texts) + 1, np.int64)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self._starts(code, [t for t in texts if t], at[lens > 0])
        size = np.diff(np.append(starts, len(code)))
        place = np.arange(len(code)) - np.repeat(starts, size)
        h = W.mix(np.add.reduceat((code.astype(np.uint64) + np.uint64(7)) * _ODD * W._pow(int(size.max()))[place], starts))
        if self.count > REMEMBERED:
            self.forget()
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        piece = self.slot_at[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            k = np.minimum(np.searchsorted(self.hashes, u), max(len(self.hashes) - 1, 0))
            new = self.hashes[k] != u if len(self.hashes) else np.ones(len(u), bool)
            found = np.where(new, 0, self.numbers[k]) if len(self.hashes) else np.zeros(len(u), np.int64)
            if new.any():
                where = miss[first[new]]
                found[new] = np.arange(self.count, self.count + len(where))
                self._learn([whole[x:y] for x, y in zip(starts[where].tolist(), (starts[where] + size[where]).tolist())], u[new])
            piece[miss] = found[back]
            s = (u & np.uint64(_SLOTS - 1)).astype(np.int64)
            self.slot_hash[s], self.slot_at[s] = u, found
        n = self.size[piece].astype(np.int64)
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.begin[piece] - (total - n), n) + np.arange(total[-1])]
        ends = np.searchsorted(starts, at + lens)
        bounds = np.zeros(len(texts) + 1, np.int64)
        bounds[1:] = np.append(0, total)[ends]
        return ids, bounds

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        some = [t or "" for t in texts]
        whole = {}
        if self.added:
            for i, t in enumerate(some):
                if self.added.search(t):
                    whole[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.pool.dtype)
                    some[i] = ""
        a = total = 0
        for i in range(len(some) + 1):
            if i == len(some) or (total and total + len(some[i]) > _CHARS):
                if i > a:
                    ids, bounds = self._chunk(some[a:i])
                    for j in range(i - a):
                        yield whole[a + j] if a + j in whole else ids[bounds[j] : bounds[j + 1]]
                a, total = i, 0
            if i < len(some):
                total += len(some[i])


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and vocabulary."""
    return PieceEncoder(path)
