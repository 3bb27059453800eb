"""Elias-Fano sequences and a two-level n-gram trie made of them, as arrays that
can be memory-mapped; all look-ups work on many queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Ones in each byte, and the place of the r-th one in it (both made by rule).
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


@dataclass
class EliasFano:
    """A monotone sequence of ``n`` numbers: ``low`` bits of each in ``lows``,
    the rest as gaps in unary in ``highs``."""

    n: int
    low: int
    highs: np.ndarray  # bytes of the unary part
    lows: np.ndarray   # 64-bit words of the low bits

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64)
        size = (top >> low) + n + 1
        bits = np.zeros(-(-size // 8) * 8, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little")
        # low bits: each number ends up in one word or in two
        words = np.zeros(-(-n * low // 64) + 1, np.uint64)
        if low:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            rest = values & np.uint64((1 << low) - 1)
            np.bitwise_or.at(words, word, rest << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(words, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, low, highs, words)

    @cached_property
    def _ones_ahead(self) -> np.ndarray:
        """Ones ahead of each byte: the directory of ``_select``, made when a
        sequence is first asked and not stored."""
        return np.concatenate([[0], np.cumsum(_ONES[self.highs])])

    @cached_property
    def _zeros_ahead(self) -> np.ndarray:
        return np.arange(len(self.highs) + 1) * 8 - self._ones_ahead

    def _select(self, r: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the r-th ones (or zeros) of the unary part."""
        ahead = self._ones_ahead if ones else self._zeros_ahead
        at = np.searchsorted(ahead, r, "right") - 1
        return at * 8 + _PLACE[self.highs[at] if ones else ~self.highs[at], r - ahead[at]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.lows[word] >> shift
        over = shift + np.uint64(self.low) > 64
        value[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first place whose number is x or more (``n`` if none)."""
        x = np.asarray(x, np.uint64)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        begin, end = self._starts(high), self._starts(high + 1)
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # binary search within the numbers of one high part
            mid = (begin[open_] + end[open_]) >> 1
            less = self[mid] < x[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[begin[open_] < end[open_]]
        return begin

    def _starts(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part: as many ones as stand ahead
        of the zero that ends the part before."""
        zeros = len(self.highs) * 8 - self.n
        at = self._select(np.clip(high - 1, 0, zeros - 1), False) - high + 1
        return np.where(high <= 0, 0, np.where(high > zeros, self.n, at))


class BigramTrie:
    """Sorted pairs (context, word) with a code each.

    Level 1 has the distinct contexts; its pointers, one more than contexts, say
    where the words of each begin in level 2. The words of a context are made
    monotone over the whole level by adding the last number ahead of them, so a
    word is sought relative to its context.
    """

    PARTS = ("contexts", "pointers", "words")

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.words, self.codes = contexts, pointers, words, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> BigramTrie:
        """From pairs in order, without repeats."""
        n = len(context)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if n else np.empty(0, np.int64)
        ends = np.append(first, n)[1:]
        word = word.astype(np.uint64) + np.uint64(1)
        last = word[ends - 1] if n else word
        base = np.concatenate([[0], np.cumsum(last, dtype=np.uint64)[:-1]]).astype(np.uint64) if n else word
        return cls(EliasFano.encode(context[first]), EliasFano.encode(np.append(first, n)),
                   EliasFano.encode(word + np.repeat(base, ends - first)), codes)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the pairs, 0 for those that are not there."""
        out = np.zeros(len(context), self.codes.dtype)
        if not self.contexts.n or not len(context):
            return out
        seek, back = np.unique(context, return_inverse=True)
        at = self.contexts.successor(seek)
        there = at < self.contexts.n
        there[there] = self.contexts[at[there]] == seek[there]
        begin, end, base = (np.zeros(len(seek), t) for t in (np.int64, np.int64, np.uint64))
        begin[there] = self.pointers[at[there]].astype(np.int64)
        end[there] = self.pointers[at[there] + 1].astype(np.int64)
        ahead = there & (begin > 0)
        base[ahead] = self.words[begin[ahead] - 1]
        own = np.flatnonzero(there[back])
        target = base[back[own]] + word[own].astype(np.uint64) + np.uint64(1)
        spot = self.words.successor(target)
        hit = spot < end[back[own]]
        hit[hit] = self.words[spot[hit]] == target[hit]
        out[own[hit]] = self.codes[spot[hit]]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        """What is written: a file for each."""
        out = {"codes": self.codes}
        for part in self.PARTS:
            e = getattr(self, part)
            out |= {f"{part}.shape": np.array([e.n, e.low], np.int64), f"{part}.highs": e.highs, f"{part}.lows": e.lows}
        return out

    @classmethod
    def open(cls, read) -> BigramTrie:
        """From ``read(name, dtype)``, which gives each written array."""
        levels = []
        for part in cls.PARTS:
            n, low = (int(x) for x in read(f"{part}.shape", np.int64))
            levels.append(EliasFano(n, low, read(f"{part}.highs", np.uint8), read(f"{part}.lows", np.uint64)))
        return cls(*levels, read("codes", np.uint8))
