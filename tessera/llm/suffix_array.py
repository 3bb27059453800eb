"""Suffix arrays of one shard in numpy: Larsson-Sadakane refinement and Kasai's
common prefixes, both cut at the length that matters."""

from __future__ import annotations

import numpy as np

#: Bytes sorted at once in the first round.
WORD = 8
#: Text positions that one lane of Kasai's algorithm walks.
LANE = 64


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number, so that numbers
    are in the order of the bytes; past the end stand zeros."""
    padded = np.concatenate([buffer, np.zeros(WORD, np.uint8)])
    return np.ndarray((len(buffer),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place with an equal value."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_array(buffer: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each position) by the first ``depth`` bytes or more.

    Positions are sorted by eight bytes; then, as Larsson and Sadakane do, each
    round sorts only the groups that are not settled, by the rank of the suffix
    that starts where the compared bytes end, and doubles the length compared.
    """
    n = len(buffer)
    keys = words_at(buffer)
    array = np.argsort(keys)
    starts = _group_starts(keys[array])
    rank = np.empty(n, np.int64)
    rank[array] = starts
    length = WORD
    open_ = np.flatnonzero(_unsettled(starts))  # places in the array
    while length < depth and len(open_):
        at = array[open_]
        # past the end, the shorter suffix is the smaller
        follow = at + length
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, n - follow) + rank[at] * (n + length + 1)
        order = np.argsort(key)
        array[open_] = at = at[order]
        first = _group_starts(key[order])
        rank[at] = open_[first]
        open_ = open_[_unsettled(first)]
        length *= 2
    return array, rank


def _unsettled(starts: np.ndarray) -> np.ndarray:
    """Which places are in a group of two or more, given the first place of each group."""
    same = np.zeros(len(starts), bool)
    equal = starts[1:] == starts[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    return same


def common_prefixes(buffer: np.ndarray, array: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of each suffix with the one before it
    in the array. Kasai's algorithm: in text order, a suffix shares at least one
    byte less with its neighbour than the suffix that starts one byte earlier
    does. That holds while the two differ within the bytes that were sorted; after
    ``most`` common bytes a suffix starts anew, unless its rank, that of at least
    ``most`` bytes, is its neighbour's. The text is walked in lanes, all at once."""
    n = len(buffer)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[:1]] = -1
    padded = np.concatenate([buffer, np.zeros(most + WORD, np.uint8)])
    words = np.ndarray((n + most,), "<u8", padded, strides=(1,))
    shared = np.zeros(n, np.int64)
    begin = np.arange(0, n, LANE)
    carried = np.zeros(len(begin), np.int64)
    for step in range(min(LANE, n)):
        at = begin + step
        at = at[: np.searchsorted(at, n)]
        have = carried[: len(at)] - 1
        have[(have < 0) | (have == most - 1)] = 0
        other = before[at]
        have[rank[at] == rank[other]] = most
        have[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (have < most))
        while len(live):
            a, b, h = at[live], other[live], have[live]
            differ = words[a + h] ^ words[b + h]
            # a set lowest byte means that the first of the eight bytes differs
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, WORD, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            h = np.minimum(h + same, np.minimum(most, n - np.maximum(a, b)))
            have[live] = h
            live = live[(same == WORD) & (h < most) & (h < n - np.maximum(a, b))]
        shared[at] = have
        carried[: len(at)] = have
    return shared[array]
