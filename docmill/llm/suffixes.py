"""Suffix arrays in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of the byte strings text[bounds[i]:bounds[i + 1]], in order.

    A suffix ends with its string; the ends are symbols below all bytes, ordered by string, so that
    no two suffixes are equal.  Suffixes start sorted by seven symbols.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    symbol = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(at + k < end, symbol[k : k + n], np.uint64(0))
    return _refined(key, bounds, 7, None)


def refined(symbols: np.ndarray, bounds: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of strings of numbers, sorted by `depth` symbols at least (all without); equal beginnings of that length stay in any order."""
    return _refined(symbols, bounds, 1, depth) if len(symbols) else np.zeros(0, np.int64)


def ranked(symbols: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of strings of numbers, sorted by more than `depth` symbols, and the ranks of every round.

    Row k of the ranks is equal for two suffixes only if their first 2^k symbols are equal and inside their strings,
    so the length in which two suffixes agree is read from the rows, the largest first.
    """
    rounds: list[np.ndarray] = []
    order = _refined(symbols, bounds, 1, depth + 1, rounds) if len(symbols) else np.zeros(0, np.int64)
    return order, np.stack(rounds) if rounds else np.zeros((0, len(symbols)), np.int32)


def agreement(ranks: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many symbols the suffixes x and y agree, pair by pair; end of each place's string."""
    out, last = np.zeros(len(x), np.int64), ranks.shape[1] - 1
    for k in range(len(ranks) - 1, -1, -1):
        a, b = x + out, y + out
        same = (a < end[x]) & (b < end[y])
        same &= ranks[k, np.minimum(a, last)] == ranks[k, np.minimum(b, last)]
        out += same.astype(np.int64) << k
    return out


def _refined(key: np.ndarray, bounds: np.ndarray, h: int, depth: int | None, rounds: list[np.ndarray] | None = None) -> np.ndarray:
    """Suffixes sorted by their first h symbols, which key stands for; then every round sorts the groups
    that are still tied by the rank of what follows the sorted part, which doubles it.  rounds takes the ranks of each."""
    n, strings = len(key), len(bounds) - 1
    string = np.repeat(np.arange(strings), np.diff(bounds))
    end = bounds[1:][string]
    at = np.arange(n)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    alone = new & np.append(new[1:], True)
    tied = np.flatnonzero(~alone)
    if rounds is not None:
        rounds.append(rank.astype(np.int32))
    while len(tied) and (depth is None or h < depth):
        suffix = order[tied]
        group = rank[suffix]
        after = suffix + h
        inside = after < end[suffix]
        follow = np.where(inside, strings + rank[np.minimum(after, n - 1)], string[suffix])
        by = np.argsort(group * np.int64(n + strings) + follow)
        suffix, group, follow = suffix[by], group[by], follow[by]
        order[tied] = suffix
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(fresh, tied, 0))
        single = fresh & np.append(fresh[1:], True)
        tied = tied[~single]
        h *= 2
        if rounds is not None:
            rounds.append(rank.astype(np.int32))
    return order


def common_prefixes(text: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every place of the suffix array, the length its suffix shares with the one before it.

    Kasai: going through a string, the shared length falls by one at most.  All strings go forward together.
    """
    n = len(text)
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][string]
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    shared = np.zeros(n, np.int64)
    lengths = np.diff(bounds)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = bounds[:-1][by_length], lengths[by_length]
    carry = np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -t, "left"))
        i = starts[:live] + t
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(carry[:live] - 1, 0))
        go = np.flatnonzero(j >= 0)
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            inside = (a < end[i[go]]) & (b < end[j[go]])
            go, a, b = go[inside], a[inside], b[inside]
            go = go[text[a] == text[b]]
            h[go] += 1
        shared[i] = h
        carry[:live] = h
    return shared[order]
