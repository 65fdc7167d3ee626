"""Suffix arrays and common prefixes of many short texts laid end to end, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key: 7 of 9 bits.
PACK = 7


def packed(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position the next PACK symbols as one number; behind the end of its text the symbol is 0."""
    n = len(data)
    padded = np.zeros(n + PACK, np.int64)
    padded[:n] = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for k in range(PACK):
        key = (key << 9) | np.where(left > k, padded[k : k + n], 0)
    return key


def suffix_array(key: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Sorted suffixes, compared on at least ``depth`` symbols or to their end.

    Larsson-Sadakane: the suffixes are sorted by their first symbols, then only the groups that are still
    equal are sorted again, by the rank of the suffix as far on as was compared, which doubles the reach.
    left: symbols from a position to the end of its text.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    slot = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0)) + 1
    rank[n] = 0
    tail = np.append(head[1:], True)
    open_ = np.flatnonzero(~(head & tail))
    reach = PACK
    while reach < depth and len(open_):
        at = order[open_]
        ahead = np.where(left[at] > reach, rank[np.minimum(at + reach, n)], 0)
        first = rank[at]
        again = np.lexsort((ahead, first))
        at, ahead, first = at[again], ahead[again], first[again]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (ahead[1:] != ahead[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        last = np.append(new[1:], True)
        open_ = open_[~(new & last)]
        reach *= 2
    return order


def common_prefixes(order: np.ndarray, key: np.ndarray, left: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each place in the suffix array, the common prefix with the place before it (0 for the first).

    Kasai: in text order the common prefix loses at most one symbol a step. Where the suffix before it in the
    array moves on in step, it loses exactly one; only the other positions are compared symbol by symbol.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = np.zeros(n, bool)
    step[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (left[1:] < left[:-1])
    step[1:] &= left[np.maximum(before[1:], 0)] < left[np.maximum(before[:-1], 0)]
    own = np.flatnonzero(~step & (before >= 0))
    lcp = np.zeros(n, np.int64)
    live, reach = own, 0
    while len(live):
        a, b = live + reach, before[live] + reach
        full = (left[live] >= reach + PACK) & (left[before[live]] >= reach + PACK)
        same = full & (key[np.minimum(a, n - 1)] == key[np.minimum(b, n - 1)])
        rest = live[~same]
        lcp[rest] = reach
        live = live[same]
        reach += PACK
    live = own
    for _ in range(PACK):
        a, b = live + lcp[live], before[live] + lcp[live]
        ok = (left[live] > lcp[live]) & (left[before[live]] > lcp[live])
        ok &= data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)]
        live = live[ok]
        lcp[live] += 1
    start = np.maximum.accumulate(np.where(step, 0, np.arange(n)))
    found = np.where(before >= 0, np.maximum(lcp[start] - (np.arange(n) - start), 0), 0)
    return found[order]


def words(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each position as big-endian numbers, so that rows compare as the bytes do."""
    size = -(-width // 8) * 8
    rows = np.zeros((len(at), size), np.uint8)
    rows[:, :width] = data[at[:, None] + np.arange(width)]
    return rows.view(">u8").astype(np.uint64)


def lookup(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place of each row in a sorted table of rows, or -1: a binary search for all rows at once."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(table), np.int64)
    lane = np.arange(len(rows))
    while True:
        busy = low < high
        if not busy.any():
            break
        mid = np.minimum((low + high) // 2, len(table) - 1)
        differs = table[mid] != rows
        col = differs.argmax(1)
        less = differs[lane, col] & (table[mid, col] < rows[lane, col])
        low, high = np.where(busy & less, mid + 1, low), np.where(busy & ~less, mid, high)
    at = np.minimum(low, len(table) - 1)
    return np.where((low < len(table)) & (table[at] == rows).all(1), at, -1)
