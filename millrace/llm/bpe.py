"""Byte-pair merging: of one unit of text, and of many short ones at once in numpy."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

#: Rank of a pair that no rule merges.
NEVER = float("inf")

#: Units longer than this are merged with a heap, in n log n steps.
LONG = 48


def merge(symbols: list, rank: Callable) -> list:
    """Merge neighbours, lowest ``rank(a, b)`` first, leftmost first among equals."""
    if len(symbols) > LONG:
        return _merge_long(symbols, rank)
    ranks = list(map(rank, symbols, symbols[1:]))
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        i = ranks.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank(symbols[i], symbols[i + 1])
        if i:
            ranks[i - 1] = rank(symbols[i - 1], symbols[i])
    return symbols


def _merge_long(symbols: list, rank: Callable) -> list:
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(symbols[i], symbols[k])) != NEVER:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := rank(symbols[h], symbols[i])) != NEVER:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return [s for s in symbols if s is not None]


class PairTable:
    """Mergeable pairs of symbol numbers, with rank and merged symbol, looked up for whole arrays."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]]):
        """``pairs``: (left, right, rank, merged); ranks are whole numbers under 2^30."""
        rows = np.array(sorted(set(pairs)), np.int64).reshape(-1, 4)
        codes = rows[:, 0] << 32 | rows[:, 1]
        self.rank, self.merged = np.append(rows[:, 2], NO_RANK), np.append(rows[:, 3], -1)
        # Slots of a first table; what finds its slot taken goes to a next one with other slots.
        self.tables, left, turn = [], np.arange(len(codes)), 0
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 3)
            slots = self._slots(codes[left], bits, turn)
            held = np.full(1 << bits, len(codes))
            held[slots] = left
            self.tables.append((bits, np.append(codes, -1)[held], held))
            left, turn = left[held[slots] != left], turn + 1

    @staticmethod
    def _slots(codes: np.ndarray, bits: int, turn: int) -> np.ndarray:
        mixed = (codes.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in ``rank`` and ``merged``; their last one for pairs that do not merge."""
        codes = left.astype(np.int64) << 32 | right
        out = np.full(len(codes), len(self.rank) - 1)
        for turn, (bits, known, held) in enumerate(self.tables):
            slots = self._slots(codes, bits, turn)
            hit = known[slots] == codes
            out[hit] = held[slots[hit]]
        return out


NO_RANK = 1 << 30


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Units of ``lengths`` symbols each, merged like ``merge`` does: their symbols, and the new lengths.

    A round merges the best pair of every unit that still has one.
    """
    unit = np.repeat(np.arange(len(lengths)), lengths)
    pair = np.full(len(symbols), len(table.rank) - 1)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    pair[inner] = table.find(symbols[inner], symbols[inner + 1])
    done_symbols, done_units = [], []
    while len(symbols):
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(table.rank[pair] << 32 | np.arange(len(pair)), first)
        going = best >> 32 < NO_RANK
        size = np.diff(np.append(first, len(symbols)))
        stays = np.repeat(going, size)
        done_symbols.append(symbols[~stays])
        done_units.append(unit[~stays])
        at = best[going] & 0xFFFFFFFF
        symbols[at] = table.merged[pair[at]]
        stays[at + 1] = False
        place = np.cumsum(stays) - 1
        symbols, unit, pair, at = symbols[stays], unit[stays], pair[stays], place[at]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        changed = np.flatnonzero(touched)
        pair[changed] = len(table.rank) - 1
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[unit[changed] == unit[changed + 1]]
        pair[changed] = table.find(symbols[changed], symbols[changed + 1])
    units = np.concatenate(done_units) if done_units else np.zeros(0, np.int64)
    order = np.argsort(units, kind="stable")
    merged = np.concatenate(done_symbols)[order] if done_symbols else symbols
    return merged, np.bincount(units, minlength=len(lengths))
