"""Byte-pair merges of many words at once.

The words lie in one flat array of symbols. Each round finds the minimum rank of every word's
neighbouring pairs, merges the leftmost pairs of that rank in all words together, and compacts the
array; words in which no pair merges are finished and leave.

Several pairs of a word may merge in one round only if no merge can follow from the merged symbol
with a rank as good. That is checked per rank; where it does not hold, one pair merges per round.
"""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np

NONE = np.iinfo(np.int32).max
# Symbols merged in one flat array: what stays in a core's cache.
SYMBOLS_AT_ONCE = 150_000
# Longer words are merged one by one with a heap, in n log n steps.
LONG = 2_000


class Merger:
    """``pairs`` maps two symbols to a rank and the merged symbol; negative symbols never merge."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], unsafe: set[int] = frozenset()):
        made: dict[int, list[int]] = {}
        for rank, symbol in pairs.values():
            made.setdefault(symbol, []).append(rank)
        self.safe = np.ones(max((r for r, _ in pairs.values()), default=0) + 1, bool)
        self.safe[list(unsafe)] = False
        for parts, (rank, _) in pairs.items():
            for part in parts:
                for own in made.get(part, ()):
                    if own >= rank:
                        self.safe[own] = False
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.pair_rank = np.full(1 << bits, NONE, np.int32)
        self.pair_symbol = np.zeros(1 << bits, np.int32)
        self.probes = 1
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        for key, slot, (rank, symbol) in zip(keys.tolist(), self._slots(keys).tolist(), pairs.values(), strict=True):
            probes = 1
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
                probes += 1
            self.probes = max(self.probes, probes)
            self.keys[slot], self.pair_rank[slot], self.pair_symbol[slot] = key, rank, symbol

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is NONE where a pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        there = self.keys[slots]
        hit = there == keys
        rank = np.where(hit, self.pair_rank[slots], NONE)
        symbol = self.pair_symbol[slots]
        open_ = np.flatnonzero(~hit & (there >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = at = (slots[open_] + 1) % len(self.keys)
            there = self.keys[at]
            hit = there == keys[open_]
            rank[open_[hit]] = self.pair_rank[at[hit]]
            symbol[open_[hit]] = self.pair_symbol[at[hit]]
            open_ = open_[~hit & (there >= 0)]
        return rank, symbol

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, one after the other, and how many each word has."""
        ends = np.cumsum(lengths)
        parts, counts = [], []
        begin = 0
        while begin < len(lengths):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + SYMBOLS_AT_ONCE, "right")))
            if lengths[begin] > LONG:
                stop = begin + 1
                found = np.array(self._one(symbols[base : ends[begin]]), np.int32)
                parts.append(found)
                counts.append(np.array([len(found)]))
            else:
                long = np.flatnonzero(lengths[begin:stop] > LONG)
                stop = begin + int(long[0]) if len(long) else stop
                found, n = self._together(symbols[base : ends[stop - 1]], lengths[begin:stop])
                parts.append(found)
                counts.append(n)
            begin = stop
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(parts), np.concatenate(counts)

    def _together(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(lengths)
        symbols = symbols.astype(np.int32)
        word = np.repeat(np.arange(n, dtype=np.int32), lengths)
        done_symbols, done_words = [], []
        rank, into = self.look_up(symbols[:-1], symbols[1:]) if len(symbols) else (symbols, symbols)
        rank[word[:-1] != word[1:]] = NONE
        rank, into = np.append(rank, np.int32(NONE)), np.append(into, np.int32(0))
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            going = least != NONE
            if not going.all():
                open_ = np.repeat(going, sizes)
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, into = symbols[open_], word[open_], rank[open_], into[open_]
                least, sizes = least[going], sizes[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of pairs that overlap in a run, every other one from the left.
            start = np.concatenate(([True], at[1:] != at[:-1] + 1))
            if not start.all():
                run = np.cumsum(start) - 1
                at = at[(at - at[start][run]) % 2 == 0]
            owner = word[at]
            leftmost = np.concatenate(([True], owner[1:] != owner[:-1]))
            if not leftmost.all():
                at = at[leftmost | self.safe[rank[at]]]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            # The pairs on both sides of a merged symbol are new.
            rank[new] = NONE
            before = new[new > 0] - 1
            rank[before] = NONE
            pairs = np.concatenate((new, before))
            pairs = pairs[pairs + 1 < len(symbols)]
            pairs = pairs[word[pairs] == word[pairs + 1]]
            rank[pairs], into[pairs] = self.look_up(symbols[pairs], symbols[pairs + 1])
        if not done_words:
            return symbols, np.zeros(n, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def _one(self, word: np.ndarray) -> list[int]:
        """One long word: a heap of pairs over a linked list."""
        symbols = word.tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def fill(pairs: list[tuple[int, int]]) -> None:
            new = list({p for p in pairs if p not in known})
            if new:
                rank, into = self.look_up(*np.array(new, np.int64).T)
                known.update(zip(new, zip(rank.tolist(), into.tolist(), strict=True), strict=True))

        fill(list(pairwise(symbols)))
        heap = [(known[p][0], i, p) for i, p in enumerate(pairwise(symbols)) if known[p][0] != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i] = known[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    p = (symbols[a], symbols[b])
                    fill([p])
                    if known[p][0] != NONE:
                        heapq.heappush(heap, (known[p][0], a, p))
        return [s for s, kept in zip(symbols, alive, strict=True) if kept]
