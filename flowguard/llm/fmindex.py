"""An FM-index over the words of one shard: wavelet-matrix ranks, backward search, and sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Zeros end a run of words; each compares lower than any word, by place."""
    n = len(text)
    ends = text == 0
    keys = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(keys, kind="stable")
    span = 1
    while True:
        ranked = keys[order]
        fresh = np.concatenate(([0], (ranked[1:] != ranked[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if int(fresh.sum()) == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[:-span] = rank[span:] + 1
        keys = rank * (n + 1) + later
        order = np.argsort(keys, kind="stable")
        span *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per bit of the largest symbol."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest = symbols.astype(np.int64)
        for bit in range(max(1, int(rest.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            zeros = len(rest) - int(before[-1])
            self.levels.append((bit, before, zeros))
            rest = np.concatenate((rest[ones == 0], rest[ones == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(place), place
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low_ones, high_ones = before[low], before[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """Index of runs of word codes (1 and above), each run followed by a zero."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.last = text[order - 1].astype(np.int64)  # the symbol before each suffix
        self.ranks = WaveletMatrix(self.last)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))))
        begins = np.concatenate(([True], text[:-1] == 0))  # the walk back never leaves a run
        kept = (begins | (np.arange(len(text)) % sample == 0))[order]
        self.kept, self.kept_before = kept, np.cumsum(kept) - 1
        self.places = order[kept]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases (rows of equal length) that occur, with the first and the end of their suffix rows."""
        n = len(self.last)
        alive = np.flatnonzero((phrases < len(self.smaller) - 1).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low, high = self._step(symbol, low), self._step(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        place, row = np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            hit = self.kept[row]
            place[open_[hit]] = self.places[self.kept_before[row[hit]]] + steps
            open_, row = open_[~hit], row[~hit]
            row = self._step(self.last[row], row) if len(row) else row
            steps += 1
        return place
