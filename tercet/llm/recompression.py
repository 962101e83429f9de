"""Run-length grammars of integer sequences by recompression, and their longest common extensions.

Levels alternate. A block level turns every maximal repetition of one symbol into one symbol; a pair
level cuts the symbols into left and right ones by a hash of the level and turns every left-right pair
into one symbol. Both look at neighbours alone, so equal substrings are parsed alike but for their
ends. That is what an extension query uses: from two places it climbs the levels while both are
boundaries, stepping over a symbol or two a level, and comes down again where symbols differ. All
queries of a call move together, level by level, in numpy.
"""

from __future__ import annotations

import numpy as np

from tercet.llm.textkernel import mix


class Grammar:
    """The grammar of ``symbols`` (not negative, below 2^31); ``starts`` has where each sequence begins.

    Sequences are parted by symbols that occur once each, so that no extension leaves its own.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        n, parts = len(symbols), len(starts)
        text = np.full(n + parts + 1, -1, np.int64)
        place = np.arange(n) + np.searchsorted(starts, np.arange(n), "right")
        text[place] = symbols
        gaps = np.flatnonzero(text < 0)
        fresh = int(symbols.max(initial=-1)) + 1
        text[gaps] = fresh + np.arange(len(gaps))
        self.place, self.size = place, len(text)
        self.kinds: list[str] = []
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(text, np.arange(len(text) + 1))]  # symbols, and where each begins
        self._build(len(gaps))

    def _build(self, separators: int) -> None:
        least, still, round_ = 2 * separators + 1, 0, 0
        while len(self.levels[-1][0]) > least and still < 24:
            symbols, begins = self.levels[-1]
            made = self._blocks(symbols, begins) if round_ % 2 == 0 else self._pairs(symbols, begins, round_)
            still = still + 1 if made is None else 0
            if made is not None:
                self.kinds.append("block" if round_ % 2 == 0 else "pair")
                self.levels.append(made)
            round_ += 1

    @staticmethod
    def _named(keys: np.ndarray, merged: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """New numbers: one for each distinct symbol that stays and for each distinct key of those merged."""
        out = np.empty(len(symbols), np.int64)
        stay, kept = np.unique(symbols[~merged], return_inverse=True)
        _, named = np.unique(keys[merged], return_inverse=True)
        out[~merged] = kept
        out[merged] = named + len(stay)
        return out

    def _blocks(self, symbols: np.ndarray, begins: np.ndarray):
        first = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
        at = np.flatnonzero(first)
        if len(at) == len(symbols):
            return None
        times = np.diff(np.append(at, len(symbols)))
        return self._named(symbols[at] << 32 | times, times > 1, symbols[at]), np.append(begins[at], begins[-1])

    def _pairs(self, symbols: np.ndarray, begins: np.ndarray, round_: int):
        left = (mix(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(round_)) & np.uint64(1)).astype(bool)
        joined = left[:-1] & ~left[1:]
        if not joined.any():
            return None
        second = np.zeros(len(symbols), bool)
        second[1:] = joined
        at = np.flatnonzero(~second)
        merged = np.append(joined, False)[at]
        keys = symbols[at] << 32 | symbols[np.minimum(at + 1, len(symbols) - 1)]
        return self._named(keys, merged, symbols[at]), np.append(begins[at], begins[-1])

    def _step(self, level: int, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How far equal symbols of the level reach from boundaries x and y: one symbol, or the shorter of two blocks of it; 0 if they differ."""
        symbols, begins = self.levels[level]
        i, j = np.searchsorted(begins, x), np.searchsorted(begins, y)
        if not forward:
            i, j = i - 1, j - 1
        inside = (i >= 0) & (j >= 0) & (i < len(symbols)) & (j < len(symbols))
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        same = inside & (symbols[i] == symbols[j])
        length = begins[i + 1] - begins[i]
        if level < len(self.kinds) and self.kinds[level] == "block":
            over = self.levels[level + 1][1]  # where blocks begin
            if forward:
                room = np.minimum(over[np.searchsorted(over, x, "right")] - x, over[np.searchsorted(over, y, "right")] - y)
            else:
                room = np.minimum(x - over[np.searchsorted(over, x, "left") - 1], y - over[np.searchsorted(over, y, "left") - 1])
            length = np.where(same, room, length)
        return np.where(same, length, 0)

    def _boundary(self, level: int, x: np.ndarray) -> np.ndarray:
        begins = self.levels[level][1]
        return begins[np.searchsorted(begins, x)] == x

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """Length of the longest equal stretch from places a and b of the sequences on (or, before them, back)."""
        x, y = self.place[a].copy(), self.place[b].copy()
        start, sign = x.copy(), 1 if forward else -1
        top = np.zeros(len(x), np.int64)
        rising = np.arange(len(x))
        for level in range(len(self.levels)):
            moving = rising
            last = level + 1 == len(self.levels)
            lifted = []
            while len(moving):
                if not last:
                    up = self._boundary(level + 1, x[moving]) & self._boundary(level + 1, y[moving])
                    lifted.append(moving[up])
                    moving = moving[~up]
                step = self._step(level, x[moving], y[moving], forward)
                x[moving] += sign * step
                y[moving] += sign * step
                top[moving[step == 0]] = level
                moving = moving[step > 0]
            rising = np.concatenate(lifted) if lifted else rising[:0]
        for level in range(len(self.levels) - 2, -1, -1):
            moving = np.flatnonzero(top > level)
            while len(moving):
                step = self._step(level, x[moving], y[moving], forward)
                x[moving] += sign * step
                y[moving] += sign * step
                moving = moving[step > 0]
        return np.abs(x - start)
