"""A word-level FM-index over one shard: wavelet-matrix ranks and sampled suffix positions.

The shard is a list of runs (arrays of word codes 1..sigma).  Every run ends with its own
separator, so suffixes differ within a run's length and sorting stays shallow.
"""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, is_sep: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; separators (ranked by place) end comparisons."""
    n = len(codes)
    n_sep = int(is_sep.sum())
    key = codes.astype(np.int64) + n_sep
    key[is_sep] = np.arange(n_sep)
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        key = (rank + 1) << 32
        key[:-step] |= rank[step:] + 1
        step *= 2


class WaveletMatrix:
    """Ranks and symbols of a sequence of codes below ``1 << levels``."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels = levels
        self.bits: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before place ``i``."""
        at, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        for depth in range(self.levels):
            one = (code >> (self.levels - 1 - depth) & 1).astype(bool)
            ones, z = self.ones[depth], self.zeros[depth]
            a, s = ones[at], ones[start]
            at = np.where(one, z + a, at - a)
            start = np.where(one, z + s, start - s)
        return at - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at place ``i`` and how often it stands before it."""
        at, start, code = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for depth in range(self.levels):
            one = self.bits[depth][at]
            ones, z = self.ones[depth], self.zeros[depth]
            a, s = ones[at], ones[start]
            at = np.where(one, z + a, at - a)
            start = np.where(one, z + s, start - s)
            code = code << 1 | one
        return code, at - start


class FMIndex:
    def __init__(self, runs: list[np.ndarray], sigma: int, sample: int = 8):
        lengths = np.array([len(r) for r in runs], np.int64)
        self.starts = np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(runs) else np.zeros(0, np.int64)
        n = int(lengths.sum() + len(runs))
        codes = np.zeros(n, np.int64)
        is_sep = np.zeros(n, bool)
        is_sep[self.starts + lengths] = True
        codes[~is_sep] = np.concatenate(runs) if runs else 0
        self.n, self.sample = n, sample
        order = suffix_array(codes, is_sep)
        self.wavelet = WaveletMatrix(codes[order - 1], max(1, int(sigma).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(codes, minlength=sigma + 1))]
        # Places are sampled from each run's start, so a walk ends before it meets a separator.
        place = np.arange(n) - np.repeat(self.starts, lengths + 1)
        self.marked = place[order] % sample == 0
        self.kept = order[self.marked]
        self.mark_rank = np.cumsum(self.marked) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns at once (rows of codes, padded at the end), last word first."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        hi[lengths <= 0] = 0
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lo[live] < hi[live])]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            c = patterns[now, lengths[now] - back]
            lo[now] = self.first[c] + self.wavelet.rank(c, lo[now])
            hi[now] = self.first[c] + self.wavelet.rank(c, hi[now])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows, by stepping back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[at[todo]]
            here = todo[done]
            out[here] = self.kept[self.mark_rank[at[here]]] + steps[here]
            todo = todo[~done]
            if len(todo):
                c, before = self.wavelet.access(at[todo])
                at[todo] = self.first[c] + before
                steps[todo] += 1
        return out
