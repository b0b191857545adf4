"""Recompression: a run-length grammar of a sequence, with longest common extensions.

A sequence of letters is rewritten round by round.  Block compression replaces
each maximal block of one letter by a name for (letter, length); pair compression
deals the letters into lefts and rights by their names alone and replaces each
adjacent left-right pair by a name for (left, right).  Equal stretches are
therefore rewritten equally but for a symbol at either end of a level, and the
levels form a balanced run-length grammar of the sequence.

``Grammar.extend`` answers many longest-common-extension queries at once, to the
right or to the left: both places climb the levels while they begin (end) a
parent and agree, step over a symbol, or what two blocks have in common, where
they don't begin one, and go down at the first difference.  Two steps a level are
enough, so a query costs the number of levels; no suffix array is made.
"""

from __future__ import annotations

import numpy as np

_SALTS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


class Level:
    """One level's symbols and the places of their parents in the next."""

    def __init__(self, sym: np.ndarray):
        self.sym = sym
        self.parent = self.new = self.blocks = None

    def grow(self, new: np.ndarray, blocks: bool) -> None:
        """``new``: whether a symbol begins a parent."""
        self.new, self.blocks = new, blocks
        self.parent = np.cumsum(new) - 1


def _names(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _lefts(sym: np.ndarray) -> np.ndarray:
    """Which symbols are lefts: by a mixed bit of the name, of a few mixes the one that makes most pairs."""
    best, most = None, -1
    for salt in _SALTS:
        x = (sym + 1) * salt & 0xFFFFFFFF
        bit = ((x ^ x >> 15) * 0x2C1B3C6D >> 13 & 1).astype(bool)
        for left in (bit, ~bit):
            n = np.count_nonzero(left[:-1] & ~left[1:])
            if n > most:
                best, most = left, n
    return best


def _levels(sym: np.ndarray) -> list[Level]:
    """From the letters up, until one symbol is left or, among letters that never repeat, nothing is gained."""
    out = [Level(sym)]
    while len(out[-1].sym) > 1:
        at = out[-1]
        new = np.ones(len(at.sym), bool)
        np.not_equal(at.sym[1:], at.sym[:-1], out=new[1:])
        if not new.all():
            at.grow(new, True)
            first = np.flatnonzero(new)
            out.append(Level(_names(at.sym[first] << 32 | np.diff(first, append=len(new)))))
            at = out[-1]
            if len(at.sym) == 1:
                break
        left = _lefts(at.sym)
        new = np.ones(len(at.sym), bool)
        new[1:] = ~(left[:-1] & ~left[1:])
        if new.all():  # no left stands before a right: the mixes leave one side empty
            left = at.sym == at.sym[0]
            new[1:] = ~(left[:-1] & ~left[1:])
        at.grow(new, False)
        first = np.flatnonzero(new)
        paired = np.diff(first, append=len(new)) == 2
        second = np.where(paired, at.sym[np.minimum(first + 1, len(at.sym) - 1)] + 1, 0)
        out.append(Level(_names(at.sym[first] << 32 | second)))
    return out


class Grammar:
    """The grammar of ``letters`` (names from 0).  The first and the last letter must
    occur nowhere else; letters that occur once part texts from each other."""

    def __init__(self, letters: np.ndarray):
        levels = _levels(letters.astype(np.int64))
        self.n = len(letters)
        self.height = len(levels)
        base = np.cumsum([0] + [len(x.sym) for x in levels])
        total = int(base[-1])
        kind = np.int32 if total < 2**31 else np.int64
        self.sym = np.concatenate([x.sym for x in levels]).astype(kind)
        self.parent = np.full(total, -1, kind)
        self.first, self.last = np.zeros((2, total), kind)  # children, from the second level on
        self.begins, self.ends = np.zeros((2, total), bool)  # a parent, if there is one
        self.right, self.left = np.ones((2, total), kind)  # symbols of the block from here on
        for k, x in enumerate(levels[:-1]):
            lo, hi = base[k], base[k + 1]
            self.parent[lo:hi] = base[k + 1] + x.parent
            self.begins[lo:hi] = x.new
            self.ends[lo : hi - 1] = x.new[1:]
            self.ends[hi - 1] = True
            at = np.flatnonzero(x.new)
            end = np.append(at[1:], len(x.new))
            self.first[base[k + 1] : base[k + 2]] = lo + at
            self.last[base[k + 1] : base[k + 2]] = lo + end - 1
            if x.blocks:
                here = np.arange(len(x.new))
                self.right[lo:hi] = end[x.parent] - here
                self.left[lo:hi] = here - at[x.parent] + 1

    def extend(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many letters from ``i`` and from ``j`` on agree, to the right (``step`` 1) or left (-1); i and j differ."""
        edge, child, block = (self.begins, self.first, self.right) if step > 0 else (self.ends, self.last, self.left)
        out = np.zeros(len(i), np.int64)
        who = np.arange(len(i))
        a, b = i.astype(np.int64), j.astype(np.int64)
        down = np.zeros(len(i), bool)
        while len(who):
            same = self.sym[a] == self.sym[b]
            done = ~same & (a < self.n)
            if done.any():
                out[who[done]] = np.abs(a[done] - i[who[done]])
                stay = ~done
                who, a, b, down, same = who[stay], a[stay], b[stay], down[stay], same[stay]
                if not len(who):
                    break
            down |= ~same
            climb = same & ~down & edge[a] & edge[b]
            over = np.minimum(block[a], block[b])
            over *= step
            a, b = (np.where(climb, self.parent[x], np.where(same, x + over, child[x])).astype(np.int64) for x in (a, b))
        return out
