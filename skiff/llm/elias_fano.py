"""Elias-Fano sequences over numpy arrays that may be memory-mapped.

A strictly increasing sequence keeps the low bytes of its values packed, and the
high parts as a bit vector in unary: value i sets bit ``high(i) + i``, so the
zeros part the values by high part.  Select on zeros finds the few values of one
high part; a binary search on their low bytes ends the look-up.  The low part is
whole bytes, the next multiple of eight at or above the optimum.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_BLOCK = 8  # words of 64 bits to a directory entry
U64 = np.uint64


class Zeros:
    """Select on the zeros of a bit vector, with a directory of zeros before every block of words."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @staticmethod
    def build(ones: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and directory of a vector of ``length`` bits with ``ones`` set; padded with ones."""
        n = (length // 64 // _BLOCK + 1) * _BLOCK
        bits = np.zeros(n * 64, bool)
        bits[ones] = True
        bits[length:] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros = (64 - np.bitwise_count(words).astype(np.int64)).reshape(-1, _BLOCK).sum(axis=1)
        return words, np.concatenate([[0], np.cumsum(zeros)])[:-1].astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero of each rank ``k`` (from 0)."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            zeros = 64 - np.bitwise_count(self.words[word]).astype(np.int64)
            go = left >= zeros
            if not go.any():
                break
            left -= np.where(go, zeros, 0)
            word += go
        rest = ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & U64((1 << step) - 1)).astype(np.int64)
            go = left >= low
            left -= np.where(go, low, 0)
            at += np.where(go, step, 0)
            rest = np.where(go, rest >> U64(step), rest)
        return word * 64 + at

    def ranges(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First value, and the end, of each high part."""
        end = self.select(part) - part
        first = np.where(part > 0, self.select(np.maximum(part - 1, 0)) - (part - 1), 0)
        return first, end


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def load(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = low[at, 0].astype(U64) if low.shape[1] else np.zeros(len(at), U64)
    for j in range(1, low.shape[1]):
        out |= low[at, j].astype(U64) << U64(8 * j)
    return out


def search(low: np.ndarray, first: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Place of each target within its own ascending range of packed values, or -1."""
    lo, hi = first.copy(), end.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = load(low, mid) < target[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    out = np.full(len(lo), -1, np.int64)
    at = np.flatnonzero(lo < end)
    at = at[load(low, lo[at]) == target[at]]
    out[at] = lo[at]
    return out


class EliasFano:
    """Look-up in a strictly increasing sequence of unsigned 64-bit values."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low = arrays[f"{name}_low"]
        self.zeros = Zeros(arrays[f"{name}_bits"], arrays[f"{name}_before"])
        self.parts = int(arrays[f"{name}_parts"][0])

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        width = -(-max(0, (universe // max(n, 1)).bit_length() - 1) // 8)
        high = (values >> U64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        parts = int(high[-1]) + 1 if n else 0
        words, before = Zeros.build(high + np.arange(n), n + parts)
        return {f"{name}_low": pack(values, width), f"{name}_bits": words, f"{name}_before": before, f"{name}_parts": np.array([parts])}

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each value, or -1."""
        width = self.low.shape[1]
        part = (x >> U64(8 * width)).astype(np.int64) if width < 8 else np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        at = np.flatnonzero(part < self.parts)
        if len(at):
            first, end = self.zeros.ranges(part[at])
            own = x[at] & U64((1 << (8 * width)) - 1) if width < 8 else x[at]
            out[at] = search(self.low, first, end, own)
        return out


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays, each from a multiple of 64 bytes on; it appears whole or not at all."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 64)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    os.replace(own, path)


def read(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(data[8 : 8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(data[8 + size + at : 8 + size + at + n]).view(kind).reshape(shape) if n else np.zeros(shape, kind)
    return out
