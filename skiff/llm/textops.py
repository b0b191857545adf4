"""Words, lines and their hashes over whole Arrow batches.

A batch's texts lie one after another in one UTF-8 buffer, so words, lines,
counts and shingles come from a few numpy passes over that buffer instead of a
Python loop over rows.  Batches are cut into slices of bounded bytes, so the
temporaries stay small whatever the row count; one very long text is one slice.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``.  Null
texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
#: White space and all other ASCII that is neither letter nor digit.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


#: One object of the operator at work, kept between the tasks of a Python worker.
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """The object made for ``key``; that of another key is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, key: str = "") -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``most`` bytes of ``column``; no slice is empty.
    A worker that turns to an operator of another ``key`` lets the held object go."""
    if key not in _held:
        _held.clear()
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch needed


class Texts:
    """Bytes of a column of strings with their word boundaries."""

    def __init__(self, column: pa.Array, lower: str = "", between: np.ndarray = _WS):
        """``lower``: "" keeps the bytes, "ascii" lowers A-Z, "unicode" lowers all letters;
        ``between``: the bytes that part words, white space or ``PUNCTUATION`` too."""
        column = pc.fill_null(column, "")
        if lower == "unicode":
            column = pc.utf8_lower(column)
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        self.n = len(column)
        raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.b = whole[raw[0] : raw[-1]]
        self.off = raw - raw[0]
        if lower == "ascii":
            self.b = _LOWER[self.b]
        ws = between[self.b]
        n = len(self.b)
        first = np.zeros(n + 1, bool)  # a text begins here
        first[self.off] = True
        word = ~ws
        start = word.copy()
        start[1:] &= ws[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ws[1:] | first[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.word = word
        self.at = np.searchsorted(self.start, self.off)  # first word of each text, and the total
        self.n_words = np.diff(self.at)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set bytes in each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def per_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        c = np.zeros(len(flags) + 1, flags.dtype if flags.dtype.kind == "f" else np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.at[1:]] - c[self.at[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans_hash(self.b, self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every ``\\n``-split line; an empty text has one empty line."""
        nl = np.flatnonzero(self.b == 10)
        start = np.sort(np.concatenate([self.off[:-1], nl + 1]))
        doc = np.repeat(np.arange(self.n), 1 + self.per_text(self.b == 10))
        # a line that starts where the next text does belongs to the earlier text first
        end = np.sort(np.concatenate([self.off[1:], nl]))
        return start, end, doc

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``k`` words and whether it lies within one text."""
        m = max(0, len(h) - k + 1)
        w = np.zeros(m, U64)
        for j in range(k):
            w = w * _P + h[j : j + m]
        inside = self.doc[:m] == self.doc[k - 1 : k - 1 + m]
        return mix(w), inside

    def shingles(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each text, ascending, and their text; a text of
        fewer than ``k`` words (at least one) has one shingle of all its words."""
        w, inside = self.windows(h, k)
        at = np.flatnonzero(inside)
        value, doc = w[at], self.doc[at]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if len(short):
            own = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = self.n_words[short] > j
                own[has] = own[has] * _P + h[self.at[short[has]] + j]
            value = np.concatenate([value, mix(own + U64(1))])
            doc = np.concatenate([doc, short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        return value[keep], doc[keep]


def spans_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``b[start:end]``; spans are ascending and don't overlap, and may be empty."""
    out = np.zeros(len(start), U64)
    size = end - start
    full = np.flatnonzero(size > 0)
    if len(full):
        s, length = start[full], size[full]
        total = int(length.sum())
        base = np.cumsum(length) - length
        at = np.arange(total) - np.repeat(base, length)
        most = int(length.max())
        power = np.ones(most, U64)
        np.multiply.accumulate(np.full(most - 1, _P), out=power[1:]) if most > 1 else None
        value = b[np.repeat(s, length) + at].astype(U64) + U64(1)
        value *= power[at]
        out[full] = np.add.reduceat(value, base)
    return mix(out + size.astype(U64) * _M2)


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out
