"""Benchmark decontamination by greedy string tiling.

Benchmark and documents are words in lower case without punctuation.  Every
window of ``min_match`` words of a benchmark item is a seed; a document is read
once, its windows are hashed by a running Karp-Rabin sum and joined with the
seeds (a bit table first, then the sorted seed hashes).  For each (document,
item) pair that shares a seed the matches are extended along their diagonals and
tiled: the longest match of words not yet marked is marked in both, again and
again, until none of ``min_match`` words is left.  Tiles don't overlap and may
come in any order, so reordered passages are caught.  A pair counts when the
tiles cover at least ``threshold`` of the item's words.

The benchmark is the query set and goes out in blocks of about ``block_bytes``
of text, so what a block broadcasts is bounded whatever the benchmark's size;
all documents meet all blocks and nothing is shuffled.

Defined cases: null and empty texts match nothing; an item of fewer than
``min_match`` words has no seed and contaminates nothing; repeated documents or
items give one row each, null ids too; a pair of texts of few words many times over
takes memory in the sum of its lengths; an empty benchmark or corpus gives no rows; ties
between tiles go to the earliest place in the item, then in the document; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow, small_batches
from skiff.llm.textops import PUNCTUATION, Texts, mix, slices

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
_BITS = 22


@dataclass
class Seeds:
    """One block of the benchmark: its items' words, and all windows sorted by hash."""

    ids: pa.Array
    words: np.ndarray
    at: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    k: int

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return bits


def seeds(ids: pa.Array, texts: pa.Array, k: int) -> Seeds:
    x = Texts(texts, "unicode", PUNCTUATION)
    h = x.hashes()
    w, inside = x.windows(h, k)
    at = np.flatnonzero(inside)
    order = np.argsort(w[at], kind="stable")
    at = at[order]
    return Seeds(ids, h, x.at, w[at], x.doc[at], at - x.at[x.doc[at]], k)


def tile(hits: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length) from seed hits,
    rows of (place in document, place in item)."""
    diagonal = hits[:, 0] - hits[:, 1]
    order = np.lexsort((hits[:, 1], diagonal))
    diagonal, place = diagonal[order], hits[order, 1]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(order))) + k - 1
    heap = [(-n, i, i + d) for n, i, d in zip(size.tolist(), place[first].tolist(), diagonal[first].tolist())]
    heapq.heapify(heap)
    in_item, in_doc, out = bytearray(n_item), set(), []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [not in_item[i + j] and d + j not in in_doc for j in range(n)]
        if all(free):
            out.append((i, d, n))
            in_item[i : i + n] = b"\1" * n
            in_doc.update(range(d, d + n))
            if all(in_item):
                break
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (start - j, i + start, d + start))
                start = None
    return out


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Running Karp-Rabin hashes of a word sequence: the hash of each beginning of it."""
    out = np.zeros(len(words) + 1, np.uint64)
    # in doublings: h(a + b) = h(a) * base^len(b) + h(b)
    out[1:] = words
    step = 1
    while step < len(words):
        out[1 + step :] += out[1:-step] * _power(step)
        step *= 2
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


_BASE = 0x9E3779B97F4A7C15


def _rolled(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words."""
    return mix(prefix[n:] - prefix[:-n] * _power(n))


def _free(taken: np.ndarray, n: int) -> np.ndarray:
    """Whether each window of ``n`` places has no taken one."""
    c = np.zeros(len(taken) + 1, np.int64)
    np.cumsum(taken, out=c[1:])
    return c[n:] == c[:-n]


def tile_long(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile``, from the two word sequences and in memory of their lengths:
    the longest length at which free windows of both have equal running hashes is found by
    halving, its matches are marked in order of their place in the item, and so on down to ``k``."""
    sides = _prefixes(item), _prefixes(doc)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the item's windows, and the free places of item and document whose hashes meet."""
        a, b = (_rolled(p, n) for p in sides)
        i, d = np.flatnonzero(_free(in_item, n)), np.flatnonzero(_free(in_doc, n))
        return a, i[np.isin(a[i], b[d])], d

    most = min(len(item), len(doc))
    while most >= k:
        if not len(shared(k)[1]):
            break
        low, high = k, most
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if len(shared(half)[1]) else (low, half - 1)
        a, places, d = shared(low)
        b = _rolled(sides[1], low)[d]
        order = np.lexsort((d, b))
        d, b = d[order], b[order]
        first = np.searchsorted(b, a[places])
        spot: dict[int, int] = {}  # of each hash, the first document place that may still be free
        for i, f in zip(places.tolist(), first.tolist()):
            if in_item[i : i + low].any():
                continue
            j = spot.get(f, f)
            while j < len(b) and b[j] == a[i] and in_doc[d[j] : d[j] + low].any():
                j += 1
            spot[f] = j
            if j < len(b) and b[j] == a[i]:
                at = int(d[j])
                out.append((i, at, low))
                in_item[i : i + low] = True
                in_doc[at : at + low] = True
        most = low - 1
    return out


#: Seed hits of a slice that are listed at once; a document with more is matched by ``tile_long``.
HITS = 1 << 20


def matches(block: Seeds, bits: np.ndarray, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
    """(row, item, its words, covered words, tiles) of each contaminated pair."""
    x = Texts(texts, "unicode", PUNCTUATION)
    h = x.hashes()
    w, inside = x.windows(h, block.k)
    at = np.flatnonzero(bits[(w & np.uint64((1 << _BITS) - 1)).astype(np.int64)] & inside)
    lo, hi = np.searchsorted(block.seed, w[at], "left"), np.searchsorted(block.seed, w[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    doc = x.doc[at]
    cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))  # first hit of each document, and the end
    hits = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a + 1 < len(cut):
        if hits[cut[a + 1]] - hits[cut[a]] > HITS:
            own = slice(cut[a], cut[a + 1])
            yield from _heavy(block, h[x.at[doc[cut[a]]] : x.at[doc[cut[a]] + 1]], int(doc[cut[a]]), lo[own], n[own], threshold)
            a += 1
            continue
        b = a + 1
        while b + 1 < len(cut) and hits[cut[b + 1]] - hits[cut[a]] <= HITS:
            b += 1
        own = slice(cut[a], cut[b])
        yield from _listed(block, doc[own], at[own] - x.at[doc[own]], lo[own], n[own], threshold)
        a = b


def _reach(places: np.ndarray, k: int, words: int) -> int:
    """Words of the item in any seed hit: no tiling covers more."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + k, -1)
    return np.count_nonzero(np.cumsum(edge)[:words])


def _listed(block: Seeds, doc: np.ndarray, spot: np.ndarray, lo: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Documents whose hits are listed: each (place in document, place in item) of equal windows."""
    where = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    row, item, spot = np.repeat(doc, n), block.item[where], np.repeat(spot, n)
    order = np.lexsort((spot, item, row))
    row, item, pairs = row[order], item[order], np.stack([spot, block.place[where]], axis=1)[order]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(cut, [*cut[1:], len(row)]):
        words = int(block.at[item[a] + 1] - block.at[item[a]])
        if _reach(pairs[a:b, 1], block.k, words) >= threshold * words:
            tiles = tile(pairs[a:b], block.k, words)
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * words:
                yield int(row[a]), int(item[a]), words, covered, tiles


def _heavy(block: Seeds, doc: np.ndarray, row: int, lo: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple]:
    """A document whose windows repeat so often that its hits would grow as a product of lengths:
    each different window is looked up once, and items that it may cover are tiled by running hashes."""
    lo, first = np.unique(lo, return_index=True)
    n = n[first]
    where = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    item, place = block.item[where], block.place[where]
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    cut = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for a, b in zip(cut[:-1], cut[1:]):
        start, end = (int(v) for v in block.at[item[a] : item[a] + 2])
        if _reach(place[a:b], block.k, end - start) >= threshold * (end - start):
            tiles = tile_long(block.words[start:end], doc, block.k)
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * (end - start):
                yield row, int(item[a]), end - start, covered, tiles


def blocks(benchmark: DataFrame, k: int, block_bytes: int, id_column: str, text_column: str) -> Iterator[Seeds]:
    items = narrow(benchmark, id_column, text_column).toDF("id", "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n if total else 0):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).toArrow().combine_chunks()
        if own.num_rows:
            yield seeds(pa.concat_arrays(own["id"].chunks), pa.concat_arrays(own["text"].chunks), k)


def _over(docs: DataFrame, block: Seeds, threshold: float, schema, emit: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = own.table()
        for batch in batches:
            for part in slices(batch, "text"):
                yield emit(part, own, matches(own, bits, part.column("text"), threshold))

    return small_batches(docs).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per contaminated pair: document id, item id, item_words, covered_words,
    coverage, and the tiles as places in item and document and lengths (in words)."""
    rows = narrow(docs, id_column, text_column).toDF("id", "text")
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, item_words long, covered_words long, coverage double, tiles array<struct<item_at:long,doc_at:long,words:long>>"
    tiles_type = pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))

    def emit(part: pa.RecordBatch, block: Seeds, found) -> pa.RecordBatch:
        got = list(found)
        return pa.record_batch(
            [
                part.column("id").take(pa.array([g[0] for g in got], pa.int64())),
                block.ids.take(pa.array([g[1] for g in got], pa.int64())),
                pa.array([g[2] for g in got], pa.int64()),
                pa.array([g[3] for g in got], pa.int64()),
                pa.array([g[3] / g[2] for g in got], pa.float64()),
                pa.array([[dict(zip(("item_at", "doc_at", "words"), t)) for t in g[4]] for g in got], tiles_type),
            ],
            names=["id", "item", "item_words", "covered_words", "coverage", "tiles"],
        )

    out = None
    for block in blocks(benchmark, min_match, block_bytes, item_column, item_text_column):
        one = _over(rows, block, threshold, schema, emit)
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents (all their columns) that no benchmark item contaminates; blocks filter one after another."""
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = out.withColumn("text", F.col(f"c{docs.columns.index(text_column)}"))

    def emit(part: pa.RecordBatch, block: Seeds, found) -> pa.RecordBatch:
        keep = np.ones(part.num_rows, bool)
        keep[[g[0] for g in found]] = False
        return part.filter(pa.array(keep))

    for block in blocks(benchmark, min_match, block_bytes, item_column, item_text_column):
        out = _over(out, block, threshold, out.schema, emit)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
