"""Language-model scoring with an Elias-Fano n-gram trie (bigrams over unigrams).

Training counts words and word pairs of all training texts, an end after each
text included, and writes the trie's levels as files in the shared folder:

* level 1, by ranges of word hash: the sorted hashes as an Elias-Fano sequence
  (a word's id is its rank), their counts, and the number of distinct successors
  of each word, from which its back-off weight follows;
* level 2, by a hash of the pair, so that a frequent first word is spread over
  all files: the sorted context ids as an Elias-Fano sequence, monotone pointers
  to each context's successors as a unary bit vector, the successors' ids packed
  and ascending within their context, and one byte each for the quantised
  logarithm of the discounted probability.

A query finds its context, takes the pointer range, and searches the successor
within that range.  Scoring maps the files it needs into memory; look-ups are
done once per distinct pair of a slice of texts, file by file in sorted order.
The number of files grows with the input's partitions, so a file stays small.

Smoothing: ``P(w | v) = max(c(v w) - D, 0) / c(v) + D * N(v) / c(v) * P(w)``, with
``N(v)`` distinct successors; unigrams are discounted by their counts of counts
(three classes), and the mass left over goes in equal parts to the estimated
number of unseen words (Chao's lower bound).  A pair whose first word is unknown
falls back to ``P(w)``.

What crosses the shuffle are sorted blocks of (word or pair, count), combined
within each task, as one binary value per task and file.

Defined cases: null and empty texts are one end; repeated rows count each; an
empty training set gives probability by the unseen share alone (one unseen
word); ties don't arise; extra columns are ignored.  The shared folder must be a
path that all executors can map (``file:`` or plain).
"""

from __future__ import annotations

import math
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow, shared_folder
from skiff.llm.elias_fano import EliasFano, Zeros, pack, read, search, write
from skiff.llm.textops import Texts, mix, slices

DISCOUNT = 0.75
#: Distinct pairs that a task holds before it sends them on.
HELD = 3_000_000
#: Files that a worker keeps mapped.
OPEN = 4096
END = np.uint64(0x5851F42D4C957F2D)
U64 = np.uint64


def tokens(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end after each text, and each text's first token (with the end)."""
    first = x.at + np.arange(x.n + 1)
    out = np.full(first[-1], END, U64)
    out[np.arange(len(x.start)) + x.doc] = x.hashes()
    return out, first


def folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def planes(a: np.ndarray) -> bytes:
    """The array byte plane by byte plane, which the shuffle's compression can shrink."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def encode(key: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts."""
    return planes(np.diff(key, prepend=U64(0)).astype("<u8")) + planes(count.astype("<u8"))


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.cumsum(from_planes(raw[:half], "<u8"), dtype=U64), from_planes(raw[half:], "<u8").astype(np.int64)


def _sent(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One row per file: its keys (ascending as given) and counts."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    raw = [encode(keys[o], counts[o]) for o in np.split(order, first[1:])]
    return pa.record_batch([pa.array(part[first].astype(np.int32)), pa.array(raw, pa.binary())], names=["part", "data"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and summed counts of each file, from rows sorted by file."""
    now, wait = None, []
    for b in batches:
        for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
            if part != now and wait:
                yield now, *folded(*zip(*wait))
                wait = []
            now = part
            wait.append(decode(raw))
    if wait:
        yield now, *folded(*zip(*wait))


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    """File of a word: an equal range of hashes each."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def pair_part(pair: np.ndarray, parts: int) -> np.ndarray:
    return (mix(pair) % U64(parts)).astype(np.int64)


class Words:
    """Level 1 over all its files: ids, counts and numbers of successors."""

    def __init__(self, folder: str, base: np.ndarray):
        self.folder, self.base, self.parts = folder, base, len(base) - 1
        self.files: OrderedDict[str, dict] = OrderedDict()

    def file(self, name: str) -> dict:
        """A file's arrays, mapped when first used; the longest unused ones are let go."""
        got = self.files.get(name)
        if got is None:
            got = self.files[name] = read(f"{self.folder}/{name}")
            if len(self.files) > OPEN:
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return got

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Id of each ascending hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        cuts = np.searchsorted(hash_part(h, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            if self.base[p + 1] > self.base[p]:
                rank = EliasFano(self.file(f"words-{p}"), "hash").find(h[cuts[p] : cuts[p + 1]])
                out[cuts[p] : cuts[p + 1]] = np.where(rank >= 0, rank + self.base[p], -1)
        return out

    def of_ids(self, ids: np.ndarray, name: str, array: str) -> np.ndarray:
        """A value per ascending id."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.base)
        for p in np.flatnonzero(np.diff(cuts)):
            out[cuts[p] : cuts[p + 1]] = self.file(f"{name}-{p}")[array][ids[cuts[p] : cuts[p + 1]] - self.base[p]]
        return out


@dataclass
class Model:
    """Where the trie lies, and its totals."""

    folder: str
    base: np.ndarray
    pair_parts: int
    tokens: int
    texts: int
    discounts: tuple[float, float, float]
    unseen_log: float
    start_successors: int = 0
    words: Words | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": None}

    @property
    def types(self) -> int:
        return int(self.base[-1])

    def level1(self) -> Words:
        if self.words is None:
            self.words = Words(self.folder, self.base)
        return self.words

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) from the word's training count; 0 is an unseen word."""
        d = np.array([0.0, *self.discounts])[np.minimum(count, 3)]
        return np.where(count > 0, np.maximum(count - d, 1e-9) / max(self.tokens, 1), 10.0**self.unseen_log)

    def pairs(self, pair: np.ndarray) -> np.ndarray:
        """Discounted P(w | v) of each distinct pair of ids (v << 32 | w); 0 if not in the trie."""
        out = np.zeros(len(pair))
        part = pair_part(pair, self.pair_parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.pair_parts + 1))
        level = self.level1()
        for p in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[p] : cuts[p + 1]]
            f = level.file(f"pairs-{p}")
            v = pair[at] >> U64(32)  # ascending: the order within a file is that of the pairs
            first = np.concatenate([[True], v[1:] != v[:-1]])
            rank = EliasFano(f, "context").find(v[first])
            begin, end = Zeros(f["ptr_bits"], f["ptr_before"]).ranges(np.maximum(rank, 0))
            begin, end = np.where(rank >= 0, begin, 0), np.where(rank >= 0, end, 0)
            of = np.cumsum(first) - 1
            spot = search(f["successor"], begin[of], end[of], pair[at] & U64(0xFFFFFFFF))
            out[at] = np.where(spot >= 0, f["codebook"][f["code"][np.maximum(spot, 0)]], 0.0) if len(f["code"]) else 0.0
        return out


def word_level(h: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    return EliasFano.build(h, 2**64, "hash") | {"count": count.astype("<u8") if len(count) and count.max() >= 2**32 else count.astype("<u4")}


def pair_level(pair: np.ndarray, count: np.ndarray, types: int, context_count: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts, monotone pointers, successors and quantised probabilities of a file's ascending pairs."""
    v, w = pair >> U64(32), pair & U64(0xFFFFFFFF)
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    rank = np.cumsum(first) - 1
    contexts = v[first]
    # pointers in unary: a one per successor, a zero ends each context
    words, before = Zeros.build(np.arange(len(w)) + rank, len(w) + len(contexts))
    value = np.log10(np.maximum(count - DISCOUNT, 1e-9) / context_count[rank]) if len(w) else np.zeros(0)
    edges = np.unique(np.quantile(value, np.linspace(0, 1, 257)[1:-1])) if len(w) else np.zeros(0)
    code = np.searchsorted(edges, value, "right")
    total, n = np.bincount(code, value, minlength=256), np.bincount(code, minlength=256)
    return EliasFano.build(contexts, types + 1, "context") | {
        "ptr_bits": words,
        "ptr_before": before,
        "successor": pack(w, max(1, -(-int(types).bit_length() // 8))),
        "code": code.astype(np.uint8),
        "codebook": 10.0 ** (total / np.maximum(n, 1)),
    }


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: the trie's levels are memory-mapped; the shared folder must be a mounted path")
    return path


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return narrow(docs, id_column, text_column).toDF("id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def train(docs: DataFrame, where: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Write the trie of all texts (those ``where`` holds) to the shared folder."""
    spark = docs.sparkSession
    rows = _texts(docs.filter(where) if where is not None else docs, id_column, text_column).select("text")
    parts = max(4, 2 * docs.rdd.getNumPartitions())
    folder = _local(shared_folder(spark, "trie"))
    os.makedirs(folder, exist_ok=True)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                k, c = np.unique(tokens(Texts(part.column("text"), "ascii"))[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= HELD:
                    k, c = folded(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held >= HELD // 2:
                        yield _sent(k, c, hash_part(k, parts))
                        keys, counts, held = [], [], 0
        if keys:
            k, c = folded(keys, counts)
            yield _sent(k, c, hash_part(k, parts))

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, k, c in _by_part(batches):
            write(f"{folder}/words-{part}", word_level(k, c))
            f = [int(np.count_nonzero(c == j)) for j in (1, 2, 3, 4)]
            end = np.searchsorted(k, END)
            texts = int(c[end]) if end < len(k) and k[end] == END else 0
            yield pa.record_batch([pa.array([v]) for v in (part, len(k), int(c.sum()), texts, *f)], names=["part", "types", "tokens", "texts", "f1", "f2", "f3", "f4"])

    blocks = _gathered(rows.mapInArrow(words, "part int, data binary"), parts)
    # one row of totals per file
    totals = blocks.mapInArrow(build_words, "part long, types long, tokens long, texts long, f1 long, f2 long, f3 long, f4 long").collect()
    types = np.zeros(parts, np.int64)
    for r in totals:
        types[r["part"]] = r["types"]
    base = np.concatenate([[0], np.cumsum(types)])
    if base[-1] >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct words: a pair's ids no longer fit 64 bits")
    f1, f2, f3, f4 = (sum(r[f"f{j}"] for r in totals) for j in (1, 2, 3, 4))
    n, texts = sum(r["tokens"] for r in totals), sum(r["texts"] for r in totals)
    y = f1 / max(f1 + 2 * f2, 1)
    discounts = tuple(min(max(j - (j + 1) * y * b / max(a, 1), 0.05), j - 0.05) for j, a, b in ((1, f1, f2), (2, f2, f3), (3, f3, f4)))
    left = (discounts[0] * f1 + discounts[1] * f2 + discounts[2] * max(int(base[-1]) - f1 - f2, 0)) / n if n else 1.0
    unseen = max(1.0, f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2)
    model = Model(folder, base, parts, n, texts, discounts, math.log10(max(left, 1e-12)) - math.log10(unseen))
    if not n:
        return model
    shared = spark.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, level = shared.value, shared.value.level1()
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = tokens(Texts(part.column("text"), "ascii"))
                k, c = np.unique(text_pairs(h, first, level, own.types)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= HELD:
                    k, c = folded(keys, counts)
                    yield _sent(k, c, pair_part(k, parts))
                    keys, counts, held = [], [], 0
        if keys:
            k, c = folded(keys, counts)
            yield _sent(k, c, pair_part(k, parts))

    def build_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, level = shared.value, shared.value.level1()
        for part, k, c in _by_part(batches):
            v = k >> U64(32)
            contexts, successors = np.unique(v, return_counts=True)
            known = contexts < own.types
            total = np.full(len(contexts), max(own.texts, 1))
            total[known] = level.of_ids(contexts[known].astype(np.int64), "words", "count")
            write(f"{folder}/pairs-{part}", pair_level(k, c, own.types, total))
            # a first word's successors are spread over all files: send the numbers to the word's own
            to = np.minimum(np.searchsorted(own.base, contexts.astype(np.int64), "right") - 1, parts - 1)
            yield _sent(contexts, successors, to)

    def build_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, k, c in _by_part(batches):
            n = np.zeros(int(own.base[part + 1] - own.base[part]) + 1, "<u4")
            n[k.astype(np.int64) - own.base[part]] = c
            write(f"{folder}/successors-{part}", {"n": n})
            yield pa.record_batch([pa.array([part]), pa.array([int(c[k >= U64(own.types)].sum())])], names=["part", "start"])

    blocks = _gathered(rows.mapInArrow(pairs, "part int, data binary"), parts)
    numbers = _gathered(blocks.mapInArrow(build_pairs, "part int, data binary"), parts)
    done = numbers.mapInArrow(build_weights, "part long, start long").collect()
    model.start_successors = sum(r["start"] for r in done)
    return model


def text_pairs(h: np.ndarray, first: np.ndarray, level: Words, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: the pair (id before << 32 | own id), the id before (-1: unknown),
    whether both are known, and the token's count in training."""
    distinct, at = np.unique(h, return_inverse=True)
    ids = level.ids(distinct)
    known = np.flatnonzero(ids >= 0)
    count = np.zeros(len(ids), np.int64)
    count[known] = level.of_ids(ids[known], "words", "count")
    own = ids[at]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first[:-1]] = types  # a text's start is the id after the last word's
    both = (own >= 0) & (before >= 0)
    pair = (np.maximum(before, 0).astype(U64) << U64(32)) | np.maximum(own, 0).astype(U64)
    return pair, before, both, count[at]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score (add-one unigrams), score (log10 probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("id"), *(pa.array(a) for a in text_scores(own, part.column("text")))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    rows = _texts(docs, id_column, text_column)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_column)


def text_scores(m: Model, texts: pa.Array) -> tuple[np.ndarray, ...]:
    level = m.level1()
    h, first = tokens(Texts(texts, "ascii"))
    pair, before, both, count = text_pairs(h, first, level, m.types)
    base = np.log10(count + 1.0) - math.log10(m.tokens + m.types + 1)
    p = m.unigram(count)
    # back-off weight of each token's context, once per distinct context
    seen, at = np.unique(before[before >= 0], return_inverse=True)
    if m.types and len(seen):
        words = np.searchsorted(seen, m.types)
        total, n = np.full(len(seen), max(m.texts, 1), np.int64), np.full(len(seen), m.start_successors, np.int64)
        total[:words] = level.of_ids(seen[:words], "words", "count")
        n[:words] = level.of_ids(seen[:words], "successors", "n")
        weight = np.where(n > 0, DISCOUNT * n / np.maximum(total, 1), 1.0)
        p[before >= 0] *= weight[at]
        distinct, back = np.unique(pair[both], return_inverse=True)
        p[both] += m.pairs(distinct)[back]
    sums = [np.add.reduceat(a, first[:-1]) for a in ((count > 0).astype(np.int64), base, np.log10(p))]
    return np.diff(first), sums[0], sums[1], sums[2]
