"""Best-fit-decreasing packing of token sequences.

1. Every text is encoded once (library ids, then an end id) and cut into pieces
   of at most ``capacity``; one narrow row per piece goes to the shared folder.
2. Pieces of equal length are interchangeable, so the plan needs only the
   number of pieces of each length: at most ``capacity`` rows, however large the
   corpus.  From the longest length down, a segment tree over remaining
   capacities finds the tightest open bins (logarithmic time a search); bins with
   the same history form one group, and a run "ranks a..b of length s go to bins
   from x on, q to a bin, at offset o" places all pieces that a group takes at
   once.  This is best-fit decreasing piece by piece: the bin that took the last
   piece stays the tightest while it fits.
3. A piece's rank among those of its length is the number in earlier input
   partitions plus its place in its own; the runs (a few per group) turn rank
   into sequence and offset on the executors.

Defined cases: null and empty texts are one end id; a text longer than
``capacity`` is cut into full pieces and a rest; ids need not be unique, every
row is packed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.common import kept, narrow
from skiff.llm.textops import held, slices

#: Entries of the word cache (about 200 bytes an entry); a full cache starts anew.
CACHE = 1_200_000
#: Texts made only of these have known letters, digits, case and normal form; others go whole through the library.
_PLAIN = r"\t\n\r -~À-ÖØ-öø-įı-ž‘’“”–—…•€«»¿¡§©®°"
_ODD = re.compile(f"[^{_PLAIN}]|<\\|")
#: The tokenizer file's own word pattern, over that alphabet.
_WORD = re.compile(r"[a-zß-öø-ž]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ž0-9]+")


class Known(dict):
    """Ids by word; what is asked for and missing is listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.new.append(word)
        return b""


class WordIds:
    """Ids of the texts by a ``tokenizers`` file whose words end in ``</w>``.

    White space parts words, so a text's ids are those of its stretches without
    white space, and theirs those of their words.  The library encodes each new
    word once per worker; a bounded cache keeps the ids of words and stretches.
    Texts with characters outside the plain alphabet, or with special strings,
    are encoded whole."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.known = Known()

    def learn(self, stretches: set[str]) -> None:
        known = self.known
        split = {s: _WORD.findall(s) for s in stretches if not s.isalpha()}
        new = [s for s in stretches if s not in split]
        new += {w for ws in split.values() for w in ws if w not in known and w not in stretches or w in split}
        if new:
            ids = self.library.encode(" ".join(new), add_special_tokens=False).ids
            raw, at, n = np.array(ids, "<u4").tobytes(), 0, 0
            for e in (np.flatnonzero(self.last[ids]) * 4 + 4).tolist():
                known[new[n]] = raw[at:e]
                at, n = e, n + 1
            if n != len(new) or at != len(raw):
                raise ValueError("the tokenizer file splits words in another way")
        for s, ws in split.items():
            known[s] = b"".join([known[w] for w in ws])

    def text(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        own, known = text.lower().split(), self.known
        if len(known) >= CACHE:
            known.clear()
        ids = b"".join(map(known.__getitem__, own))
        if known.new:
            self.learn(set(known.new))
            known.new.clear()
            ids = b"".join(map(known.__getitem__, own))
        return ids


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its input
    partition ``part`` with its ``place`` among that partition's pieces of its length."""
    end, key = int(end_id).to_bytes(4, "little"), f"ids {tokenizer_file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held(key, lambda: WordIds(tokenizer_file))
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20, key):
                which, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(rows.column("text").to_pylist()):
                    raw = ids.text(text) + end
                    for j, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        which.append(k)
                        piece.append(j)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                length = np.array(length)
                order = np.argsort(length, kind="stable")
                sizes, first, n = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                yield pa.record_batch(
                    [rows.column("id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(length), part), pa.int64()), pa.array(place)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    rows = narrow(docs, id_column, text_column).toDF("id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, place long")


class Tightest:
    """Segment tree over remaining capacities 0..capacity: the least one at or above a size with an open bin."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.half)

    def set(self, at: int, is_open: bool) -> None:
        i = at + self.half
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, size: int) -> int | None:
        i = size + self.half
        if self.open[i]:
            return size
        while i > 1:  # up to the first open right neighbour, then down to its leftmost open leaf
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.half
            i //= 2
        return None


@dataclass
class Plan:
    """Runs by (length, first rank): first bin, pieces to a bin, offset of the first in a bin."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given their length and rank."""
        # a length is below 2^15, a rank below 2^48: both make one ascending key
        run = (self.length << 48) | self.rank
        i = np.searchsorted(run, (length << 48) | rank, "right") - 1
        k = rank - self.rank[i]
        return self.bin[i] + k // self.each[i], self.offset[i] + (k % self.each[i]) * length


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing for ``counts[length]`` pieces of each length."""
    if capacity >= 1 << 15:
        raise ValueError("sequences of 2^15 tokens or more")
    tree = Tightest(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first bin, bins)
    runs, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            own = groups.setdefault(remaining, [])
            if not own:
                tree.set(remaining, True)
            own.append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.find(size)
            if remaining is None:
                remaining, first = capacity, bins
                n = -(-left // (capacity // size))
                bins += n
            else:
                first, n = groups[remaining].pop()
                if not groups[remaining]:
                    tree.set(remaining, False)
            each = remaining // size
            full, more = divmod(min(left, n * each), each)
            runs.append((size, rank, first, each, capacity - remaining))
            put(remaining - each * size, first, full)
            if more:
                put(remaining - more * size, first + full, 1)
            put(remaining, first + full + bool(more), n - full - bool(more))
            rank += full * each + more
            left -= full * each + more
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*a, bins)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = kept(pieces(docs, tokenizer_file, capacity, end_id, id_column, text_column), "pieces")
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
                yield pa.record_batch([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    kind = rows.schema["id"].dataType.simpleString()
    out = ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
