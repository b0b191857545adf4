"""Runs of repeated words: maximal stretches with a smallest period, found through a
recompression grammar, and the text with each run cut to its first period.

All texts of a slice of a batch form one sequence of words, parted by letters that
occur once, and get one grammar (``recompression``).  Candidates lie on the
harmonic grid: a run of period p is at least 2p words long, so it holds a place i
divided by p with i + p in it too.  For every p and every such i whose two words
are equal, two grammar queries give the exact stretch to the right and to the left
over which words p apart agree.  Stretches of at least ``max(least, 2p)`` words are
runs; of equal stretches the least p is the smallest period (a longer period of the
same run is its multiple and has the same ends).  A text of n words has less than
n (1 + ln n) grid places; they are taken in pieces of ``PLACES``, and memory is a
multiple of a slice, which holds whole texts (one very long text is one slice).

Defined cases: null and empty texts have no words, no runs and an empty collapsed
text.  Rows keep their ids, null and repeated ones too; each row is judged by its
own text.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow
from skiff.llm.recompression import Grammar
from skiff.llm.textops import Texts, slices

LEAST = 12
SLICE = 1 << 20
PLACES = 1 << 20


def word_names(x: Texts) -> np.ndarray:
    """A number for each word, equal for equal words only: words of equal hash are compared byte by byte."""
    _, first, name = np.unique(x.hashes(), return_index=True, return_inverse=True)
    size = x.end - x.start
    other = first[name]
    alike = bool((size == size[other]).all())
    if alike and len(size):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        alike = bool((x.b[np.repeat(x.start, size) + within] == x.b[np.repeat(x.start[other], size) + within]).all())
    if not alike:
        raw = x.b.tobytes()
        known: dict[bytes, int] = {}
        name = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(x.start, x.end)], np.int64)
    return name.astype(np.int64)


def _grid(at: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid of texts of ``n`` words whose first words are ``at``, in pieces."""
    periods = n // 2
    text = np.repeat(np.arange(len(n)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (n[text] - 1) // p  # multiples i of p, from 0, with i + p < n
    total = np.cumsum(count)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PLACES, "right")))
        c, q = count[lo:hi], np.repeat(p[lo:hi], count[lo:hi])
        k = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        yield k * q + np.repeat(at[text[lo:hi]], c), q
        lo = hi


def runs_of(name: np.ndarray, n_words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (a word number of the text), length and period of all runs, by text, start and period;
    ``name``: all texts' words one after another."""
    texts = np.arange(len(n_words))
    before = np.cumsum(n_words) - n_words
    # a letter of its own stands before every text and after the last
    letters = np.zeros(len(name) + len(texts) + 1, np.int64)
    at = before + texts + 1
    place = np.arange(len(name)) + np.repeat(texts, n_words) + 1
    letters[place] = name
    alone = np.append(at - 1, len(letters) - 1)
    letters[alone] = (int(name.max()) + 1 if len(name) else 0) + np.arange(len(alone))
    grammar = None
    found = []
    long = n_words >= least
    for i, p in _grid(at[long], n_words[long]):
        hit = letters[i] == letters[i + p]
        if not hit.any():
            continue
        i, p = i[hit], p[hit]
        grammar = grammar or Grammar(letters)
        right = grammar.extend(i, i + p)
        left = grammar.extend(i - 1, i + p - 1, -1)
        size = left + right + p
        run = (size >= least) & (size >= 2 * p)
        if run.any():
            found.append(np.unique(np.stack([i[run] - left[run], size[run], p[run]], axis=1), axis=0))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, size, p = np.unique(np.concatenate(found), axis=0).T  # by start, length, period: of equal stretches the least period first
    keep = np.append(True, (start[1:] != start[:-1]) | (size[1:] != size[:-1]))
    start, size, p = start[keep], size[keep], p[keep]
    order = np.lexsort((p, start))
    start, size, p = start[order], size[order], p[order]
    text = np.searchsorted(at, start, "right") - 1
    return text, start - at[text], size, p


def _collapsed(x: Texts, text: np.ndarray, start: np.ndarray, size: np.ndarray, p: np.ndarray) -> pa.Array:
    """Each text's words but those that a run holds after its first period, joined by one space."""
    edge = np.zeros(len(x.start) + 1, np.int64)
    first = x.at[text] + start
    np.add.at(edge, first + p, 1)
    np.add.at(edge, first + size, -1)
    keep = np.cumsum(edge[:-1]) == 0
    doc, s = x.doc[keep], x.start[keep]
    n = x.end[keep] - s
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    full = n + ~last  # with the space after it
    off = np.cumsum(full) - full
    out = np.full(int(full.sum()), 0x20, np.uint8)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(off, n) + within] = x.b[np.repeat(s, n) + within]
    ends = np.append(off, len(out))[np.searchsorted(doc, np.arange(x.n + 1))]
    return pa.LargeStringArray.from_buffers(x.n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (start, length, period by start and period), collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = Texts(part.column("text"))
                found = runs_of(word_names(x), x.n_words, least)
                first = np.searchsorted(found[0], np.arange(x.n + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(a, pa.int64()) for a in found[1:]], ["start", "length", "period"])
                yield pa.record_batch([part.column("id"), pa.array(x.n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(first), each), _collapsed(x, *found)], names=["id", "n_words", "runs", "collapsed"])

    rows = narrow(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_column)


def rewritten(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The texts with a run in about a tenth of them, as the registered query wants it: with h the
    crc32 of the id as text, if h % 10 is 0, g = h // 10 and n words, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), each word i >= a becomes word a + (i - a) % p, and the words
    are joined by one space.  Other texts, and those of null ids, stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h = part.column("h").to_numpy(zero_copy_only=False)
                chosen = np.flatnonzero(h % 10 == 0)
                texts = part.column("text")
                if len(chosen):
                    x = Texts(texts.take(pa.array(chosen)))
                    raw = x.b.tobytes()
                    new = texts.to_pylist()
                    for k, d in enumerate(chosen):
                        lo, n = int(x.at[k]), int(x.n_words[k])
                        if n:
                            g = int(h[d]) // 10
                            a = g % n
                            p = 1 + (n - a) // (3 + g % 8)
                            i = np.arange(n)
                            i[a:] = a + (i[a:] - a) % p
                            new[d] = b" ".join([raw[s:e] for s, e in zip(x.start[lo + i].tolist(), x.end[lo + i].tolist())]).decode()
                    texts = pa.array(new, pa.string())
                yield pa.record_batch([part.column("id"), texts], names=["id", "text"])

    rows = narrow(docs, id_column, text_column).toDF("id", "text")
    hashed = rows.withColumn("h", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(1)))
    return hashed.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").toDF(id_column, text_column)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the registered query returns, from the rows of ``find_runs``."""
    most = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    length, start, period = (F.col(f"most.{c}") for c in ("length", "start", "period"))
    return found.withColumn("most", most).select(
        id_column,
        F.size("runs").cast("long").alias("n_runs"),
        (-start).alias("start"),
        length.alias("length"),
        (-period).alias("period"),
        F.expr("(1000 * most.length) div (-most.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
