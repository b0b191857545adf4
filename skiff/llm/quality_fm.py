"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A text's features are its words hashed into ``BUCKETS`` (damped frequencies of
unit length), ``STATS`` ratios of its structure, and its size.  The score is
``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2))``:
the sum-of-squares identity makes the pairwise part linear in the number of
features.  The machine is fitted by Adam on at most ``max_train`` labelled rows,
those of smallest hash of the id, whose features alone reach the driver;
scoring is one pass over the texts on the executors with the fitted weights (a
fixed number, under 2 MB).

Defined cases: null and empty texts have only the constant features and still
get a score; a null size is counted from the text; labels of one id that
disagree count by their mean; of documents with one id the least text trains;
rows without an id or label don't train; without any labelled row every score is 0.5; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow, remainder, small_batches
from skiff.llm.host_rules import SYMBOLS, measure
from skiff.llm.textops import Texts, slices

BUCKETS = 1 << 14
STATS = 15
WIDTH = BUCKETS + STATS
FACTORS = 8


def _bytes(*spans: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in spans:
        out[ord(s[0]) : ord(s[-1]) + 1] = True
    return out


UPPER, LETTER, DIGIT, PIPE = _bytes("AZ"), _bytes("az", "AZ"), _bytes("09"), _bytes("|")
MARKS = _bytes("!/", ":@", "[`", "{~")


def features(x: Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature, value, and the first entry of each text (with the end)."""
    m = measure(x)
    words = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(x.off), 1)
    h = x.hashes()
    key, tf = np.unique(x.doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    doc = key // BUCKETS
    value = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=x.n))
    value /= norm[doc]
    ratio = lambda flags, per: np.minimum(x.per_text(flags) / per, 1.0)
    letters = np.maximum(x.per_text(LETTER[x.b]), 1)
    stats = np.stack(
        [
            ratio(UPPER[x.b], letters),
            ratio(DIGIT[x.b], size),
            ratio(SYMBOLS[x.b], words),
            ratio(PIPE[x.b], words),
            ratio(MARKS[x.b], words),
            ratio(x.b == 33, words),
            ratio(x.b == 10, words),
            ratio(x.b >= 0x80, size),
            np.minimum(m["word_chars"] / words / 16, 1.0),
            m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
            m["n_repeat_words"] / words,
            np.bincount(doc, minlength=x.n) / words,
            np.minimum(np.log1p(m["n_words"]) / 12, 1.0),
            (m["n_words"] == 0) * 1.0,
            np.minimum(np.log1p(np.maximum(n_chars, 0)) / 16, 1.0),
        ],
        axis=1,
    )
    at = np.concatenate([np.searchsorted(doc, np.arange(x.n)), [len(doc)]])
    n = np.diff(at) + STATS
    first = np.concatenate([[0], np.cumsum(n)])
    index, values = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
    where = np.arange(len(doc)) + doc * STATS
    index[where], values[where] = key % BUCKETS, value
    tail = (first[1:, None] - STATS + np.arange(STATS)).ravel()
    index[tail], values[tail] = np.tile(np.arange(BUCKETS, WIDTH), x.n), stats.ravel()
    return index, values, first


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def parts(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw score of each row, v_if x_i of each entry, and their sums over the rows."""
        vx = self.v[index] * value[:, None]
        linear = np.add.reduceat(self.w[index] * value, first[:-1])
        s = np.add.reduceat(vx, first[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, first[:-1], axis=0)
        return self.bias + linear + 0.5 * (s * s - squares).sum(axis=1), vx, s

    def score(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(index, value, first)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss over sparse rows (feature, value, label)."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32))
    if not rows:
        return Machine(0.0, m.w, np.zeros_like(m.v))
    table = np.zeros((WIDTH, FACTORS + 1), np.float32)
    mean, square, step, bias_mean, bias_square = np.zeros_like(table), np.zeros_like(table), 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = [rows[i] for i in order[at : at + batch]]
            n = np.array([len(r[0]) for r in own])
            first = np.concatenate([[0], np.cumsum(n)])
            index, value = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            raw, vx, s = m.parts(index, value, first)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - np.array([r[2] for r in own])) / len(own)
            each = np.repeat(slope, n) * value
            dv = each[:, None] * (np.repeat(s, n, axis=0) - vx)
            grad = np.stack([np.bincount(index, each, WIDTH), *(np.bincount(index, dv[:, f], WIDTH) for f in range(FACTORS))], axis=1)
            grad += decay * np.concatenate([m.w[:, None], m.v], axis=1)
            step += 1
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad * grad - square)
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
            m.w -= move[:, 0]
            m.v -= move[:, 1:]
            g = float(slope.sum())
            bias_mean += 0.1 * (g - bias_mean)
            bias_square += 0.001 * (g * g - bias_square)
            m.bias -= rate * (bias_mean / (1 - 0.9**step)) / ((bias_square / (1 - 0.999**step)) ** 0.5 + 1e-6)
    return m


def _inputs(docs: DataFrame, id_column: str, text_column: str, size_column: str) -> DataFrame:
    small_batches(docs)
    size = F.col(f"`{size_column}`") if size_column in docs.columns else F.lit(None)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), size.cast("long").alias("size"))
    return rows.withColumn("size", F.coalesce("size", F.length("text").cast("long")))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000, folds: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", size_column: str = "n_chars") -> Machine:
    """Fit on labelled rows whose crc32(id) mod ``folds`` isn't 0: the ``max_train``
    of smallest id hash, so that the driver holds that many rows' features at most."""
    known = narrow(labels, id_column, label_column).toDF("id", "label").filter("id is not null and label is not null").groupBy("id").agg(F.avg("label").alias("label"))
    there = narrow(docs, id_column).toDF("id").filter("id is not null").distinct()
    chosen = known.join(there, "id", "left_semi").filter(remainder("id", folds) != 0).orderBy(F.xxhash64("id"), "id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                index, value, first = features(Texts(part.column("text")), part.column("size").to_numpy())
                cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())  # noqa: E731, B023
                yield pa.record_batch([part.column("id"), cut(index), cut(value), part.column("label")], names=["id", "index", "value", "label"])

    rows = _inputs(docs, id_column, text_column, size_column).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("text", "size")).alias("row")).select("id", "row.text", "row.size", "label")
    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, index binary, value binary, label double").toArrow()
    got = got.sort_by("id")
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(got["index"].to_pylist(), got["value"].to_pylist(), got["label"].to_pylist())])


def score(docs: DataFrame, machine: Machine, limit: float = 0.3, keep: bool = False, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """Per row: id, ``score`` and ``predicted``; with ``keep`` also all columns of ``docs``."""
    weights = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = weights.value.score(*features(Texts(part.column("text")), part.column("size").to_numpy()))
                yield pa.record_batch([*(part.column(c) for c in passed), pa.array(s)], names=[*passed, "score"])

    if keep:
        small_batches(docs)
        named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        text, size = f"c{docs.columns.index(text_column)}", f"c{docs.columns.index(size_column)}"
        rows = named.withColumns({"text": F.coalesce(text, F.lit("")), "size": F.coalesce(F.col(size).cast("long"), F.length(text).cast("long"), F.lit(0).cast("long"))})
        passed = named.columns
        out = rows.mapInArrow(run, named.schema.add("score", "double")).filter(F.col("score") >= limit)
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    rows, passed = _inputs(docs, id_column, text_column, size_column), ["id"]
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_column), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
