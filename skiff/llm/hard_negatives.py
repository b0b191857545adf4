"""Hard-negative mining by length buckets and coordinate pruning (LEMP).

Rows of a cell and label are sorted by length and cut into buckets of similar
length.  A bucket holds the rows' directions (vectors over their lengths) and, per
coordinate, the list of its rows sorted by that coordinate's value.  A search for
inner products of at least t with anchor a turns, in a bucket of greatest length l,
into cosines of at least c = t / (|a| l): if c > 1 the whole bucket is passed over.
Otherwise a row at cosine c or more has in every coordinate f a value between
cos(angle(a_f) + angle(c)) and cos(angle(a_f) - angle(c)).  The feasible ranges of
the anchor's focus coordinates (those of largest absolute value) are cut out of the
sorted lists by binary search, a row must be in all of them, and only such rows are
scored exactly.

1. Positives: per anchor the first k rows of its label.  t is the k-th best score so
   far, buckets come longest first.
2. Negatives: per anchor and positive of score p the first k rows of other labels
   with share * p <= score <= p.  t is the least, over the anchor's positives, of
   share * p or the k-th best score found for it.

Each step runs in the cells of ``vectors.in_cells``; a cell gives k rows a list at
most, and Spark's ranked window takes the best k of all cells.

Defined cases: null ids, null labels and vectors that are null or hold a null or
non-finite component take no part; an id is one row (see ``integer_rows``).  Only
vectors of the same length compare; zero and empty vectors have score 0.  An anchor
without positives, or a positive without feasible negatives, gives no rows; a
negative positive score has none by the condition itself.  An empty table gives no
rows; extra columns are ignored.  Scores beyond a long raise an OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.vectors import Scores, by_width, first_by_score, in_cells, integer_rows, settled

FOCUS = 4
#: A bucket's least length is at least this share of its greatest, and it holds so many rows at most.
SIMILAR, MOST_ROWS = 0.9, 1024


class Bucket:
    """Rows (numbers of a matrix) of similar length, longest first."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, length: np.ndarray):
        self.rows, self.longest = rows, float(length.max(initial=0))
        unit = x[rows] / np.maximum(length, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0).T
        self.value = np.take_along_axis(unit.T, self.order, axis=1)

    def feasible(self, unit: np.ndarray, focus: np.ndarray, size: float, least: float) -> np.ndarray:
        """Rows that may have an inner product of ``least`` or more with the anchor of
        direction ``unit`` and length ``size``, by its ``focus`` coordinates."""
        if least <= 0:  # says nothing of the cosine of a shorter row
            return self.rows
        reach = size * self.longest
        cosine = (least - 0.25) / reach if reach else np.inf  # scores are integers
        if cosine > 1 + 1e-9:
            return self.rows[:0]
        angle = np.arccos(min(1.0, cosine))
        seen = np.zeros(len(self.rows), np.int16)
        for f in focus:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, own + angle)) - 1e-7
            high = np.cos(max(0.0, own - angle)) + 1e-7
            lo, hi = np.searchsorted(self.value[f], low, "left"), np.searchsorted(self.value[f], high, "right")
            seen[self.order[f, lo:hi]] += 1
        return self.rows[seen == len(focus)]


def buckets(rows: np.ndarray, x: np.ndarray) -> list[Bucket]:
    length = np.sqrt((x[rows] ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    rows, length = rows[order], length[order]
    out, at = [], 0
    while at < len(rows):
        end = at + int(np.searchsorted(-length[at:], -SIMILAR * length[at], "right"))
        end = min(max(end, at + 1), at + MOST_ROWS)
        out.append(Bucket(rows[at:end], x, length[at:end]))
        at = end
    return out


class Cell:
    """The rows of a cell that have one width: exact scores, and buckets by label."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.ids, self.exact = ids, Scores(queries, rows)
        x = rows.astype(np.float64)
        self.q = queries.astype(np.float64)
        self.size = np.sqrt((self.q**2).sum(axis=1))
        self.unit = self.q / np.maximum(self.size, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.by_label = {int(v): buckets(np.flatnonzero(labels == v), x) for v in np.unique(labels)}

    def candidates(self, i: int, bucket: Bucket, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``bucket`` that may reach ``least`` with query ``i``, and their exact scores."""
        rows = bucket.feasible(self.unit[i], self.focus[i], self.size[i], least) if least > -np.inf else bucket.rows
        return rows, self.exact.one(i, rows)

    def positives(self, i: int, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first ``k`` rows of ``label`` but ``own``."""
        ids, score = np.zeros((2, 0), np.int64)
        for b in self.by_label.get(label, []):
            rows, s = self.candidates(i, b, float(score[-1]) if len(score) == k else -np.inf)
            other = self.ids[rows] != own
            ids, score = np.append(ids, self.ids[rows][other]), np.append(score, s[other])
            top = first_by_score(score, ids, k)
            ids, score = ids[top], score[top]
        return ids, score

    def negatives(self, i: int, label: int, positive: np.ndarray, k: int, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per positive score (ids, scores) of the first ``k`` rows of other labels in its window."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in positive]
        every = [b for v, own in self.by_label.items() if v != label for b in own]
        for b in sorted(every, key=lambda b: -b.longest):
            least = min(max(float(-(-percent * p // 100)), float(s[-1]) if len(s) == k else -np.inf) for p, (_, s) in zip(positive.tolist(), found))
            rows, s = self.candidates(i, b, least)
            ids = self.ids[rows]
            for j, p in enumerate(positive):
                within = (percent * p <= 100 * s) & (s <= p)
                if within.any():
                    ids_j, s_j = np.append(found[j][0], ids[within]), np.append(found[j][1], s[within])
                    top = first_by_score(s_j, ids_j, k)
                    found[j] = ids_j[top], s_j[top]
        return found


def _cells(left: pa.Table, right: pa.Table):
    of, to = by_width(left), by_width(right)
    for width in sorted(of.keys() & to.keys()):
        (a, q), (b, x) = of[width], to[width]
        if width:
            yield a, Cell(q, x, right.column("id").to_numpy()[b], right.column("label").to_numpy()[b])


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(anchor_id, rank, id, score): per anchor the first ``k`` other rows of its label."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a_labels = (left.column(c).to_numpy() for c in ("id", "label"))
        out = [(a_ids[r], *cell.positives(i, a_ids[r], int(a_labels[r]), k)) for at, cell in _cells(left, right) for i, r in enumerate(at)]
        n = [len(s) for _, _, s in out]
        anchor = np.repeat(np.array([a for a, _, _ in out], np.int64), n)
        ids, score = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in out)]) for c in (1, 2))
        return pa.table([anchor, ids, score], names=["anchor_id", "id", "score"])

    return _first(in_cells(anchors, rows, work, "anchor_id long, id long, score long"), k, "anchor_id")


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, percent: int = 80, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per anchor (rows with ``is_anchor``, a condition on ``id_column``) and positive the first
    ``k`` negatives scored from ``percent`` to 100 percent of the positive: anchor_id,
    positive_id, rank from 1, negative_id, positive_score, negative_score; ties to smaller ids."""
    labelled = vectors.filter(F.col(f"`{label_column}`").isNotNull())
    rows = integer_rows(labelled, id_column, vector_column, label_column, scale=scale).withColumnRenamed(label_column, "label").withColumn("label", F.col("label").cast("long"))
    rows = settled(rows, "labelled-vectors")
    anchors = rows.withColumnRenamed("id", id_column).filter(is_anchor).withColumnRenamed(id_column, "id")
    # an anchor has k positives at most: a short list
    found = positives(anchors, rows, k).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asked = settled(anchors.join(found.withColumnRenamed("anchor_id", "id"), "id").select("id", "vec", "label", F.col("p.id").alias("positive"), F.col("p.score").alias("reach")), "anchors")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a_labels = (left.column(c).to_numpy() for c in ("id", "label"))
        positive, reach = (left.column(c).to_pylist() for c in ("positive", "reach"))
        out = []
        for at, cell in _cells(left, right):
            for i, r in enumerate(at):
                lists = cell.negatives(i, int(a_labels[r]), np.array(reach[r], np.int64), k, percent)
                out += [(a_ids[r], p, s, *own) for p, s, own in zip(positive[r], reach[r], lists)]
        n = [len(x[4]) for x in out]
        each = [np.repeat(np.array([x[c] for x in out], np.int64), n) for c in range(3)]
        lists = [np.concatenate([np.zeros(0, np.int64), *(x[c] for x in out)]) for c in (3, 4)]
        return pa.table([*each, *lists], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    negatives = in_cells(asked, rows, work, "anchor_id long, positive_id long, positive_score long, id long, score long")
    first = _first(negatives, k, "anchor_id", "positive_id")
    return first.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.vec) = len(r.vec)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""
