"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, then more and shorter segments; a segment of length L has a
mean m and a deviation s.  For query q and row x,

    |q - x|^2  >=  sum over segments of L * ((m_q - m_x)^2 + (s_q - s_x)^2),

and as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, a lower bound of the distance is an upper
bound of the score, |q|^2 and |x|^2 being known:

    q.x  <=  sum over segments of L * (m_q * m_x + s_q * s_x).

Each resolution's bounds are one product of two narrow matrices.  Coarse to fine,
rows whose bound is below the query's k-th best exact score so far are left out;
at each resolution the rows of best bound are scored exactly, which raises that
score.  What survives the finest resolution (segments of two) is scored exactly.
Bounds get a slack above their rounding error, so no row is lost.

Queries and rows meet in the cells of ``vectors.in_cells``; a cell gives k rows a
query at most, and Spark's ranked window takes the best k of all cells.

Defined cases: null ids and vectors that are null or hold a null or non-finite
component take no part; an id is one row (see ``integer_rows``); a query's own id
is no candidate; only vectors of the same length compare, empty ones have score 0.
Fewer than k candidates are all returned.  An empty table gives no rows; extra
columns are ignored.  Scores beyond a long raise an OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.vectors import Scores, by_width, first_by_score, in_cells, integer_rows, settled

#: Pairs of a query and a row that are looked at together.
TILE = 1 << 20


def resolutions(width: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has segments of two (one of an odd rest)."""
    finest = max(1, (width + 1) // 2)
    return sorted({1, max(1, finest // 8), max(1, finest // 2), finest})


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Per vector and segment sqrt(L) * mean and sqrt(L) * deviation, side by side: bounds are products of two such rows."""
    first = np.arange(segments) * m.shape[1] // segments
    length = np.diff(first, append=m.shape[1]).astype(np.float64)
    mean = np.add.reduceat(m, first, axis=1) / length
    rest = np.add.reduceat((m - np.repeat(mean, length.astype(int), axis=1)) ** 2, first, axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(rest)], axis=1)


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows of another id; rows are ascending by id."""
    n, width = rows.shape
    exact = Scores(queries, rows)
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    levels = [(statistics(q, s), statistics(x, s)) for s in resolutions(width)] if width else []
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0)) + 0.25
    out = []
    tall = max(1, TILE // max(1, n))
    for lo in range(0, len(q), tall):
        here = np.arange(lo, min(lo + tall, len(q)))
        alive = q_ids[here, None] != ids[None, :]
        floor = np.full(len(here), -np.inf)
        for fq, fx in levels:
            some = np.flatnonzero(alive.any(axis=0))
            if len(some) <= k:
                break
            bound = np.where(alive[:, some], fq[here] @ fx[some].T, -np.inf)
            # the rows of best bound, scored exactly, raise the k-th best score so far
            probe = np.argpartition(-bound, k, axis=1)[:, : k + 1] if len(some) > k + 1 else np.broadcast_to(np.arange(len(some)), bound.shape)
            scores = exact.pairs(np.repeat(here, probe.shape[1]), some[probe].ravel()).reshape(probe.shape).astype(np.float64)
            scores[np.take_along_axis(bound, probe, axis=1) == -np.inf] = -np.inf
            floor = np.maximum(floor, np.sort(scores, axis=1)[:, -k])
            alive[:, some] &= bound + slack[here, None] >= floor[:, None]
        who, row = np.nonzero(alive)
        score = exact.pairs(here[who], row)
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((here[who[rank < k]], row[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per query (rows with ``is_query``, a condition on ``id_column``) its ``k`` best other
    rows: query_id, rank from 1, the row's id, score; ties to smaller ids."""
    rows = settled(integer_rows(vectors, id_column, vector_column, scale=scale), "integer-vectors")
    queries = rows.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        of, to = by_width(left), by_width(right)
        for width in of.keys() & to.keys():
            (a, q), (b, x) = of[width], to[width]
            q_ids, ids = left.column("id").to_numpy()[a], right.column("id").to_numpy()[b]
            i, j, score = best(q, q_ids, x, ids, k)
            found.append(pa.table([q_ids[i], ids[j], score], names=["query_id", "id", "score"]))
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "id", "score"])

    merged = in_cells(queries, rows.select("id", "vec"), work, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def oracle_sql(every: int = 50, k: int = 5) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.vec, r.vec) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % {every} = 0 AND q.vec_id <> r.vec_id AND len(q.vec) = len(r.vec)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
