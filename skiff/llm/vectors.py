"""Integer vectors, and a grid of (query block, row block) cells over Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import kept, narrow

#: Most numbers a cell holds of either side; a longer side has more blocks.
CELL = 1 << 22
#: Rows that a block has at least, so that small tables don't make cells of a few rows.
LEAST_ROWS = 1024


def integer_rows(df: DataFrame, id_column: str, vector_column: str, *more: str, scale: int = 256) -> DataFrame:
    """(id, vec, more...): ``vec`` holds floor(scale * component), the component as a double.

    Left out: null ids, and vectors that are null or hold a null or non-finite
    component.  An id is one row: of several rows of an id the least counts (by
    vector, then the other columns), so repeated rows are one; a partial aggregate
    sees to it, however often an id repeats."""
    rows = narrow(df, id_column, vector_column, *more).toDF("id", "raw", *more)
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("raw").isNotNull() & finite)
    rows = rows.select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"), *more)
    return rows.groupBy("id").agg(F.min(F.struct("vec", *more)).alias("row")).select("id", "row.*")


def in_cells(queries: DataFrame, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(queries, rows)`` on the Arrow tables of every pair of a query block and a row block.

    Blocks are dealt by the id's hash, so a frequent vector or label is spread.  A
    query is copied once for each row block and a row once for each query block;
    cells hold at most about ``CELL`` numbers of a side, whatever the table's size,
    and there are several cells a core.  Cells are shuffled, not broadcast: a lost
    executor's cells are made again from the shuffle."""
    spark = rows.sparkSession

    def blocks(df: DataFrame, cells: int, least: int) -> int:
        n, width = df.agg(F.count("*"), F.max(F.size("vec"))).first()
        most = max(1, CELL // max(1, width or 1))
        return max(1, -(-n // min(most, max(least, -(-n // cells)))))

    wide = 4 * spark.sparkContext.defaultParallelism
    n_rows, n_queries = blocks(rows, wide, LEAST_ROWS), blocks(queries, 1, LEAST_ROWS)

    def dealt(df: DataFrame, own: int, others: int, cell) -> DataFrame:
        df = df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return df.withColumn("cell", cell(F.col("own"), F.col("other")).cast("long")).drop("own", "other").repartition(n_rows * n_queries if n_rows * n_queries < 10_000 else 10_000, "cell")

    left = dealt(queries, n_queries, n_rows, lambda own, other: own * n_rows + other)
    right = dealt(rows, n_rows, n_queries, lambda own, other: other * n_rows + own)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(work, schema)


def settled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once: both sides of the cells, and every repetition of a lost task, read the same table."""
    return kept(rows, name)


def by_width(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: (row numbers ascending by id, matrix of int64); only vectors of one length compare."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vec = rows.column("vec").combine_chunks()
    vec = pa.concat_arrays(vec.chunks) if isinstance(vec, pa.ChunkedArray) else vec
    off = vec.offsets.to_numpy().astype(np.int64)
    flat = vec.values.to_numpy()
    size = np.diff(off)[order]
    out = {}
    for d in np.unique(size):
        at = order[size == d]
        out[int(d)] = (at, flat[off[at][:, None] + np.arange(d)])
    return out


class Scores:
    """Exact inner products of int64 matrices: in doubles where these are exact, else in
    integers; an OverflowError where a long doesn't hold them."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, rows)]
        bound = most[0] * most[1] * max(1, queries.shape[1])
        if bound >= 2.0**62:
            raise OverflowError("inner products of these vectors don't fit a long")
        kind = np.float64 if bound < 2.0**53 else np.int64
        self.q, self.x = queries.astype(kind), rows.astype(kind)

    def pairs(self, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(0, len(i), step):
            out[k : k + step] = np.einsum("ij,ij->i", self.q[i[k : k + step]], self.x[j[k : k + step]])
        return out

    def one(self, i: int, j: np.ndarray) -> np.ndarray:
        return (self.x[j] @ self.q[i]).astype(np.int64)


def first_by_score(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]
