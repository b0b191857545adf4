"""As-of joins without a theta join (JN-01/02/03/08/13).

Both sides are unioned and ordered by time inside the join keys; the right
side's values are carried forward with the bucketed ``scan`` (last non-null),
so the work per task is bounded by the bucket width even when one key holds
a large share of the rows.  Ties follow ``bisect_right``: a right-side row at
the same time as a left row counts as already happened (``right_first``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.operators.scan import scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    right_cols: Sequence[str],
    *,
    prefix: str = "",
    right_first: bool = True,
    left_tiebreak: Sequence[str] = (),
    right_tiebreak: Sequence[str] = (),
    width: float = 3600.0,
    strict: bool = False,
) -> DataFrame:
    """For each left row, the latest right row with ``right_t <= left_t``
    (``<`` when ``strict``) and equal keys; ``right_cols`` are added with
    ``prefix`` (null when there is none).  Of right rows at one time the last
    in ``right_tiebreak`` order wins; rows equal in that too are ordered by
    ``right_cols``, so the winner never depends on the order of arrival."""
    keys = list(keys)
    rstruct = F.struct(*[F.col(c).alias(c) for c in right_cols], F.col(right_t).alias("__rt"))
    tie = F.struct(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(right_tiebreak)], rstruct.alias("__r"))
    r = right.select(*keys, F.col(right_t).alias("__t"), rstruct.alias("__r"), tie.alias("__tie"))
    src_right = 0 if (right_first and not strict) else 2
    r = r.withColumn("__src", F.lit(src_right))
    lcols = left.columns
    lt = left.withColumn("__t", F.col(left_t)).withColumn("__src", F.lit(1))
    for c in left_tiebreak:
        if c in keys:
            raise ValueError(f"tie-break column {c!r} is a join key")
        r = r.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    u = lt.unionByName(r, allowMissingColumns=True)
    s = scan(u, keys, "__t", ["__src", *left_tiebreak, "__tie"], width=width, lasts={"__m": F.col("__r")})
    out = s.filter(F.col("__src") == 1)
    sel = [F.col(c) for c in lcols] + [F.col("__m")[c].alias(prefix + c) for c in right_cols]
    return out.select(*sel)


def neighbours_by_key(
    queries: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    qx: str,
    kx: str,
    ky: str,
    width: float,
) -> DataFrame:
    """For each query value ``qx`` the known point with the largest ``kx <= qx``
    (``x0``, ``y0``) and the one with the smallest ``kx > qx`` (``x1``,
    ``y1``) — the two sides of ``bisect_right``.  Ordered by ``x``."""
    keys = list(keys)
    kv = known.select(*keys, F.col(kx).cast("double").alias("__x"), F.struct(F.col(kx).alias("x"), F.col(ky).alias("y")).alias("__k"))
    qv = queries.withColumn("__x", F.col(qx).cast("double")).withColumn("__q", F.lit(True))
    # lower side: known first at equal x
    u = qv.withColumn("__src", F.lit(1)).unionByName(kv.withColumn("__src", F.lit(0)), allowMissingColumns=True)
    lo = scan(u, keys, "__x", ["__src"], width=width, lasts={"__lo": F.col("__k")}).filter(F.col("__q").isNotNull())
    lo = lo.drop("__k", "__src")
    # upper side: scan on -x, query first at equal x (strictly greater)
    u2 = lo.withColumn("__nx", -F.col("__x")).withColumn("__src", F.lit(0)).unionByName(
        kv.withColumn("__nx", -F.col("__x")).withColumn("__src", F.lit(1)), allowMissingColumns=True
    )
    hi = scan(u2, keys, "__nx", ["__src"], width=width, lasts={"__hi": F.col("__k")}).filter(F.col("__q").isNotNull())
    return hi.select(
        *[c for c in queries.columns],
        F.col("__lo.x").alias("x0"), F.col("__lo.y").alias("y0"),
        F.col("__hi.x").alias("x1"), F.col("__hi.y").alias("y1"),
    )


def interpolate_asof(queries: DataFrame, known: DataFrame, keys: Sequence[str], qx: str, kx: str, ky: str, out: str, width: float = 1e6) -> DataFrame:
    """JN-02: place ``qx`` on the ``kx -> ky`` map by linear interpolation
    between the bracketing known points; clamp to the first / last ``ky``
    outside the known range."""
    nb = neighbours_by_key(queries, known, keys, qx, kx, ky, width)
    ends = known.groupBy(*keys).agg(F.min_by(ky, kx).alias("__first"), F.max_by(ky, kx).alias("__last"))
    nb = nb.join(ends, on=list(keys), how="left")
    x = F.col(qx)
    val = (
        F.when(F.col("x0").isNull(), F.col("__first"))
        .when(F.col("x1").isNull(), F.col("__last"))
        .when(F.col("x1") == F.col("x0"), F.col("y0"))
        .otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0")))
    )
    return nb.withColumn(out, val).drop("x0", "y0", "x1", "y1", "__first", "__last")


def nearest(queries: DataFrame, known: DataFrame, keys: Sequence[str], qx: str, kx: str, ky: str, out: str, width: float = 1e6) -> DataFrame:
    """JN-03: value of the known point nearest to ``qx``; the lower wins ties."""
    nb = neighbours_by_key(queries, known, keys, qx, kx, ky, width)
    x = F.col(qx)
    pick_hi = F.col("x0").isNull() | (F.col("x1").isNotNull() & (F.abs(F.col("x1") - x) < F.abs(x - F.col("x0"))))
    return nb.withColumn(out, F.when(pick_hi, F.col("y1")).otherwise(F.col("y0"))).drop("x0", "y0", "x1", "y1")
