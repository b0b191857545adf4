"""Bucketed prefix scans: running aggregates, as-of carry and row neighbours
over a time order, exact, without a window that spans a whole key.

A window ``partitionBy(run_id).orderBy(t)`` sorts every row of a run in one
task; if one run holds a third of the data that task never finishes.  Every
time-ordered scan in this package therefore runs in two levels:

1. rows are windowed inside ``(keys, bucket)`` where ``bucket = floor(t / width)``
   (bounded by the bucket width), and
2. one partial per ``(keys, bucket)`` is aggregated, the partials are scanned
   per key over buckets (one row per bucket: tiny), and the carry is joined
   back on ``(keys, bucket)`` (the row side is already partitioned that way).

The result equals the single-window result exactly: sums and maxima are
associative, "last non-null" and "previous row" carry across empty buckets
because only non-empty buckets exist at level 2.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__sc_bkt"
_RN = "__sc_rn"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` hash-partitioned by ``keys``, so that several branches read one exchange.

    Spark reuses an exchange only where the branches ask it for the same
    columns, and would prune each branch's columns below it.  The filter reads
    all columns, and as it isn't deterministic it stays above the exchange; it
    holds for every row."""
    every = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.repartition(*keys).filter(F.rand(0) * F.lit(0.5) <= F.when(every == 0, F.lit(0.5)).otherwise(F.lit(0.75)))


#: A scan's plan holds its input twice, though one exchange runs; the planner's
#: work doubles with every chained scan.  An input whose plan has more leaves than
#: this is written with ``checkpoint()`` to the shared folder first.
MOST_LEAVES = 12


def settled(df: DataFrame) -> DataFrame:
    """``df``, from a written copy if its plan has grown too large to plan on."""
    if df._jdf.queryExecution().analyzed().collectLeaves().size() <= MOST_LEAVES:
        return df
    from skiff.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tiebreak: Sequence[str] = (),
    *,
    width: float = 3600.0,
    sums: Mapping[str, Column | str] | None = None,
    maxes: Mapping[str, Column | str] | None = None,
    mins: Mapping[str, Column | str] | None = None,
    lasts: Mapping[str, Column | str] | None = None,
    prevs: Mapping[str, Column | str] | None = None,
    nexts: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Add running columns ordered by ``(time, *tiebreak)`` within ``keys``.

    ``sums``/``maxes``/``mins``: inclusive running aggregate.
    ``lasts``: last non-null value at or before the row (as-of carry).
    ``prevs``/``nexts``: value of the previous / next row (null at the ends).
    """
    sums, maxes, mins = dict(sums or {}), dict(maxes or {}), dict(mins or {})
    lasts, prevs, nexts = dict(lasts or {}), dict(prevs or {}), dict(nexts or {})
    keys = list(keys)
    order = [F.col(time)] + [F.col(c) for c in tiebreak]
    ostruct = F.struct(*order)

    exprs = {_B: F.floor(F.col(time) / F.lit(float(width))).cast("long")}
    for prefix, spec in (("__sc_s_", sums), ("__sc_x_", maxes), ("__sc_m_", mins), ("__sc_l_", lasts), ("__sc_p_", prevs), ("__sc_n_", nexts)):
        for name, expr in spec.items():
            exprs[prefix + name] = _col(expr)
    # both levels read one exchange, so chained scans don't compute their input twice
    df = settled(df)
    base = dealt(df.withColumns(exprs), [*keys, _B])

    w_in = Window.partitionBy(*keys, _B).orderBy(*order)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # level 2: one partial per (keys, bucket)
    parts = []
    for n in sums:
        parts.append(F.sum("__sc_s_" + n).alias("__sc_ps_" + n))
    for n in maxes:
        parts.append(F.max("__sc_x_" + n).alias("__sc_px_" + n))
    for n in mins:
        parts.append(F.min("__sc_m_" + n).alias("__sc_pm_" + n))
    for n in lasts:
        parts.append(F.max_by("__sc_l_" + n, F.when(F.col("__sc_l_" + n).isNotNull(), ostruct)).alias("__sc_pl_" + n))
    for n in prevs:
        parts.append(F.max_by("__sc_p_" + n, ostruct).alias("__sc_pp_" + n))
    for n in nexts:
        parts.append(F.min_by("__sc_n_" + n, ostruct).alias("__sc_pn_" + n))

    w_b = Window.partitionBy(*keys).orderBy(_B)
    w_before = w_b.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for n in sums:
        carry_cols.append(F.coalesce(F.sum("__sc_ps_" + n).over(w_before), F.lit(0)).alias("__sc_cs_" + n))
    for n in maxes:
        carry_cols.append(F.max("__sc_px_" + n).over(w_before).alias("__sc_cx_" + n))
    for n in mins:
        carry_cols.append(F.min("__sc_pm_" + n).over(w_before).alias("__sc_cm_" + n))
    for n in lasts:
        carry_cols.append(F.last("__sc_pl_" + n, ignorenulls=True).over(w_before).alias("__sc_cl_" + n))
    for n in prevs:
        carry_cols.append(F.lag("__sc_pp_" + n).over(w_b).alias("__sc_cp_" + n))
    for n in nexts:
        carry_cols.append(F.lead("__sc_pn_" + n).over(w_b).alias("__sc_cn_" + n))

    carry = base.groupBy(*keys, _B).agg(*parts).select(*keys, _B, *carry_cols)

    within = {}
    if prevs:
        within[_RN] = F.row_number().over(w_in)
    for n in sums:
        within["__sc_rs_" + n] = F.sum("__sc_s_" + n).over(w_run)
    for n in maxes:
        within["__sc_rx_" + n] = F.max("__sc_x_" + n).over(w_run)
    for n in mins:
        within["__sc_rm_" + n] = F.min("__sc_m_" + n).over(w_run)
    for n in lasts:
        within["__sc_rl_" + n] = F.last("__sc_l_" + n, ignorenulls=True).over(w_run)
    for n in prevs:
        within["__sc_rp_" + n] = F.lag("__sc_p_" + n).over(w_in)
    for n in nexts:
        within["__sc_rn_" + n] = F.lead("__sc_n_" + n).over(w_in)
        within["__sc_rnz_" + n] = F.lead(F.lit(1)).over(w_in)
    out = base.withColumns(within).join(carry, on=[*keys, _B], how="inner")

    final = {}
    for n in sums:
        final[n] = F.col("__sc_cs_" + n) + F.col("__sc_rs_" + n)
    for n in maxes:
        final[n] = F.greatest("__sc_cx_" + n, "__sc_rx_" + n)
    for n in mins:
        final[n] = F.least("__sc_cm_" + n, "__sc_rm_" + n)
    for n in lasts:
        final[n] = F.coalesce("__sc_rl_" + n, "__sc_cl_" + n)
    for n in prevs:
        final[n] = F.when(F.col(_RN) == 1, F.col("__sc_cp_" + n)).otherwise(F.col("__sc_rp_" + n))
    for n in nexts:
        final[n] = F.when(F.col("__sc_rnz_" + n).isNull(), F.col("__sc_cn_" + n)).otherwise(F.col("__sc_rn_" + n))
    keep = [c for c in df.columns if c not in final]
    return out.select(*[F.col(c) for c in keep], *[v.alias(k) for k, v in final.items()])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value_cols: Iterable[str],
    tiebreak: Sequence[str] = (),
    *,
    width: float = 3600.0,
    out: str = "island",
) -> DataFrame:
    """Number maximal runs of consecutive rows with equal ``value_cols``
    (null-safe) per key: gaps-and-islands.  Adds ``out`` (1-based, per key)."""
    value_cols = list(value_cols)
    cur = F.struct(*[F.col(c) for c in value_cols])
    marked = scan(df, keys, time, tiebreak, width=width, prevs={"__prev_v": cur, "__has_prev": F.lit(True)})
    change = F.when(F.col("__has_prev").isNull(), 1).when(~F.col("__prev_v").eqNullSafe(cur), 1).otherwise(0)
    marked = marked.withColumn("__chg", change)
    res = scan(marked, keys, time, tiebreak, width=width, sums={out: "__chg"})
    return res.drop("__prev_v", "__has_prev", "__chg")


def flag_runs(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    flag: Column | str,
    tiebreak: Sequence[str] = (),
    *,
    width: float = 3600.0,
    out: str = "run",
) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds, in one scan:
    rows of one run share the running count of non-flag rows before them.
    Adds ``out`` (meaningful on flagged rows only)."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return scan(df, keys, time, tiebreak, width=width, sums={out: F.when(f, F.lit(0)).otherwise(F.lit(1))})


def spans(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value_cols: Sequence[str],
    tiebreak: Sequence[str] = (),
    *,
    as_of: Column | float | None = None,
    width: float = 3600.0,
) -> DataFrame:
    """Merge equal consecutive samples into spans ``[start, end)`` (WN-05).

    A span ends where the next different sample starts; the last span of a
    key ends at ``as_of`` (a column or a number).  Two scans: neighbours
    (previous value, next time) in one, the island number in the second."""
    value_cols = list(value_cols)
    cur = F.struct(*[F.col(c) for c in value_cols])
    s = scan(df, keys, time, tiebreak, width=width,
             nexts={"__next_t": F.col(time)}, prevs={"__prev_v": cur, "__has_prev": F.lit(True)})
    chg = F.when(F.col("__has_prev").isNull(), 1).when(~F.col("__prev_v").eqNullSafe(cur), 1).otherwise(0)
    s = scan(s.withColumn("__chg", chg), keys, time, tiebreak, width=width, sums={"span_no": "__chg"})
    ostruct = F.struct(F.col(time), *[F.col(c) for c in tiebreak])
    end_default = as_of if isinstance(as_of, Column) else F.lit(as_of)
    agg = s.groupBy(*keys, "span_no").agg(
        F.min(time).alias("start"),
        F.max_by("__next_t", ostruct).alias("__end"),
        F.count(F.lit(1)).alias("samples"),
        *[F.first(c).alias(c) for c in value_cols],
    )
    if as_of is None:
        end = F.col("__end")
    else:
        end = F.coalesce(F.col("__end"), end_default.cast("double"))
    return agg.withColumn("end", end).drop("__end")
