"""Exact order statistics per group without collecting a group into one task.

``percentile_disc`` / ``median`` buffer every value of a group in one
aggregation buffer; a group holding a third of the data would sit in one
task.  ``kth_values`` instead selects the k-th smallest value exactly in two
passes:

1. values are counted per ``(group, value bucket)`` with a monotone bucket
   function (partial aggregation map-side; the result is small),
2. a running count over the buckets of each group (a window over the small
   table) locates the bucket holding each requested rank and the offset in
   it, and only that bucket's distinct values are counted and scanned.

Where many distinct values may lie within a bucket's 0.3 %, ``levels`` above one
narrows the target bucket first, each time to one of 4,096 equal parts of the range
that its values really have: after level k the last scan holds a 4,096th of what it
held after level k - 1 (evenly spread values), at one more small aggregation over the
target buckets' rows.

The percentile flavours of the reference are rank rules on top:

* nearest rank (load generator, AG-19): ``sorted[ceil(p/100*n) - 1]``, 0 when empty
* rounded index (AG-20): ``sorted[round(p/100*(n-1))]`` with half-even rounding
* upper median (WN-19, WN-03): ``sorted[n // 2]``
* true median (AG-22, AG-11): mean of ``sorted[(n-1)//2]`` and ``sorted[n//2]``
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# resolution of the value buckets: 2**(1/_RES) relative width
_RES = 256.0


# equal parts of a bucket's own range at the levels after the first
_PARTS = 4096


def _vbucket(v: Column) -> Column:
    # monotone in v: sign(v) * log2(1 + |v|), scaled and floored
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * F.lit(_RES)).cast("long")


def kth_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    levels: int = 1,
) -> DataFrame:
    """For each group of ``keys`` return ``n`` and, per entry of ``ranks``,
    the value of 1-based rank ``ranks[name](n)`` (null when the rank is out
    of ``1..n``).  Null values are ignored."""
    keys = list(keys)
    if not keys:  # one global group: a constant key keeps the same plan shape
        out = kth_values(df.withColumn("__g", F.lit(0)), ["__g"], value, ranks, levels)
        return out.drop("__g")
    vals = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    vals = vals.withColumn("__b", _vbucket(F.col("__v")))
    range_ = [F.min("__v").alias("__lo"), F.max("__v").alias("__hi")] if levels > 1 else []

    hist = vals.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), *range_)
    wk = Window.partitionBy(*keys)
    wb = wk.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (
        hist.withColumn("__n", F.sum("__c").over(wk))
        .withColumn("__cum", F.sum("__c").over(wb))
        .withColumn("__prev", F.col("__cum") - F.col("__c"))
    )
    names = list(ranks)
    bounds = ["__lo", "__hi"] if levels > 1 else []
    # one row per (group, rank name) with the target bucket and offset in it
    rank_arr = F.array(
        *[F.struct(F.lit(n).alias("name"), ranks[n](F.col("__n")).cast("long").alias("r")) for n in names]
    )
    targets = (
        hist.select(*keys, "__b", *bounds, "__n", "__cum", "__prev", F.explode(rank_arr).alias("__rkx"))
        .filter((F.col("__rkx.r") > F.col("__prev")) & (F.col("__rkx.r") <= F.col("__cum")))
        .select(*keys, "__b", *bounds, F.col("__rkx.name").alias("__name"), (F.col("__rkx.r") - F.col("__prev")).alias("__off"))
    )
    counts = hist.groupBy(*keys).agg(F.first("__n").alias("n"))

    at = [*keys, "__b"]
    for level in range(1, levels):
        vals, targets, at = _narrowed(vals, targets, at, f"__b{level}")

    # distinct values of the target buckets only
    cand = vals.join(targets.select(*at).distinct(), on=at, how="left_semi")
    dv = cand.groupBy(*at, "__v").agg(F.count(F.lit(1)).alias("__vc"))
    wv = Window.partitionBy(*at).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dv = dv.withColumn("__vcum", F.sum("__vc").over(wv)).withColumn("__vprev", F.col("__vcum") - F.col("__vc"))
    picked = (
        dv.join(targets, on=at, how="inner")
        .filter((F.col("__off") > F.col("__vprev")) & (F.col("__off") <= F.col("__vcum")))
        .groupBy(*keys)
        .pivot("__name", names)
        .agg(F.first("__v"))
    )
    return counts.join(picked, on=keys, how="left")


def _narrowed(vals: DataFrame, targets: DataFrame, at: list[str], part: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of the target buckets with their ``part`` of the bucket's range, and the targets
    with part, range and offset there. The part is monotone in the value: subtraction,
    division and product by a positive number are, also rounded."""
    lo, hi, v = F.col("__lo"), F.col("__hi"), F.col("__v")
    place = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * F.lit(_PARTS)), F.lit(_PARTS - 1))).otherwise(0).cast("int")
    rows = vals.join(targets.select(*at, "__lo", "__hi").distinct(), on=at).withColumn(part, place).select(*at, part, "__v")
    hist = rows.groupBy(*at, part).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    w = Window.partitionBy(*at).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("__cum", F.sum("__c").over(w)).withColumn("__prev", F.col("__cum") - F.col("__c"))
    inside = (F.col("__off") > F.col("__prev")) & (F.col("__off") <= F.col("__cum"))
    found = hist.join(targets.drop("__lo", "__hi"), on=at).filter(inside)
    return rows, found.select(*at, part, "__lo", "__hi", "__name", (F.col("__off") - F.col("__prev")).alias("__off")), [*at, part]


# rank rules (1-based) -------------------------------------------------------

def nearest_rank(p: float) -> Callable[[Column], Column]:
    """``sorted[ceil(p/100 * n) - 1]`` (0-based) -> rank ``ceil(p/100*n)``, at least 1."""
    return lambda n: F.greatest(F.ceil(F.lit(p / 100.0) * n), F.lit(1))


def rounded_index(p: float) -> Callable[[Column], Column]:
    """``sorted[round(p/100 * (n-1))]`` with Python's half-even rounding."""
    return lambda n: F.bround(F.lit(p / 100.0) * (n - 1), 0) + 1


def upper_median() -> Callable[[Column], Column]:
    return lambda n: F.floor(n / 2) + 1


def lower_median() -> Callable[[Column], Column]:
    return lambda n: F.floor((n - 1) / 2) + 1


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    spec: Mapping[str, Callable[[Column], Column]],
    *,
    empty: float | None = None,
    levels: int = 1,
) -> DataFrame:
    """``kth_values`` with optional default for empty groups."""
    out = kth_values(df, keys, value, spec, levels)
    if empty is not None:
        for n in spec:
            out = out.withColumn(n, F.coalesce(F.col(n), F.lit(float(empty))))
    return out


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", levels: int = 1) -> DataFrame:
    """True median (mean of the two middle values for even counts)."""
    r = kth_values(df, keys, value, {"__lower": lower_median(), "__upper": upper_median()}, levels)
    return r.withColumn(out, (F.col("__lower") + F.col("__upper")) / 2).drop("__lower", "__upper")


def rank_rule(name: str, p: float) -> Callable[[Column], Column]:
    """UDF-05: the percentile flavour chosen by name: ``nearest_rank`` (load
    generator), ``rounded_index`` (calibration script), ``upper_median``,
    ``lower_median``."""
    rules = {
        "nearest_rank": lambda: nearest_rank(p),
        "rounded_index": lambda: rounded_index(p),
        "upper_median": upper_median,
        "lower_median": lower_median,
    }
    return rules[name]()
