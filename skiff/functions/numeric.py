"""Numeric helpers shared by operators and oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(col: Column | str, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in IEEE doubles.

    Report columns are rounded like the reference's output; written as plain
    double arithmetic it gives bit-identical results in Spark and in any SQL
    engine, unlike engine-specific ``round`` implementations at exact ties."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_half_up_sql(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(floor(({expr}) * {scale!r} + 0.5) / {scale!r})"


def human_bytes(col: Column | str) -> Column:
    """PRJ-15: readable byte size in steps of 1024 (B, KB, MB, GB, TB), one
    decimal."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = None
    for i, u in reversed(list(enumerate(units))):
        scaled = F.format_string("%.1f " + u, c / F.lit(float(1024 ** i)))
        cond = c >= F.lit(float(1024 ** i)) if i else F.lit(True)
        expr = F.when(cond, scaled) if expr is None else expr.when(cond, scaled)
    return expr


# gp3 volume pricing used by the prep estimate (fixed values of the reference)
GP3_GB_MONTH_USD = 0.08
GP3_IOPS_MONTH_USD = 0.005
GP3_MBPS_MONTH_USD = 0.040
GP3_FREE_IOPS = 3000
GP3_FREE_MBPS = 125
HOURS_PER_MONTH = 730.0


def prep_estimate_usd(rate: Column, hours: Column, gb: Column, iops: Column, mbps: Column) -> Column:
    """PRJ-16: instance plus volume cost of a prep job, with the free IOPS and
    throughput tiers; null without an instance rate."""
    share = hours / HOURS_PER_MONTH
    ebs = gb * GP3_GB_MONTH_USD * share
    ebs = ebs + F.greatest(F.lit(0), iops - GP3_FREE_IOPS) * GP3_IOPS_MONTH_USD * share
    ebs = ebs + F.greatest(F.lit(0), mbps - GP3_FREE_MBPS) * GP3_MBPS_MONTH_USD * share
    return F.when(rate.isNotNull(), rate * hours + ebs)
