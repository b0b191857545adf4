"""Per-run series, outages, cost and summaries (SNK-01, WN-01/02/03/04/19/23,
JN-01/02/04/10, AG-35/36/37/38, PRJ-08/09).

Steps: ``(run_id, event_id, step, loss, ms, ws, t)`` — rank-0 step lines,
ordered by time (steps repeat after a rollback: time, not step, orders).
Ticks: ``(run_id, event_id, t, epoch, members, ckpt_step, nodes)``.
Ledger: ``(run_id, instance_id, hourly_usd, started_at, stopped_at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.functions.numeric import round_half_up
from skiff.functions.percentile import kth_values, upper_median
from skiff.operators.asof import asof_join, interpolate_asof
from skiff.operators.scan import scan

BILLABLE_STATES = ["pending", "running"]  # AWS states that bill
MIN_OUTAGE_S = 90.0
OUTAGE_FACTOR = 3.0
TYPICAL_WINDOW = 31  # rolling-median width in steps


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- outages --

def outages(ticks: DataFrame, factor: float = OUTAGE_FACTOR, floor: float = MIN_OUTAGE_S, width: float = 86400.0) -> DataFrame:
    """WN-19: gaps between consecutive status ticks longer than
    ``max(factor x upper-median gap, floor)`` (a zero median reads 10 s);
    runs with fewer than three ticks have none."""
    t = ticks.select("run_id", "t", "event_id")
    t = scan(t, ["run_id"], "t", ["event_id"], width=width, nexts={"__b": F.col("t")})
    gaps = t.filter(F.col("__b").isNotNull()).select("run_id", F.col("t").alias("start"), F.col("__b").alias("end"))
    gaps = gaps.withColumn("gap_s", F.col("end") - F.col("start"))
    med = kth_values(gaps, ["run_id"], "gap_s", {"median_gap": upper_median()})
    thr = F.greatest(F.when(F.col("median_gap") == 0, F.lit(10.0)).otherwise(F.col("median_gap")) * factor, F.lit(floor))
    med = med.withColumn("threshold", thr)
    return (
        gaps.join(med, on="run_id")
        .filter((F.col("n") >= 2) & (F.col("gap_s") > F.col("threshold")))
        .select("run_id", "start", "end", "gap_s", "median_gap", "threshold")
    )


def outage_annotations(gaps: DataFrame) -> DataFrame:
    """SNK-06: control-plane-down regions in epoch milliseconds."""
    return gaps.select(
        "run_id",
        F.floor(F.col("start") * 1000).cast("long").alias("time"),
        F.floor(F.col("end") * 1000).cast("long").alias("timeEnd"),
        F.lit("control plane down").alias("title"),
        F.col("gap_s").alias("seconds"),
    )


def in_gap(rows: DataFrame, gaps: DataFrame, t: str = "t", tiebreak=("event_id",)) -> DataFrame:
    """JN-10: ``supervisor_up = 0`` when ``t`` lies strictly inside an outage
    (as-of on the gap start, strict, then ``t < end``)."""
    j = asof_join(rows, gaps.select("run_id", "start", "end"), ["run_id"], t, "start", ["end"],
                  prefix="__gap_", strict=True, left_tiebreak=list(tiebreak), width=86400.0)
    return j.withColumn("supervisor_up", F.when(F.col(t) < F.col("__gap_end"), F.lit(0)).otherwise(F.lit(1))).drop("__gap_end")


# ------------------------------------------------------------------ cost --

def cost_ledger(ledger: DataFrame, as_of: Column | float) -> DataFrame:
    """AG-35 per machine: billed seconds (open rows close at ``as_of``) and
    dollars (null for an unknown rate)."""
    end = F.coalesce(F.col("stopped_at"), _lit(as_of))
    secs = F.greatest(F.lit(0.0), end - F.col("started_at"))
    return ledger.select(
        "run_id", "instance_id", "hourly_usd", "started_at", "stopped_at",
        secs.alias("billed_seconds"),
        F.when(F.col("hourly_usd").isNotNull(), secs * F.col("hourly_usd") / 3600.0).alias("usd"),
    )


def cost_totals(ledger: DataFrame, as_of: Column | float) -> DataFrame:
    """AG-35 per run: total dollars at ``as_of`` (unknown rates add 0 and
    are counted)."""
    a = _lit(as_of)
    end = F.least(F.coalesce(F.col("stopped_at"), a), a)
    usd = F.when(F.col("hourly_usd").isNotNull(), F.greatest(F.lit(0.0), end - F.col("started_at")) * F.col("hourly_usd") / 3600.0)
    return ledger.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("instances"),
        round_half_up(F.coalesce(F.sum(usd), F.lit(0.0)), 6).alias("total_usd"),
        F.count(F.when(F.col("hourly_usd").isNull(), F.lit(1))).alias("rate_unknown_count"),
    )


def cost_at(queries: DataFrame, ledger: DataFrame, t: str = "t", t0: float = 0.0, width: float = 86400.0) -> DataFrame:
    """JN-04: cumulative dollars at each query time: for every machine
    ``rate x max(0, min(t, stop) - start)`` (open machines accrue to ``t``).

    No range join: starts and stops become breakpoints ``(time, +-rate)``
    and ``cost(t) = (t * sum(d) - sum(d * t_i)) / 3600`` over breakpoints at
    or before ``t`` — two running sums in one bucketed scan.  The sums run
    in decimals (times in microseconds relative to ``t0``, rates quantised
    to 1e-7 $/h) so they are exact and independent of the summation order."""
    tdec, ddec = "decimal(15,6)", "decimal(18,0)"
    rate = F.round(F.col("hourly_usd") * 1e7).cast(ddec)
    known = ledger.filter(F.col("hourly_usd").isNotNull())
    starts = known.select("run_id", (F.col("started_at") - t0).alias("__tf"), rate.alias("__d"))
    stops = known.filter(F.col("stopped_at").isNotNull()).select(
        "run_id", (F.col("stopped_at") - t0).alias("__tf"), (-rate).alias("__d")
    )
    bp = starts.unionByName(stops).withColumn("__src", F.lit(0))
    q = queries.withColumn("__tf", F.col(t) - t0).withColumn("__d", F.lit(0).cast(ddec)).withColumn("__src", F.lit(1))
    u = q.unionByName(bp, allowMissingColumns=True).withColumn("__td", F.col("__tf").cast(tdec))
    u = u.withColumn("__dt", F.col("__d") * F.col("__td"))
    s = scan(u, ["run_id"], "__tf", ["__src"], width=width, sums={"__sd": "__d", "__sdt": "__dt"})
    s = s.filter(F.col("__src") == 1)
    usd = (F.col("__td") * F.col("__sd").cast("decimal(22,0)") - F.col("__sdt")).cast("double") / 36_000_000_000.0
    return s.withColumn("usd", F.greatest(usd, F.lit(0.0))).select(*queries.columns, "usd")


def cost_curve(ledger: DataFrame, as_of: float, t0_of_run: DataFrame | None = None) -> DataFrame:
    """WN-23: cumulative cost at every start and stop (open machines stop
    at ``as_of``), piecewise linear between them."""
    pts = ledger.select("run_id", F.col("started_at").alias("t")).unionByName(
        ledger.select("run_id", F.coalesce(F.col("stopped_at"), F.lit(as_of)).alias("t"))
    ).distinct()
    closed = ledger.withColumn("stopped_at", F.coalesce(F.col("stopped_at"), F.lit(as_of)))
    c = cost_at(pts, closed, "t", t0=float(as_of))
    return c.withColumn("usd", round_half_up("usd", 6))


def observed_instances(ticks: DataFrame, now: Column | float) -> DataFrame:
    """AG-36: billing spans rebuilt from status polls: from first sight to
    the last billable sight; billable at its last sight keeps accruing to
    ``now``."""
    n = ticks.select("run_id", "t", "event_id", F.explode("nodes").alias("n")).select(
        "run_id", "t", "event_id", F.col("n.instance_id").alias("instance_id"), F.col("n.aws_state").alias("aws_state")
    ).filter(F.col("instance_id").isNotNull() & (F.col("instance_id") != ""))
    billable = F.coalesce(F.col("aws_state"), F.lit("running")).isin(BILLABLE_STATES)
    g = n.groupBy("run_id", "instance_id").agg(
        F.min("t").alias("start"),
        F.max(F.when(billable, F.col("t"))).alias("__end"),
        F.max_by(billable, F.struct("t", "event_id")).alias("billable"),
    )
    end = F.coalesce(F.col("__end"), F.col("start"))
    end = F.when(F.col("billable"), F.greatest(end, _lit(now))).otherwise(end)
    return g.select("run_id", "instance_id", "start", end.alias("end"), "billable")


# ------------------------------------------------------------- run series --

def launch_time(run_ids: DataFrame, ticks: DataFrame, steps: DataFrame) -> DataFrame:
    """PRJ-08: launch = the 10-digit epoch suffix of the run id, else the
    first tick, else the first step."""
    ft = ticks.groupBy("run_id").agg(F.min("t").alias("__ft"))
    fs = steps.groupBy("run_id").agg(F.min("t").alias("__fs"))
    suffix = F.regexp_extract("run_id", r"-([0-9]{10})$", 1)
    r = run_ids.join(ft, "run_id", "left").join(fs, "run_id", "left")
    return r.select(
        "run_id",
        F.coalesce(F.when(suffix != "", suffix.cast("double")), F.col("__ft"), F.col("__fs")).alias("launch"),
    )


def rolling_upper_median(rows: DataFrame, keys: list[str], idx: str, value: str, half: int = TYPICAL_WINDOW // 2,
                         chunk: int = 4096, out: str = "typical") -> DataFrame:
    """WN-03: centred rolling upper median over rows ``idx - half .. idx + half``.

    Rows are split into chunks of ``chunk`` consecutive indices; the first
    and last ``half`` rows of a chunk are also copied into the neighbouring
    chunk as a halo, so each chunk computes its windows locally and exactly."""
    c = F.floor(F.col(idx) / chunk).cast("long")
    r = F.col(idx) % chunk
    copies = F.array(
        c,
        F.when(r < half, c - 1),
        F.when(r >= chunk - half, c + 1),
    )
    x = rows.withColumn("__own", c).withColumn("__chunk", F.explode(copies)).filter(F.col("__chunk").isNotNull())
    w = Window.partitionBy(*keys, "__chunk").orderBy(idx).rowsBetween(-half, half)
    x = x.withColumn("__win", F.array_sort(F.collect_list(value).over(w)))
    x = x.filter(F.col("__chunk") == F.col("__own"))
    x = x.withColumn(out, F.element_at("__win", (F.size("__win") / 2).cast("int") + 1))
    return x.drop("__own", "__chunk", "__win")


def run_series(
    steps: DataFrame,
    ticks: DataFrame,
    changes: DataFrame,
    ledger: DataFrame,
    gaps: DataFrame,
    *,
    target_world: int,
    tokens_per_step: int,
    width: float = 3600.0,
    t0: float = 1_704_067_200.0,
) -> DataFrame:
    """SNK-01 step rows of the run series (the reference's 19 columns).

    One union of five record kinds per run — status ticks, membership
    changes and ledger breakpoints (ordered before a step at the same time),
    the step lines, and outage starts (after, so an outage must start
    strictly before a step) — and ONE bucketed scan computes, per step:

    * WN-01 furthest step, the step index and the run's first step time,
    * JN-01 membership and durable step of the latest tick at or before it,
    * WN-02 cumulative losses and joins (inclusive),
    * JN-04 dollars so far (two decimal running sums over ±rate breakpoints),
    * JN-10 whether it lies inside an outage (latest outage start, strict).

    Then WN-04 steps at risk, PRJ-09 tokens, degraded flag and band, AG-37
    goodput and WN-03 typical step time are column expressions."""
    tdec, ddec = "decimal(15,6)", "decimal(18,0)"
    st = steps.select("run_id", "event_id", "step", "loss", "ms", "ws", "t", F.lit(1).alias("__src"))
    tk = ticks.select("run_id", "t", "event_id", F.lit(0).alias("__src"),
                      F.struct(F.size("members").alias("members_n"), F.col("ckpt_step")).alias("__tick"))
    ch = changes.select("run_id", "t", F.lit(0).alias("__src"),
                        (F.col("kind") == "lost").cast("int").alias("__l"), (F.col("kind") == "joined").cast("int").alias("__j"))
    known = ledger.filter(F.col("hourly_usd").isNotNull())
    rate = F.round(F.col("hourly_usd") * 1e7).cast(ddec)
    bp = known.select("run_id", F.col("started_at").alias("t"), rate.alias("__d")).unionByName(
        known.filter(F.col("stopped_at").isNotNull()).select("run_id", F.col("stopped_at").alias("t"), (-rate).alias("__d")))
    bp = bp.withColumn("__src", F.lit(0))
    gp = gaps.select("run_id", F.col("start").alias("t"), F.lit(2).alias("__src"), F.struct(F.col("end")).alias("__gap"))
    u = st.unionByName(tk, allowMissingColumns=True).unionByName(ch, allowMissingColumns=True)
    u = u.unionByName(bp, allowMissingColumns=True).unionByName(gp, allowMissingColumns=True)
    u = u.withColumn("__td", (F.col("t") - t0).cast(tdec))
    is_step = F.col("__src") == 1
    s = scan(
        u, ["run_id"], "t", ["__src", "event_id"], width=width,
        maxes={"furthest_step": "step"},
        mins={"__t0": F.when(is_step, F.col("t"))},
        sums={
            "__idx": F.when(is_step, F.lit(1)).otherwise(F.lit(0)),
            "nodes_lost": F.coalesce(F.col("__l"), F.lit(0)),
            "replacements": F.coalesce(F.col("__j"), F.lit(0)),
            "__sd": F.coalesce(F.col("__d"), F.lit(0).cast(ddec)),
            "__sdt": F.coalesce(F.col("__d") * F.col("__td"), F.lit(0).cast("decimal(34,6)")),
        },
        lasts={"__lt": F.col("__tick"), "__lg": F.col("__gap")},
    )
    s = s.filter(is_step)
    world = F.when(F.col("ws") != 0, F.col("ws")).otherwise(F.coalesce(F.col("__lt.members_n"), F.col("ws")))
    ckpt = F.coalesce(F.col("__lt.ckpt_step"), F.lit(-1))
    usd = F.greatest((F.col("__td") * F.col("__sd").cast("decimal(22,0)") - F.col("__sdt")).cast("double") / 36_000_000_000.0, F.lit(0.0))
    s = s.withColumns({
        "nodes_training": world.cast("int"), "durable_step": F.greatest(ckpt, F.lit(0)), "usd": usd,
        "supervisor_up": F.when(F.col("t") < F.col("__lg.end"), F.lit(0)).otherwise(F.lit(1)),
    })
    trained = steps.groupBy("run_id").agg((F.sum("ms") / 1000.0).alias("__trained"))
    s = s.join(trained, "run_id", "left")
    s = rolling_upper_median(s, ["run_id"], "__idx", "ms", out="ms_per_step_typical")
    elapsed = F.col("t") - F.col("__t0")
    below = F.col("nodes_training") < target_world
    return s.select(
        "run_id",
        F.floor(F.col("t") * 1000).cast("long").alias("time"),
        "durable_step",
        F.col("step").alias("current_step"),
        "furthest_step",
        F.greatest(F.lit(0), F.col("step") - F.col("durable_step")).alias("steps_at_risk"),
        round_half_up("loss", 4).alias("train_loss"),
        round_half_up(F.col("step") * tokens_per_step / 1e9, 6).alias("tokens_b"),
        "nodes_training",
        F.col("nodes_lost").cast("long").alias("nodes_lost"),
        F.col("replacements").cast("long").alias("replacements"),
        below.cast("int").alias("below_full_world"),
        F.when(below, F.col("furthest_step")).alias("degraded_band"),
        F.when(elapsed > 0, round_half_up(F.least(elapsed, F.col("__trained")) / elapsed, 4)).alias("goodput"),
        F.col("ms").alias("ms_per_step"),
        "ms_per_step_typical",
        F.lit(0).alias("whole_group_restarts"),
        round_half_up("usd", 4).alias("usd"),
        F.when(F.col("step") != 0, round_half_up(F.col("usd") / F.col("step") * 1000, 4)).alias("usd_per_1k"),
        "supervisor_up",
    )


def boot_rows(ticks: DataFrame, steps: DataFrame, changes: DataFrame, ledger: DataFrame, gaps: DataFrame, target_world: int) -> DataFrame:
    """SET-01: rows for the status polls before the first step; only what
    the poll asserts (step columns null)."""
    first = steps.groupBy("run_id").agg(F.min("t").alias("__first"))
    b = ticks.join(first, "run_id", "left").filter(F.col("__first").isNull() | (F.col("t") < F.col("__first")))
    b = b.select("run_id", "t", "event_id", F.size("members").alias("nodes_training"), F.greatest("ckpt_step", F.lit(0)).alias("durable_step"))
    ch = changes.select("run_id", "t", (F.col("kind") == "lost").cast("int").alias("__l"),
                        (F.col("kind") == "joined").cast("int").alias("__j"), F.lit(0).alias("__src"))
    u = b.withColumn("__l", F.lit(0)).withColumn("__j", F.lit(0)).withColumn("__src", F.lit(1)).unionByName(ch, allowMissingColumns=True)
    u = scan(u, ["run_id"], "t", ["__src", "event_id"], width=86400.0, sums={"nodes_lost": "__l", "replacements": "__j"})
    b = u.filter(F.col("__src") == 1).drop("__l", "__j", "__src")
    b = cost_at(b, ledger, "t", t0=float(1_704_067_200.0))
    b = in_gap(b, gaps, "t")
    return b.select(
        "run_id", F.floor(F.col("t") * 1000).cast("long").alias("time"), "durable_step",
        F.lit(None).cast("long").alias("current_step"), F.lit(0).cast("long").alias("furthest_step"),
        F.lit(0).cast("long").alias("steps_at_risk"), F.lit(None).cast("double").alias("train_loss"),
        F.lit(0.0).alias("tokens_b"), "nodes_training",
        F.col("nodes_lost").cast("long").alias("nodes_lost"), F.col("replacements").cast("long").alias("replacements"),
        (F.col("nodes_training") < target_world).cast("int").alias("below_full_world"),
        F.lit(None).cast("long").alias("degraded_band"), F.lit(None).cast("double").alias("goodput"),
        F.lit(None).cast("int").alias("ms_per_step"), F.lit(None).cast("int").alias("ms_per_step_typical"),
        F.lit(0).alias("whole_group_restarts"), round_half_up("usd", 4).alias("usd"), F.lit(None).cast("double").alias("usd_per_1k"),
        "supervisor_up",
    )


# ------------------------------------------------------------ validation --

def eval_points(evals: DataFrame, steps: DataFrame) -> DataFrame:
    """SRC-03 + JN-02: validation points deduplicated on ``(step, loss)``
    (not on step: a re-eval after a rollback survives) and placed on the
    clock by interpolating between the bracketing logged steps (a step
    logged twice keeps its latest time; clamped at both ends)."""
    known = steps.groupBy("run_id", "step").agg(F.max("t").alias("t"))
    e = evals.dropDuplicates(["run_id", "step", "loss"])
    return interpolate_asof(e, known, ["run_id"], "step", "step", "t", "t", width=10000.0)
