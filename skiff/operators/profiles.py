"""Run profiles: the phase timeline from control-plane marks, run summaries
and status rows, recovery rounds and run checks (WN-13/29/30/31/32,
JN-07/08/14, AG-38/45/52/53/54/56/57, PRJ-06/17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.operators.asof import asof_join
from skiff.operators.runs import in_gap
from skiff.operators.scan import scan

# Fixed values of the reference's profile: consecutive (from, to) marks ->
# phase.  Unknown pairs are dropped.
MARK_PHASE = [
    ("launch", "train_start", "provisioning"),
    ("relaunch", "train_start", "preemption_recovery"),
    ("train_start", "kill", "training"),
    ("kill", "relaunch", "downtime"),
    ("train_start", "metrics", "training"),
    ("train_start", "timeout", "training"),
    ("kill", "shrink_resume", "downtime"),
    ("relaunch", "shrink_resume", "downtime"),
    ("shrink_resume", "relaunch", "degraded"),
    ("shrink_resume", "full_world", "degraded"),
    ("relaunch", "full_world", "degraded"),
    ("shrink_resume", "kill", "degraded"),
    ("shrink_resume", "metrics", "degraded"),
    ("shrink_resume", "timeout", "degraded"),
    ("full_world", "kill", "training"),
    ("full_world", "metrics", "training"),
    ("full_world", "timeout", "training"),
]

# On-demand $/hour by instance type (fixed values of the reference's table).
ON_DEMAND_HOURLY_USD = [
    ("g4dn.xlarge", 0.526), ("g4dn.2xlarge", 0.752), ("g4dn.12xlarge", 3.912), ("g5.xlarge", 1.006),
    ("g6.xlarge", 0.805), ("t3.micro", 0.0104), ("t3.small", 0.0208), ("t3.medium", 0.0416),
    ("c6i.2xlarge", 0.34), ("c6i.4xlarge", 0.68), ("c6i.8xlarge", 1.36),
]
RESTART_CAP_S = 90.0


# trainer stamps that split the final training block (fixed values)
STAMP_PHASES = [("training", "train_s"), ("final_saves", "save_s"), ("evaluation", "eval_s"), ("sampling", "sample_s")]


def mark_segments(marks: DataFrame, stamps: DataFrame | None = None, width: float = 86400.0) -> DataFrame:
    """WN-13 + JN-14 + WN-32: consecutive marks of a run mapped to phases by
    a broadcast lookup on the pair (a literal table); the final training
    block (ending at ``metrics`` / ``timeout``) is replaced by the trainer's
    exact stamps when the run has them (``stamps(run_id, train_s, save_s,
    eval_s, sample_s)``); each segment's offset is the running sum of the
    previous segments."""
    spark = marks.sparkSession
    lookup = spark.createDataFrame(MARK_PHASE, "a string, b string, phase string")
    m = scan(marks, ["run_id"], "t", ["seq"], width=width, nexts={"__n": F.struct(F.col("event").alias("e"), F.col("t").alias("t"))})
    pairs = m.filter(F.col("__n").isNotNull()).select(
        "run_id", "seq", F.col("event").alias("a"), F.col("__n.e").alias("b"), F.col("t").alias("start"),
        (F.col("__n.t") - F.col("t")).alias("seconds"),
    )
    seg = pairs.join(F.broadcast(lookup), on=["a", "b"], how="inner").withColumn("sub", F.lit(0))
    if stamps is not None:
        final = (F.col("phase") == "training") & F.col("b").isin("metrics", "timeout")
        arr = F.filter(F.array(*[F.struct(F.lit(ph).alias("phase"), F.col(k).cast("double").alias("seconds"), F.lit(i).alias("sub"))
                                 for i, (ph, k) in enumerate(STAMP_PHASES)]), lambda x: F.coalesce(x["seconds"], F.lit(0.0)) != 0)
        st = stamps.select("run_id", arr.alias("__st")).filter(F.size("__st") > 0)
        j = seg.join(st, "run_id", "left")
        keep = j.filter(~final | F.col("__st").isNull()).drop("__st")
        split = j.filter(final & F.col("__st").isNotNull()).select("a", "b", "run_id", "seq", "start", F.explode("__st").alias("x")).select(
            "a", "b", "run_id", "seq", "start", F.col("x.seconds").alias("seconds"), F.col("x.phase").alias("phase"), F.col("x.sub").alias("sub"))
        seg = keep.unionByName(split)
    seg = scan(seg, ["run_id"], "start", ["seq", "sub"], width=width, sums={"__cum": "seconds"})
    return seg.select("run_id", "seq", "phase", "start", "seconds", (F.col("__cum") - F.col("seconds")).alias("offset_s"))


def phase_seconds(segments: DataFrame) -> DataFrame:
    """AG-34 from marks: seconds per phase and the total per run."""
    p = segments.groupBy("run_id", "phase").agg(F.sum("seconds").alias("seconds"))
    t = segments.groupBy("run_id").agg(F.sum("seconds").alias("seconds")).withColumn("phase", F.lit("total_s"))
    return p.unionByName(t)


def newest_attempts(events: DataFrame) -> DataFrame:
    """WN-18: the newest attempt of every node."""
    return events.filter(F.col("node").isNotNull()).groupBy("run_id", "node").agg(
        F.max(F.coalesce(F.col("attempt"), F.lit(0))).alias("attempt"))


def effective_rates(ledger: DataFrame, type_col: str = "instance_type") -> DataFrame:
    """JN-07: the recorded rate wins; otherwise the on-demand rate of the
    instance type from the (literal, broadcast) table; flagged when both
    are missing."""
    rates = ledger.sparkSession.createDataFrame(ON_DEMAND_HOURLY_USD, f"{type_col} string, on_demand_usd double")
    j = ledger.join(F.broadcast(rates), on=type_col, how="left")
    return j.withColumn("rate_usd", F.coalesce(F.col("hourly_usd"), F.col("on_demand_usd"))).withColumn(
        "rate_source", F.when(F.col("hourly_usd").isNotNull(), F.lit("ledger")).when(F.col("on_demand_usd").isNotNull(), F.lit("on_demand")).otherwise(F.lit("unknown")))


def launch_price(instances: DataFrame, prices: DataFrame) -> DataFrame:
    """JN-08: the spot price a machine bills at: the newest price sample of
    its type and AZ at or before its launch (ties at one time: the highest)."""
    p = prices.groupBy("instance_type", "az", "t").agg(F.max("price_usd").alias("price_usd"))
    return asof_join(instances, p, ["instance_type", "az"], "started_at", "t", ["price_usd"], prefix="spot_",
                     left_tiebreak=["instance_id"], width=86400.0)


def control_plane_cost(created_at: Column, rate: Column, now: Column) -> Column:
    """PRJ-17: controller cost since creation (null without rate or start)."""
    return F.when(rate.isNotNull() & (rate > 0) & created_at.isNotNull(), (now - created_at) * rate / 3600.0)


def tick_payload(series: DataFrame) -> DataFrame:
    """PRJ-06: the per-tick metric payload from run-series rows."""
    return series.select(
        "run_id", "time", F.col("current_step").alias("train_step"), "durable_step", "steps_at_risk", "train_loss",
        "tokens_b", "nodes_training", "below_full_world", "nodes_lost", "replacements", "goodput",
        "whole_group_restarts", "ms_per_step", "usd", "usd_per_1k",
    )


def run_summary(steps: DataFrame, vals: DataFrame, launch: DataFrame, changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """AG-38 + AG-37: one summary row per run: window from launch to the last
    step, goodput = trained seconds / wall seconds, losses and joins from
    the epoch timeline, steps, final validation loss, dollars, wall hours."""
    s = steps.groupBy("run_id").agg(
        F.max("t").alias("end_t"), F.max_by("step", F.struct("t", "event_id")).alias("steps"),
        (F.sum("ms") / 1000.0).alias("trained_s"),
    )
    v = vals.groupBy("run_id").agg(F.max_by("loss", F.struct("step", "loss")).alias("val_loss"))
    c = changes.groupBy("run_id").agg(
        F.count(F.when(F.col("kind") == "lost", F.lit(1))).alias("nodes_lost"),
        F.count(F.when(F.col("kind") == "joined", F.lit(1))).alias("replacements"),
    )
    j = s.join(launch, "run_id", "left").join(v, "run_id", "left").join(c, "run_id", "left")
    led = ledger.join(j.select("run_id", "end_t"), "run_id")
    end = F.least(F.coalesce(F.col("stopped_at"), F.col("end_t")), F.col("end_t"))
    usd = led.groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("hourly_usd").isNotNull(),
                                                            F.greatest(F.lit(0.0), end - F.col("started_at")) * F.col("hourly_usd") / 3600.0)), F.lit(0.0)).alias("usd"))
    j = j.join(usd, "run_id", "left")
    wall = F.col("end_t") - F.col("launch")
    return j.select(
        "run_id",
        F.floor(F.col("launch") * 1000).cast("long").alias("run_start_ms"),
        F.floor(F.col("end_t") * 1000).cast("long").alias("run_end_ms"),
        (F.col("trained_s") / F.when(wall > 0, wall).otherwise(F.lit(1.0))).alias("goodput"),
        F.coalesce(F.col("nodes_lost"), F.lit(0)).alias("nodes_lost"),
        F.coalesce(F.col("replacements"), F.lit(0)).alias("replacements"),
        F.lit(0).alias("whole_group_restarts"), "steps", "val_loss",
        F.coalesce(F.col("usd"), F.lit(0.0)).alias("usd"), (wall / 3600.0).alias("wall_hours"),
    )


def status_rows(ticks: DataFrame, ledger: DataFrame, as_of: float, budget_s: float, stale_s: float = 90.0) -> DataFrame:
    """AG-57: status per run at ``as_of``: last tick age and stale flag,
    epoch, world, durable step, dollars so far, elapsed seconds and share of
    the budget, done."""
    last = ticks.groupBy("run_id").agg(
        F.max_by(F.struct("t", "epoch", F.size("members").alias("world"), "ckpt_step", "done"), F.struct("t", "event_id")).alias("x"),
        F.min("t").alias("first_t"),
    )
    end = F.least(F.coalesce(F.col("stopped_at"), F.lit(as_of)), F.lit(as_of))
    usd = ledger.groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("hourly_usd").isNotNull(),
                                                               F.greatest(F.lit(0.0), end - F.col("started_at")) * F.col("hourly_usd") / 3600.0)), F.lit(0.0)).alias("usd"))
    j = last.join(usd, "run_id", "left")
    age = F.lit(as_of) - F.col("x.t")
    elapsed = F.lit(as_of) - F.col("first_t")
    return j.select(
        "run_id", age.alias("tick_age_s"), (age > stale_s).alias("stale"), F.col("x.epoch").alias("epoch"),
        F.col("x.world").alias("world"), F.greatest(F.col("x.ckpt_step"), F.lit(0)).alias("durable_step"),
        F.coalesce(F.col("usd"), F.lit(0.0)).alias("usd"), elapsed.alias("elapsed_s"),
        (elapsed / budget_s).alias("budget_share"), F.coalesce(F.col("x.done"), F.lit(False)).alias("done"),
    )


def shrink_verdict(marks: DataFrame, steps: DataFrame, full_world: int, node_count: int) -> DataFrame:
    """AG-45: the three checks of an elastic-shrink run: a shrink_resume mark,
    step lines at the shrunken world size, and a final world size of the
    shrunken group."""
    shrunk = full_world // node_count * (node_count - 1) if full_world % node_count == 0 else None
    m = marks.groupBy("run_id").agg(F.max((F.col("event") == "shrink_resume").cast("int")).alias("__m"))
    s = steps.groupBy("run_id").agg(
        F.max((F.col("ws") == F.lit(shrunk)).cast("int")).alias("__ws"),
        F.max_by("ws", F.struct("t", "event_id")).alias("final_ws"),
    )
    j = s.join(m, "run_id", "left")
    c1 = F.coalesce(F.col("__m"), F.lit(0)) == 1
    c2 = F.coalesce(F.col("__ws"), F.lit(0)) == 1
    c3 = F.col("final_ws") == F.lit(shrunk)
    return j.select("run_id", c1.alias("survivors_checkpointing"), c2.alias("shrunken_steps"),
                    F.coalesce(c3, F.lit(False)).alias("shrunken_metrics"),
                    (c1 & c2 & F.coalesce(c3, F.lit(False))).alias("passed"))


def threshold_marks(kills: DataFrame, ticks: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-29: per kill cycle, the first tick whose durable step passes the
    step durable at the kill (``shrink_resume``) and the first tick back at
    full world (``full_world``).  Ticks are attached to the latest kill (an
    as-of join), so each cycle is a plain group."""
    full = ticks.groupBy("run_id").agg(F.max(F.size("members")).alias("__full"))
    tk = ticks.select("run_id", "t", "event_id", "ckpt_step", F.size("members").alias("world"))
    base = asof_join(kills.select("run_id", "kill_t", "kill_id"), tk, ["run_id"], "kill_t", "t", ["ckpt_step"], prefix="base_",
                     left_tiebreak=["kill_id"], right_tiebreak=["event_id"], width=width)
    cyc = asof_join(tk, base.select("run_id", "kill_t", "kill_id", "base_ckpt_step"), ["run_id"], "t", "kill_t",
                    ["kill_t", "kill_id", "base_ckpt_step"], prefix="k_", left_tiebreak=["event_id"], right_tiebreak=["kill_id"], width=width, strict=True)
    cyc = cyc.filter(F.col("k_kill_id").isNotNull()).join(full, "run_id")
    g = cyc.groupBy("run_id", F.col("k_kill_id").alias("kill_id"), F.col("k_kill_t").alias("kill_t")).agg(
        F.min(F.when(F.col("ckpt_step") > F.coalesce(F.col("k_base_ckpt_step"), F.lit(-1)), F.col("t"))).alias("shrink_resume_t"),
        F.min(F.when(F.col("world") >= F.col("__full"), F.col("t"))).alias("full_world_t"),
    )
    return g


def restart_labels(obs: DataFrame, timeline: DataFrame, ticks: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-30 + WN-31: label per node per tick — ``down`` (AWS dead state),
    ``restart`` (a survivor of the last epoch change until the durable step
    advances past the change, at most 90 s), ``train`` (member), ``prov``;
    ``kill`` marks a node going train -> down."""
    ch = scan(timeline, ["run_id"], "t", ["event_id"], width=width, prevs={"__pm": F.col("members")})
    ch = ch.filter(F.col("__pm").isNotNull()).select(
        "run_id", F.col("t").alias("change_t"), F.col("event_id").alias("change_id"),
        F.array_intersect("__pm", "members").alias("survivors"))
    ck = ticks.select("run_id", "t", "event_id", "ckpt_step")
    base = asof_join(ch, ck, ["run_id"], "change_t", "t", ["ckpt_step"], prefix="at_", left_tiebreak=["change_id"], right_tiebreak=["event_id"], width=width)
    o = obs.join(ck.select("run_id", "event_id", "ckpt_step"), ["run_id", "event_id"])
    o = asof_join(o, base.select("run_id", "change_t", "change_id", "survivors", "at_ckpt_step"), ["run_id"], "t", "change_t",
                  ["change_t", "survivors", "at_ckpt_step"], prefix="c_", left_tiebreak=["event_id", "node"], right_tiebreak=["change_id"], width=width)
    restarting = (
        F.coalesce(F.array_contains("c_survivors", F.col("node")), F.lit(False))
        & ~(F.col("ckpt_step") > F.coalesce(F.col("c_at_ckpt_step"), F.lit(-1)))
        & ((F.col("t") - F.col("c_change_t")) <= RESTART_CAP_S)
        & F.array_contains("members", F.col("node"))
    )
    dead = F.col("aws_state").isin("shutting-down", "terminated", "stopping", "stopped")
    label = F.when(dead, F.lit("down")).when(restarting, F.lit("restart")).when(F.array_contains("members", F.col("node")), F.lit("train")).otherwise(F.lit("prov"))
    o = o.withColumn("label", label)
    o = scan(o, ["run_id", "node"], "t", ["event_id"], width=width, prevs={"__pl": F.col("label")})
    return o.select("run_id", "t", "event_id", "node", "label", ((F.col("__pl") == "train") & (F.col("label") == "down")).alias("kill"))


def data_checks(kills: DataFrame, timeline: DataFrame, gaps: DataFrame, steps: DataFrame, restarts: DataFrame, max_outages: int = 12) -> DataFrame:
    """AG-56: the data checks that judge a run, one row per (run, check):
    kills fired, epochs re-formed, no whole-group restart, outage bands as
    expected, epochs never go back, steps advance during an outage.
    ``restarts`` are the decision log's whole-group restarts; outages of a run
    don't overlap, so a step is inside one by an as-of look-up, not a pairing."""
    k = kills.groupBy("run_id").agg(F.count(F.lit(1)).alias("kills"))
    e = scan(timeline, ["run_id"], "t", ["event_id"], width=86400.0, prevs={"__pe": F.col("epoch")})
    e = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"),
                                F.coalesce(F.bool_and(F.col("__pe").isNull() | (F.col("epoch") >= F.col("__pe"))), F.lit(True)).alias("monotone"))
    g = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("outages"))
    placed = in_gap(steps.select("run_id", "t", "step"), gaps, tiebreak=("step",))
    runs = placed.groupBy("run_id").agg(F.count_if(F.col("supervisor_up") == 0).alias("steps_in_outage"))
    w = restarts.groupBy("run_id").agg(F.count(F.lit(1)).alias("restarts"))
    j = runs.join(k, "run_id", "left").join(e, "run_id", "left").join(g, "run_id", "left").join(w, "run_id", "left")
    checks = F.array(
        F.struct(F.lit("kills_fired").alias("check"), (F.coalesce(F.col("kills"), F.lit(0)) > 0).alias("passed")),
        F.struct(F.lit("epochs_reformed").alias("check"), (F.coalesce(F.col("epochs"), F.lit(0)) > 1).alias("passed")),
        F.struct(F.lit("no_whole_group_restart").alias("check"), F.col("restarts").isNull().alias("passed")),
        F.struct(F.lit("outage_bands").alias("check"), (F.coalesce(F.col("outages"), F.lit(0)) <= max_outages).alias("passed")),
        F.struct(F.lit("epochs_monotone").alias("check"), F.coalesce(F.col("monotone"), F.lit(True)).alias("passed")),
        F.struct(F.lit("steps_during_outage").alias("check"),
                 ((F.coalesce(F.col("outages"), F.lit(0)) == 0) | (F.coalesce(F.col("steps_in_outage"), F.lit(0)) > 0)).alias("passed")),
    )
    return j.select("run_id", F.explode(checks).alias("c")).select("run_id", "c.check", "c.passed")


def world_window_rates(ticks: DataFrame, width: float = 86400.0) -> DataFrame:
    """AG-54: durable-step rate inside each world-size window of the ticks
    (steps gained / seconds between the window's first and last tick),
    relative to the run's full-world rate."""
    from skiff.operators.scan import islands

    t = ticks.select("run_id", "t", "event_id", "ckpt_step", F.size("members").alias("world"))
    isl = islands(t, ["run_id"], "t", ["world"], ["event_id"], width=width, out="win")
    w = isl.groupBy("run_id", "win").agg(
        F.first("world").alias("world"), F.min("t").alias("start"), F.max("t").alias("end"),
        (F.max("ckpt_step") - F.min("ckpt_step")).alias("steps"),
    ).withColumn("rate", F.when(F.col("end") > F.col("start"), F.col("steps") / (F.col("end") - F.col("start"))))
    full = w.groupBy("run_id").agg(F.max("world").alias("__fw"))
    fr = w.join(full, "run_id").filter(F.col("world") == F.col("__fw")).groupBy("run_id").agg(
        F.try_divide(F.sum("steps").cast("double"), F.sum(F.col("end") - F.col("start"))).alias("full_rate"))
    return w.join(fr, "run_id", "left").withColumn("rate_vs_full", F.try_divide(F.col("rate"), F.col("full_rate"))).drop("__i")
