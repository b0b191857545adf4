"""Run timelines from lifecycle events and status ticks: node state spans,
wasted work, world-size spans, degraded windows, leadership, epoch timeline,
losses and joins (WN-05/06/07/08/14/15/16/22/24/25, JN-09/13/16).

Lifecycle events: ``(run_id, node, attempt, ts, state, step, world, leader,
event_id)``; ``event_id`` (or any unique column) is the tie-break for equal
times, standing in for the reference's stable sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.operators.asof import asof_join
from skiff.operators.scan import flag_runs, islands, scan, spans

# Node state -> timeline label (fixed values of the reference's reducer).
STATE_LABEL = {
    "provisioning": "prov",
    "reconfiguring": "reconfig",
    "training": "train",
    "stalled": "stalled",
    "down": "down",
    "killed": "down",
}
ROW = ["run_id", "node", "attempt"]


def _label(state: Column) -> Column:
    expr = None
    for k, v in STATE_LABEL.items():
        expr = F.when(state == k, F.lit(v)) if expr is None else expr.when(state == k, F.lit(v))
    return expr


def node_events(events: DataFrame) -> DataFrame:
    """Node events with a known state; attempt defaults to 0."""
    return events.filter(F.col("state").isin(list(STATE_LABEL)) & F.col("node").isNotNull()).withColumn(
        "attempt", F.coalesce(F.col("attempt"), F.lit(0))
    )


def run_t0(events: DataFrame) -> DataFrame:
    """Per run: first timestamp over node and world records."""
    usable = (F.col("state").isin(list(STATE_LABEL)) & F.col("node").isNotNull()) | (
        (F.col("state") == "epoch") & F.col("world").isNotNull()
    )
    return events.filter(usable).groupBy("run_id").agg(F.min("ts").alias("t0"))


def markers(events: DataFrame) -> DataFrame:
    """Instant markers: ``reconfiguring`` (node realised a world change) and
    kills (``killed`` / ``down``) per (run, node, attempt)."""
    ne = node_events(events)
    return ne.filter(F.col("state").isin("reconfiguring", "killed", "down")).select(
        *ROW, "ts", F.when(F.col("state") == "reconfiguring", F.lit("realized")).otherwise(F.lit("kill")).alias("marker")
    )


def wasted_work(events: DataFrame, width: float = 3600.0) -> DataFrame:
    """WN-16: training resumed below the peak of the previous training run.

    Per (run, node, attempt) in time order, training events open segments;
    the peak of a segment is the max of its opening step and the steps of
    stalled events inside it (peak time = the last such stalled event, else
    the opening).  A training event below the previous segment's peak lost
    ``peak - step`` steps, re-done in ``lost / rate`` seconds at the
    previous segment's rate.  One row per such event."""
    ne = node_events(events)
    ne = ne.withColumn("__is_train", (F.col("state") == "training").cast("int"))
    seg = scan(ne, ROW, "ts", ["event_id"], width=width, sums={"seg": "__is_train"})
    opens = seg.filter(F.col("state") == "training").select(
        *ROW, "seg", F.col("ts").alias("open_ts"), F.col("step").alias("open_step"), "event_id"
    )
    stalls = (
        seg.filter((F.col("state") == "stalled") & F.col("step").isNotNull() & (F.col("seg") > 0))
        .groupBy(*ROW, "seg")
        .agg(F.max("step").alias("st_max"), F.max_by("ts", F.struct("ts", "event_id")).alias("st_ts"))
    )
    prev = opens.join(stalls, on=[*ROW, "seg"], how="left").select(
        *ROW,
        (F.col("seg") + 1).alias("seg"),
        F.col("open_ts").alias("p_ts"),
        F.col("open_step").alias("p_step"),
        F.when(F.col("open_step").isNull(), F.col("st_max"))
        .otherwise(F.greatest(F.col("open_step"), F.coalesce(F.col("st_max"), F.col("open_step"))))
        .alias("peak"),
        F.coalesce(F.col("st_ts"), F.col("open_ts")).alias("peak_ts"),
    )
    j = opens.join(prev, on=[*ROW, "seg"], how="inner")
    j = j.filter(F.col("open_step").isNotNull() & F.col("peak").isNotNull() & F.col("p_step").isNotNull())
    j = j.filter(F.col("open_step") < F.col("peak"))
    lost = F.col("peak") - F.col("open_step")
    run_steps = F.col("peak") - F.col("p_step")
    run_secs = F.col("peak_ts") - F.col("p_ts")
    rate = F.when(run_secs > 0, run_steps / run_secs).otherwise(F.lit(0.0))
    secs = F.when(rate > 0, lost / rate).otherwise(F.lit(0.0))
    out = j.select(*ROW, F.col("open_ts").alias("ts"), "event_id", lost.alias("lost_steps"), secs.alias("redo_s"))
    return out.filter((F.col("lost_steps") > 0) & (F.col("redo_s") > 0))


def node_samples(events: DataFrame, width: float = 3600.0) -> DataFrame:
    """WN-08 + WN-16: labelled samples per (run, node, attempt): state
    labels, ``wasted`` painted over the re-compute window of a rollback
    (clamped to the next sample) with training re-opened after it."""
    ne = node_events(events).filter(F.col("state") != "reconfiguring")
    ne = ne.select(*ROW, "ts", "event_id", _label(F.col("state")).alias("label"))
    ne = scan(ne, ROW, "ts", ["event_id"], width=width, nexts={"next_ts": F.col("ts")})
    w = wasted_work(events, width).select(*ROW, "event_id", "redo_s")
    s = ne.join(w, on=[*ROW, "event_id"], how="left")
    we = F.least(F.col("ts") + F.col("redo_s"), F.coalesce(F.col("next_ts"), F.lit(float("inf"))))
    s = s.withColumn("__we", F.when(F.col("redo_s").isNotNull(), we))
    painted = s.select(
        *ROW, "ts", F.col("event_id").cast("double").alias("seq"),
        F.when(F.col("redo_s").isNotNull(), F.lit("wasted")).otherwise(F.col("label")).alias("label"),
    )
    reopen = s.filter(
        F.col("__we").isNotNull() & (F.col("__we") > F.col("ts")) & (F.col("__we") < F.coalesce(F.col("next_ts"), F.lit(float("inf"))))
    ).select(*ROW, F.col("__we").alias("ts"), (F.col("event_id") + 0.5).alias("seq"), F.lit("train").alias("label"))
    return painted.unionByName(reopen)


def node_spans(events: DataFrame, as_of: Column | float, width: float = 3600.0) -> DataFrame:
    """WN-05 over WN-08/16: merged state spans per (run, node, attempt),
    ``start_rel`` relative to the run's first record; the last span ends at
    ``as_of``."""
    smp = node_samples(events, width)
    sp = spans(smp, ROW, "ts", ["label"], ["seq"], as_of=as_of, width=width)
    t0 = run_t0(events)
    return sp.join(t0, on="run_id").select(
        *ROW, "span_no", "label", "start", "end",
        (F.col("start") - F.col("t0")).alias("start_rel"), (F.col("end") - F.col("start")).alias("duration"),
    )


def wasted_totals(events: DataFrame) -> DataFrame:
    """Lost steps per (run, node, attempt)."""
    return wasted_work(events).groupBy(*ROW).agg(F.sum("lost_steps").alias("wasted_steps"), F.sum("redo_s").alias("redo_s"))


def world_samples(events: DataFrame) -> DataFrame:
    return events.filter((F.col("state") == "epoch") & F.col("world").isNotNull()).select(
        "run_id", "ts", F.col("world").cast("int").alias("world"), "event_id"
    )


def world_spans(events: DataFrame, as_of: Column | float, width: float = 3600.0) -> DataFrame:
    """WN-05 on the world-size curve from epoch events (ties: smaller world
    first, as a sort of ``(ts, world)`` does)."""
    ws = world_samples(events)
    sp = spans(ws, ["run_id"], "ts", ["world"], ["world", "event_id"], as_of=as_of, width=width)
    t0 = run_t0(events)
    return sp.join(t0, on="run_id").select(
        "run_id", "span_no", "world", "start", "end",
        (F.col("start") - F.col("t0")).alias("start_rel"), (F.col("end") - F.col("start")).alias("duration"),
    )


def degraded_windows(wspans: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-06: spans below the full world (max ever seen), counted only after
    full was first reached; consecutive ones merge into a window with its
    depth (smallest world)."""
    full = wspans.groupBy("run_id").agg(F.max("world").alias("full"))
    s = wspans.join(full, on="run_id").withColumn("__atfull", ((F.col("full") > 0) & (F.col("world") >= F.col("full"))).cast("int"))
    s = scan(s, ["run_id"], "start", ["span_no"], width=width, maxes={"__reached": "__atfull"})
    s = s.withColumn("__deg", (F.col("__reached") == 1) & (F.col("full") > 0) & (F.col("world") < F.col("full")))
    isl = flag_runs(s, ["run_id"], "start", "__deg", ["span_no"], width=width, out="__w")
    return (
        isl.filter("__deg")
        .groupBy("run_id", "__w")
        .agg(F.min("start_rel").alias("start_rel"), F.sum("duration").alias("duration"), F.min("world").alias("min_world"))
        .drop("__w")
    )


def degraded_summary(wspans: DataFrame) -> DataFrame:
    """WN-06 totals per run: full world, current world, degraded seconds
    and number of windows."""
    win = degraded_windows(wspans).groupBy("run_id").agg(
        F.sum("duration").alias("total"), F.count(F.lit(1)).alias("windows")
    )
    base = wspans.groupBy("run_id").agg(
        F.max("world").alias("full"), F.max_by("world", F.struct("start", "span_no")).alias("current")
    )
    return base.join(win, on="run_id", how="left").select(
        "run_id", F.col("full").alias("full_world"), "current", F.coalesce(F.col("total"), F.lit(0.0)).alias("total"),
        F.coalesce(F.col("windows"), F.lit(0)).alias("windows"),
    )


def leader_handovers(events: DataFrame, width: float = 3600.0) -> DataFrame:
    """WN-15: epoch events where the leader changes (first leader counts)."""
    e = events.filter((F.col("state") == "epoch") & F.col("world").isNotNull() & F.col("leader").isNotNull())
    e = e.select("run_id", "ts", "event_id", F.col("leader").cast("int").alias("leader"))
    e = scan(e, ["run_id"], "ts", ["event_id"], width=width, prevs={"__prev": F.col("leader")})
    return e.filter(F.col("__prev").isNull() | (F.col("__prev") != F.col("leader"))).drop("__prev")


def leader_rows(events: DataFrame, width: float = 3600.0) -> DataFrame:
    """JN-13: the (node, attempt) row a handover lands on: the highest
    attempt of that node started by then, else its lowest attempt."""
    h = leader_handovers(events, width).select("run_id", F.col("leader").alias("node"), "ts", "event_id")
    starts = (
        node_samples(events, width)
        .groupBy(*ROW)
        .agg(F.min("ts").alias("first_ts"))
    )
    u = h.withColumn("__src", F.lit(1)).withColumn("__a", F.lit(None).cast("int")).unionByName(
        starts.select("run_id", "node", F.col("first_ts").alias("ts"), F.col("attempt").alias("__a"),
                      F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("__src"))
    )
    u = scan(u, ["run_id", "node"], "ts", ["__src", "event_id"], width=width, maxes={"__started": "__a"})
    low = starts.groupBy("run_id", "node").agg(F.min("attempt").alias("__low"))
    out = u.filter(F.col("__src") == 1).join(low, on=["run_id", "node"], how="left")
    return out.select(
        "run_id", "ts", "node",
        F.coalesce(F.col("__started"), F.col("__low"), F.lit(0)).alias("attempt"),
    )


def current_leader(events: DataFrame, as_of: Column | float) -> DataFrame:
    """WN-15: the leader at ``as_of`` (last handover at or before it)."""
    h = leader_handovers(events).filter(F.col("ts") <= (as_of if isinstance(as_of, Column) else F.lit(as_of)))
    return h.groupBy("run_id").agg(F.max_by("leader", F.struct("ts", "event_id")).alias("leader"))


# ------------------------------------------------------------ epochs -----

def epoch_timeline(ticks: DataFrame, log: DataFrame, width: float = 3600.0) -> DataFrame:
    """WN-24 + JN-16: first tick of each epoch change, only epochs the
    decision log published, consecutive repeats dropped; members and master
    come from the log (the authoritative record)."""
    known = ticks.withColumn("epoch", F.coalesce(F.col("epoch"), F.lit(0))).join(
        log.select("run_id", "epoch"), on=["run_id", "epoch"], how="left_semi"
    )
    known = scan(known.select("run_id", "t", "event_id", "epoch"), ["run_id"], "t", ["event_id"], width=width,
                 prevs={"__prev": F.col("epoch")})
    firsts = known.filter(F.col("__prev").isNull() | (F.col("__prev") != F.col("epoch"))).drop("__prev")
    return firsts.join(log, on=["run_id", "epoch"]).select("run_id", "t", "event_id", "epoch", "members", "master")


def member_changes(timeline: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-14 / SET-03: one row per node lost or joined at an epoch change
    (the first epoch yields none)."""
    s = scan(timeline, ["run_id"], "t", ["event_id"], width=width, prevs={"__pm": F.col("members")})
    s = s.filter(F.col("__pm").isNotNull())
    lost = s.select("run_id", "t", F.lit("lost").alias("kind"), F.explode(F.array_except("__pm", "members")).alias("node"))
    joined = s.select("run_id", "t", F.lit("joined").alias("kind"), F.explode(F.array_except("members", "__pm")).alias("node"))
    return lost.unionByName(joined)


def survivors(timeline: DataFrame, width: float = 86400.0) -> DataFrame:
    """SET-04: members on both sides of each epoch change."""
    s = scan(timeline, ["run_id"], "t", ["event_id"], width=width, prevs={"__pm": F.col("members")})
    return s.filter(F.col("__pm").isNotNull()).select("run_id", "t", "epoch", F.array_intersect("__pm", "members").alias("survivors"))


def world_rows(timeline: DataFrame, launch: DataFrame, end_t: Column | float | None, target: int) -> DataFrame:
    """WN-25: world size on the epoch clock with a zero row at launch (when
    it precedes the first epoch) and a closing row at ``end_t`` (when later
    than the last epoch)."""
    ep = timeline.select("run_id", "t", F.size("members").alias("nodes_training"), F.lit(1).alias("__o"))
    bounds = timeline.groupBy("run_id").agg(
        F.min("t").alias("__first"), F.max_by(F.size("members"), F.struct("t", "event_id")).alias("__lastn"), F.max("t").alias("__last")
    )
    l = launch.join(bounds, on="run_id", how="left")
    first = l.filter(F.col("__first").isNull() | (F.col("launch") < F.col("__first"))).select(
        "run_id", F.col("launch").alias("t"), F.lit(0).alias("nodes_training"), F.lit(0).alias("__o")
    )
    parts = first.unionByName(ep)
    if end_t is not None:
        e = end_t if isinstance(end_t, Column) else F.lit(float(end_t))
        last = l.filter(e > F.coalesce(F.col("__last"), F.col("launch"))).select(
            "run_id", e.alias("t"), F.coalesce(F.col("__lastn"), F.lit(0)).alias("nodes_training"), F.lit(2).alias("__o")
        )
        parts = parts.unionByName(last)
    return parts.select(
        "run_id", F.floor(F.col("t") * 1000).cast("long").alias("time"), "nodes_training",
        (F.col("nodes_training") < target).cast("int").alias("below_full_world"),
    )


def degraded_regions(timeline: DataFrame, target: int, width: float = 86400.0) -> DataFrame:
    """WN-07 + SNK-06: regions where the epoch world is below ``target``;
    an open region ends at the last epoch."""
    s = timeline.withColumn("__short", F.size("members") < target)
    isl = islands(s, ["run_id"], "t", ["__short"], ["event_id"], width=width, out="__i")
    isl = scan(isl, ["run_id"], "t", ["event_id"], width=width, nexts={"__next_t": F.col("t")})
    last = timeline.groupBy("run_id").agg(F.max("t").alias("__last"))
    g = isl.filter("__short").groupBy("run_id", "__i").agg(
        F.min("t").alias("start"), F.max_by("__next_t", F.struct("t", "event_id")).alias("__end")
    )
    g = g.join(last, on="run_id").withColumn("end", F.coalesce(F.col("__end"), F.col("__last")))
    return g.select(
        "run_id", F.floor(F.col("start") * 1000).cast("long").alias("time"), F.floor(F.col("end") * 1000).cast("long").alias("timeEnd"),
        F.lit("degraded").alias("title"),
    )


# ------------------------------------------------------------- kills -----

def kill_pairs(terminations: DataFrame) -> DataFrame:
    """SET-06: distinct ``(node, instance)`` pairs in order of first appearance."""
    return terminations.groupBy("run_id", "node", "instance_id").agg(F.min("pos").alias("pos"))


def kill_times(terminations: DataFrame, kills: DataFrame) -> DataFrame:
    """JN-09: zip distinct kill pairs (log order) with kill timestamps (time
    order) by ordinal; the shorter side truncates.  ``pos`` may be any
    orderable value, such as the log reader's (file, block, line); a run's
    distinct pairs are its machines, so they are ranked in one window."""
    order = Window.partitionBy("run_id").orderBy("pos", "node", "instance_id")
    pairs = kill_pairs(terminations).withColumn("ordinal", F.row_number().over(order).cast("long"))
    k = kills.withColumn("__one", F.lit(1))
    k = scan(k, ["run_id"], "ts", ["event_id"], width=86400.0, sums={"ordinal": "__one"}).drop("__one")
    return pairs.join(k.select("run_id", "ordinal", "ts"), on=["run_id", "ordinal"]).select("run_id", "ordinal", "node", "instance_id", "ts")


def generation_spans(rows: DataFrame, width: float = 1e6) -> DataFrame:
    """WN-22: per (run, slot, generation) the training window from its step
    times, clamped so generations of a slot never overlap: the start is at
    least the previous generation's end, the end never goes back."""
    g = rows.groupBy("run_id", "slot", "gen").agg(F.min("t").alias("start0"), F.max("t").alias("end0"))
    g = g.withColumn("__g", F.col("gen").cast("double"))
    # the clamped end of a generation is the running max of raw ends, so the
    # end carried into the next generation is the previous running max
    g = scan(g, ["run_id", "slot"], "__g", width=width, maxes={"__cum_end": "end0"})
    g = scan(g, ["run_id", "slot"], "__g", width=width, prevs={"__prev_end": F.col("__cum_end")})
    start = F.greatest(F.col("start0"), F.coalesce(F.col("__prev_end"), F.col("start0")))
    end = F.greatest(start, F.col("end0"), F.coalesce(F.col("__prev_end"), start))
    name = F.concat(F.lit("node"), F.col("slot").cast("string"), F.when(F.col("gen") > 0, F.concat(F.lit("-r"), F.col("gen").cast("string"))).otherwise(F.lit("")))
    # TK-05: display order of a run's rows, slot by slot (a run has few generations)
    row = F.row_number().over(Window.partitionBy("run_id").orderBy("slot", "gen"))
    return g.select("run_id", "slot", "gen", name.alias("name"), start.alias("start"), end.alias("end"), row.alias("row"))


# ---------------------------------------------------------------- occupancy --

BILLABLE = ["pending", "running"]
_FAR = 1 << 40
FIT_ROWS = 4096  # periods that one fold goes through


def _through(q: Column, f: Column, l: Column) -> Column:
    """Next free place after a period that may take places ``[f, l)``, when ``q`` (at most
    ``l``) is the next free place before it."""
    return F.greatest(f + 1, F.least(q + 1, l))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place each period of a bucket takes, from the bucket's incoming place ``q``."""
    for batch in batches:
        rows = batch.column("rows")
        sizes = rows.value_lengths().to_numpy()
        flat = rows.flatten()
        first, last = flat.field("f").to_pylist(), flat.field("l").to_pylist()
        place, at = [-1] * len(first), 0
        for q, size in zip(batch.column("q").to_pylist(), sizes.tolist()):
            for i in range(at, at + size):
                here = max(first[i], q)
                if here < last[i]:
                    place[i], q = here, here + 1
                else:
                    q = last[i]
            at += size
        run = batch.column("run_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        out = pa.record_batch([run, flat.field("pos"), pa.array(place, pa.int64())], names=["run_id", "pos", "place"])
        yield out.filter(pc.greater_equal(out.column("place"), 0))


def _first_fit(periods: DataFrame, free: DataFrame, width: float) -> DataFrame:
    """One slot by itself: its periods in time order take the first machine in
    ``[from, until)`` that no earlier period of the slot took.

    Machines are numbered by start (``free`` has ``n`` of one start, ``upto`` with all earlier
    ones), so a period may take the places ``[f, l)``, and the
    next free place runs through ``max(f + 1, min(q + 1, l))``. Such maps compose to one
    of their kind, ``max(low, min(q + n, high))``: a bucket of ``FIT_ROWS`` periods is one map,
    the maps of a run's buckets give each bucket its incoming place, and buckets are folded apart."""
    none = F.lit(0).cast("long").alias("n")
    marks = periods.select("run_id", F.col("from").alias("t"), F.lit(0).alias("kind"), "pos", none).unionByName(
        periods.select("run_id", F.col("until").alias("t"), F.lit(1).alias("kind"), "pos", none)).unionByName(
        free.select("run_id", F.col("started_at").alias("t"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("pos"), "n"))
    # bounds sort before machines of their time, so they count the machines that start earlier
    marks = scan(marks, ["run_id"], "t", ["kind", "pos"], width=width, sums={"n": F.col("n")})
    p = marks.filter("kind < 2").groupBy("run_id", "pos").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("f"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("l"))
    p = p.filter(F.col("f") < F.col("l")).withColumn("bucket", F.floor(F.col("pos") / F.lit(FIT_ROWS)).cast("long"))
    b = p.groupBy("run_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "f", "l"))).alias("rows")).checkpoint()
    start = F.struct(F.lit(-_FAR).cast("long").alias("low"), F.lit(_FAR).cast("long").alias("high"))
    whole = F.aggregate("rows", start, lambda acc, x: F.struct(
        _through(acc["low"], x["f"], x["l"]).alias("low"), _through(acc["high"], x["f"], x["l"]).alias("high")))
    maps = b.select("run_id", "bucket", F.size("rows").cast("long").alias("n"), whole.alias("m")).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n", F.col("m.low").alias("low"), F.col("m.high").alias("high")))).alias("maps"))
    into = "array<struct<bucket:bigint,q:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("q"), F.array().cast(into).alias("out"))
    carried = F.aggregate("maps", begin, lambda acc, x: F.struct(
        F.greatest(x["low"], F.least(acc["q"] + x["n"], x["high"])).alias("q"),
        F.concat(acc["out"], F.array(F.struct(x["bucket"].alias("bucket"), acc["q"].alias("q")))).alias("out")), lambda acc: acc["out"])
    maps = maps.select("run_id", F.inline(carried))
    schema = T.StructType([b.schema["run_id"], T.StructField("pos", T.LongType()), T.StructField("place", T.LongType())])
    picks = b.join(maps, ["run_id", "bucket"]).select("run_id", "rows", "q").mapInArrow(_choose, schema)
    machines = free.select("run_id", (F.col("upto") - F.col("n")).alias("first"), "started_at")
    return asof_join(picks, machines, ["run_id"], "place", "first", ["started_at"], width=100_000.0).drop("place")


def assign_replacements(downs: DataFrame, starts: DataFrame, lead_s: float = 180.0, pre_epoch_s: float = 60.0, width: float = 86400.0) -> DataFrame:
    """JN-11: give each down period of a slot the first unused machine that
    started in ``[t_out - 180 s, t_in)``, slots in ascending order, only
    machines started after the first epoch - 60 s (after 0 in a run without epochs).
    Periods of one slot don't overlap; an open one (null ``t_in``) is its last.

    A round per slot instead of a walk: the slot fits its periods into the machines that
    lower slots left, of all runs at once. Machines that started at one time are one row
    with their number. A round is a few jobs, run while the query is built, and its results
    (a row for each period that is served, a row for each start with machines left) are
    checkpointed. No run, slot or open period is one task's work."""
    from skiff.session import checkpoint_dir

    checkpoint_dir(downs.sparkSession)
    key = ["run_id", "slot"]
    d = downs.select(*key, "t_out", "t_in", "first_epoch", (F.col("t_out") - lead_s).alias("from"), F.coalesce("t_in", F.lit(1e18)).alias("until"))
    d = scan(d, key, "from", ["until"], width=width, sums={"pos": F.lit(1).cast("long")}).checkpoint()
    runs = d.groupBy("run_id").agg(F.min("first_epoch").alias("first_epoch"))
    m = starts.select("run_id", "started_at").join(runs, "run_id").filter(
        F.col("started_at") > F.coalesce(F.col("first_epoch") - pre_epoch_s, F.lit(0.0)))
    m = m.groupBy("run_id", "started_at").agg(F.count(F.lit(1)).alias("n"))
    served = d.select(*key, "pos", F.col("from").alias("started_at")).limit(0)
    for (slot,) in sorted(d.select("slot").distinct().collect()):
        free = scan(m, ["run_id"], "started_at", width=width, sums={"upto": F.col("n")}).checkpoint()
        taken = _first_fit(d.filter(F.col("slot") == slot), free, width).checkpoint()
        served = served.unionByName(taken.withColumn("slot", F.lit(slot).cast(d.schema["slot"].dataType)))
        gone = taken.groupBy("run_id", "started_at").agg(F.count(F.lit(1)).alias("gone"))
        m = free.join(gone, ["run_id", "started_at"], "left").select(
            "run_id", "started_at", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).filter("n > 0")
    return d.join(served, [*key, "pos"]).select(
        *key, F.greatest("started_at", "t_out").alias("a"), F.coalesce("t_in", F.lit(float("inf"))).alias("b"))


STATES = ["down", "provisioning", "training", "leader"]
_DOWN, _PROVISIONING, _TRAINING, _LEADER = range(4)


def occupancy(timeline: DataFrame, ticks: DataFrame, ledger: DataFrame, target: int, width: float = 86400.0) -> DataFrame:
    """WN-26: per-slot state (leader / training / provisioning / down) at every
    transition: epoch boundaries (preceded by the boot row of the first
    poll), starts of replacement windows (JN-11) and polls where the set of
    billable boxes changed; a down slot with a billable box or inside a
    replacement window reads provisioning; unchanged rows are dropped.

    A row holds all slots of its run as an array of codes; only a slot's changes are rows
    of their own, to find its down periods."""
    from skiff.session import checkpoint_dir

    checkpoint_dir(ticks.sparkSession)
    poll = ["run_id", "t", "event_id"]

    def codes(of) -> Column:
        return F.array(*[of(F.lit(i)) for i in range(target)])

    epochs = timeline.select(*poll, codes(
        lambda i: F.when(F.array_contains("members", i), F.when(i == F.col("master"), _LEADER).otherwise(_TRAINING)).otherwise(_DOWN)
    ).alias("states"), F.lit(1).alias("__ord")).checkpoint()
    first_ep = epochs.groupBy("run_id").agg(F.min("t").alias("first_epoch"))
    billable = F.filter("nodes", lambda n: F.coalesce(n["aws_state"], F.lit("")).isin(BILLABLE) & n["node"].isNotNull())
    # a poll without a number of its own says nothing of boxes
    boxed = F.when(F.col("event_id").isNotNull(), F.transform(billable, lambda n: n["node"]))
    polls = ticks.select(*poll, boxed.alias("boxed")).groupBy(*poll).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("boxed")))).alias("boxed")).checkpoint()
    boot = polls.groupBy("run_id").agg(F.min_by(F.struct("t", "event_id"), F.struct("t", "event_id")).alias("b")).select("run_id", "b.t", "b.event_id")
    boot = boot.join(polls, poll).join(first_ep, "run_id", "left").filter(
        F.col("first_epoch").isNull() | (F.col("t") < F.col("first_epoch")))
    boot = boot.select(*poll, codes(lambda i: F.when(F.array_contains("boxed", i), _PROVISIONING).otherwise(_DOWN)).alias("states"), F.lit(0).alias("__ord"))
    base = boot.unionByName(epochs).checkpoint()
    # down periods per slot: from a change to down up to the change back
    chg = scan(base, ["run_id"], "t", ["__ord", "event_id"], width=width, prevs={"__prev": F.col("states")})
    turns = F.filter(F.array(*[
        F.struct(F.lit(i).alias("slot"), (F.col("states")[i] == _DOWN).alias("out"), F.coalesce(F.col("__prev")[i] == _DOWN, F.lit(False)).alias("was"))
        for i in range(target)]), lambda x: x["out"] != x["was"])
    chg = chg.select(*poll, "__ord", F.inline(turns)).drop("was")
    downs = scan(chg, ["run_id", "slot"], "t", ["__ord", "event_id"], width=width, nexts={"t_in": F.col("t")}).filter("out").select(
        "run_id", "slot", F.col("t").alias("t_out"), "t_in").join(first_ep, "run_id", "left")
    prov = assign_replacements(downs, ledger.select("run_id", "started_at"))
    # what is known at a time of a run, and whether it is a time of transition
    moved = scan(polls, ["run_id"], "t", ["event_id"], width=width, prevs={"__pb": F.col("boxed")}).withColumn(
        "moved", F.coalesce(F.col("__pb") != F.col("boxed"), F.lit(False)))
    base = base.select("run_id", "t", F.lit(True).alias("at"), F.struct("__ord", "event_id", "states").alias("base"))
    moved = moved.select("run_id", "t", "moved", F.struct("event_id", "boxed").alias("poll"))
    prov = prov.select("run_id", F.col("a").alias("t"), F.lit(True).alias("at"), *[F.when(F.col("slot") == i, F.col("b")).alias(f"until{i}") for i in range(target)])
    untils = [f"until{i}" for i in range(target)]
    known = base.unionByName(moved, allowMissingColumns=True).unionByName(prov, allowMissingColumns=True).groupBy("run_id", "t").agg(
        F.max("at").alias("at"), F.max("moved").alias("moved"), F.max("base")["states"].alias("states"), F.max("poll")["boxed"].alias("boxed"),
        *[F.max(u).alias(u) for u in untils])
    g = scan(known, ["run_id"], "t", width=width, lasts={c: F.col(c) for c in ["states", "boxed", *untils]})
    # polls before a run's first base row are no transitions
    g = g.filter(F.col("at") | (F.col("moved") & F.col("states").isNotNull()))

    def state(i: int) -> Column:
        st = F.coalesce(F.col("states")[i], F.lit(_DOWN))
        boxed = F.coalesce(F.array_contains("boxed", F.lit(i)), F.lit(False))
        inside = F.coalesce(F.col("t") < F.col(untils[i]), F.lit(False))
        return F.when((st == _DOWN) & (boxed | inside), _PROVISIONING).otherwise(st)

    rows = g.select("run_id", "t", F.array(*[state(i) for i in range(target)]).alias("slots"))
    rows = scan(rows, ["run_id"], "t", width=width, prevs={"__ps": F.col("slots")})
    rows = rows.filter(F.col("__ps").isNull() | (F.col("__ps") != F.col("slots")))
    names = F.array(*[F.lit(s) for s in STATES])
    return rows.select("run_id", F.floor(F.col("t") * 1000).cast("long").alias("time"),
                       *[names[F.col("slots")[i]].alias(f"slot{i}") for i in range(target)])
