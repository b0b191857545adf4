"""Fleet state: node health, membership decisions, sticky death, leader
history, stall clocks, checkpoint restore points and retention (PRJ-11,
PRJ-14, WN-17/27/28/33/34, AG-51, FLT-09, SRC-18).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.functions.percentile import kth_values
from skiff.operators.asof import asof_join
from skiff.operators.scan import scan

DEAD_STATES = ["shutting-down", "terminated", "stopping", "stopped"]
CHECKPOINT_PREFIX = "ckpt-"
TMP_SUFFIX = ".tmp"
HEARTBEAT_TIMEOUT_S = 90.0
MAX_EPOCHS_WITHOUT_PROGRESS = 6
GROUP_LIMIT = 1000  # ranks up to here are cut in each task, before rows move (spark.sql.optimizer.windowGroupLimitThreshold)


def healthy(registered: str = "registered", aws_state: str = "aws_state", log_age: str = "log_age_s",
            timeout_s: float = HEARTBEAT_TIMEOUT_S) -> Column:
    """PRJ-11: registered, AWS says running, and the log heartbeat is not
    stale (no log yet counts as alive)."""
    return (
        F.coalesce(F.col(registered), F.lit(False))
        & (F.col(aws_state) == "running")
        & ~(F.col(log_age).isNotNull() & (F.col(log_age) > timeout_s))
    )


def membership_decisions(obs: DataFrame, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """WN-34: per observation tick the healthy set against the current
    epoch's members: who drops out, who joins, whether a new epoch is due."""
    g = obs.withColumn("__h", healthy(timeout_s=timeout_s)).groupBy("run_id", "t", "event_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("__h"), F.col("node")))).alias("healthy"),
        F.first("members").alias("members"),
    )
    m = F.array_sort("members")
    return g.select(
        "run_id", "t", "event_id",
        F.array_join("healthy", ",").alias("healthy"),
        F.array_join(F.array_sort(F.array_except(m, "healthy")), ",").alias("to_drop"),
        F.array_join(F.array_sort(F.array_except("healthy", m)), ",").alias("to_add"),
        ((F.size("healthy") > 0) & ~(F.array_sort("healthy") == m)).alias("publish_epoch"),
    )


def sticky_states(obs: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-17 + PRJ-14: per (run, node, attempt) over the polls: once dead
    never alive again; transition events ``new`` (first sight) and ``dead``
    (first death).  Dead = AWS reports a dead state."""
    o = obs.withColumn("__dead", F.col("aws_state").isin(DEAD_STATES).cast("int")).withColumn("__one", F.lit(1))
    s = scan(o, ["run_id", "node", "attempt"], "t", ["event_id"], width=width, maxes={"__ever": "__dead"}, sums={"__seen": "__one"})
    s = scan(s, ["run_id", "node", "attempt"], "t", ["event_id"], width=width, prevs={"__prev_ever": F.col("__ever")})
    state = F.when(F.col("__ever") == 1, F.lit("dead")).when(healthy(), F.lit("live")).otherwise(F.lit("joining"))
    event = F.when(F.col("__seen") == 1, F.lit("new")).when((F.col("__ever") == 1) & (F.coalesce(F.col("__prev_ever"), F.lit(0)) == 0), F.lit("dead"))
    return s.select("run_id", "node", "attempt", "t", "event_id", state.alias("state"), event.alias("transition"))


def _handed_on(epochs: list[tuple[set[int], set[int]]]) -> tuple[dict[int, int | None], int | None]:
    """What a stretch of epochs (members, members of the epoch before) makes of the
    master that comes in: the master after it by each member of the first epoch, and
    by anyone else.  Epochs are composed last to first: a member stays what it is
    while it is one, and otherwise turns into that epoch's choice."""
    after: dict[int, int | None] = {}
    other: int | None = None
    for k, (now, before) in enumerate(reversed(epochs)):
        chosen = min(now & before or now, default=None)
        out = (lambda m: m) if k == 0 else (lambda m, a=after, o=other: a.get(m, o))
        after, other = {m: out(m) for m in now}, out(chosen)
    return after, other


def elect_masters(timeline: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-28: the sticky master over a run's epochs: keep the current master
    while it is a member, else the lowest survivor of the previous epoch,
    else the lowest member.

    Each choice needs the one before, but a stretch of epochs is a map from the
    master that comes in to the one that goes out, of as many entries as its first
    epoch has members.  Maps of all (run, bucket of ``width`` seconds) are made at
    once, composed along a run's buckets (a row a bucket), and with the master that
    comes in known every bucket's epochs are walked at once too."""
    import pandas as pd

    keys = ["run_id", "__b"]
    rows = timeline.select("run_id", "t", "event_id", "epoch", F.coalesce("members", F.array().cast("array<int>")).cast("array<int>").alias("members"))
    rows = scan(rows, ["run_id"], "t", ["event_id", "epoch"], width=width, prevs={"before": F.col("members")})
    rows = rows.withColumn("__b", F.floor(F.col("t") / width).cast("long"))

    def epochs(part: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[set[int], set[int]]]]:
        part = part.sort_values(["t", "event_id", "epoch"], kind="stable")
        of = lambda v: set() if v is None else {int(m) for m in v}
        return part, [(of(n), of(p)) for n, p in zip(part["members"], part["before"])]

    def mapped(part: pd.DataFrame) -> pd.DataFrame:
        part, own = epochs(part)
        after, other = _handed_on(own)
        first = part.iloc[0]
        return pd.DataFrame({"run_id": [first["run_id"]], "__b": [first["__b"]], "given": [list(after)], "taken": [list(after.values())], "other": pd.array([other], "Int32")})

    def along(batches):
        of, master = None, None
        for b in batches:
            incoming = []
            for run_id, given, taken, other in zip(b["run_id"], b["given"], b["taken"], b["other"]):
                if run_id != of:
                    of, master = run_id, None
                incoming.append(master)
                master = dict(zip(given, taken)).get(master, None if pd.isna(other) else int(other))
            yield pd.DataFrame({"run_id": b["run_id"], "__b": b["__b"], "incoming": pd.array(incoming, "Int32")})

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part, own = epochs(part)
        master = part["incoming"].iloc[0]
        master, masters = None if pd.isna(master) else int(master), []
        for now, before in own:
            if master not in now:
                master = min(now & before or now, default=None)
            masters.append(master)
        return pd.DataFrame({"run_id": part["run_id"], "t": part["t"], "epoch": part["epoch"], "master": pd.array(masters, "Int32")})

    maps = rows.groupBy(*keys).applyInPandas(mapped, "run_id string, __b long, given array<int>, taken array<int>, other int")
    incoming = maps.repartition("run_id").sortWithinPartitions(*keys).mapInPandas(along, "run_id string, __b long, incoming int")
    return rows.join(incoming, keys).groupBy(*keys).applyInPandas(walked, "run_id string, t double, epoch int, master int")


def stall_clock(ticks: DataFrame, timeline: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-27 (+ ST-10 flags): per tick, seconds since the durable step last
    advanced or an epoch was published (whichever is later), and epochs
    published since the last progress."""
    tk = ticks.select("run_id", "t", "event_id", "ckpt_step")
    tk = scan(tk, ["run_id"], "t", ["event_id"], width=width, maxes={"__mx": "ckpt_step"})
    tk = scan(tk, ["run_id"], "t", ["event_id"], width=width, prevs={"__pmx": F.col("__mx")})
    tk = tk.withColumn("__progress", F.col("__pmx").isNull() | (F.col("ckpt_step") > F.col("__pmx")))
    tk = tk.withColumn("__src", F.lit(1)).withColumn("__ep", F.lit(0))
    ep = timeline.select("run_id", "t", "event_id", F.lit(0).alias("__src"), F.lit(1).alias("__ep"), F.lit(False).alias("__progress"))
    u = tk.unionByName(ep, allowMissingColumns=True)
    u = scan(u, ["run_id"], "t", ["__src", "event_id"], width=width, sums={"__E": "__ep"},
             lasts={"__lp": F.when(F.col("__progress"), F.col("t")), "__le": F.when(F.col("__ep") == 1, F.col("t"))})
    u = scan(u, ["run_id"], "t", ["__src", "event_id"], width=width, lasts={"__Elp": F.when(F.col("__progress"), F.col("__E"))})
    out = u.filter(F.col("__src") == 1)
    since = F.greatest(F.col("__lp"), F.col("__le"))
    return out.select(
        "run_id", "t", "event_id", "ckpt_step",
        (F.col("t") - since).alias("no_progress_s"),
        (F.col("__E") - F.coalesce(F.col("__Elp"), F.lit(0))).alias("epochs_without_progress"),
    )


def stall_alarms(clock: DataFrame, recovery_timeout_s: float, max_epochs: int = MAX_EPOCHS_WITHOUT_PROGRESS) -> DataFrame:
    """ST-10 in batch: whole-group restart reasons per tick."""
    return clock.withColumn(
        "restart_reason",
        F.when(F.col("no_progress_s") > recovery_timeout_s, F.lit("no checkpoint progress"))
        .when(F.col("epochs_without_progress") >= max_epochs, F.lit("epochs without progress")),
    )


# ------------------------------------------------------------- checkpoints --

def parse_listing(listing: DataFrame) -> DataFrame:
    """SRC-18 + FLT-09: checkpoint objects only (never in-flight temps),
    with the step decoded from the zero-padded name."""
    base = F.substring_index("path", "/", -1)
    ok = base.startswith(CHECKPOINT_PREFIX) & ~base.endswith(TMP_SUFFIX) & base.rlike(r"^ckpt-[0-9]+\.pt$")
    return listing.filter(ok).withColumn("name", base).withColumn(
        "step", F.regexp_extract(base, r"^ckpt-([0-9]+)\.pt$", 1).cast("long")
    )


def restore_point(listing: DataFrame, ranks: DataFrame) -> DataFrame:
    """AG-51: every rank offers its newest step over its local tier and the
    durable tier; the group takes the minimum; each rank then loads it from
    the cheapest tier that holds it (local, else durable); none anywhere ->
    fresh; held by no tier of that rank -> error.

    One aggregate of the listing gives the newest step per (run, rank, tier);
    the group step (one row per run) then selects only the objects at that
    step, so the listing is never de-duplicated or shuffled whole twice."""
    ck = parse_listing(listing).select("run_id", "tier", F.coalesce(F.col("rank"), F.lit(-1)).alias("__rk"), "step")
    best = ck.groupBy("run_id", "tier", "__rk").agg(F.max("step").alias("__best"))
    bl = best.filter(F.col("tier") == "local").select("run_id", F.col("__rk").alias("rank"), F.col("__best").alias("__bl"))
    bd = best.filter(F.col("tier") == "durable").groupBy("run_id").agg(F.max("__best").alias("__bd"))
    r = ranks.join(bl, on=["run_id", "rank"], how="left").join(bd, on="run_id", how="left")
    r = r.withColumn("best", F.greatest(F.coalesce("__bl", F.lit(-1)), F.coalesce("__bd", F.lit(-1))))
    grp = r.groupBy("run_id").agg(F.min("best").alias("group_step"))
    at = ck.join(grp, on="run_id").filter(F.col("step") == F.col("group_step"))
    held = at.groupBy("run_id", "__rk").agg(F.max((F.col("tier") == "local").cast("int")).alias("__l"),
                                            F.max((F.col("tier") == "durable").cast("int")).alias("__d"))
    hl = held.filter(F.col("__l") == 1).select("run_id", F.col("__rk").alias("rank"), F.lit(True).alias("__hl"))
    hd = held.filter(F.col("__d") == 1).groupBy("run_id").agg(F.lit(True).alias("__hd"))
    r = r.join(grp, on="run_id").join(hl, on=["run_id", "rank"], how="left").join(hd, on="run_id", how="left")
    tier = (
        F.when(F.col("group_step") < 0, F.lit("fresh"))
        .when(F.col("__hl"), F.lit("local"))
        .when(F.col("__hd"), F.lit("durable"))
        .otherwise(F.lit("error"))
    )
    return r.select("run_id", "rank", "best", "group_step", tier.alias("tier"))


def retention(listing: DataFrame, keep: int) -> DataFrame:
    """WN-33: checkpoints to delete per (run, tier, rank): all but the
    ``keep`` newest (by name = by step); ``keep <= 0`` keeps everything.
    The first step that goes, found from each task's ``keep + 1`` newest, is one
    row per key and broadcast: the listing itself is neither sorted nor moved."""
    ck = parse_listing(listing).withColumn("__rk", F.coalesce(F.col("rank"), F.lit(-1)))
    if keep <= 0:
        return ck.limit(0).select("run_id", "tier", "rank", "path", "step")
    keys = ["run_id", "tier", "__rk"]
    steps = ck.select(*keys, "step").filter(F.col("step").isNotNull())
    if keep < GROUP_LIMIT:
        newest = steps.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step")))).filter(F.col("__r") <= keep + 1)
        cut = newest.groupBy(*keys).agg(
            F.max(F.when(F.col("__r") == keep + 1, F.col("step"))).alias("__cut"), F.collect_list("step").alias("__top"))
        cut = cut.withColumn("__stay", F.size(F.filter("__top", lambda x: x == F.col("__cut"))) - 1).drop("__top")
    else:
        cut = kth_values(steps, keys, "step", {"__cut": lambda n: n - keep}).drop("n")
        above = steps.join(F.broadcast(cut), on=keys).filter(F.col("step") > F.col("__cut")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        cut = cut.join(above, on=keys, how="left").withColumn("__stay", keep - F.coalesce(F.col("__n"), F.lit(0))).drop("__n")
    j = ck.join(F.broadcast(cut.filter(F.col("__cut").isNotNull())), on=keys)
    below = j.filter(F.col("step") < F.col("__cut"))
    # a listing may repeat a name: at the cut step as many copies stay as the
    # newer steps leave room for (a tiny set, ranked by path)
    at = j.filter(F.col("step") == F.col("__cut"))
    at = at.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "step").orderBy(F.desc("path"))))
    at = at.filter(F.col("__r") > F.col("__stay"))
    cols = ["run_id", "tier", "rank", "path", "step"]
    return below.select(*cols).unionByName(at.select(*cols))
