"""Adapters: deterministic views of the driver's benchmark tables in the
shapes the fleet operators consume (SURVEY §7.3).

The driver's data has no fleet logs, so each record family is derived from a
table by a fixed rule that DuckDB can evaluate too (see
``skiff.plans.oracle_views``, which states the same rules in SQL).  Every
adapter is a projection (plus, where noted, one aggregate), so it scales with
the source table and its filters push into the parquet scan.

Fixed values of the mapping (chosen here, not taken from anywhere):
  event_type -> instance type : signup g5.xlarge, view g4dn.xlarge,
                                click g6.xlarge, error p3.2xlarge, purchase any
  event_type -> node state    : signup provisioning, view training,
                                click stalled, error killed, purchase epoch
  k = the integer inside ``props`` ({"k": n})
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.sources.tables import epoch_us, table

INSTANCE_TYPES = {
    "signup": "g5.xlarge",
    "view": "g4dn.xlarge",
    "click": "g6.xlarge",
    "error": "p3.2xlarge",
    "purchase": "any",
}
NODE_STATES = {
    "signup": "provisioning",
    "view": "training",
    "click": "stalled",
    "error": "killed",
    "purchase": "epoch",
}
PRICE_TYPES = ["g5.xlarge", "g4dn.xlarge", "g6.xlarge", "p3.2xlarge"]
INTERRUPTION_RANGES = ["<5%", "5-10%", "10-15%", "15-20%", ">20%"]

HOME_REGION = "region-0"
HOME_TYPE = "g5.xlarge"


def _case(col: str, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def _pick(idx: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"),
        epoch_us("ts").alias("t_us"),
        (epoch_us("ts") / F.lit(1e6)).alias("t"),
    )


# ---------------------------------------------------------------- market --

def sps_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement-score records ``type='sps'`` (one per event)."""
    ev = events_base(spark, sf_dir)
    az_idx = F.col("user_id") % 6
    return ev.select(
        F.lit("sps").alias("type"),
        (F.col("t_us") / F.lit(3_600_000_000)).cast("long").alias("tick_id"),
        "t",
        F.expr("concat('region-', cast((user_id % 6) div 2 as string))").alias("region"),
        F.concat(F.lit("az-"), _s(az_idx)).alias("az_id"),
        _case("event_type", INSTANCE_TYPES).alias("instance_type"),
        F.when(F.col("event_id") % 2 == 0, 8).otherwise(1).alias("capacity"),
        (F.col("event_id") % 5 != 1).alias("single_az"),
        F.when(F.col("event_id") % 10 == 0, F.lit("global_top10"))
        .when(F.col("event_id") % 10 == 5, F.lit(None).cast("string"))
        .otherwise(F.lit("region"))
        .alias("scope"),
        (F.lit(1) + F.col("k") % 10).alias("score"),
    )


def _az_name(az_idx: Column) -> Column:
    region_no = _s(F.floor(az_idx / F.lit(2)))
    return F.concat(F.lit("region-"), region_no, F.when(az_idx % 2 == 0, F.lit("a")).otherwise(F.lit("b")))


def az_map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ``az_map`` records: AZ id -> AZ name (one per day and id seen)."""
    ev = events_base(spark, sf_dir)
    az_idx = F.col("user_id") % 6
    return (
        ev.select(
            ((F.col("t_us") / F.lit(86_400_000_000)).cast("long") * 86400).cast("double").alias("t"),
            F.expr("concat('region-', cast((user_id % 6) div 2 as string))").alias("region"),
            F.concat(F.lit("az-"), _s(az_idx)).alias("az_id"),
            _az_name(az_idx).alias("az"),
        )
        .distinct()
        .withColumn("type", F.lit("az_map"))
        .withColumn("state", F.lit("available"))
    )


def probe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch probes (ground truth): all events but purchases."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") != "purchase")
    az_idx = F.col("user_id") % 6
    ok = F.col("k") % 3 != 0
    return ev.select(
        F.lit("probe").alias("type"),
        "event_id",
        "t",
        F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.expr("concat('region-', cast((user_id % 6) div 2 as string))").alias("region"),
        F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).otherwise(_az_name(az_idx)).alias("az"),
        _case("event_type", INSTANCE_TYPES).alias("instance_type"),
        ok.alias("capacity_available"),
        F.when(ok, F.lit("")).otherwise(F.lit("InsufficientInstanceCapacity")).alias("error_code"),
    )


def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot price samples: one per line item."""
    li = table(spark, sf_dir, "lineitem")
    az_idx = F.col("l_suppkey") % 6
    return li.select(
        F.lit("price").alias("type"),
        (epoch_us("l_shipdate") / F.lit(1e6) + F.col("l_linenumber")).alias("t"),
        F.expr("concat('region-', cast((l_suppkey % 6) div 2 as string))").alias("region"),
        _az_name(az_idx).alias("az"),
        _pick(F.col("l_partkey") % 4, PRICE_TYPES).alias("instance_type"),
        (F.col("l_extendedprice") / F.col("l_quantity") / F.lit(1000.0)).alias("price_usd"),
    )


def interruption_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-advisor interruption rows: one per order."""
    o = table(spark, sf_dir, "orders")
    idx = F.col("o_orderkey") % 5
    return o.select(
        F.lit("interruption").alias("type"),
        (epoch_us("o_orderdate") / F.lit(1e6)).alias("t"),
        F.col("o_orderkey").alias("record_id"),
        F.concat(F.lit("region-"), _s(F.col("o_custkey") % 3)).alias("region"),
        _pick(F.col("o_orderkey") % 4, PRICE_TYPES).alias("instance_type"),
        _pick(idx, INTERRUPTION_RANGES).alias("interruption_range"),
        idx.cast("int").alias("interruption_index"),
        (F.lit(50) + F.col("o_custkey") % 40).cast("int").alias("savings_pct"),
    )


def gap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score requests that returned nothing: error events."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "error")
    az_idx = F.col("user_id") % 6
    return ev.select(
        F.lit("sps_gap").alias("type"),
        (F.col("t_us") / F.lit(3_600_000_000)).cast("long").alias("tick_id"),
        "t",
        F.expr("concat('region-', cast((user_id % 6) div 2 as string))").alias("region"),
        F.lit("p3.2xlarge").alias("instance_type"),
        F.when(F.col("event_id") % 2 == 0, 8).otherwise(1).alias("capacity"),
        (F.col("event_id") % 5 != 1).alias("single_az"),
        F.lit("region").alias("scope"),
        (F.col("k") % 2 == 0).alias("throttled"),
        (F.col("k") % 5 == 0).alias("config_capped"),
    )


def tick_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``tick`` record per hour with events: requests and budget."""
    ev = events_base(spark, sf_dir)
    return (
        ev.groupBy((F.col("t_us") / F.lit(3_600_000_000)).cast("long").alias("tick_id"))
        .agg(
            F.min("t").alias("t"),
            F.count(F.lit(1)).cast("int").alias("sps_requests"),
            F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("int").alias("sps_gaps"),
        )
        .withColumn("type", F.lit("tick"))
        .withColumn("config_budget", F.lit(20) + (F.col("tick_id") % 3).cast("int"))
    )


# --------------------------------------------------------------- serving --

def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request-grain load results: one request per event.

    test = load level ``1 + user_id % 8``; latency grows with the level;
    failed = ``error`` events with ``k % 25 = 0`` (HTTP 500..503), a transport
    error (no status) when ``k % 25 = 5``, 429 for some clicks."""
    ev = events_base(spark, sf_dir)
    level = (F.lit(1) + F.col("user_id") % 8).cast("int")
    failed = (F.col("event_type") == "error") & (F.col("k") % 25 == 0)
    transport = (F.col("event_type") == "error") & (F.col("k") % 25 == 5)
    return ev.select(
        F.concat(F.lit("load-"), _s(level)).alias("test_id"),
        level.alias("level"),
        "event_id",
        F.col("t").alias("sent_at"),
        F.concat(F.lit("w"), _s(F.col("user_id") % 10)).alias("worker_id"),
        (F.lit(20.0) + F.col("value") * level / F.lit(10.0)).alias("latency_ms"),
        failed.alias("failed"),
        F.when(failed, F.lit(500) + F.col("k") % 4)
        .when(transport, F.lit(None).cast("int"))
        .when((F.col("event_type") == "click") & (F.col("k") % 10 == 0), F.lit(429))
        .otherwise(F.lit(200))
        .cast("int")
        .alias("status"),
        (F.col("k") % 7 == 0).alias("rerouted"),
        F.col("k").cast("long").alias("tokens"),
    )


def scrape_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-worker counter samples, one per (hour, worker) with events.

    Counters run from the start of each ISO-week-sized epoch (7 days) so they
    reset; ``ok`` is false when the hour holds a ``k % 4 = 0`` error."""
    ev = events_base(spark, sf_dir)
    tick = (F.col("t_us") / F.lit(3_600_000_000)).cast("long")
    return ev.groupBy(
        tick.alias("tick"), F.concat(F.lit("w"), _s(F.col("user_id") % 10)).alias("worker_id")
    ).agg(
        F.count(F.lit(1)).alias("d_requests"),
        F.sum("k").cast("long").alias("d_tokens"),
        F.sum(F.col("value") / F.lit(1000.0)).alias("d_gen"),
        F.max(F.col("k") % 5).cast("int").alias("in_flight"),
        F.max(((F.col("event_type") == "error") & (F.col("k") % 4 == 0)).cast("int")).alias("bad"),
    ).select(
        F.lit("fleet-0").alias("fleet"),
        (F.col("tick") * 3600).cast("double").alias("ts"),
        "worker_id",
        (F.col("bad") == 0).alias("ok"),
        (F.col("tick") / 168).cast("long").alias("counter_epoch"),
        "d_requests",
        "d_tokens",
        "d_gen",
        "in_flight",
    )


def heartbeat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker heartbeat documents: one per event; some lack an address."""
    ev = events_base(spark, sf_dir)
    wid = F.col("user_id") % 10
    return ev.select(
        F.concat(F.lit("w"), _s(wid)).alias("worker_id"),
        F.when(F.col("k") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("10.0.0."), _s(wid), F.lit(":8000")))
        .alias("addr"),
        F.lit("gpt2").alias("model"),
        F.when(wid % 2 == 0, F.lit("spot")).otherwise(F.lit("on-demand")).alias("market"),
        F.col("event_id").alias("requests_served"),
        F.col("t").alias("last_seen"),
    )


# ------------------------------------------------------------- telemetry --

TARGET_WORLD = 8
TOKENS_PER_STEP = 480 * 1024  # fixed value of the reference's run recipe
LEDGER_T0 = 1_704_067_200.0   # 2024-01-01: orders are replayed into January
ORDERS_T0 = 788_918_400.0     # 1995-01-01, the first order date
LEDGER_SCALE = 80.0


def _run_id(uid: Column) -> Column:
    return F.concat(F.lit("run-"), _s(uid % 12))


def lifecycle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[event]`` lifecycle records, one per event: node events carry
    node/attempt (and a step when training or stalled); ``epoch`` events
    are the orchestrator's, with world size and leader."""
    ev = events_base(spark, sf_dir)
    is_epoch = F.col("event_type") == "purchase"
    state = _case("event_type", NODE_STATES)
    return ev.select(
        "event_id",
        _run_id(F.col("user_id")).alias("run_id"),
        F.when(~is_epoch, F.expr("CAST((user_id div 12) % 8 AS INT)")).alias("node"),
        F.when(~is_epoch, F.expr("CAST(user_id div 96 AS INT)")).alias("attempt"),
        F.col("t").alias("ts"),
        state.alias("state"),
        F.when(F.col("event_type").isin("view", "click"), F.col("k").cast("long")).alias("step"),
        F.when(is_epoch, (F.lit(1) + F.col("k") % 8).cast("int")).alias("world"),
        F.when(is_epoch, (F.col("k") % 3).cast("int")).alias("leader"),
        F.when(is_epoch, F.lit("orch")).otherwise(F.lit("sidecar")).alias("by"),
    )


def step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-0 step lines: every non-epoch event; error events roll the step
    back by 40 (a restore from an older checkpoint); ``ws = 0`` stands for
    the older log format without a world size."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") != "purchase")
    ms = (F.lit(100) + F.col("k") * 10).cast("int")
    return ev.select(
        "event_id",
        _run_id(F.col("user_id")).alias("run_id"),
        F.expr("CAST((user_id div 12) % 8 AS INT)").alias("node"),
        F.expr("CAST(user_id div 96 AS INT)").alias("attempt"),
        F.when(F.col("event_type") == "error", F.greatest(F.col("event_id") - 40, F.lit(0)))
        .otherwise(F.col("event_id"))
        .cast("long")
        .alias("step"),
        (F.col("value") / F.lit(50.0)).alias("loss"),
        ms.alias("ms"),
        (ms * 3).alias("tok_s"),
        F.when(F.col("k") % 4 == 0, F.lit(0)).otherwise(F.lit(1) + F.col("k") % 8).cast("int").alias("ws"),
        "t",
    )


def _members(epoch: Column, run_no: Column) -> Column:
    mask = ((epoch * 37 + run_no * 11) % 256).cast("int")
    return F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)


def tick_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status ticks (the supervisor's document), one per epoch event:
    epoch every 500 events, members a function of (run, epoch), node
    entries for all eight slots with an AWS state."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "purchase")
    run_no = F.col("user_id") % 12
    epoch = F.expr("CAST(event_id div 500 AS INT)")
    members = _members(epoch, run_no)
    nodes = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.struct(
            i.alias("node"),
            (epoch % 3).alias("attempt"),
            F.concat(F.lit("i-"), F.lpad(_s(run_no * 1000 + i * 10 + epoch % 3), 8, "0")).alias("instance_id"),
            F.when(F.array_contains(members, i), F.lit("running"))
            .when((F.col("k") + i) % 3 == 0, F.lit("pending"))
            .when((F.col("k") + i) % 3 == 1, F.lit("shutting-down"))
            .otherwise(F.lit("terminated"))
            .alias("aws_state"),
        ),
    )
    return ev.select(
        "event_id",
        _run_id(F.col("user_id")).alias("run_id"),
        "t",
        F.col("t").alias("updated_at"),
        epoch.alias("epoch"),
        members.alias("members"),
        F.when(F.col("event_id") < 40, F.lit(-1)).otherwise(F.expr("event_id div 2")).cast("long").alias("ckpt_step"),
        F.lit(False).alias("done"),
        nodes.alias("nodes"),
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-log ``published epoch`` lines: one per (run, epoch) seen in
    the ticks."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "purchase")
    run_no = F.col("user_id") % 12
    d = ev.select(run_no.alias("run_no"), F.expr("CAST(event_id div 500 AS INT)").alias("epoch")).distinct()
    members = _members(F.col("epoch"), F.col("run_no"))
    return d.select(
        _run_id(F.col("run_no")).alias("run_id"),
        "epoch",
        members.alias("members"),
        F.coalesce(F.array_min(members), F.lit(0)).alias("master"),
    )


def restart_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-log ``whole-group restart`` lines: one per error event."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "error")
    return ev.select(_run_id(F.col("user_id") % 12).alias("run_id"), "t")


def termination_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-log ``terminated node N (i-…)`` lines: one per error event
    (lines repeat: the log is re-appended)."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "error")
    run_no = F.col("user_id") % 12
    node = F.expr("CAST((user_id div 12) % 8 AS INT)")
    attempt = F.expr("CAST(user_id div 96 AS INT)")
    return ev.select(
        _run_id(run_no).alias("run_id"),
        F.col("event_id").alias("pos"),
        node.alias("node"),
        F.concat(F.lit("i-"), F.lpad(_s(run_no * 1000 + node * 10 + attempt), 8, "0")).alias("instance_id"),
    )


def instance_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ledger: one machine per order, replayed into January 2024; the
    machine stops at the order's last ship date when that is later, else it
    is still open; priority 5-LOW has no known rate."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    scale = lambda c: F.lit(LEDGER_T0) + (epoch_us(c) / F.lit(1e6) - F.lit(ORDERS_T0)) / F.lit(LEDGER_SCALE)
    return j.select(
        _run_id(F.col("o_custkey")).alias("run_id"),
        F.concat(F.lit("i-"), F.lpad(_s(F.col("o_orderkey")), 8, "0")).alias("instance_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("spot")).otherwise(F.lit("on-demand")).alias("market"),
        F.concat(F.lit("region-"), _s(F.col("o_custkey") % 3), F.lit("a")).alias("az"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice") / F.lit(100000.0))
        .alias("hourly_usd"),
        scale(F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("last_ship") > F.col("o_orderdate"), scale(F.col("last_ship"))).alias("stopped_at"),
    )


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval step S: val_loss X`` lines: one per signup event at step
    ``event_id + 5`` (between logged steps); lines with ``k % 5 = 0`` are
    replayed twice (a replacement box re-reads its predecessor's log)."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "signup")
    copies = F.explode(F.array(F.lit(1), F.when(F.col("k") % 5 == 0, F.lit(2)))).alias("copy")
    return ev.select(
        _run_id(F.col("user_id")).alias("run_id"),
        (F.col("event_id") + 5).cast("long").alias("step"),
        (F.col("value") / F.lit(60.0)).alias("loss"),
        copies,
    ).filter(F.col("copy").isNotNull()).drop("copy")


def rank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[rank r] step S | ... | ws W [| t T]`` lines of the other nodes: one
    per click event; half carry no wall clock."""
    ev = events_base(spark, sf_dir).filter(F.col("event_type") == "click")
    return ev.select(
        "event_id",
        _run_id(F.col("user_id")).alias("run_id"),
        F.expr("CAST((user_id div 12) % 8 AS INT)").alias("slot"),
        F.expr("CAST(user_id div 96 AS INT)").alias("gen"),
        (F.col("event_id") + 3).cast("long").alias("step"),
        F.when(F.col("k") % 2 == 0, F.col("t")).alias("t"),
    )


# ----------------------------------------------------------------- fleet --

def node_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status tick and slot: what the supervisor observed — AWS state,
    registration (no IP when ``(k + node) % 7 = 0``) and log heartbeat age
    (no log yet when ``(k + node) % 5 = 0``)."""
    t = tick_docs(spark, sf_dir)
    e = events_base(spark, sf_dir).select("event_id", "k")
    x = t.join(e, on="event_id").select("run_id", "t", "event_id", "epoch", "members", "k", F.explode("nodes").alias("n"))
    nk = F.col("k") + F.col("n.node")
    return x.select(
        "run_id", "t", "event_id", "epoch", "members",
        F.col("n.node").alias("node"), F.col("n.attempt").alias("attempt"), F.col("n.aws_state").alias("aws_state"),
        (nk % 7 != 0).alias("registered"),
        F.when(nk % 5 == 0, F.lit(None).cast("double")).otherwise(((F.col("k") * 3 + F.col("n.node") * 17) % 200).cast("double")).alias("log_age_s"),
    )


def checkpoint_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint object listing: one object per line item; a few are
    in-flight temporaries; the local tier belongs to one rank."""
    li = table(spark, sf_dir, "lineitem")
    run = _run_id(F.col("l_orderkey"))
    tier = F.when(F.col("l_partkey") % 3 == 0, F.lit("local")).otherwise(F.lit("durable"))
    rank = (F.col("l_linenumber") % 4).cast("int")
    step = ((F.col("l_orderkey") / 12).cast("long") * 10 + F.col("l_linenumber")).cast("long")
    name = F.concat(F.lit("ckpt-"), F.lpad(_s(step), 12, "0"), F.lit(".pt"), F.when(F.col("l_suppkey") % 17 == 0, F.lit(".tmp")).otherwise(F.lit("")))
    prefix = F.concat(F.lit("runs/"), run, F.lit("/ckpt/"), tier, F.when(tier == "local", F.concat(F.lit("/rank"), _s(rank))).otherwise(F.lit("")))
    return li.select(
        run.alias("run_id"), F.when(tier == "local", rank).alias("rank"), tier.alias("tier"),
        F.concat(prefix, F.lit("/"), name).alias("path"), (F.col("l_quantity") * 1000).cast("long").alias("size"),
    )


def mark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-plane marks per run from the lifecycle records: launch (first
    record), train_start (first training), kill, relaunch (a replacement's
    provisioning), shrink_resume (an epoch below 8), full_world (an epoch at
    8), metrics (last record).  ``seq`` orders marks at one time."""
    ev = lifecycle_records(spark, sf_dir)
    first = ev.groupBy("run_id").agg(F.min("ts").alias("t"), F.max("ts").alias("last_t"))
    tstart = ev.filter(F.col("state") == "training").groupBy("run_id").agg(F.min("ts").alias("t"))
    name = (
        F.when(F.col("state") == "killed", F.lit("kill"))
        .when((F.col("state") == "provisioning") & (F.col("attempt") > 0), F.lit("relaunch"))
        .when((F.col("state") == "epoch") & (F.col("world") < TARGET_WORLD), F.lit("shrink_resume"))
        .when((F.col("state") == "epoch") & (F.col("world") == TARGET_WORLD), F.lit("full_world"))
    )
    body = ev.select("run_id", name.alias("event"), F.col("ts").alias("t"), F.col("event_id").alias("seq")).filter(F.col("event").isNotNull())
    return (
        first.select("run_id", F.lit("launch").alias("event"), "t", F.lit(-2).cast("long").alias("seq"))
        .unionByName(tstart.select("run_id", F.lit("train_start").alias("event"), "t", F.lit(-1).cast("long").alias("seq")))
        .unionByName(body)
        .unionByName(first.select("run_id", F.lit("metrics").alias("event"), F.col("last_t").alias("t"), F.lit(1 << 62).cast("long").alias("seq")))
    )
