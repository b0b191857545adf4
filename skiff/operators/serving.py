"""Serving-load analysis: request rollups, percentiles, saturation knee,
scaling efficiency, kill/recovery windows, counter rates, histograms.

Request grain: ``requests(test_id, sent_at, worker_id, latency_ms, failed, status,
rerouted, tokens)`` with ``at`` in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.functions.percentile import kth_values, lower_median, nearest_rank, rounded_index, upper_median
from skiff.operators.scan import scan

# Fixed values of the reference's analysis (stated, not derived):
SLO_MULTIPLIER = 3.0          # objective: p99 <= 3 x L0
DEFAULT_MAX_ERROR_RATE = 0.01  # a point holds only under 1 % errors
EFFICIENCY_TARGETS = {4: 0.90, 8: 0.80}
# latency histogram upper bounds in seconds (last is +Inf)
DURATION_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0, 30.0, 60.0, float("inf")]


# ------------------------------------------------------------ projections --

def outcome(status: str = "status", rerouted: str = "rerouted") -> Column:
    """PRJ-02: >= 500 (or no response) failed; else rerouted or ok (4xx is ok)."""
    s = F.col(status)
    return (
        F.when(s.isNull() | (s >= 500), F.lit("failed"))
        .when(F.coalesce(F.col(rerouted), F.lit(False)), F.lit("rerouted"))
        .otherwise(F.lit("ok"))
    )


def attempt_result(status: str = "status") -> Column:
    """PRJ-03: 2xx ok, 4xx client_error, other server_error; no status
    (transport failure) is ``error``."""
    s = F.col(status)
    return (
        F.when(s.isNull(), F.lit("error"))
        .when((s >= 200) & (s < 300), F.lit("ok"))
        .when((s >= 400) & (s < 500), F.lit("client_error"))
        .otherwise(F.lit("server_error"))
    )


def worker_gauges(df: DataFrame) -> DataFrame:
    """PRJ-04: lifetime tokens/s and ``queued = max(in_flight - 1, 0)``."""
    return df.withColumn(
        "tokens_per_second",
        F.coalesce(F.try_divide(F.col("completion_tokens").cast("double"), F.col("generate_seconds")), F.lit(0.0)),
    ).withColumn("queued", F.greatest(F.col("in_flight") - 1, F.lit(0)))


def achieved_rps(succeeded: str = "succeeded", duration: str = "duration_s") -> Column:
    """PRJ-05: served rate."""
    return F.when(F.col(duration) > 0, F.col(succeeded) / F.col(duration)).otherwise(F.lit(0.0))


def tail_ratio(p99: str = "p99_ms", p50: str = "p50_ms") -> Column:
    """PRJ-05: p99 / p50, infinite without a median."""
    return F.when(F.col(p50) > 0, F.col(p99) / F.col(p50)).otherwise(F.lit(float("inf")))


def holds_slo(slo: Column, max_error_rate: float = DEFAULT_MAX_ERROR_RATE) -> Column:
    """FLT-03: successes > 0, error rate <= 1 %, p99 <= objective."""
    return (F.col("succeeded") > 0) & (F.col("error_rate") <= max_error_rate) & (F.col("p99_ms") <= slo)


def is_clean(failed: str = "failed", dropped: str = "dropped") -> Column:
    """FLT-04: no failures and no drops."""
    return (F.col(failed) == 0) & (F.col(dropped) == 0)


# ------------------------------------------------------------ aggregates --

def per_second(requests: DataFrame) -> DataFrame:
    """AG-17: per-second buckets by send time relative to the test start:
    sent, ok, errors, nearest-rank p99 and mean over successes (0 if none).

    A one-second bucket is bounded by the request rate, so the built-in
    ``percentile_disc`` (nearest rank, checked equal to the generator's rule)
    is safe here."""
    t0 = requests.groupBy("test_id").agg(F.min("sent_at").alias("__t0"))
    r = requests.join(t0, on="test_id").withColumn("t", F.floor(F.col("sent_at") - F.col("__t0")).cast("int"))
    ok_lat = F.when(~F.col("failed"), F.col("latency_ms"))
    return r.groupBy("test_id", "t").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count(ok_lat).alias("ok"),
        F.count(F.when(F.col("failed"), F.lit(1))).alias("errors"),
        F.coalesce(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY CASE WHEN NOT failed THEN latency_ms END)"), F.lit(0.0)).alias("p99_ms"),
        F.coalesce(F.avg(ok_lat), F.lit(0.0)).alias("mean_ms"),
    )


def test_totals(requests: DataFrame) -> DataFrame:
    """AG-18 + AG-19: whole-test totals with nearest-rank percentiles over
    successes (0 when none).  Percentiles use the two-pass exact selection,
    so a test with a huge share of the rows never lands in one task."""
    totals = requests.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(~F.col("failed"), F.lit(1))).alias("succeeded"),
        F.count(F.when(F.col("failed"), F.lit(1))).alias("failed"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("tokens"))), F.lit(0)).cast("long").alias("completion_tokens"),
        (F.max("sent_at") - F.min("sent_at")).alias("duration_s"),
        F.coalesce(F.avg(F.when(~F.col("failed"), F.col("latency_ms"))), F.lit(0.0)).alias("mean_ms"),
    )
    ok = requests.filter(~F.col("failed"))
    pct = kth_values(
        ok,
        ["test_id"],
        "latency_ms",
        {"p50_ms": nearest_rank(50), "p90_ms": nearest_rank(90), "p95_ms": nearest_rank(95), "p99_ms": nearest_rank(99)},
        levels=2,  # a test's latencies lie close together
    ).drop("n")
    out = totals.join(pct, on="test_id", how="left")
    for c in ("p50_ms", "p90_ms", "p95_ms", "p99_ms"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return (
        out.withColumn("error_rate", F.when(F.col("requests") > 0, F.col("failed") / F.col("requests")).otherwise(F.lit(0.0)))
        .withColumn(
            "tokens_per_second",
            F.when(F.col("duration_s") > 0, F.col("completion_tokens") / F.col("duration_s")).otherwise(F.lit(0.0)),
        )
        .withColumn("dropped", F.lit(0).cast("long"))
    )


def unloaded_calibration(requests: DataFrame, key: str = "worker_id") -> DataFrame:
    """AG-20 + AG-21: unloaded latency per ``key`` over successful requests:
    L0 = rounded-index p50, p90, min, max, modal tokens (ties: smallest),
    decode rate, objective 3 x L0."""
    ok = requests.filter(~F.col("failed"))
    pct = kth_values(ok, [key], "latency_ms", {"L0_ms": rounded_index(50), "p90_ms": rounded_index(90)})
    agg = ok.groupBy(key).agg(
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.avg("tokens").alias("mean_tokens"),
    )
    modal = ok.groupBy(key, "tokens").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(
        F.max_by("tokens", F.struct("c", (-F.col("tokens")).alias("neg"))).alias("tokens_per_request")
    )
    out = pct.join(agg, on=key).join(modal, on=key)
    return out.select(
        key,
        "n",
        "L0_ms",
        "p90_ms",
        "min_ms",
        "max_ms",
        "tokens_per_request",
        F.when(F.col("L0_ms") > 0, F.col("mean_tokens") / (F.col("L0_ms") / 1000.0)).otherwise(F.lit(0.0)).alias("tokens_per_second"),
        (F.lit(SLO_MULTIPLIER) * F.col("L0_ms")).alias("slo_p99_ms"),
    )


def points_from_tests(totals: DataFrame, level: str = "level") -> DataFrame:
    """Sweep points from test totals: offered rate ``2 x level``; levels
    1-4 are the one-worker saturation sweep, 5-8 run 2, 4, 8, 16 workers."""
    lv = F.col(level)
    return totals.withColumn("offered_rps", (lv * 2).cast("double")).withColumn(
        "workers", F.when(lv <= 4, F.lit(1)).otherwise(F.pow(F.lit(2), lv - 4).cast("int"))
    ).withColumnRenamed("test_id", "label")


def l0_ms(points: DataFrame) -> Column:
    """AG-23: p50 of the one-worker point with the lowest offered rate
    (ties: lower p50); only points with successes and a median."""
    c = points.filter((F.col("workers") <= 1) & (F.col("succeeded") > 0) & (F.col("p50_ms") > 0))
    return c.agg(F.min_by("p50_ms", F.struct("offered_rps", "p50_ms"))).scalar()


def saturation(points: DataFrame, slo_multiplier: float = SLO_MULTIPLIER) -> DataFrame:
    """AG-24/25 + WN-10: per point of a one-worker sweep: within objective,
    tail ratio, and the knee = last point of the *leading* healthy run
    (points ordered by offered rate, label as tie-break)."""
    sweep = points.filter(F.col("workers") == 1)
    l0 = l0_ms(points)
    slo = F.lit(slo_multiplier) * l0
    p = sweep.withColumn("within_slo", holds_slo(slo)).withColumn("p99_p50_ratio", tail_ratio())
    p = p.withColumn("l0_ms", l0).withColumn("slo_ms", slo)
    # the sweep is one row per load point: a window over it is tiny
    w = Window.partitionBy("workers").orderBy("offered_rps", "label")
    lead_run = F.min(F.col("within_slo").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    p = p.withColumn("__lead", lead_run)
    last_lead = F.max(F.when(F.col("__lead"), F.struct("offered_rps", "label"))).over(Window.partitionBy("workers"))
    last_pt = F.max(F.struct("offered_rps", "label")).over(Window.partitionBy("workers"))
    p = p.withColumn("is_knee", F.coalesce(F.struct("offered_rps", "label") == last_lead, F.lit(False)))
    p = p.withColumn("knee_beyond_sweep", F.coalesce(last_lead == last_pt, F.lit(False)))
    return p.select(
        "label", "offered_rps", "workers", "p50_ms", "p99_ms", "error_rate", "within_slo",
        "p99_p50_ratio", "is_knee", "knee_beyond_sweep", "l0_ms", "slo_ms",
    )


def scaling(points: DataFrame, targets: dict[int, float] | None = None) -> DataFrame:
    """AG-26: best run per worker count (most tokens/s, ties: smaller label),
    efficiency ``(tput_N / N) / (tput_base / base)`` against the smallest N,
    target and verdict (``passed``: every targeted N meets it)."""
    targets = EFFICIENCY_TARGETS if targets is None else targets
    best = points.groupBy("workers").agg(
        F.min_by(F.struct("tokens_per_second", "p99_ms", "error_rate", "offered_rps", "label"),
                 F.struct((-F.col("tokens_per_second")).alias("neg_tps"), F.col("label"))).alias("b")
    ).select("workers", "b.*")
    base = best.agg(F.min_by(F.col("tokens_per_second") / F.col("workers"), F.col("workers"))).scalar()
    tgt = None
    for n, v in targets.items():
        tgt = F.when(F.col("workers") == n, F.lit(v)) if tgt is None else tgt.when(F.col("workers") == n, F.lit(v))
    out = best.select(
        "workers",
        "tokens_per_second",
        (base * F.col("workers")).alias("ideal_tokens_per_second"),
        ((F.col("tokens_per_second") / F.col("workers")) / base).alias("efficiency"),
        tgt.cast("double").alias("target"),
        "p99_ms",
        "error_rate",
        "offered_rps",
    ).withColumn("meets_target", F.when(F.col("target").isNotNull(), F.col("efficiency") >= F.col("target")))
    passed = out.agg(
        (F.count("meets_target") > 0) & F.coalesce(F.bool_and("meets_target"), F.lit(False))
    ).scalar()
    return out.withColumn("passed", passed)


def usd_per_million_tokens(price_per_hour: float, workers: str = "workers", tps: str = "tokens_per_second") -> Column:
    """AG-27: dollars per million tokens at a fleet's hourly price; null
    without throughput."""
    return F.when(F.col(tps) > 0, F.lit(price_per_hour) * F.col(workers) * 1e6 / 3600.0 / F.col(tps))


def outcome_counts(requests: DataFrame) -> DataFrame:
    """AG-28: request outcomes and per-worker attempt results, one long table."""
    a = requests.groupBy(F.lit("outcome").alias("counter"), F.lit("").alias("worker_id"), outcome().alias("label")).count()
    b = requests.groupBy(F.lit("attempt").alias("counter"), "worker_id", attempt_result().alias("label")).count()
    return a.unionByName(b)


def latency_histogram(requests: DataFrame, key: str = "test_id", seconds: Column | None = None) -> DataFrame:
    """AG-29: cumulative ``le`` histogram per key from one aggregate (one
    conditional count per bound), unpivoted to rows; empty buckets stay."""
    x = seconds if seconds is not None else F.col("latency_ms") / 1000.0
    counts = [F.count(F.when(x <= F.lit(b), F.lit(1))).alias(f"__le{i}") for i, b in enumerate(DURATION_BUCKETS)]
    wide = requests.groupBy(key).agg(*counts)
    arr = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__le{i}").alias("cum_count")) for i, b in enumerate(DURATION_BUCKETS)])
    return wide.select(key, F.explode(arr).alias("b")).select(key, "b.le", "b.cum_count")


def histogram_quantile(hist: DataFrame, q: float, key: str = "test_id") -> DataFrame:
    """AG-30: quantile from cumulative buckets, linear inside the bucket; a
    quantile in the +Inf bucket reads the highest finite bound; null when
    empty.  Windows run over the bounds of one key (14 rows)."""
    w = Window.partitionBy(key).orderBy("le")
    h = hist.withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    h = h.withColumn("prev_cum", F.coalesce(F.lag("cum_count").over(w), F.lit(0)))
    h = h.withColumn("total", F.max("cum_count").over(Window.partitionBy(key)))
    h = h.withColumn("rank", F.lit(q) * F.col("total"))
    hit = h.filter((F.col("total") > 0) & (F.col("cum_count") >= F.col("rank")))
    first = hit.groupBy(key).agg(F.min_by(F.struct("le", "prev_le", "prev_cum", "cum_count", "rank"), F.col("le")).alias("b"))
    b = F.col("b")
    val = F.when(b["le"] == F.lit(float("inf")), b["prev_le"]).otherwise(
        b["prev_le"] + (b["le"] - b["prev_le"]) * F.try_divide(b["rank"] - b["prev_cum"], b["cum_count"] - b["prev_cum"])
    )
    keys = hist.select(key).distinct()
    return keys.join(first.select(key, val.alias("q")), on=key, how="left")


def latency_quantiles(hist: DataFrame, slo_seconds: float, key: str = "test_id") -> DataFrame:
    """AG-30/31: p50, p95, p99 from buckets; tail ratio p99/p50 and share of
    the latency budget in percent."""
    out = None
    for q, name in ((0.5, "q50"), (0.95, "q95"), (0.99, "q99")):
        d = histogram_quantile(hist, q, key).withColumnRenamed("q", name)
        out = d if out is None else out.join(d, on=key)
    return out.withColumn("tail_ratio", F.try_divide(F.col("q99"), F.col("q50"))).withColumn(
        "budget_pct", F.col("q99") / F.lit(slo_seconds) * 100.0
    )


# ------------------------------------------------------- scrapes & rates --

def cumulative_counters(samples: DataFrame) -> DataFrame:
    """Turn per-interval deltas into the counters a worker exports (running
    sums per worker and counter epoch; a new epoch is a restart)."""
    c = scan(
        samples,
        ["worker_id", "counter_epoch"],
        "ts",
        width=86400.0 * 7,
        sums={"requests": "d_requests", "completion_tokens": "d_tokens", "generate_seconds": "d_gen"},
    )
    return c.drop("d_requests", "d_tokens", "d_gen")


def counter_rates(samples: DataFrame) -> DataFrame:
    """WN-12: per-worker rates between consecutive scrapes of a fleet.  The
    previous *scrape* must contain the worker and both samples must be ok;
    otherwise (new, restarted-into-null, failed) the rates read 0.  Deltas
    clamp at 0 (a reset reads idle), utilisation is capped at 1."""
    scrapes = samples.select("fleet", "ts").distinct()
    scrapes = scan(scrapes, ["fleet"], "ts", width=86400.0, prevs={"prev_ts": F.col("ts")})
    cur = samples.join(scrapes, on=["fleet", "ts"])
    prev = samples.select(
        "fleet",
        F.col("ts").alias("prev_ts"),
        "worker_id",
        F.col("ok").alias("p_ok"),
        F.col("requests").alias("p_req"),
        F.col("completion_tokens").alias("p_tok"),
        F.col("generate_seconds").alias("p_gen"),
    )
    j = cur.join(prev, on=["fleet", "prev_ts", "worker_id"], how="left")
    dt = F.greatest(F.col("ts") - F.col("prev_ts"), F.lit(1e-6))
    valid = F.col("prev_ts").isNotNull() & F.col("p_ok").isNotNull() & F.col("ok") & F.col("p_ok")
    return j.select(
        "fleet",
        "ts",
        "worker_id",
        "ok",
        F.when(valid, F.greatest(F.col("requests") - F.col("p_req"), F.lit(0)) / dt).otherwise(F.lit(0.0)).alias("rps"),
        F.when(valid, F.greatest(F.col("completion_tokens") - F.col("p_tok"), F.lit(0)) / dt).otherwise(F.lit(0.0)).alias("tok_s"),
        F.when(valid, F.least(F.greatest(F.col("generate_seconds") - F.col("p_gen"), F.lit(0.0)) / dt, F.lit(1.0)))
        .otherwise(F.lit(0.0))
        .alias("util"),
    )


def flatten_metrics(rates: DataFrame, samples: DataFrame) -> DataFrame:
    """PRJ-13: one ``(ts, metric, value)`` row per worker metric; a failed
    worker only reports ``ok``."""
    j = rates.join(samples.select("fleet", "ts", "worker_id", F.greatest(F.col("in_flight") - 1, F.lit(0)).alias("queued"), "in_flight"),
                   on=["fleet", "ts", "worker_id"])
    metrics = [("ok", F.when(F.col("ok"), 1.0).otherwise(0.0))] + [
        (m, F.when(F.col("ok"), F.col(c).cast("double"))) for m, c in
        (("queued", "queued"), ("in_flight", "in_flight"), ("rps", "rps"), ("tok_s", "tok_s"), ("util", "util"))
    ]
    arr = F.array(*[F.struct(F.lit(m).alias("m"), v.alias("value")) for m, v in metrics])
    return (
        j.select("ts", "worker_id", F.explode(arr).alias("x"))
        .filter(F.col("x.value").isNotNull())
        .select("ts", F.concat(F.lit("workers/"), F.col("worker_id"), F.lit("/"), F.col("x.m")).alias("metric"), F.col("x.value").alias("value"))
    )


def fleet_gauges(samples: DataFrame) -> DataFrame:
    """AG-32/33: per scrape: live workers, workers reporting a queue, max /
    avg / total queue over healthy workers, in-flight total, and the fleet's
    decode rate (sum of the live workers' tokens per second); empty reads 0."""
    ok = F.col("ok")
    q = F.greatest(F.col("in_flight") - 1, F.lit(0))
    return samples.groupBy("fleet", "ts").agg(
        F.count(F.when(ok, F.lit(1))).alias("live_workers"),
        F.count(F.when(ok, q)).alias("reporting"),
        F.coalesce(F.max(F.when(ok, q)), F.lit(0)).alias("max_queue"),
        F.coalesce(F.avg(F.when(ok, q)), F.lit(0.0)).alias("avg_queue"),
        F.coalesce(F.sum(F.when(ok, q)), F.lit(0)).cast("long").alias("queued_total"),
        F.coalesce(F.sum(F.when(ok, F.col("in_flight"))), F.lit(0)).cast("long").alias("in_flight_total"),
        F.coalesce(F.sum(F.when(ok & (F.col("generate_seconds") > 0), F.col("completion_tokens") / F.col("generate_seconds"))), F.lit(0.0)).alias("tokens_per_second"),
    )


def live_workers(heartbeats: DataFrame, as_of: Column, ttl_seconds: float) -> DataFrame:
    """FLT-05: newest heartbeat per worker, live when not older than the TTL
    (inclusive) and it carries an address."""
    newest = heartbeats.groupBy("worker_id").agg(
        F.max_by(F.struct(*[c for c in heartbeats.columns if c != "worker_id"]), F.col("last_seen")).alias("h")
    ).select("worker_id", "h.*")
    return newest.filter((as_of - F.col("last_seen") <= ttl_seconds) & F.col("addr").isNotNull() & (F.col("addr") != ""))


# ------------------------------------------------------ kill and recovery --

PHASES = ["before", "disruption", "recovered"]


def preempt_windows(per_sec: DataFrame, kill_rel: float, ttl: float) -> DataFrame:
    """AG-22: before / disruption / recovered statistics around a kill at
    ``kill_rel`` seconds: sums, true median of per-second means and max p99
    over seconds with successes (0 when none).  All three phases appear."""
    phase = (
        F.when(F.col("t") < kill_rel, F.lit("before"))
        .when(F.col("t") < kill_rel + ttl, F.lit("disruption"))
        .otherwise(F.lit("recovered"))
    )
    b = per_sec.withColumn("phase", phase)
    sums = b.groupBy("test_id", "phase").agg(
        F.sum("sent").alias("requests"),
        F.sum("ok").alias("ok"),
        F.sum("errors").alias("errors"),
        F.max(F.when(F.col("ok") > 0, F.col("p99_ms"))).alias("p99_ms"),
    )
    med = kth_values(b.filter(F.col("ok") > 0), ["test_id", "phase"], "mean_ms", {"lo": lower_median(), "hi": upper_median()})
    med = med.select("test_id", "phase", ((F.col("lo") + F.col("hi")) / 2).alias("p50_ms"))
    dom = per_sec.select("test_id").distinct().select("test_id", F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"))
    out = dom.join(sums, on=["test_id", "phase"], how="left").join(med, on=["test_id", "phase"], how="left")
    return out.select(
        "test_id",
        "phase",
        F.coalesce(F.col("requests"), F.lit(0)).cast("long").alias("requests"),
        F.coalesce(F.col("ok"), F.lit(0)).cast("long").alias("ok"),
        F.coalesce(F.col("errors"), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.col("p50_ms"), F.lit(0.0)).alias("p50_ms"),
        F.coalesce(F.col("p99_ms"), F.lit(0.0)).alias("p99_ms"),
    )


def recovery(per_sec: DataFrame, totals: DataFrame, kill_rel: float, ttl: float) -> DataFrame:
    """WN-11: first post-kill second where it and the next two *rows* are
    error-free, non-empty and p99 <= max(2 x baseline, 1); baseline = true
    median of pre-kill p99 over seconds with successes.  Passed = no
    failures and recovery within TTL + 10 s."""
    pre = per_sec.filter((F.col("t") < kill_rel) & (F.col("ok") > 0))
    base = kth_values(pre, ["test_id"], "p99_ms", {"lo": lower_median(), "hi": upper_median()})
    base = base.select("test_id", ((F.col("lo") + F.col("hi")) / 2).alias("baseline_p99_ms"))
    post = per_sec.filter(F.col("t") >= kill_rel).join(base, on="test_id", how="left")
    post = post.withColumn("__b", F.coalesce(F.col("baseline_p99_ms"), F.lit(0.0)))
    good = (F.col("errors") == 0) & (F.col("ok") > 0) & (F.col("p99_ms") <= F.greatest(2 * F.col("__b"), F.lit(1.0)))
    post = post.withColumn("__g", good)
    post = scan(post, ["test_id"], "t", width=86400.0, nexts={"__g1": F.col("__g")})
    post = scan(post, ["test_id"], "t", width=86400.0, nexts={"__g2": F.col("__g1")})
    hit = post.filter(F.col("__g") & F.coalesce(F.col("__g1"), F.lit(False)) & F.coalesce(F.col("__g2"), F.lit(False)))
    rec = hit.groupBy("test_id").agg((F.min("t") - F.lit(kill_rel)).cast("double").alias("recovery_s"))
    tests = totals.select("test_id", "failed", "dropped")
    out = tests.join(base, on="test_id", how="left").join(rec, on="test_id", how="left")
    return out.select(
        "test_id",
        F.lit(float(kill_rel)).alias("kill_rel_s"),
        F.coalesce(F.col("baseline_p99_ms"), F.lit(0.0)).alias("baseline_p99_ms"),
        "recovery_s",
        F.col("failed").alias("total_failed"),
        F.col("dropped").alias("total_dropped"),
        ((F.col("failed") == 0) & F.col("recovery_s").isNotNull() & (F.col("recovery_s") <= ttl + 10)).alias("passed"),
    )


def requests_per_node(before: DataFrame, after: DataFrame, placement: DataFrame) -> DataFrame:
    """JN-12: requests served per node during a test: counter after minus
    before per worker (full join: a worker missing before counts from 0),
    only workers that served, then placed on their node."""
    j = after.select("worker_id", F.col("value").alias("after")).join(
        before.select("worker_id", F.col("value").alias("before")), "worker_id", "full")
    d = j.select("worker_id", (F.coalesce(F.col("after"), F.lit(0)) - F.coalesce(F.col("before"), F.lit(0))).alias("requests"))
    return d.filter(F.col("requests") > 0).join(placement, "worker_id", "left")
