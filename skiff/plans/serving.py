"""Registered serving-load queries over the driver's tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.functions.percentile import kth_values, rank_rule
from skiff.operators import serving as S
from skiff.plans.oracle_views import with_views
from skiff.sources import driver as D

KILL_REL = 1_296_000.0  # kill 15 days after each test's first request
KILL_TTL = 86_400.0     # disruption window after the kill
SLO_SECONDS = 0.3       # latency budget for the histogram panels
LIVE_TTL = 7_200.0      # heartbeat TTL for the driver's sparse events
PRICE_PER_WORKER_HOUR = 1.006


def _req(spark, sf):
    return D.request_records(spark, sf)


def _points(spark, sf):
    tot = S.test_totals(_req(spark, sf))
    tot = tot.withColumn("level", F.substring_index("test_id", "-", -1).cast("int"))
    return S.points_from_tests(tot)


def _samples(spark, sf):
    return S.cumulative_counters(D.scrape_records(spark, sf))


def q_per_second(spark, sf):
    return S.per_second(_req(spark, sf))


RULES = {"nearest_rank": (50.0, 99.0), "rounded_index": (50.0, 99.0), "upper_median": (50.0,), "lower_median": (50.0,)}


def q_rank_rules(spark, sf):
    """UDF-05: the latencies of every test under each percentile flavour by name."""
    spec = {f"{name}_{p:.0f}": rank_rule(name, p) for name, ps in RULES.items() for p in ps}
    return kth_values(_req(spark, sf).filter(~F.col("failed")), ["test_id"], "latency_ms", spec)


def q_totals(spark, sf):
    return S.test_totals(_req(spark, sf))


def q_unloaded(spark, sf):
    return S.unloaded_calibration(_req(spark, sf))


def q_saturation(spark, sf):
    return S.saturation(_points(spark, sf))


def q_scaling(spark, sf):
    sc = S.scaling(_points(spark, sf))
    return sc.withColumn("usd_per_mtok", S.usd_per_million_tokens(PRICE_PER_WORKER_HOUR))


def q_clean_points(spark, sf):
    p = _points(spark, sf)
    return p.select("label", "workers", "offered_rps", "failed", "dropped", S.is_clean().alias("clean"),
                    S.achieved_rps().alias("achieved_rps"))


def q_outcomes(spark, sf):
    return S.outcome_counts(_req(spark, sf))


def q_histogram(spark, sf):
    return S.latency_histogram(_req(spark, sf))


def q_quantiles(spark, sf):
    return S.latency_quantiles(S.latency_histogram(_req(spark, sf)), SLO_SECONDS)


def q_rates(spark, sf):
    return S.counter_rates(_samples(spark, sf))


def q_flat(spark, sf):
    s = _samples(spark, sf)
    return S.flatten_metrics(S.counter_rates(s), s)


def q_gauges(spark, sf):
    return S.fleet_gauges(_samples(spark, sf))


def q_worker_gauges(spark, sf):
    s = _samples(spark, sf)
    return S.worker_gauges(s).select("fleet", "ts", "worker_id", "tokens_per_second", "queued")


def q_live(spark, sf):
    hb = D.heartbeat_records(spark, sf)
    as_of = hb.agg(F.max("last_seen")).scalar()
    return S.live_workers(hb, as_of, LIVE_TTL)


def q_preempt(spark, sf):
    return S.preempt_windows(S.per_second(_req(spark, sf)), KILL_REL, KILL_TTL)


def q_recovery(spark, sf):
    r = _req(spark, sf)
    return S.recovery(S.per_second(r), S.test_totals(r), KILL_REL, KILL_TTL)


QUERIES = {
    "serving_rank_rules": q_rank_rules,
    "serving_per_second": q_per_second,
    "serving_test_totals": q_totals,
    "serving_unloaded": q_unloaded,
    "serving_saturation": q_saturation,
    "serving_scaling": q_scaling,
    "serving_clean_points": q_clean_points,
    "serving_outcomes": q_outcomes,
    "serving_histogram": q_histogram,
    "serving_latency_quantiles": q_quantiles,
    "serving_counter_rates": q_rates,
    "serving_flat_metrics": q_flat,
    "serving_fleet_gauges": q_gauges,
    "serving_worker_gauges": q_worker_gauges,
    "serving_live_workers": q_live,
    "serving_preempt_windows": q_preempt,
    "serving_recovery": q_recovery,
}

# ------------------------------------------------------------------ SQL --


def _nr(x: str, cond: str, p: float) -> str:
    """Nearest-rank percentile of ``x`` over rows matching ``cond``."""
    return (
        f"(list_sort(list({x}) FILTER (WHERE {cond})))"
        f"[greatest(CAST(ceil(CAST({p / 100.0!r} AS DOUBLE) * count(*) FILTER (WHERE {cond})) AS BIGINT), 1)]"
    )


def _ri(x: str, p: float) -> str:
    """Rounded-index percentile (half-even) of ``x`` over the group."""
    return f"(list_sort(list({x})))[CAST(round_even(CAST({p / 100.0!r} AS DOUBLE) * (count(*) - 1), 0) AS BIGINT) + 1]"


_PS = """ps AS (SELECT test_id, t, count(*) AS sent, count(*) FILTER (WHERE NOT failed) AS ok,
           count(*) FILTER (WHERE failed) AS errors,
           coalesce({p99}, 0.0) AS p99_ms,
           coalesce(avg(latency_ms) FILTER (WHERE NOT failed), 0.0) AS mean_ms
         FROM (SELECT r.*, CAST(floor(sent_at - min(sent_at) OVER (PARTITION BY test_id)) AS INTEGER) AS t FROM req r) x
         GROUP BY test_id, t)""".format(p99=_nr("latency_ms", "NOT failed", 99))

_TOT = """tot AS (SELECT test_id, count(*) AS requests, count(*) FILTER (WHERE NOT failed) AS succeeded,
           count(*) FILTER (WHERE failed) AS failed,
           CAST(coalesce(sum(tokens) FILTER (WHERE NOT failed), 0) AS BIGINT) AS completion_tokens,
           max(sent_at) - min(sent_at) AS duration_s,
           coalesce(avg(latency_ms) FILTER (WHERE NOT failed), 0.0) AS mean_ms,
           coalesce({p50}, 0.0) AS p50_ms, coalesce({p90}, 0.0) AS p90_ms,
           coalesce({p95}, 0.0) AS p95_ms, coalesce({p99}, 0.0) AS p99_ms,
           CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE failed) / count(*) ELSE 0.0 END AS error_rate,
           CASE WHEN max(sent_at) - min(sent_at) > 0 THEN coalesce(sum(tokens) FILTER (WHERE NOT failed), 0) / (max(sent_at) - min(sent_at))
                ELSE 0.0 END AS tokens_per_second,
           CAST(0 AS BIGINT) AS dropped
         FROM req GROUP BY test_id)""".format(
    p50=_nr("latency_ms", "NOT failed", 50), p90=_nr("latency_ms", "NOT failed", 90),
    p95=_nr("latency_ms", "NOT failed", 95), p99=_nr("latency_ms", "NOT failed", 99),
)

_PTS = """pts AS (SELECT test_id AS label, * EXCLUDE (test_id),
           CAST(CAST(split_part(test_id, '-', 2) AS INTEGER) * 2 AS DOUBLE) AS offered_rps,
           CASE WHEN CAST(split_part(test_id, '-', 2) AS INTEGER) <= 4 THEN 1
                ELSE CAST(pow(2, CAST(split_part(test_id, '-', 2) AS INTEGER) - 4) AS INTEGER) END AS workers
         FROM tot)"""


def _ctes(*views, extra=()):
    base = with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]
    return base + "".join(",\n" + e for e in extra) + "\n"


_SAT = _ctes("req", extra=(_TOT, _PTS)) + f"""
, l0 AS (SELECT first(p50_ms ORDER BY offered_rps, p50_ms) AS l0_ms FROM pts WHERE workers <= 1 AND succeeded > 0 AND p50_ms > 0),
sw AS (SELECT p.*, (SELECT l0_ms FROM l0) AS l0_ms, {S.SLO_MULTIPLIER} * (SELECT l0_ms FROM l0) AS slo_ms FROM pts p WHERE workers = 1),
f AS (SELECT *, coalesce(succeeded > 0 AND error_rate <= {S.DEFAULT_MAX_ERROR_RATE} AND p99_ms <= slo_ms, false) AS within_slo,
        CASE WHEN p50_ms > 0 THEN p99_ms / p50_ms ELSE 'inf'::DOUBLE END AS p99_p50_ratio FROM sw),
g AS (SELECT *, min(CASE WHEN within_slo THEN 1 ELSE 0 END) OVER (ORDER BY offered_rps, label ROWS UNBOUNDED PRECEDING) = 1 AS lead FROM f),
k AS (SELECT (SELECT label FROM g WHERE lead ORDER BY offered_rps DESC, label DESC LIMIT 1) AS knee,
             (SELECT label FROM g ORDER BY offered_rps DESC, label DESC LIMIT 1) AS last)
SELECT label, offered_rps, workers, p50_ms, p99_ms, error_rate, within_slo, p99_p50_ratio,
       coalesce(label = (SELECT knee FROM k), false) AS is_knee,
       coalesce((SELECT knee FROM k) = (SELECT last FROM k), false) AS knee_beyond_sweep,
       l0_ms, slo_ms
FROM g"""

_SCALING = _ctes("req", extra=(_TOT, _PTS)) + f"""
, best AS (SELECT workers, first(tokens_per_second ORDER BY tokens_per_second DESC, label) AS tokens_per_second,
             first(p99_ms ORDER BY tokens_per_second DESC, label) AS p99_ms,
             first(error_rate ORDER BY tokens_per_second DESC, label) AS error_rate,
             first(offered_rps ORDER BY tokens_per_second DESC, label) AS offered_rps
           FROM pts GROUP BY workers),
base AS (SELECT first(tokens_per_second / workers ORDER BY workers) AS b FROM best),
o AS (SELECT workers, tokens_per_second, (SELECT b FROM base) * workers AS ideal_tokens_per_second,
        (tokens_per_second / workers) / (SELECT b FROM base) AS efficiency,
        CAST(CASE workers WHEN 4 THEN 0.9 WHEN 8 THEN 0.8 END AS DOUBLE) AS target, p99_ms, error_rate, offered_rps
      FROM best),
o2 AS (SELECT *, CASE WHEN target IS NOT NULL THEN efficiency >= target END AS meets_target FROM o)
SELECT *, (SELECT count(meets_target) > 0 AND coalesce(bool_and(meets_target), false) FROM o2) AS passed,
       CASE WHEN tokens_per_second > 0 THEN {PRICE_PER_WORKER_HOUR} * workers * 1e6 / 3600.0 / tokens_per_second END AS usd_per_mtok
FROM o2"""

_BOUNDS = ", ".join(f"({b!r}::DOUBLE)" if b != float("inf") else "('inf'::DOUBLE)" for b in S.DURATION_BUCKETS)
_HIST = f"""hist AS (SELECT r.test_id, b.le, count(*) FILTER (WHERE r.latency_ms / 1000.0 <= b.le) AS cum_count
            FROM req r, (VALUES {_BOUNDS}) b(le) GROUP BY r.test_id, b.le)"""


def _hq(q, name):
    return f"""{name} AS (SELECT test_id, first(CASE WHEN le = 'inf'::DOUBLE THEN prev_le
                  ELSE prev_le + (le - prev_le) * (rk - prev_cum) / nullif(cum_count - prev_cum, 0) END ORDER BY le) AS {name}
        FROM (SELECT *, coalesce(lag(le) OVER w, 0.0) AS prev_le, coalesce(lag(cum_count) OVER w, 0) AS prev_cum,
                     {q!r} * max(cum_count) OVER (PARTITION BY test_id) AS rk, max(cum_count) OVER (PARTITION BY test_id) AS total
              FROM hist WINDOW w AS (PARTITION BY test_id ORDER BY le)) x
        WHERE total > 0 AND cum_count >= rk GROUP BY test_id)"""


_SAMPLES = """samples AS (SELECT *, sum(d_requests) OVER w AS requests, sum(d_tokens) OVER w AS completion_tokens,
                  sum(d_gen) OVER w AS generate_seconds
           FROM scrape WINDOW w AS (PARTITION BY worker_id, counter_epoch ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
_RATES = """sc AS (SELECT fleet, ts, lag(ts) OVER (PARTITION BY fleet ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT fleet, ts FROM samples) d),
rates AS (SELECT c.fleet, c.ts, c.worker_id, c.ok,
    CASE WHEN v THEN greatest(c.requests - p.requests, 0) / dt ELSE 0.0 END AS rps,
    CASE WHEN v THEN greatest(c.completion_tokens - p.completion_tokens, 0) / dt ELSE 0.0 END AS tok_s,
    CASE WHEN v THEN least(greatest(c.generate_seconds - p.generate_seconds, 0.0) / dt, 1.0) ELSE 0.0 END AS util
  FROM (SELECT s.*, sc.prev_ts FROM samples s JOIN sc USING (fleet, ts)) c
  LEFT JOIN samples p ON p.fleet = c.fleet AND p.ts = c.prev_ts AND p.worker_id = c.worker_id,
  LATERAL (SELECT c.prev_ts IS NOT NULL AND p.ok IS NOT NULL AND c.ok AND p.ok AS v, greatest(c.ts - c.prev_ts, 1e-6) AS dt))"""

_PHASE = f"CASE WHEN t < {KILL_REL} THEN 'before' WHEN t < {KILL_REL + KILL_TTL} THEN 'disruption' ELSE 'recovered' END"

ORACLE = {
    "serving_per_second": _ctes("req", extra=(_PS,)) + "SELECT * FROM ps",
    "serving_test_totals": _ctes("req", extra=(_TOT,)) + "SELECT * FROM tot",
    "serving_unloaded": with_views(
        f"""SELECT worker_id, count(*) AS n, {_ri('latency_ms', 50)} AS L0_ms, {_ri('latency_ms', 90)} AS p90_ms,
              min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
              (SELECT first(tokens ORDER BY c DESC, tokens) FROM (SELECT tokens, count(*) AS c FROM req r2
                 WHERE NOT failed AND r2.worker_id = r.worker_id GROUP BY tokens)) AS tokens_per_request,
              CASE WHEN {_ri('latency_ms', 50)} > 0 THEN avg(tokens) / ({_ri('latency_ms', 50)} / 1000.0) ELSE 0.0 END AS tokens_per_second,
              {S.SLO_MULTIPLIER} * {_ri('latency_ms', 50)} AS slo_p99_ms
            FROM req r WHERE NOT failed GROUP BY worker_id""",
        "req",
    ),
    "serving_saturation": _SAT,
    "serving_scaling": _SCALING,
    "serving_clean_points": _ctes("req", extra=(_TOT, _PTS))
    + """SELECT label, workers, offered_rps, failed, dropped, failed = 0 AND dropped = 0 AS clean,
           CASE WHEN duration_s > 0 THEN succeeded / duration_s ELSE 0.0 END AS achieved_rps FROM pts""",
    "serving_outcomes": with_views(
        """SELECT 'outcome' AS counter, '' AS worker_id,
                  CASE WHEN status IS NULL OR status >= 500 THEN 'failed' WHEN coalesce(rerouted, false) THEN 'rerouted' ELSE 'ok' END AS label,
                  count(*) AS count FROM req GROUP BY ALL
           UNION ALL
           SELECT 'attempt', worker_id,
                  CASE WHEN status IS NULL THEN 'error' WHEN status >= 200 AND status < 300 THEN 'ok'
                       WHEN status >= 400 AND status < 500 THEN 'client_error' ELSE 'server_error' END, count(*)
           FROM req GROUP BY ALL""",
        "req",
    ),
    "serving_histogram": _ctes("req", extra=(_HIST,)) + "SELECT * FROM hist",
    "serving_latency_quantiles": _ctes("req", extra=(_HIST, _hq(0.5, "q50"), _hq(0.95, "q95"), _hq(0.99, "q99")))
    + f"""SELECT t.test_id, q50, q95, q99, q99 / nullif(q50, 0) AS tail_ratio, q99 / {SLO_SECONDS} * 100.0 AS budget_pct
          FROM (SELECT DISTINCT test_id FROM hist) t LEFT JOIN q50 USING (test_id) LEFT JOIN q95 USING (test_id)
          LEFT JOIN q99 USING (test_id)""",
    "serving_counter_rates": _ctes("scrape", extra=(_SAMPLES, _RATES)) + "SELECT * FROM rates",
    "serving_flat_metrics": _ctes("scrape", extra=(_SAMPLES, _RATES))
    + """, j AS (SELECT r.*, greatest(s.in_flight - 1, 0) AS queued, s.in_flight FROM rates r JOIN samples s USING (fleet, ts, worker_id))
         SELECT ts, 'workers/' || worker_id || '/ok' AS metric, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS value FROM j
         UNION ALL SELECT ts, 'workers/' || worker_id || '/queued', CAST(queued AS DOUBLE) FROM j WHERE ok
         UNION ALL SELECT ts, 'workers/' || worker_id || '/in_flight', CAST(in_flight AS DOUBLE) FROM j WHERE ok
         UNION ALL SELECT ts, 'workers/' || worker_id || '/rps', rps FROM j WHERE ok
         UNION ALL SELECT ts, 'workers/' || worker_id || '/tok_s', tok_s FROM j WHERE ok
         UNION ALL SELECT ts, 'workers/' || worker_id || '/util', util FROM j WHERE ok""",
    "serving_fleet_gauges": _ctes("scrape", extra=(_SAMPLES,))
    + """SELECT fleet, ts, count(*) FILTER (WHERE ok) AS live_workers, count(*) FILTER (WHERE ok) AS reporting,
                  coalesce(max(greatest(in_flight - 1, 0)) FILTER (WHERE ok), 0) AS max_queue,
                  coalesce(avg(greatest(in_flight - 1, 0)) FILTER (WHERE ok), 0.0) AS avg_queue,
                  CAST(coalesce(sum(greatest(in_flight - 1, 0)) FILTER (WHERE ok), 0) AS BIGINT) AS queued_total,
                  CAST(coalesce(sum(in_flight) FILTER (WHERE ok), 0) AS BIGINT) AS in_flight_total,
                  coalesce(sum(completion_tokens / generate_seconds) FILTER (WHERE ok AND generate_seconds > 0), 0.0) AS tokens_per_second
           FROM samples GROUP BY fleet, ts""",
    "serving_worker_gauges": _ctes("scrape", extra=(_SAMPLES,))
    + """SELECT fleet, ts, worker_id, coalesce(completion_tokens / nullif(generate_seconds, 0), 0.0) AS tokens_per_second,
              greatest(in_flight - 1, 0) AS queued FROM samples""",
    "serving_live_workers": with_views(
        f"""SELECT worker_id, addr, model, market, requests_served, last_seen FROM (
              SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY last_seen DESC) AS rn FROM heartbeat) h
            WHERE rn = 1 AND (SELECT max(last_seen) FROM heartbeat) - last_seen <= {LIVE_TTL}
              AND addr IS NOT NULL AND addr <> ''""",
        "heartbeat",
    ),
    "serving_preempt_windows": _ctes("req", extra=(_PS,))
    + f""", b AS (SELECT *, {_PHASE} AS phase FROM ps),
          s AS (SELECT test_id, phase, sum(sent) AS requests, sum(ok) AS ok, sum(errors) AS errors,
                       median(mean_ms) FILTER (WHERE ok > 0) AS p50_ms, max(p99_ms) FILTER (WHERE ok > 0) AS p99_ms
                FROM b GROUP BY ALL),
          dom AS (SELECT test_id, phase FROM (SELECT DISTINCT test_id FROM ps) t,
                  (VALUES ('before'), ('disruption'), ('recovered')) v(phase))
          SELECT test_id, phase, CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(ok, 0) AS BIGINT) AS ok,
                 CAST(coalesce(errors, 0) AS BIGINT) AS errors, coalesce(p50_ms, 0.0) AS p50_ms, coalesce(p99_ms, 0.0) AS p99_ms
          FROM dom LEFT JOIN s USING (test_id, phase)""",
    "serving_recovery": _ctes("req", extra=(_PS, _TOT))
    + f""", base AS (SELECT test_id, median(p99_ms) AS baseline_p99_ms FROM ps WHERE t < {KILL_REL} AND ok > 0 GROUP BY 1),
          post AS (SELECT p.*, errors = 0 AND ok > 0 AND p99_ms <= greatest(2 * coalesce(b.baseline_p99_ms, 0.0), 1.0) AS g
                   FROM ps p LEFT JOIN base b USING (test_id) WHERE t >= {KILL_REL}),
          l AS (SELECT *, lead(g, 1) OVER w AS g1, lead(g, 2) OVER w AS g2 FROM post WINDOW w AS (PARTITION BY test_id ORDER BY t)),
          rec AS (SELECT test_id, CAST(min(t) - {KILL_REL} AS DOUBLE) AS recovery_s FROM l WHERE g AND coalesce(g1, false) AND coalesce(g2, false) GROUP BY 1)
          SELECT test_id, {KILL_REL} ::DOUBLE AS kill_rel_s, coalesce(baseline_p99_ms, 0.0) AS baseline_p99_ms, recovery_s,
                 failed AS total_failed, dropped AS total_dropped,
                 coalesce(failed = 0 AND recovery_s IS NOT NULL AND recovery_s <= {KILL_TTL + 10}, false) AS passed
          FROM tot LEFT JOIN base USING (test_id) LEFT JOIN rec USING (test_id)""",
}
ORACLE["serving_rank_rules"] = with_views(
    """SELECT test_id, len(x) AS n, x[ceil(0.5::DOUBLE * len(x))::BIGINT] AS nearest_rank_50, x[ceil(0.99::DOUBLE * len(x))::BIGINT] AS nearest_rank_99,
         x[round_even(0.5::DOUBLE * (len(x) - 1), 0)::BIGINT + 1] AS rounded_index_50, x[round_even(0.99::DOUBLE * (len(x) - 1), 0)::BIGINT + 1] AS rounded_index_99,
         x[len(x) // 2 + 1] AS upper_median_50, x[(len(x) - 1) // 2 + 1] AS lower_median_50
       FROM (SELECT test_id, list_sort(list(latency_ms)) AS x FROM req WHERE NOT failed GROUP BY 1)""",
    "req",
)
