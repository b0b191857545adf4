"""Registered run-profile queries (marks timeline, summaries, checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.operators import profiles as P
from skiff.operators import runs as R
from skiff.operators import timeline as T
from skiff.plans.oracle_views import with_views
from skiff.sources import driver as D

AS_OF = 1_706_745_600.0
BUDGET_S = 2_592_000.0  # 30 days


def _ledger_typed(spark, sf):
    led = D.instance_ledger(spark, sf)
    no = F.substring(F.col("instance_id"), 3, 20).cast("long")
    types = D.PRICE_TYPES
    t = F.when(no % 4 == 0, types[0]).when(no % 4 == 1, types[1]).when(no % 4 == 2, types[2]).otherwise(types[3])
    return led.withColumn("instance_type", t)


def _timeline(spark, sf):
    return T.epoch_timeline(D.tick_docs(spark, sf), D.epoch_log(spark, sf))


def q_segments(spark, sf):
    return P.mark_segments(D.mark_records(spark, sf))


def q_phase_seconds(spark, sf):
    return P.phase_seconds(P.mark_segments(D.mark_records(spark, sf)))


def q_newest(spark, sf):
    return P.newest_attempts(D.lifecycle_records(spark, sf))


def q_rates(spark, sf):
    return P.effective_rates(_ledger_typed(spark, sf)).select("run_id", "instance_id", "instance_type", "rate_usd", "rate_source")


def q_launch_price(spark, sf):
    inst = _ledger_typed(spark, sf).select("run_id", "instance_id", "instance_type", "az", "started_at")
    prices = D.price_records(spark, sf).select("instance_type", "az", "t", "price_usd")
    return P.launch_price(inst, prices)


def q_summary(spark, sf):
    steps = D.step_records(spark, sf)
    vals = D.eval_records(spark, sf)
    ticks = D.tick_docs(spark, sf)
    launch = R.launch_time(steps.select("run_id").distinct(), ticks, steps)
    return P.run_summary(steps, vals, launch, T.member_changes(_timeline(spark, sf)), D.instance_ledger(spark, sf))


def q_status(spark, sf):
    return P.status_rows(D.tick_docs(spark, sf), D.instance_ledger(spark, sf), AS_OF, BUDGET_S)


def q_shrink(spark, sf):
    return P.shrink_verdict(D.mark_records(spark, sf), D.step_records(spark, sf), full_world=8, node_count=8)


def q_threshold_marks(spark, sf):
    kills = D.lifecycle_records(spark, sf).filter(F.col("state") == "killed").select(
        "run_id", F.col("ts").alias("kill_t"), F.col("event_id").alias("kill_id"))
    return P.threshold_marks(kills, D.tick_docs(spark, sf))


def q_restart_labels(spark, sf):
    return P.restart_labels(D.node_observations(spark, sf), _timeline(spark, sf), D.tick_docs(spark, sf))


def q_data_checks(spark, sf):
    kills = D.lifecycle_records(spark, sf).filter(F.col("state") == "killed")
    return P.data_checks(kills, _timeline(spark, sf), R.outages(D.tick_docs(spark, sf)), D.step_records(spark, sf), D.restart_log(spark, sf))


def q_window_rates(spark, sf):
    return P.world_window_rates(D.tick_docs(spark, sf))


QUERIES = {
    "prof_mark_segments": q_segments,
    "prof_phase_seconds": q_phase_seconds,
    "prof_newest_attempts": q_newest,
    "prof_effective_rates": q_rates,
    "prof_launch_price": q_launch_price,
    "prof_run_summary": q_summary,
    "prof_status_rows": q_status,
    "prof_shrink_verdict": q_shrink,
    "prof_threshold_marks": q_threshold_marks,
    "prof_restart_labels": q_restart_labels,
    "prof_data_checks": q_data_checks,
    "prof_world_window_rates": q_window_rates,
}

# ------------------------------------------------------------------ SQL --

_PAIRS = ", ".join(f"('{a}', '{b}', '{p}')" for a, b, p in P.MARK_PHASE)
_SEG = f"""m1 AS (SELECT *, lead(event) OVER w AS b, lead(t) OVER w AS nt FROM marks WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
seg AS (SELECT m1.run_id, m1.seq, l.phase, m1.t AS start, m1.nt - m1.t AS seconds
        FROM m1 JOIN (VALUES {_PAIRS}) l(a, b, phase) ON l.a = m1.event AND l.b = m1.b WHERE m1.b IS NOT NULL)"""
_TYPE = ("CASE CAST(substr(instance_id, 3) AS BIGINT) % 4 WHEN 0 THEN 'g5.xlarge' WHEN 1 THEN 'g4dn.xlarge' "
         "WHEN 2 THEN 'g6.xlarge' ELSE 'p3.2xlarge' END")
_RATES = ", ".join(f"('{k}', {v})" for k, v in P.ON_DEMAND_HOURLY_USD)


def _ctes(*views, extra=()):
    base = with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]
    return base + "".join(",\n" + e for e in extra) + "\n"


ORACLE = {
    "prof_mark_segments": _ctes("marks", extra=(_SEG,))
    + "SELECT run_id, seq, phase, start, seconds, sum(seconds) OVER (PARTITION BY run_id ORDER BY start, seq ROWS UNBOUNDED PRECEDING) - seconds AS offset_s FROM seg",
    "prof_phase_seconds": _ctes("marks", extra=(_SEG,))
    + "SELECT run_id, phase, sum(seconds) AS seconds FROM seg GROUP BY 1, 2 UNION ALL SELECT run_id, 'total_s', sum(seconds) FROM seg GROUP BY 1",
    "prof_newest_attempts": with_views("SELECT run_id, node, max(coalesce(attempt, 0)) AS attempt FROM lifecycle WHERE node IS NOT NULL GROUP BY 1, 2", "lifecycle"),
    "prof_effective_rates": with_views(
        f"""SELECT run_id, instance_id, {_TYPE} AS instance_type, coalesce(hourly_usd, r.od) AS rate_usd,
              CASE WHEN hourly_usd IS NOT NULL THEN 'ledger' WHEN r.od IS NOT NULL THEN 'on_demand' ELSE 'unknown' END AS rate_source
            FROM ledger LEFT JOIN (VALUES {_RATES}) r(it, od) ON r.it = {_TYPE}""",
        "ledger",
    ),
    "prof_launch_price": with_views(
        f"""SELECT i.run_id, i.instance_id, i.instance_type, i.az, i.started_at, p.price_usd AS spot_price_usd
            FROM (SELECT run_id, instance_id, {_TYPE} AS instance_type, az, started_at FROM ledger) i
            ASOF LEFT JOIN (SELECT instance_type, az, t, max(price_usd) AS price_usd FROM price GROUP BY ALL) p
              ON i.instance_type = p.instance_type AND i.az = p.az AND i.started_at >= p.t""",
        "ledger", "price",
    ),
    "prof_status_rows": with_views(
        f"""SELECT l.run_id, {AS_OF} - l.t AS tick_age_s, {AS_OF} - l.t > 90.0 AS stale, l.epoch, l.world,
              greatest(l.ckpt_step, 0) AS durable_step, coalesce(u.usd, 0.0) AS usd, {AS_OF} - l.first_t AS elapsed_s,
              ({AS_OF} - l.first_t) / {BUDGET_S} AS budget_share, coalesce(l.done, false) AS done
            FROM (SELECT run_id, last(t ORDER BY t, event_id) AS t, last(epoch ORDER BY t, event_id) AS epoch,
                         last(len(members) ORDER BY t, event_id) AS world, last(ckpt_step ORDER BY t, event_id) AS ckpt_step,
                         last(done ORDER BY t, event_id) AS done, min(t) AS first_t FROM ticks GROUP BY 1) l
            LEFT JOIN (SELECT run_id, coalesce(sum(CASE WHEN hourly_usd IS NOT NULL THEN
                         greatest(0.0, least(coalesce(stopped_at, {AS_OF}), {AS_OF}) - started_at) * hourly_usd / 3600.0 END), 0.0) AS usd
                       FROM ledger GROUP BY 1) u USING (run_id)""",
        "ticks", "ledger",
    ),
    "prof_shrink_verdict": with_views(
        """SELECT s.run_id, coalesce(m.mk, false) AS survivors_checkpointing, s.ws7 AS shrunken_steps,
              coalesce(s.final_ws = 7, false) AS shrunken_metrics, coalesce(m.mk, false) AND s.ws7 AND coalesce(s.final_ws = 7, false) AS passed
            FROM (SELECT run_id, bool_or(ws = 7) AS ws7, last(ws ORDER BY t, event_id) AS final_ws FROM steps GROUP BY 1) s
            LEFT JOIN (SELECT run_id, bool_or(event = 'shrink_resume') AS mk FROM marks GROUP BY 1) m USING (run_id)""",
        "steps", "marks",
    ),
}


def q_recovery_rounds(spark, sf):
    from skiff.operators.experiments import recovery_rounds

    kills = D.lifecycle_records(spark, sf).filter(F.col("state") == "killed").select("run_id", F.col("ts").alias("t"))
    return recovery_rounds(kills, _timeline(spark, sf), full_world=8, ticks=D.tick_docs(spark, sf))


QUERIES["prof_recovery_rounds"] = q_recovery_rounds


def q_top_hours(spark, sf):
    from skiff.operators import market as M
    from skiff.plans.market import HOME_REGION, HOME_TYPE, THRESHOLD

    return M.top_hours(M.hourly_odds(D.sps_records(spark, sf), THRESHOLD, HOME_REGION, HOME_TYPE, 8), 6)


QUERIES["market_top_hours"] = q_top_hours

_TLX = """tl0 AS (SELECT t.run_id, t.t, t.event_id, t.epoch FROM ticks t WHERE (t.run_id, t.epoch) IN (SELECT run_id, epoch FROM epoch_log)),
tl1 AS (SELECT *, lag(epoch) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pe FROM tl0),
tl AS (SELECT tl1.run_id, tl1.t, tl1.event_id, tl1.epoch, l.members, l.master FROM tl1 JOIN epoch_log l USING (run_id, epoch)
       WHERE pe IS NULL OR pe <> tl1.epoch),
chg0 AS (SELECT *, lag(members) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pm FROM tl),
changes AS (SELECT run_id, t, 'lost' AS kind, unnest(list_filter(pm, lambda x: NOT list_contains(members, x))) AS node FROM chg0 WHERE pm IS NOT NULL
            UNION ALL
            SELECT run_id, t, 'joined', unnest(list_filter(members, lambda x: NOT list_contains(pm, x))) FROM chg0 WHERE pm IS NOT NULL)"""

ORACLE["market_top_hours"] = with_views(
    """SELECT hour, count(*) AS ticks, avg(CASE WHEN best >= 7.0 THEN 1.0 ELSE 0.0 END) AS p_good, avg(best) AS mean_best, max(best) AS max_best
       FROM (SELECT CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, tick_id, max(CAST(score AS DOUBLE)) AS best FROM sps
             WHERE capacity = 8 AND score IS NOT NULL AND coalesce(scope, 'region') = 'region' AND coalesce(single_az, false) = true
               AND region = 'region-0' AND instance_type = 'g5.xlarge' GROUP BY 1, 2) x
       GROUP BY hour ORDER BY p_good DESC NULLS LAST, ticks DESC, hour LIMIT 6""",
    "sps",
)

ORACLE["prof_run_summary"] = _ctes("steps", "ticks", "epoch_log", "evals", "ledger", extra=(_TLX,)) + """
, s AS (SELECT run_id, max(t) AS end_t, last(step ORDER BY t, event_id) AS steps, sum(ms) / 1000.0 AS trained_s, min(t) AS fs FROM steps GROUP BY 1),
la AS (SELECT s.run_id, coalesce(ft.ft, s.fs) AS launch FROM s LEFT JOIN (SELECT run_id, min(t) AS ft FROM ticks GROUP BY 1) ft USING (run_id)),
v AS (SELECT run_id, last(loss ORDER BY step, loss) AS val_loss FROM evals GROUP BY 1),
c AS (SELECT run_id, count(*) FILTER (WHERE kind = 'lost') AS nodes_lost, count(*) FILTER (WHERE kind = 'joined') AS replacements FROM changes GROUP BY 1),
u AS (SELECT l.run_id, coalesce(sum(CASE WHEN hourly_usd IS NOT NULL THEN greatest(0.0, least(coalesce(stopped_at, s.end_t), s.end_t) - started_at) * hourly_usd / 3600.0 END), 0.0) AS usd
      FROM ledger l JOIN s USING (run_id) GROUP BY 1)
SELECT s.run_id, CAST(floor(la.launch * 1000) AS BIGINT) AS run_start_ms, CAST(floor(s.end_t * 1000) AS BIGINT) AS run_end_ms,
       s.trained_s / CASE WHEN s.end_t - la.launch > 0 THEN s.end_t - la.launch ELSE 1.0 END AS goodput,
       coalesce(c.nodes_lost, 0) AS nodes_lost, coalesce(c.replacements, 0) AS replacements, 0 AS whole_group_restarts,
       s.steps, v.val_loss, coalesce(u.usd, 0.0) AS usd, (s.end_t - la.launch) / 3600.0 AS wall_hours
FROM s JOIN la USING (run_id) LEFT JOIN v USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN u USING (run_id)"""

ORACLE["prof_world_window_rates"] = with_views("""
SELECT w2.*, fr.full_rate, w2.rate / nullif(fr.full_rate, 0) AS rate_vs_full FROM (
  SELECT *, CASE WHEN "end" > start THEN steps / ("end" - start) END AS rate FROM (
    SELECT run_id, win, first(world) AS world, min(t) AS start, max(t) AS "end", max(ckpt_step) - min(ckpt_step) AS steps FROM (
      SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS win FROM (
        SELECT run_id, t, event_id, ckpt_step, len(members) AS world,
               CASE WHEN lag(len(members)) OVER w IS NOT DISTINCT FROM len(members) AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
        FROM ticks WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id)) t1) t2 GROUP BY 1, 2) w) w2
LEFT JOIN (SELECT w3.run_id, sum(steps) / nullif(sum("end" - start), 0) AS full_rate FROM (
    SELECT run_id, win, first(world) AS world, min(t) AS start, max(t) AS "end", max(ckpt_step) - min(ckpt_step) AS steps FROM (
      SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS win FROM (
        SELECT run_id, t, event_id, ckpt_step, len(members) AS world,
               CASE WHEN lag(len(members)) OVER w IS NOT DISTINCT FROM len(members) AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
        FROM ticks WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id)) t1) t2 GROUP BY 1, 2) w3
  JOIN (SELECT run_id, max(len(members)) AS fw FROM ticks GROUP BY 1) f ON f.run_id = w3.run_id AND w3.world = f.fw GROUP BY 1) fr
ON fr.run_id = w2.run_id""", "ticks")

ORACLE["prof_recovery_rounds"] = _ctes("lifecycle", "ticks", "epoch_log", extra=(_TLX,)) + """
, r0 AS (SELECT run_id, ts AS kill_t, count(*) AS nodes_lost FROM lifecycle WHERE state = 'killed' GROUP BY 1, 2),
r AS (SELECT *, lead(kill_t) OVER (PARTITION BY run_id ORDER BY kill_t) AS next_kill FROM r0),
x AS (SELECT r.*,
        (SELECT min(t) FROM tl WHERE tl.run_id = r.run_id AND tl.t > r.kill_t AND len(tl.members) < 8) AS s_et,
        (SELECT first(len(members) ORDER BY t) FROM tl WHERE tl.run_id = r.run_id AND tl.t > r.kill_t AND len(tl.members) < 8) AS s_world,
        (SELECT min(t) FROM tl WHERE tl.run_id = r.run_id AND tl.t > r.kill_t AND len(tl.members) >= 8) AS f_et
      FROM r),
y AS (SELECT *, CASE WHEN next_kill IS NULL OR s_et <= next_kill THEN s_et END AS shrink_t,
                CASE WHEN next_kill IS NULL OR f_et <= next_kill THEN f_et END AS full_t FROM x)
, e AS (SELECT r.run_id, r.kill_t, min(len(tl.members)) AS smallest_world FROM r JOIN tl ON tl.run_id = r.run_id AND tl.t > r.kill_t AND (r.next_kill IS NULL OR tl.t <= r.next_kill)
      WHERE len(tl.members) < 8 GROUP BY 1, 2),
d AS (SELECT r.run_id, r.kill_t, max(ckpt_step) - min(ckpt_step) AS ckpt_gain FROM r JOIN ticks k ON k.run_id = r.run_id AND k.t > r.kill_t AND (r.next_kill IS NULL OR k.t <= r.next_kill) GROUP BY 1, 2)
SELECT y.run_id, y.kill_t, nodes_lost, CASE WHEN shrink_t IS NOT NULL THEN s_world END AS shrunk_world,
       shrink_t - y.kill_t AS detection_s, full_t - y.kill_t AS kill_to_full_s, full_t - shrink_t AS degraded_s, smallest_world, ckpt_gain
FROM y LEFT JOIN e ON e.run_id = y.run_id AND e.kill_t = y.kill_t LEFT JOIN d ON d.run_id = y.run_id AND d.kill_t = y.kill_t"""


# ------------------------------------------------- small report operators --

CONTROL_RATE = 0.0208  # t3.small, the controller box


def q_control_cost(spark, sf):
    """PRJ-17: controller cost per run from its first status tick to AS_OF."""
    t = D.tick_docs(spark, sf).groupBy("run_id").agg(F.min("t").alias("created_at"))
    return t.select("run_id", P.control_plane_cost(F.col("created_at"), F.lit(CONTROL_RATE), F.lit(AS_OF)).alias("usd"))


def q_prep_estimate(spark, sf):
    """PRJ-15 + PRJ-16: readable corpus size and the prep job estimate for
    one hour per GB of text on a c6i.4xlarge with a 500 GB gp3 volume."""
    from skiff.functions.numeric import human_bytes, prep_estimate_usd
    from skiff.sources.tables import table

    docs = table(spark, sf, "documents")
    size = docs.agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    hours = F.greatest(F.lit(1.0), F.col("bytes") / 1e9)
    return size.select("bytes", human_bytes("bytes").alias("readable"),
                       prep_estimate_usd(F.lit(0.68), hours, F.lit(500), F.lit(6000), F.lit(250)).alias("usd"))


def q_requests_per_node(spark, sf):
    """JN-12: requests per node between the first and the last day of the
    scrape history (counter after minus before), workers placed on nodes."""
    from skiff.operators import serving as S

    s = S.cumulative_counters(D.scrape_records(spark, sf))
    day = (F.col("ts") / 86400).cast("long")
    first_day = s.agg(F.min(day)).scalar()
    last_day = s.agg(F.max(day)).scalar()
    before = s.filter(day == first_day).groupBy("worker_id").agg(F.max_by("requests", "ts").alias("value"))
    after = s.filter(day == last_day).groupBy("worker_id").agg(F.max_by("requests", "ts").alias("value"))
    placement = s.select("worker_id").distinct().withColumn(
        "node", (F.substring("worker_id", 2, 5).cast("int") % 4).cast("int"))
    return S.requests_per_node(before, after, placement)


def q_sample_grid(spark, sf):
    """JN-18 over ``conversations``: prompt x run x step side by side."""
    from skiff.operators.experiments import sample_grid
    from skiff.sources.tables import table

    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("run-"), (F.col("conv_id") % 12).cast("string")).alias("run_id"),
        (F.col("turn") / 2).cast("long").alias("step"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("prompt"),
        (F.col("turn") % 2).cast("int").alias("sample_index"),
        F.col("conv_id").alias("sample_id"),
        F.col("text").alias("completion"),
    )
    return sample_grid(c).select("run_id", "step", "prompt", "sample_id", F.md5("completion").alias("completion_md5"), F.length("completion").alias("completion_chars"))


QUERIES.update({
    "prof_control_plane_cost": q_control_cost,
    "prof_prep_estimate": q_prep_estimate,
    "serving_requests_per_node": q_requests_per_node,
    "exp_sample_grid": q_sample_grid,
})

ORACLE["prof_control_plane_cost"] = with_views(
    f"SELECT run_id, ({AS_OF} - min(t)) * {CONTROL_RATE} / 3600.0 AS usd FROM ticks GROUP BY 1", "ticks")
ORACLE["prof_prep_estimate"] = f"""
SELECT bytes,
       CASE WHEN bytes >= 1099511627776 THEN printf('%.1f TB', bytes / 1099511627776.0)
            WHEN bytes >= 1073741824 THEN printf('%.1f GB', bytes / 1073741824.0)
            WHEN bytes >= 1048576 THEN printf('%.1f MB', bytes / 1048576.0)
            WHEN bytes >= 1024 THEN printf('%.1f KB', bytes / 1024.0)
            ELSE printf('%.1f B', bytes * 1.0) END AS readable,
       0.68 * h + 500 * 0.08 * (h / 730.0) + greatest(0, 6000 - 3000) * 0.005 * (h / 730.0) + greatest(0, 250 - 125) * 0.04 * (h / 730.0) AS usd
FROM (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, greatest(1.0, sum(octet_length(encode(text))) / 1e9) AS h FROM documents) x"""
ORACLE["exp_sample_grid"] = """
WITH c AS (SELECT 'run-' || CAST(conv_id % 12 AS VARCHAR) AS run_id, CAST(turn // 2 AS BIGINT) AS step, 'p' || CAST(conv_id % 5 AS VARCHAR) AS prompt,
                  CAST(turn % 2 AS INTEGER) AS sample_index, conv_id AS sample_id, text AS completion FROM conversations),
g AS (SELECT s.run_id, s.step, p.prompt FROM (SELECT DISTINCT run_id, step FROM c) s, (SELECT DISTINCT prompt FROM c) p),
f AS (SELECT run_id, step, prompt, sample_id, completion FROM c WHERE sample_index = 0)
SELECT g.run_id, g.step, g.prompt, f.sample_id, md5(f.completion) AS completion_md5, length(f.completion) AS completion_chars
FROM g LEFT JOIN f USING (run_id, step, prompt)"""

from skiff.plans.serving import _SAMPLES as _SERVING_SAMPLES  # noqa: E402

ORACLE["serving_requests_per_node"] = _ctes("scrape", extra=(_SERVING_SAMPLES,)) + """
, d AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) AS day FROM samples),
b AS (SELECT worker_id, last(requests ORDER BY ts) AS value FROM d WHERE day = (SELECT min(day) FROM d) GROUP BY 1),
a AS (SELECT worker_id, last(requests ORDER BY ts) AS value FROM d WHERE day = (SELECT max(day) FROM d) GROUP BY 1),
j AS (SELECT coalesce(a.worker_id, b.worker_id) AS worker_id, coalesce(a.value, 0) - coalesce(b.value, 0) AS requests
      FROM a FULL JOIN b ON a.worker_id = b.worker_id)
SELECT j.worker_id, j.requests, CAST(CAST(substr(j.worker_id, 2) AS INTEGER) % 4 AS INTEGER) AS node FROM j WHERE requests > 0"""

ORACLE["prof_threshold_marks"] = with_views("""
WITH k AS (SELECT run_id, ts AS kill_t, event_id AS kill_id FROM lifecycle WHERE state = 'killed'),
tk AS (SELECT run_id, t, event_id, ckpt_step, len(members) AS world FROM ticks),
kb AS (SELECT k.run_id, k.kill_t, k.kill_id, tk.ckpt_step AS base_ckpt FROM k ASOF LEFT JOIN tk ON k.run_id = tk.run_id AND k.kill_t >= tk.t),
cyc AS (SELECT tk.*, kb.kill_t, kb.kill_id, kb.base_ckpt FROM tk ASOF JOIN kb ON tk.run_id = kb.run_id AND tk.t > kb.kill_t),
fw AS (SELECT run_id, max(len(members)) AS full FROM ticks GROUP BY 1)
SELECT cyc.run_id, kill_id, kill_t,
       min(t) FILTER (WHERE ckpt_step > coalesce(base_ckpt, -1)) AS shrink_resume_t,
       min(t) FILTER (WHERE world >= fw.full) AS full_world_t
FROM cyc JOIN fw USING (run_id) GROUP BY cyc.run_id, kill_id, kill_t""".replace("WITH k AS", ", k AS"), "lifecycle", "ticks")

ORACLE["prof_data_checks"] = _ctes("lifecycle", "ticks", "epoch_log", "steps", "restart_log", extra=(_TLX,)) + """
, tt AS (SELECT run_id, t, lead(t) OVER (PARTITION BY run_id ORDER BY t, event_id) AS b FROM ticks),
gp AS (SELECT run_id, t AS start, b AS "end", b - t AS gap_s FROM tt WHERE b IS NOT NULL),
med AS (SELECT run_id, count(*) AS n, list_sort(list(gap_s))[count(*) // 2 + 1] AS median_gap FROM gp GROUP BY 1),
gaps AS (SELECT gp.* FROM gp JOIN med USING (run_id)
         WHERE n >= 2 AND gap_s > greatest(CASE WHEN median_gap = 0 THEN 10.0 ELSE median_gap END * 3.0, 90.0)),
k AS (SELECT run_id, count(*) AS kills FROM lifecycle WHERE state = 'killed' GROUP BY 1),
e AS (SELECT run_id, count(*) AS epochs, coalesce(bool_and(pe IS NULL OR epoch >= pe), true) AS monotone
      FROM (SELECT *, lag(epoch) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pe FROM tl) x GROUP BY 1),
g AS (SELECT run_id, count(*) AS outages FROM gaps GROUP BY 1),
adv AS (SELECT s.run_id, count(*) AS steps_in_outage FROM steps s JOIN gaps g ON s.run_id = g.run_id AND s.t > g.start AND s.t < g."end" GROUP BY 1),
j AS (SELECT r.run_id, coalesce(kills, 0) AS kills, coalesce(epochs, 0) AS epochs, monotone, coalesce(outages, 0) AS outages,
             coalesce(steps_in_outage, 0) AS sio
      FROM (SELECT DISTINCT run_id FROM steps) r LEFT JOIN k USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN g USING (run_id) LEFT JOIN adv USING (run_id))
SELECT run_id, 'kills_fired' AS "check", kills > 0 AS passed FROM j
UNION ALL SELECT run_id, 'epochs_reformed', epochs > 1 FROM j
UNION ALL SELECT run_id, 'no_whole_group_restart', run_id NOT IN (SELECT run_id FROM restart_log) FROM j
UNION ALL SELECT run_id, 'outage_bands', outages <= 12 FROM j
UNION ALL SELECT run_id, 'epochs_monotone', coalesce(monotone, true) FROM j
UNION ALL SELECT run_id, 'steps_during_outage', outages = 0 OR sio > 0 FROM j"""

ORACLE["prof_restart_labels"] = _ctes("node_obs", "ticks", "epoch_log", extra=(_TLX,)) + """
, ch AS (SELECT run_id, t AS change_t, event_id AS change_id, list_filter(members, lambda x: list_contains(pm, x)) AS survivors
         FROM chg0 WHERE pm IS NOT NULL),
base AS (SELECT ch.*, tk.ckpt_step AS at_ckpt FROM ch ASOF LEFT JOIN (SELECT run_id, t, ckpt_step FROM ticks) tk
           ON ch.run_id = tk.run_id AND ch.change_t >= tk.t),
o AS (SELECT n.run_id, n.t, n.event_id, n.node, n.aws_state, n.members, k.ckpt_step FROM node_obs n JOIN ticks k USING (run_id, event_id)),
oc AS (SELECT o.*, b.change_t, b.survivors, b.at_ckpt FROM o ASOF LEFT JOIN base b ON o.run_id = b.run_id AND o.t >= b.change_t),
lab AS (SELECT run_id, t, event_id, node,
          CASE WHEN aws_state IN ('shutting-down', 'terminated', 'stopping', 'stopped') THEN 'down'
               WHEN coalesce(list_contains(survivors, node), false) AND NOT (ckpt_step > coalesce(at_ckpt, -1))
                    AND (t - change_t) <= 90.0 AND list_contains(members, node) THEN 'restart'
               WHEN list_contains(members, node) THEN 'train' ELSE 'prov' END AS label FROM oc)
SELECT run_id, t, event_id, node, label,
       lag(label) OVER (PARTITION BY run_id, node ORDER BY t, event_id) = 'train' AND label = 'down' AS kill FROM lab"""


def q_tick_payload(spark, sf):
    from skiff.plans.telemetry import q_run_series

    return P.tick_payload(q_run_series(spark, sf))


QUERIES["prof_tick_payload"] = q_tick_payload

from skiff.plans.telemetry import ORACLE as _TEL_ORACLE  # noqa: E402

ORACLE["prof_tick_payload"] = (
    "WITH series AS (" + _TEL_ORACLE["telemetry_run_series"] + ")\n"
    "SELECT run_id, time, current_step AS train_step, durable_step, steps_at_risk, train_loss, tokens_b, nodes_training,\n"
    "       below_full_world, nodes_lost, replacements, goodput, whole_group_restarts, ms_per_step, usd, usd_per_1k FROM series"
)


# ------------------------------------------- predicate and trainer stamps --

def q_predicate_best(spark, sf):
    """UDF-01: odds of a user's own scenario, passed as a column predicate."""
    from skiff.operators import market as M

    mine = F.col("instance_type").isin("g5.xlarge", "g6.xlarge") & (F.col("region") != "region-1") & (F.col("capacity") == 8)
    return M.odds(M.per_tick_best(D.sps_records(spark, sf), predicate=mine, by=["single_az"]), 7.0, by=["single_az"])


def q_stamped_segments(spark, sf):
    """WN-13: undisturbed runs (launch, training start, end), the even ones with the trainer's stamps."""
    marks = D.mark_records(spark, sf).filter(F.col("event").isin("launch", "train_start", "metrics"))
    no = F.substring_index("run_id", "-", -1).cast("int")
    stamps = marks.select("run_id").distinct().filter(no % 2 == 0).select(
        "run_id", (no + 100.5).alias("train_s"), F.lit(10.0).alias("save_s"), F.lit(0.0).alias("eval_s"), (no * 1.0 + 2).alias("sample_s"))
    return P.mark_segments(marks, stamps)


QUERIES |= {"market_predicate_best": q_predicate_best, "prof_stamped_segments": q_stamped_segments}
ORACLE["market_predicate_best"] = with_views("""SELECT single_az, count(*) AS ticks, avg((best >= 7)::INT) AS p_good, avg(best) AS mean_best, max(best) AS max_best FROM (
    SELECT single_az, tick_id, max(score)::DOUBLE AS best FROM sps WHERE instance_type IN ('g5.xlarge', 'g6.xlarge') AND region <> 'region-1' AND capacity = 8 GROUP BY 1, 2) GROUP BY 1""", "sps")
ORACLE["prof_stamped_segments"] = _ctes("marks") + """
, m AS (SELECT run_id, split_part(run_id, '-', 2)::INT AS no, min(t) FILTER (event = 'launch') AS a, min(t) FILTER (event = 'train_start') AS b, max(t) FILTER (event = 'metrics') AS c FROM marks GROUP BY 1),
s AS (SELECT run_id, -2::BIGINT AS seq, 'provisioning' AS phase, a AS start, b - a AS seconds, 0 AS sub FROM m
      UNION ALL SELECT run_id, -1, 'training', b, CASE WHEN no % 2 = 0 THEN no + 100.5 ELSE c - b END, 0 FROM m
      UNION ALL SELECT run_id, -1, 'final_saves', b, 10.0, 1 FROM m WHERE no % 2 = 0
      UNION ALL SELECT run_id, -1, 'sampling', b, no + 2.0, 3 FROM m WHERE no % 2 = 0)
SELECT run_id, seq, phase, start, seconds, sum(seconds) OVER (PARTITION BY run_id ORDER BY start, seq, sub ROWS UNBOUNDED PRECEDING) - seconds AS offset_s FROM s"""
