"""Registered run-telemetry queries over the driver's tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.operators import runs as R
from skiff.operators import timeline as T
from skiff.operators.asof import nearest
from skiff.functions.numeric import round_half_up_sql as _r
from skiff.plans.oracle_views import with_views
from skiff.sinks.writers import TS_COLUMNS, run_series_table
from skiff.sources import driver as D

AS_OF = 1_706_745_600.0  # 2024-02-01: "now" for every run of the driver data
TARGET = D.TARGET_WORLD


def _ev(spark, sf):
    return D.lifecycle_records(spark, sf)


def _timeline(spark, sf):
    return T.epoch_timeline(D.tick_docs(spark, sf), D.epoch_log(spark, sf))


def _gaps(spark, sf):
    return R.outages(D.tick_docs(spark, sf))


def q_node_spans(spark, sf):
    return T.node_spans(_ev(spark, sf), AS_OF)


def q_wasted(spark, sf):
    return T.wasted_work(_ev(spark, sf))


def q_world_spans(spark, sf):
    return T.world_spans(_ev(spark, sf), AS_OF)


def q_degraded(spark, sf):
    return T.degraded_windows(T.world_spans(_ev(spark, sf), AS_OF))


def q_degraded_summary(spark, sf):
    return T.degraded_summary(T.world_spans(_ev(spark, sf), AS_OF))


def q_leaders(spark, sf):
    return T.leader_handovers(_ev(spark, sf))


def q_leader_rows(spark, sf):
    return T.leader_rows(_ev(spark, sf))


def q_current_leader(spark, sf):
    return T.current_leader(_ev(spark, sf), AS_OF - 86400 * 7)


def q_markers(spark, sf):
    return T.markers(_ev(spark, sf))


def q_epoch_timeline(spark, sf):
    return _timeline(spark, sf).withColumn("members", F.array_join("members", ","))


def q_member_changes(spark, sf):
    return T.member_changes(_timeline(spark, sf))


def q_survivors(spark, sf):
    return T.survivors(_timeline(spark, sf)).withColumn("survivors", F.array_join("survivors", ","))


def q_world_rows(spark, sf):
    launch = R.launch_time(D.tick_docs(spark, sf).select("run_id").distinct(), D.tick_docs(spark, sf), D.step_records(spark, sf))
    return T.world_rows(_timeline(spark, sf), launch, AS_OF, TARGET)


def q_degraded_regions(spark, sf):
    return T.degraded_regions(_timeline(spark, sf), TARGET)


def q_kill_times(spark, sf):
    kills = _ev(spark, sf).filter(F.col("state").isin("killed", "down")).select("run_id", "ts", "event_id")
    return T.kill_times(D.termination_log(spark, sf), kills)


def q_outages(spark, sf):
    return R.outage_annotations(_gaps(spark, sf))


def q_cost_ledger(spark, sf):
    return R.cost_ledger(D.instance_ledger(spark, sf), AS_OF)


def q_cost_totals(spark, sf):
    return R.cost_totals(D.instance_ledger(spark, sf), AS_OF)


def q_observed(spark, sf):
    return R.observed_instances(D.tick_docs(spark, sf), AS_OF)


def q_cost_curve(spark, sf):
    return R.cost_curve(D.instance_ledger(spark, sf), AS_OF)


def q_run_series(spark, sf):
    ticks = D.tick_docs(spark, sf)
    steps = D.step_records(spark, sf)
    changes = T.member_changes(_timeline(spark, sf))
    return R.run_series(steps, ticks, changes, D.instance_ledger(spark, sf), R.outages(ticks),
                        target_world=TARGET, tokens_per_step=D.TOKENS_PER_STEP)


def q_boot_rows(spark, sf):
    ticks = D.tick_docs(spark, sf)
    changes = T.member_changes(_timeline(spark, sf))
    return R.boot_rows(ticks, D.step_records(spark, sf), changes, D.instance_ledger(spark, sf), R.outages(ticks), TARGET)


def q_series_table(spark, sf):
    """SET-01: boot rows and step rows as one table."""
    return run_series_table(q_run_series(spark, sf), q_boot_rows(spark, sf))


def q_eval_points(spark, sf):
    return R.eval_points(D.eval_records(spark, sf), D.step_records(spark, sf))


def q_rank_times(spark, sf):
    """JN-03: rank lines without a clock take the nearest known step's time."""
    steps = D.step_records(spark, sf)
    known = steps.groupBy("run_id", "step").agg(F.max("t").alias("t"))
    rl = D.rank_lines(spark, sf)
    missing = rl.filter(F.col("t").isNull()).drop("t")
    placed = nearest(missing, known, ["run_id"], "step", "step", "t", "t", width=10000.0)
    return placed.unionByName(rl.filter(F.col("t").isNotNull()))


def q_generation_spans(spark, sf):
    return T.generation_spans(q_rank_times(spark, sf).filter(F.col("t").isNotNull()))


QUERIES = {
    "telemetry_series_table": q_series_table,
    "telemetry_node_spans": q_node_spans,
    "telemetry_wasted": q_wasted,
    "telemetry_world_spans": q_world_spans,
    "telemetry_degraded": q_degraded,
    "telemetry_degraded_summary": q_degraded_summary,
    "telemetry_leaders": q_leaders,
    "telemetry_leader_rows": q_leader_rows,
    "telemetry_current_leader": q_current_leader,
    "telemetry_markers": q_markers,
    "telemetry_epoch_timeline": q_epoch_timeline,
    "telemetry_member_changes": q_member_changes,
    "telemetry_survivors": q_survivors,
    "telemetry_world_rows": q_world_rows,
    "telemetry_degraded_regions": q_degraded_regions,
    "telemetry_kill_times": q_kill_times,
    "telemetry_outages": q_outages,
    "telemetry_cost_ledger": q_cost_ledger,
    "telemetry_cost_totals": q_cost_totals,
    "telemetry_observed_instances": q_observed,
    "telemetry_cost_curve": q_cost_curve,
    "telemetry_run_series": q_run_series,
    "telemetry_boot_rows": q_boot_rows,
    "telemetry_eval_points": q_eval_points,
    "telemetry_rank_times": q_rank_times,
    "telemetry_generation_spans": q_generation_spans,
}

# ------------------------------------------------------------------ SQL --

_LABEL = ("CASE state WHEN 'provisioning' THEN 'prov' WHEN 'reconfiguring' THEN 'reconfig' WHEN 'training' THEN 'train' "
          "WHEN 'stalled' THEN 'stalled' WHEN 'down' THEN 'down' WHEN 'killed' THEN 'down' END")
_STATES = "('provisioning','reconfiguring','training','stalled','down','killed')"
_ROW = "run_id, node, attempt"


def _ctes(*views, extra=()):
    base = with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]
    return base + "".join(",\n" + e for e in extra) + "\n"


_NE = f"""ne AS (SELECT run_id, node, coalesce(attempt, 0) AS attempt, ts, event_id, state, step
         FROM lifecycle WHERE state IN {_STATES} AND node IS NOT NULL)"""
_T0 = f"""t0 AS (SELECT run_id, min(ts) AS t0 FROM lifecycle
         WHERE (state IN {_STATES} AND node IS NOT NULL) OR (state = 'epoch' AND world IS NOT NULL) GROUP BY 1)"""
_WASTED = f"""seg AS (SELECT *, sum(CASE WHEN state = 'training' THEN 1 ELSE 0 END) OVER (
           PARTITION BY {_ROW} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM ne),
opens AS (SELECT {_ROW}, seg, ts AS open_ts, step AS open_step, event_id FROM seg WHERE state = 'training'),
stalls AS (SELECT {_ROW}, seg, max(step) AS st_max, max(ts) AS st_ts FROM seg
           WHERE state = 'stalled' AND step IS NOT NULL AND seg > 0 GROUP BY ALL),
prev AS (SELECT o.run_id, o.node, o.attempt, o.seg + 1 AS seg, o.open_ts AS p_ts, o.open_step AS p_step,
           CASE WHEN o.open_step IS NULL THEN s.st_max ELSE greatest(o.open_step, coalesce(s.st_max, o.open_step)) END AS peak,
           coalesce(s.st_ts, o.open_ts) AS peak_ts
         FROM opens o LEFT JOIN stalls s USING ({_ROW}, seg)),
wj AS (SELECT o.*, p.p_ts, p.p_step, p.peak, p.peak_ts FROM opens o JOIN prev p USING ({_ROW}, seg)
       WHERE o.open_step IS NOT NULL AND p.peak IS NOT NULL AND p.p_step IS NOT NULL AND o.open_step < p.peak),
wr AS (SELECT *, peak - open_step AS lost_steps,
         CASE WHEN peak_ts - p_ts > 0 THEN (peak - p_step) / (peak_ts - p_ts) ELSE 0.0 END AS rate FROM wj),
wasted AS (SELECT {_ROW}, open_ts AS ts, event_id, lost_steps, CASE WHEN rate > 0 THEN lost_steps / rate ELSE 0.0 END AS redo_s
           FROM wr WHERE lost_steps > 0 AND (CASE WHEN rate > 0 THEN lost_steps / rate ELSE 0.0 END) > 0)"""
_SAMPLES = f"""s0 AS (SELECT {_ROW}, ts, event_id, {_LABEL} AS label,
          lead(ts) OVER (PARTITION BY {_ROW} ORDER BY ts, event_id) AS next_ts FROM ne WHERE state <> 'reconfiguring'),
s1 AS (SELECT s0.*, w.redo_s, CASE WHEN w.redo_s IS NOT NULL THEN least(s0.ts + w.redo_s, coalesce(s0.next_ts, 'inf'::DOUBLE)) END AS we
       FROM s0 LEFT JOIN wasted w USING ({_ROW}, event_id)),
smp AS (SELECT {_ROW}, ts, CAST(event_id AS DOUBLE) AS seq, CASE WHEN redo_s IS NOT NULL THEN 'wasted' ELSE label END AS label FROM s1
        UNION ALL
        SELECT {_ROW}, we, event_id + 0.5, 'train' FROM s1 WHERE we IS NOT NULL AND we > ts AND we < coalesce(next_ts, 'inf'::DOUBLE))"""


def _spans_sql(src, keys, order, value, as_of):
    return f"""sp1 AS (SELECT *, lead(ts) OVER (PARTITION BY {keys} ORDER BY {order}) AS nx,
                 CASE WHEN lag({value}) OVER (PARTITION BY {keys} ORDER BY {order}) IS NOT DISTINCT FROM {value}
                      AND row_number() OVER (PARTITION BY {keys} ORDER BY {order}) > 1 THEN 0 ELSE 1 END AS chg FROM {src}),
sp2 AS (SELECT *, sum(chg) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS span_no FROM sp1),
sp AS (SELECT {keys}, span_no, first({value}) AS {value}, min(ts) AS start,
         coalesce(last(nx ORDER BY {order}), {as_of}) AS "end" FROM sp2 GROUP BY ALL)"""


_WORLD = f"""ws AS (SELECT run_id, ts, CAST(world AS INTEGER) AS world, event_id FROM lifecycle WHERE state = 'epoch' AND world IS NOT NULL),
{_spans_sql('ws', 'run_id', 'ts, world, event_id', 'world', AS_OF)},
wsp AS (SELECT run_id, span_no, world, start, "end", start - t0 AS start_rel, "end" - start AS duration FROM sp JOIN t0 USING (run_id))"""

_DEGRADED = """full_w AS (SELECT run_id, max(world) AS fw FROM wsp GROUP BY 1),
d1 AS (SELECT w.*, f.fw, max(CASE WHEN f.fw > 0 AND w.world >= f.fw THEN 1 ELSE 0 END) OVER (
         PARTITION BY run_id ORDER BY start, span_no ROWS UNBOUNDED PRECEDING) AS reached FROM wsp w JOIN full_w f USING (run_id)),
d2 AS (SELECT *, reached = 1 AND fw > 0 AND world < fw AS deg FROM d1),
d2b AS (SELECT *, CASE WHEN deg IS NOT DISTINCT FROM lag(deg) OVER (PARTITION BY run_id ORDER BY start, span_no)
                        AND row_number() OVER (PARTITION BY run_id ORDER BY start, span_no) > 1 THEN 0 ELSE 1 END AS chg FROM d2),
d3 AS (SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY start, span_no ROWS UNBOUNDED PRECEDING) AS grp FROM d2b),
dw AS (SELECT run_id, min(start_rel) AS start_rel, sum(duration) AS duration, min(world) AS min_world FROM d3 WHERE deg GROUP BY run_id, grp)"""

_TL = """tl0 AS (SELECT t.run_id, t.t, t.event_id, t.epoch FROM ticks t WHERE (t.run_id, t.epoch) IN (SELECT run_id, epoch FROM epoch_log)),
tl1 AS (SELECT *, lag(epoch) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pe FROM tl0),
tl AS (SELECT tl1.run_id, tl1.t, tl1.event_id, tl1.epoch, l.members, l.master FROM tl1 JOIN epoch_log l USING (run_id, epoch)
       WHERE pe IS NULL OR pe <> tl1.epoch),
chg0 AS (SELECT *, lag(members) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pm FROM tl),
changes AS (SELECT run_id, t, 'lost' AS kind, unnest(list_filter(pm, lambda x: NOT list_contains(members, x))) AS node FROM chg0 WHERE pm IS NOT NULL
            UNION ALL
            SELECT run_id, t, 'joined', unnest(list_filter(members, lambda x: NOT list_contains(pm, x))) FROM chg0 WHERE pm IS NOT NULL)"""

_GAPS = """tt AS (SELECT run_id, t, lead(t) OVER (PARTITION BY run_id ORDER BY t, event_id) AS b FROM ticks),
gp AS (SELECT run_id, t AS start, b AS "end", b - t AS gap_s FROM tt WHERE b IS NOT NULL),
med AS (SELECT run_id, count(*) AS n, list_sort(list(gap_s))[count(*) // 2 + 1] AS median_gap FROM gp GROUP BY 1),
gaps AS (SELECT gp.*, median_gap, greatest(CASE WHEN median_gap = 0 THEN 10.0 ELSE median_gap END * 3.0, 90.0) AS threshold
         FROM gp JOIN med USING (run_id)
         WHERE n >= 2 AND gap_s > greatest(CASE WHEN median_gap = 0 THEN 10.0 ELSE median_gap END * 3.0, 90.0))"""


def _cost(t_expr, run_expr, stop="coalesce(stopped_at, 'inf'::DOUBLE)"):
    """Exact cost at a time: decimal products summed, then to double."""
    return f"""(SELECT coalesce(CAST(sum(CAST(round(hourly_usd * 1e7) AS DECIMAL(38,0))
                   * CAST(greatest(0.0, least({t_expr}, {stop}) - started_at) AS DECIMAL(15,6))) AS DOUBLE) / 36000000000.0, 0.0)
               FROM ledger l WHERE l.run_id = {run_expr} AND hourly_usd IS NOT NULL AND {t_expr} > started_at)"""


def _up(t_expr, run_expr):
    return f"""CASE WHEN EXISTS (SELECT 1 FROM gaps g WHERE g.run_id = {run_expr} AND g.start < {t_expr} AND {t_expr} < g."end") THEN 0 ELSE 1 END"""


def _cnt(kind, t_expr, run_expr):
    return f"(SELECT count(*) FROM changes c WHERE c.run_id = {run_expr} AND c.kind = '{kind}' AND c.t <= {t_expr})"


_SERIES = f"""st AS (SELECT s.*, max(step) OVER w AS furthest_step, min(t) OVER w AS t0,
           list_sort(list(ms) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS win
         FROM steps s WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
tk AS (SELECT run_id, t AS tick_t, len(members) AS members_n, ckpt_step FROM ticks),
j AS (SELECT st.*, tk.members_n, tk.ckpt_step AS tick_ckpt FROM st ASOF LEFT JOIN tk ON st.run_id = tk.run_id AND st.t >= tk.tick_t),
tr AS (SELECT run_id, sum(ms) / 1000.0 AS trained FROM steps GROUP BY 1),
j2 AS (SELECT j.*, CAST(CASE WHEN ws <> 0 THEN ws ELSE coalesce(members_n, ws) END AS INTEGER) AS nodes_training,
         greatest(coalesce(tick_ckpt, -1), 0) AS durable_step, tr.trained,
         {_cost('j.t', 'j.run_id')} AS usd_raw, {_up('j.t', 'j.run_id')} AS supervisor_up,
         {_cnt('lost', 'j.t', 'j.run_id')} AS nodes_lost, {_cnt('joined', 'j.t', 'j.run_id')} AS replacements
       FROM j LEFT JOIN tr USING (run_id))"""

ORACLE = {
    "telemetry_node_spans": _ctes("lifecycle", extra=(_NE, _T0, _WASTED, _SAMPLES, _spans_sql("smp", _ROW, "ts, seq", "label", AS_OF)))
    + f"""SELECT {_ROW}, span_no, label, start, "end", start - t0 AS start_rel, "end" - start AS duration FROM sp JOIN t0 USING (run_id)""",
    "telemetry_wasted": _ctes("lifecycle", extra=(_NE, _WASTED)) + "SELECT * FROM wasted",
    "telemetry_world_spans": _ctes("lifecycle", extra=(_T0, _WORLD)) + "SELECT * FROM wsp",
    "telemetry_degraded": _ctes("lifecycle", extra=(_T0, _WORLD, _DEGRADED)) + "SELECT * FROM dw",
    "telemetry_degraded_summary": _ctes("lifecycle", extra=(_T0, _WORLD, _DEGRADED))
    + """SELECT b.run_id, b.full_world, b.current, coalesce(x.total, 0.0) AS total, coalesce(x.windows, 0) AS windows
         FROM (SELECT run_id, max(world) AS full_world, last(world ORDER BY start, span_no) AS current FROM wsp GROUP BY 1) b
         LEFT JOIN (SELECT run_id, sum(duration) AS total, count(*) AS windows FROM dw GROUP BY 1) x USING (run_id)""",
    "telemetry_leaders": with_views(
        """SELECT run_id, ts, event_id, leader FROM (
             SELECT run_id, ts, event_id, CAST(leader AS INTEGER) AS leader,
                    lag(CAST(leader AS INTEGER)) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS pl
             FROM lifecycle WHERE state = 'epoch' AND world IS NOT NULL AND leader IS NOT NULL) x
           WHERE pl IS NULL OR pl <> leader""",
        "lifecycle",
    ),
    "telemetry_leader_rows": _ctes("lifecycle", extra=(_NE, _WASTED, _SAMPLES))
    + """, h AS (SELECT run_id, ts, leader AS node FROM (
             SELECT run_id, ts, event_id, CAST(leader AS INTEGER) AS leader,
                    lag(CAST(leader AS INTEGER)) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS pl
             FROM lifecycle WHERE state = 'epoch' AND world IS NOT NULL AND leader IS NOT NULL) x WHERE pl IS NULL OR pl <> leader),
         st AS (SELECT run_id, node, attempt, min(ts) AS first_ts FROM smp GROUP BY ALL)
         SELECT h.run_id, h.ts, h.node,
                coalesce((SELECT max(attempt) FROM st WHERE st.run_id = h.run_id AND st.node = h.node AND st.first_ts <= h.ts),
                         (SELECT min(attempt) FROM st WHERE st.run_id = h.run_id AND st.node = h.node), 0) AS attempt
         FROM h""",
    "telemetry_current_leader": with_views(
        f"""SELECT run_id, last(leader ORDER BY ts, event_id) AS leader FROM (
             SELECT run_id, ts, event_id, CAST(leader AS INTEGER) AS leader,
                    lag(CAST(leader AS INTEGER)) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS pl
             FROM lifecycle WHERE state = 'epoch' AND world IS NOT NULL AND leader IS NOT NULL) x
           WHERE (pl IS NULL OR pl <> leader) AND ts <= {AS_OF - 86400 * 7} GROUP BY run_id""",
        "lifecycle",
    ),
    "telemetry_markers": _ctes("lifecycle", extra=(_NE,))
    + f"""SELECT {_ROW}, ts, CASE WHEN state = 'reconfiguring' THEN 'realized' ELSE 'kill' END AS marker
          FROM ne WHERE state IN ('reconfiguring', 'killed', 'down')""",
    "telemetry_epoch_timeline": _ctes("ticks", "epoch_log", extra=(_TL,))
    + "SELECT run_id, t, event_id, epoch, array_to_string(members, ',') AS members, master FROM tl",
    "telemetry_member_changes": _ctes("ticks", "epoch_log", extra=(_TL,)) + "SELECT * FROM changes",
    "telemetry_survivors": _ctes("ticks", "epoch_log", extra=(_TL,))
    + """SELECT run_id, t, epoch, array_to_string(list_filter(members, lambda x: list_contains(pm, x)), ',') AS survivors
         FROM chg0 WHERE pm IS NOT NULL""",
    "telemetry_world_rows": _ctes("ticks", "epoch_log", "steps", extra=(_TL,))
    + f""", launch AS (SELECT r.run_id, coalesce(ft, fs) AS launch FROM (SELECT DISTINCT run_id FROM ticks) r
               LEFT JOIN (SELECT run_id, min(t) AS ft FROM ticks GROUP BY 1) a USING (run_id)
               LEFT JOIN (SELECT run_id, min(t) AS fs FROM steps GROUP BY 1) b USING (run_id)),
          bd AS (SELECT run_id, min(t) AS first_t, max(t) AS last_t, last(len(members) ORDER BY t, event_id) AS lastn FROM tl GROUP BY 1),
          rows_ AS (
            SELECT l.run_id, l.launch AS t, 0 AS n FROM launch l LEFT JOIN bd USING (run_id) WHERE bd.first_t IS NULL OR l.launch < bd.first_t
            UNION ALL SELECT run_id, t, len(members) FROM tl
            UNION ALL SELECT l.run_id, {AS_OF}, coalesce(bd.lastn, 0) FROM launch l LEFT JOIN bd USING (run_id)
                      WHERE {AS_OF} > coalesce(bd.last_t, l.launch))
          SELECT run_id, CAST(floor(t * 1000) AS BIGINT) AS time, CAST(n AS INTEGER) AS nodes_training,
                 CAST(CASE WHEN n < {TARGET} THEN 1 ELSE 0 END AS INTEGER) AS below_full_world FROM rows_""",
    "telemetry_degraded_regions": _ctes("ticks", "epoch_log", extra=(_TL,))
    + f""", r1 AS (SELECT *, len(members) < {TARGET} AS short, lead(t) OVER (PARTITION BY run_id ORDER BY t, event_id) AS nx FROM tl),
          r1b AS (SELECT *, CASE WHEN short IS NOT DISTINCT FROM lag(short) OVER (PARTITION BY run_id ORDER BY t, event_id)
                                 AND row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) > 1 THEN 0 ELSE 1 END AS chg FROM r1),
          r2 AS (SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM r1b),
          lastt AS (SELECT run_id, max(t) AS last_t FROM tl GROUP BY 1)
          SELECT run_id, CAST(floor(min(t) * 1000) AS BIGINT) AS time,
                 CAST(floor(coalesce(last(nx ORDER BY t, event_id), max(last_t)) * 1000) AS BIGINT) AS timeEnd, 'degraded' AS title
          FROM r2 JOIN lastt USING (run_id) WHERE short GROUP BY run_id, grp""",
    "telemetry_kill_times": with_views(
        """SELECT p.run_id, p.ordinal, p.node, p.instance_id, k.ts FROM
             (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos, instance_id) AS ordinal FROM
                (SELECT run_id, node, instance_id, min(pos) AS pos FROM terminations GROUP BY ALL) d) p
           JOIN (SELECT run_id, ts, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS ordinal
                 FROM lifecycle WHERE state IN ('killed', 'down')) k USING (run_id, ordinal)""",
        "terminations", "lifecycle",
    ),
    "telemetry_outages": _ctes("ticks", extra=(_GAPS,))
    + """SELECT run_id, CAST(floor(start * 1000) AS BIGINT) AS time, CAST(floor("end" * 1000) AS BIGINT) AS timeEnd,
                'control plane down' AS title, gap_s AS seconds FROM gaps""",
    "telemetry_cost_ledger": with_views(
        f"""SELECT run_id, instance_id, hourly_usd, started_at, stopped_at,
              greatest(0.0, coalesce(stopped_at, {AS_OF}) - started_at) AS billed_seconds,
              CASE WHEN hourly_usd IS NOT NULL THEN greatest(0.0, coalesce(stopped_at, {AS_OF}) - started_at) * hourly_usd / 3600.0 END AS usd
            FROM ledger""",
        "ledger",
    ),
    "telemetry_cost_totals": with_views(
        f"""SELECT run_id, count(*) AS instances,
              {_r(f"coalesce(sum(CASE WHEN hourly_usd IS NOT NULL THEN greatest(0.0, least(coalesce(stopped_at, {AS_OF}), {AS_OF}) - started_at) * hourly_usd / 3600.0 END), 0.0)", 6)} AS total_usd,
              count(*) FILTER (WHERE hourly_usd IS NULL) AS rate_unknown_count
            FROM ledger GROUP BY run_id""",
        "ledger",
    ),
    "telemetry_observed_instances": with_views(
        f"""SELECT run_id, instance_id, min(t) AS start,
              CASE WHEN last(coalesce(aws_state, 'running') IN ('pending', 'running') ORDER BY t, event_id)
                   THEN greatest(coalesce(max(t) FILTER (WHERE coalesce(aws_state, 'running') IN ('pending', 'running')), min(t)), {AS_OF})
                   ELSE coalesce(max(t) FILTER (WHERE coalesce(aws_state, 'running') IN ('pending', 'running')), min(t)) END AS "end",
              last(coalesce(aws_state, 'running') IN ('pending', 'running') ORDER BY t, event_id) AS billable
            FROM (SELECT n.*, t2.event_id FROM tick_nodes n JOIN (SELECT run_id, t, event_id FROM ticks) t2 USING (run_id, t)) x
            WHERE instance_id IS NOT NULL AND instance_id <> '' GROUP BY ALL""",
        "tick_nodes", "ticks",
    ),
    "telemetry_cost_curve": with_views(
        f"""SELECT run_id, t, {_r(_cost('p.t', 'p.run_id', f'coalesce(stopped_at, {AS_OF})'), 6)} AS usd
            FROM (SELECT DISTINCT run_id, t FROM (SELECT run_id, started_at AS t FROM ledger
                                                  UNION ALL SELECT run_id, coalesce(stopped_at, {AS_OF}) FROM ledger)) p""",
        "ledger",
    ),
    "telemetry_run_series": _ctes("steps", "ticks", "epoch_log", "ledger", extra=(_TL, _GAPS, _SERIES))
    + f"""SELECT run_id, CAST(floor(t * 1000) AS BIGINT) AS time, durable_step, step AS current_step, furthest_step,
              greatest(0, step - durable_step) AS steps_at_risk, {_r('loss', 4)} AS train_loss,
              {_r(f'step * {D.TOKENS_PER_STEP} / 1e9', 6)} AS tokens_b, nodes_training, nodes_lost, replacements,
              CAST(CASE WHEN nodes_training < {TARGET} THEN 1 ELSE 0 END AS INTEGER) AS below_full_world,
              CASE WHEN nodes_training < {TARGET} THEN furthest_step END AS degraded_band,
              CASE WHEN t - t0 > 0 THEN {_r('least(t - t0, trained) / (t - t0)', 4)} END AS goodput,
              ms AS ms_per_step, win[len(win) // 2 + 1] AS ms_per_step_typical, 0 AS whole_group_restarts,
              {_r('usd_raw', 4)} AS usd, CASE WHEN step <> 0 THEN {_r('usd_raw / step * 1000', 4)} END AS usd_per_1k,
              supervisor_up
          FROM j2""",
    "telemetry_boot_rows": _ctes("steps", "ticks", "epoch_log", "ledger", extra=(_TL, _GAPS))
    + f""", fs AS (SELECT run_id, min(t) AS first_t FROM steps GROUP BY 1),
          b AS (SELECT k.* FROM ticks k LEFT JOIN fs USING (run_id) WHERE fs.first_t IS NULL OR k.t < fs.first_t)
          SELECT run_id, CAST(floor(t * 1000) AS BIGINT) AS time, greatest(ckpt_step, 0) AS durable_step, CAST(NULL AS BIGINT) AS current_step,
                 CAST(0 AS BIGINT) AS furthest_step, CAST(0 AS BIGINT) AS steps_at_risk, CAST(NULL AS DOUBLE) AS train_loss, CAST(0.0 AS DOUBLE) AS tokens_b,
                 len(members) AS nodes_training, {_cnt('lost', 'b.t', 'b.run_id')} AS nodes_lost,
                 {_cnt('joined', 'b.t', 'b.run_id')} AS replacements,
                 CAST(CASE WHEN len(members) < {TARGET} THEN 1 ELSE 0 END AS INTEGER) AS below_full_world,
                 CAST(NULL AS BIGINT) AS degraded_band, CAST(NULL AS DOUBLE) AS goodput, CAST(NULL AS INTEGER) AS ms_per_step,
                 CAST(NULL AS INTEGER) AS ms_per_step_typical, 0 AS whole_group_restarts,
                 {_r(_cost('b.t', 'b.run_id'), 4)} AS usd, CAST(NULL AS DOUBLE) AS usd_per_1k, {_up('b.t', 'b.run_id')} AS supervisor_up
          FROM b""",
    "telemetry_eval_points": with_views(
        """SELECT e.run_id, e.step, e.loss,
              CASE WHEN lo.x IS NULL THEN en.first_t WHEN hi.x IS NULL THEN en.last_t WHEN hi.x = lo.x THEN lo.y
                   ELSE lo.y + (hi.y - lo.y) * (e.step - lo.x) / (hi.x - lo.x) END AS t
           FROM (SELECT DISTINCT run_id, step, loss FROM evals) e
           LEFT JOIN LATERAL (SELECT k.step AS x, k.t AS y FROM (SELECT run_id, step, max(t) AS t FROM steps GROUP BY ALL) k
                              WHERE k.run_id = e.run_id AND k.step <= e.step ORDER BY k.step DESC LIMIT 1) lo ON true
           LEFT JOIN LATERAL (SELECT k.step AS x, k.t AS y FROM (SELECT run_id, step, max(t) AS t FROM steps GROUP BY ALL) k
                              WHERE k.run_id = e.run_id AND k.step > e.step ORDER BY k.step LIMIT 1) hi ON true
           LEFT JOIN (SELECT run_id, first(t ORDER BY step) AS first_t, last(t ORDER BY step) AS last_t
                      FROM (SELECT run_id, step, max(t) AS t FROM steps GROUP BY ALL) k GROUP BY 1) en ON en.run_id = e.run_id""",
        "evals", "steps",
    ),
}

_RANK = """known AS (SELECT run_id, step, max(t) AS t FROM steps GROUP BY ALL),
placed AS (SELECT r.event_id, r.run_id, r.slot, r.gen, r.step,
             CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y
                  WHEN abs(hi.x - r.step) < abs(r.step - lo.x) THEN hi.y ELSE lo.y END AS t
           FROM rank_lines r
           LEFT JOIN LATERAL (SELECT k.step AS x, k.t AS y FROM known k WHERE k.run_id = r.run_id AND k.step <= r.step
                              ORDER BY k.step DESC LIMIT 1) lo ON true
           LEFT JOIN LATERAL (SELECT k.step AS x, k.t AS y FROM known k WHERE k.run_id = r.run_id AND k.step > r.step
                              ORDER BY k.step LIMIT 1) hi ON true
           WHERE r.t IS NULL
           UNION ALL SELECT event_id, run_id, slot, gen, step, t FROM rank_lines WHERE t IS NOT NULL)"""

ORACLE["telemetry_rank_times"] = _ctes("rank_lines", "steps", extra=(_RANK,)) + "SELECT * FROM placed"
ORACLE["telemetry_generation_spans"] = _ctes("rank_lines", "steps", extra=(_RANK,)) + """
, g AS (SELECT run_id, slot, gen, min(t) AS start0, max(t) AS end0 FROM placed WHERE t IS NOT NULL GROUP BY ALL),
g2 AS (SELECT *, max(end0) OVER (PARTITION BY run_id, slot ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM g)
SELECT run_id, slot, gen, 'node' || CAST(slot AS VARCHAR) || CASE WHEN gen > 0 THEN '-r' || CAST(gen AS VARCHAR) ELSE '' END AS name,
       greatest(start0, coalesce(prev_end, start0)) AS start,
       greatest(greatest(start0, coalesce(prev_end, start0)), end0, coalesce(prev_end, start0)) AS "end",
       row_number() OVER (PARTITION BY run_id ORDER BY slot, gen) AS row
FROM g2"""


def q_occupancy(spark, sf):
    ticks = D.tick_docs(spark, sf)
    return T.occupancy(_timeline(spark, sf), ticks, D.instance_ledger(spark, sf), TARGET)


QUERIES["telemetry_occupancy"] = q_occupancy

# the recursion walks a run's down periods, slots ascending, and keeps the machines it used
_OCC = f"""box AS (SELECT k.run_id, k.t, k.event_id, coalesce(b.boxed, []::INTEGER[]) AS boxed FROM ticks k LEFT JOIN
         (SELECT run_id, t, list_sort(list(DISTINCT CAST(node AS INTEGER))) AS boxed FROM tick_nodes
          WHERE aws_state IN ('pending', 'running') GROUP BY ALL) b USING (run_id, t)),
ep AS (SELECT run_id, min(t) AS first_epoch FROM tl GROUP BY 1),
boot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) AS rn FROM box)
         LEFT JOIN ep USING (run_id) WHERE rn = 1 AND (first_epoch IS NULL OR t < first_epoch)),
base AS (SELECT run_id, t, event_id, s.slot, CASE WHEN list_contains(boxed, s.slot) THEN 'provisioning' ELSE 'down' END AS state
         FROM boot, (SELECT CAST(i AS INTEGER) AS slot FROM range(0, {TARGET}) r(i)) s
         UNION ALL SELECT run_id, t, event_id, s.slot, CASE WHEN NOT list_contains(members, s.slot) THEN 'down'
                          WHEN s.slot = master THEN 'leader' ELSE 'training' END
         FROM tl, (SELECT CAST(i AS INTEGER) AS slot FROM range(0, {TARGET}) r(i)) s),
base1 AS (SELECT *, lead(t) OVER w AS nt, sum(CASE WHEN state = 'down' THEN 0 ELSE 1 END) OVER w AS ups FROM base
          WINDOW w AS (PARTITION BY run_id, slot ORDER BY t, event_id)),
per AS (SELECT run_id, slot, min(t) AS t_out, last(nt ORDER BY t, event_id) AS t_in FROM base1 WHERE state = 'down' GROUP BY run_id, slot, ups),
per1 AS (SELECT per.*, row_number() OVER (PARTITION BY run_id ORDER BY slot, t_out) AS n, first_epoch FROM per LEFT JOIN ep USING (run_id)),
mach AS (SELECT run_id, started_at, row_number() OVER (PARTITION BY run_id ORDER BY started_at, instance_id) AS k FROM ledger),
cand AS (SELECT p.run_id, p.n, list(m.k ORDER BY m.k) FILTER (m.k IS NOT NULL) AS ks FROM per1 p LEFT JOIN mach m ON m.run_id = p.run_id
         AND m.started_at >= p.t_out - 180 AND m.started_at < coalesce(p.t_in, 1e18) AND m.started_at > coalesce(p.first_epoch - 60, 0) GROUP BY ALL),
walk AS (SELECT run_id, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS used, CAST(NULL AS BIGINT) AS pick FROM (SELECT DISTINCT run_id FROM cand)
         UNION ALL SELECT run_id, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM
           (SELECT w.run_id, c.n, w.used, list_filter(c.ks, lambda x: NOT list_contains(w.used, x))[1] AS pick
            FROM walk w JOIN cand c ON c.run_id = w.run_id AND c.n = w.n + 1)),
prov AS (SELECT p.run_id, p.slot, greatest(m.started_at, p.t_out) AS a, coalesce(p.t_in, 'infinity'::DOUBLE) AS b
         FROM walk w JOIN per1 p ON p.run_id = w.run_id AND p.n = w.n JOIN mach m ON m.run_id = w.run_id AND m.k = w.pick),
moved AS (SELECT run_id, t FROM (SELECT run_id, t, boxed, lag(boxed) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pb FROM box)
          JOIN (SELECT run_id, min(t) AS tf FROM base GROUP BY 1) USING (run_id) WHERE pb IS NOT NULL AND pb <> boxed AND t >= tf),
tms AS (SELECT run_id, t FROM base UNION SELECT run_id, a FROM prov UNION SELECT run_id, t FROM moved),
lastbase AS (SELECT run_id, slot, t, last(state ORDER BY event_id) AS state FROM base GROUP BY ALL),
lastbox AS (SELECT run_id, t, last(boxed ORDER BY event_id) AS boxed FROM box GROUP BY ALL),
grid AS (SELECT run_id, t, CAST(i AS INTEGER) AS slot FROM tms, range(0, {TARGET}) r(i)),
g1 AS (SELECT g.run_id, g.slot, g.t, b.state FROM grid g ASOF LEFT JOIN lastbase b ON b.run_id = g.run_id AND b.slot = g.slot AND g.t >= b.t),
g2 AS (SELECT g.*, x.boxed FROM g1 g ASOF LEFT JOIN lastbox x ON x.run_id = g.run_id AND g.t >= x.t),
g3 AS (SELECT g.*, EXISTS (SELECT 1 FROM prov v WHERE v.run_id = g.run_id AND v.slot = g.slot AND v.a <= g.t AND g.t < v.b) AS inside FROM g2 g),
seen AS (SELECT run_id, t, list(CASE WHEN coalesce(state, 'down') = 'down' AND (inside OR coalesce(list_contains(boxed, slot), false)) THEN 'provisioning'
                                ELSE coalesce(state, 'down') END ORDER BY slot) AS slots FROM g3 GROUP BY ALL),
kept AS (SELECT *, lag(slots) OVER (PARTITION BY run_id ORDER BY t) AS ps FROM seen)"""
ORACLE["telemetry_occupancy"] = "WITH RECURSIVE" + _ctes("ticks", "tick_nodes", "epoch_log", "ledger", extra=(_TL, _OCC)).removeprefix("WITH") + (
    "SELECT run_id, CAST(floor(t * 1000) AS BIGINT) AS time, " + ", ".join(f"slots[{i + 1}] AS slot{i}" for i in range(TARGET))
    + " FROM kept WHERE ps IS NULL OR ps <> slots"
)
ORACLE["telemetry_series_table"] = (
    f"SELECT run_id, {', '.join(TS_COLUMNS)} FROM ({ORACLE['telemetry_run_series']}) s\n"
    f"UNION ALL SELECT run_id, {', '.join(TS_COLUMNS)} FROM ({ORACLE['telemetry_boot_rows']}) b"
)
