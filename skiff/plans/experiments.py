"""Registered experiment-analysis queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.operators import experiments as X
from skiff.operators import runs as R
from skiff.operators import timeline as T
from skiff.plans.telemetry import AS_OF
from skiff.plans.oracle_views import with_views
from skiff.sources import driver as D

TARGET_LOSS = 0.05
CAP_S = 3600


def _steps(spark, sf):
    return D.step_records(spark, sf)


def _vals(spark, sf):
    return D.eval_records(spark, sf).dropDuplicates(["run_id", "step", "loss"])


def _runs(df):
    no = F.substring_index("run_id", "-", -1).cast("int")
    return df.withColumn("nodes", X.run_nodes(F.col("run_id"))).withColumn("sweep", (no / 4).cast("int")).withColumn("label", F.col("run_id"))


def _marks(spark, sf):
    ev = D.lifecycle_records(spark, sf)
    ev_name = (
        F.when(F.col("state") == "killed", F.lit("kill"))
        .when((F.col("state") == "provisioning") & (F.col("attempt") > 0), F.lit("relaunch"))
        .when(F.col("state") == "training", F.lit("shrink_resume"))
        .when((F.col("state") == "epoch") & (F.col("world") == 8), F.lit("full_world"))
    )
    return ev.select("run_id", ev_name.alias("event"), F.col("ts").alias("t")).filter(F.col("event").isNotNull())


def q_ttt(spark, sf):
    return X.time_to_target(_steps(spark, sf), _vals(spark, sf), TARGET_LOSS)


def q_throughput(spark, sf):
    return X.throughput(_steps(spark, sf))


def q_speedup_target(spark, sf):
    return X.speedups(_runs(q_ttt(spark, sf)).withColumn("m", F.when(F.col("reached"), F.col("time_to_target_s"))), "m")


def q_speedup_throughput(spark, sf):
    return X.speedups(_runs(q_throughput(spark, sf)), "ms_per_step")


def q_control(spark, sf):
    return X.control_check(_runs(q_ttt(spark, sf)))


def q_hypothesis(spark, sf):
    r = _runs(q_ttt(spark, sf))
    pairs = r.select(
        F.col("sweep"), F.col("nodes"), F.col("label")
    )
    a = pairs.alias("a")
    b = pairs.alias("b")
    p = a.join(b, (F.col("a.sweep") == F.col("b.sweep")) & (F.col("a.nodes") == F.col("b.nodes") * 2)).select(
        F.concat(F.lit("sweep"), F.col("a.sweep").cast("string"), F.lit(": "), F.col("a.nodes").cast("string"), F.lit("n beats "),
                 F.col("b.nodes").cast("string"), F.lit("n")).alias("name"),
        F.col("a.label").alias("faster"), F.col("b.label").alias("slower"),
    )
    return X.hypothesis(r, p)


def q_preempt(spark, sf):
    return X.preempt_stats(_marks(spark, sf), _steps(spark, sf))


def q_sizing(spark, sf):
    return X.sizing(_steps(spark, sf), _vals(spark, sf), CAP_S)


def q_loss_fit(spark, sf):
    return X.loss_fit(_steps(spark, sf))


def q_stall_cycles(spark, sf):
    return X.stall_cycles(_steps(spark, sf))


def _budget(spark, sf):
    """Clean run ``2i`` is projected to the trained seconds of failure run ``2i+1``."""
    s = _steps(spark, sf)
    no = F.substring_index("run_id", "-", -1).cast("int")
    tr = s.groupBy("run_id").agg((F.sum("ms") / 1000.0).alias("budget_s"))
    return tr.filter(no % 2 == 1).select(F.concat(F.lit("run-"), (no - 1).cast("string")).alias("run_id"), "budget_s")


def q_projection(spark, sf):
    return X.clean_projection(_steps(spark, sf), _budget(spark, sf), _facts(spark, sf))


def _facts(spark, sf):
    """Cost facts of a run from its ledger: its machines, the first one's rate,
    the mean seconds billed beyond the run's training, and a fixed share outside it."""
    led = D.instance_ledger(spark, sf)
    billed = F.coalesce(F.col("stopped_at"), F.lit(AS_OF)) - F.col("started_at")
    f = led.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.avg(billed).alias("billed"), F.min_by("hourly_usd", F.struct("started_at", "instance_id")).alias("hourly_usd"))
    t = _steps(spark, sf).groupBy("run_id").agg((F.sum("ms") / 1000.0).alias("trained"))
    return f.join(t, "run_id").select("run_id", (F.col("nodes") * 10.0).alias("fixed_s"), (F.col("billed") - F.col("trained")).alias("overhead_s"), "nodes", "hourly_usd")


def q_ab(spark, sf):
    proj = q_projection(spark, sf).select(F.col("run_id").alias("clean_run"), "steps", F.col("budget_s").alias("trained_s"), "wall_s", "usd")
    s = _steps(spark, sf)
    no = F.substring_index("run_id", "-", -1).cast("int")
    kills = D.lifecycle_records(spark, sf).filter(F.col("state") == "killed").groupBy("run_id").agg(F.count(F.lit(1)).alias("kills"), F.countDistinct(F.floor(F.col("ts") / 3600)).alias("events"))
    cost = _facts(spark, sf).select("run_id", "fixed_s", (F.col("nodes") * F.col("overhead_s")).alias("extra"), "nodes", "hourly_usd")
    fail = s.groupBy("run_id").agg(F.max("step").cast("double").alias("steps"), (F.sum("ms") / 1000.0).alias("trained_s"))
    fail = fail.join(kills, on="run_id", how="left").join(cost, "run_id", "left").filter(no % 2 == 1)
    fail = fail.withColumn("wall_s", F.col("fixed_s") + F.col("trained_s"))
    fail = fail.withColumn("usd", (F.col("nodes") * F.col("wall_s") + F.col("extra")) * F.col("hourly_usd") / 3600)
    fail = fail.withColumn("clean_run", F.concat(F.lit("run-"), (F.substring_index("run_id", "-", -1).cast("int") - 1).cast("string")))
    return X.ab_compare(proj, fail.drop("run_id"), "clean_run", ["steps", "trained_s", "wall_s", "usd"])


def q_by_world(spark, sf):
    return X.by_world(_steps(spark, sf))


def q_transitions(spark, sf):
    return X.world_transitions(_steps(spark, sf))


PHASES = [*sorted(set(T.STATE_LABEL.values())), "wasted", "total"]


def q_comparison(spark, sf):
    """AG-52: steps, seconds per phase and dollars of every run."""
    summary = _steps(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("lines"), F.max("step").alias("last_step"))
    phases = q_durations(spark, sf).withColumnRenamed("label", "phase")
    return X.comparison_rows(summary, phases, R.cost_totals(D.instance_ledger(spark, sf), AS_OF), PHASES)


def q_utilisation(spark, sf):
    return X.utilisation(_steps(spark, sf))


def q_durations(spark, sf):
    return X.phase_durations(T.node_spans(D.lifecycle_records(spark, sf), 1_706_745_600.0))


def q_recipe(spark, sf):
    r = _runs(q_throughput(spark, sf))
    no = F.substring_index("run_id", "-", -1).cast("int")
    r = r.withColumn("pair", (no / 2).cast("int")).withColumn("dataset", F.lit("documents"))
    return X.recipe_guard(r, "pair", ["dataset", "nodes"])


def q_kill_drift(spark, sf):
    """The schedule is each node's stalls in order, what fired its kills: some planned kills never fire."""
    from skiff.operators.scan import scan

    def nth(state, name):
        k = D.lifecycle_records(spark, sf).filter(F.col("state") == state).withColumn("__one", F.lit(1))
        k = scan(k, ["run_id", "node"], "ts", ["event_id"], width=86400.0, sums={"ordinal": "__one"})
        return k.select("run_id", "node", "ordinal", F.col("ts").alias(name))

    return X.kill_drift(nth("stalled", "planned_t"), nth("killed", "fired_t"), tolerance_s=21_600.0)


QUERIES = {
    "exp_comparison_rows": q_comparison,
    "exp_time_to_target": q_ttt,
    "exp_throughput": q_throughput,
    "exp_speedup_target": q_speedup_target,
    "exp_speedup_throughput": q_speedup_throughput,
    "exp_control_check": q_control,
    "exp_hypothesis": q_hypothesis,
    "exp_preempt_stats": q_preempt,
    "exp_sizing": q_sizing,
    "exp_loss_fit": q_loss_fit,
    "exp_stall_cycles": q_stall_cycles,
    "exp_clean_projection": q_projection,
    "exp_ab_compare": q_ab,
    "exp_by_world": q_by_world,
    "exp_world_transitions": q_transitions,
    "exp_utilisation": q_utilisation,
    "exp_phase_durations": q_durations,
    "exp_recipe_guard": q_recipe,
    "exp_kill_drift": q_kill_drift,
}

# ------------------------------------------------------------------ SQL --


def _ctes(*views, extra=()):
    base = with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]
    return base + "".join(",\n" + e for e in extra) + "\n"


_VALS = "vals AS (SELECT DISTINCT run_id, step, loss FROM evals)"
_TTT = f"""ttt0 AS (SELECT s.run_id, s.first_t, s.last_t,
           (SELECT first({{'step': step, 'loss': loss}} ORDER BY step, loss) FROM vals v WHERE v.run_id = s.run_id AND loss <= {TARGET_LOSS}) AS hit,
           (SELECT first(loss ORDER BY loss, step) FROM vals v WHERE v.run_id = s.run_id) AS best_val,
           (SELECT max(step) FROM vals v WHERE v.run_id = s.run_id) AS last_step
         FROM (SELECT run_id, min(t) AS first_t, max(t) AS last_t FROM steps GROUP BY 1) s
         WHERE s.run_id IN (SELECT run_id FROM vals)),
ttt AS (SELECT run_id, hit IS NOT NULL AS reached, CAST({TARGET_LOSS} AS DOUBLE) AS target,
          CASE WHEN hit IS NOT NULL THEN hit.step END AS target_step, CASE WHEN hit IS NOT NULL THEN hit.loss END AS hit_val,
          CASE WHEN hit IS NOT NULL THEN coalesce((SELECT min(t) FROM steps x WHERE x.run_id = ttt0.run_id AND x.step >= hit.step), last_t) - first_t END AS time_to_target_s,
          last_t - first_t AS total_train_s,
          CASE WHEN hit IS NULL THEN best_val END AS best_val, CASE WHEN hit IS NULL THEN last_step END AS last_step
        FROM ttt0)"""
_RUNS = "CAST(pow(2, CAST(split_part(run_id, '-', 2) AS INTEGER) % 4) AS INTEGER) AS nodes, CAST(CAST(split_part(run_id, '-', 2) AS INTEGER) // 4 AS INTEGER) AS sweep"
_TP = """tp AS (SELECT o.run_id, o.tok_per_s, o.run_time_s, m.ms_per_step FROM
          (SELECT run_id, CAST(floor(avg(tok_s) FILTER (WHERE tok_s IS NOT NULL AND tok_s <> 0)) AS BIGINT) AS tok_per_s,
                  CASE WHEN count(*) >= 2 THEN max(t) - min(t) END AS run_time_s FROM steps GROUP BY 1) o
          LEFT JOIN (SELECT run_id, CASE WHEN len(core) > 0 THEN list_avg(core) ELSE list_avg(l) END AS ms_per_step FROM
                      (SELECT run_id, l, l[len(l) // 4 + 1 : len(l) - len(l) // 4] AS core FROM
                        (SELECT run_id, list_sort(list(CAST(ms AS DOUBLE))) AS l FROM steps WHERE ms IS NOT NULL AND ms <> 0 GROUP BY 1) a) b) m USING (run_id))"""


def _speed(src, metric):
    return f"""SELECT r.sweep, r.nodes, r.run_id, r.m AS metric, b.base_n,
                  CASE WHEN r.m IS NOT NULL AND b.base_m IS NOT NULL THEN CASE WHEN r.m > 0 THEN b.base_m / r.m ELSE 'inf'::DOUBLE END END AS speedup,
                  CASE WHEN r.m IS NOT NULL AND b.base_m IS NOT NULL THEN CASE WHEN r.m > 0 THEN b.base_m / r.m ELSE 'inf'::DOUBLE END / (r.nodes / b.base_n) * 100 END AS efficiency_pct
           FROM (SELECT *, {_RUNS}, {metric} AS m FROM {src}) r
           JOIN (SELECT sweep, first(nodes ORDER BY nodes) AS base_n, first(m ORDER BY nodes) AS base_m
                 FROM (SELECT *, {_RUNS}, {metric} AS m FROM {src}) q GROUP BY sweep) b USING (sweep)"""


_MED = """med AS (SELECT run_id, median(ms) AS med FROM steps GROUP BY 1)"""
_IDX = """si AS (SELECT s.*, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) AS idx FROM steps s)"""
_CYC = f"""st AS (SELECT si.*, m.med FROM si JOIN med m USING (run_id) WHERE ms > m.med * {X.STALL_FACTOR} AND idx > 1),
st2 AS (SELECT *, CASE WHEN lag(idx) OVER (PARTITION BY run_id ORDER BY idx) IS NULL
                       OR idx - lag(idx) OVER (PARTITION BY run_id ORDER BY idx) > {X.STALL_GAP} THEN 1 ELSE 0 END AS nw FROM st),
st3 AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cycle FROM st2),
cyc AS (SELECT run_id, cycle, min(idx) AS start_idx, sum((ms - med) / 1000.0) AS excess_s, count(*) AS stalls FROM st3 GROUP BY 1, 2)"""
_PROJ = f"""budget AS (SELECT 'run-' || CAST(CAST(split_part(run_id, '-', 2) AS INTEGER) - 1 AS VARCHAR) AS run_id, sum(ms) / 1000.0 AS budget_s
           FROM steps WHERE CAST(split_part(run_id, '-', 2) AS INTEGER) % 2 = 1 GROUP BY steps.run_id),
base AS (SELECT si.run_id, avg(ms) FILTER (WHERE ms <= m.med * {X.STALL_FACTOR}) / 1000.0 AS steady_s,
           (first(ms ORDER BY idx) - first(m.med)) / 1000.0 AS warmup_s, count(*) AS n, sum(ms) / 1000.0 AS sum_s
         FROM si JOIN med m USING (run_id) GROUP BY 1),
per AS (SELECT run_id, avg(excess_s) AS cycle_excess_s, avg(start_idx - ps) AS cycle_period_steps FROM
          (SELECT *, lag(start_idx) OVER (PARTITION BY run_id ORDER BY cycle) AS ps FROM cyc) x GROUP BY 1),
pj AS (SELECT b.run_id, g.budget_s, steady_s, warmup_s, cycle_excess_s, cycle_period_steps,
          steady_s + cycle_excess_s / cycle_period_steps AS amortised_s, n, sum_s
       FROM base b LEFT JOIN per USING (run_id) JOIN budget g USING (run_id)),
proj AS (SELECT run_id, budget_s, steady_s, warmup_s, cycle_excess_s, cycle_period_steps, amortised_s,
           (budget_s - warmup_s) / amortised_s AS steps_model, budget_s * (n / sum_s) AS steps_naive,
           ((budget_s - warmup_s) / amortised_s + budget_s * (n / sum_s)) / 2 AS steps,
           abs((budget_s - warmup_s) / amortised_s - budget_s * (n / sum_s)) / ((budget_s - warmup_s) / amortised_s) * 100 AS spread_pct
         FROM pj),
facts AS (SELECT l.run_id, n * 10.0::DOUBLE AS fixed_s, billed - trained AS overhead_s, n AS nodes, rate AS hourly_usd
          FROM (SELECT run_id, count(*) AS n, avg(coalesce(stopped_at, {AS_OF}) - started_at) AS billed, first(hourly_usd ORDER BY started_at, instance_id) AS rate FROM ledger GROUP BY 1) l
          JOIN (SELECT run_id, sum(ms) / 1000.0 AS trained FROM steps GROUP BY 1) USING (run_id)),
full_proj AS (SELECT p.*, fixed_s, fixed_s + budget_s AS wall_s, nodes * (fixed_s + budget_s + overhead_s) AS instance_s, nodes * (fixed_s + budget_s + overhead_s) * hourly_usd / 3600 AS usd
              FROM proj p LEFT JOIN facts USING (run_id))"""

ORACLE = {
    "exp_time_to_target": _ctes("steps", "evals", extra=(_VALS, _TTT)) + "SELECT * FROM ttt",
    "exp_throughput": _ctes("steps", extra=(_TP,)) + "SELECT * FROM tp",
    "exp_speedup_target": _ctes("steps", "evals", extra=(_VALS, _TTT)) + _speed("ttt", "CASE WHEN reached THEN time_to_target_s END"),
    "exp_speedup_throughput": _ctes("steps", extra=(_TP,)) + _speed("tp", "ms_per_step"),
    "exp_control_check": _ctes("steps", "evals", extra=(_VALS, _TTT))
    + f"""SELECT sweep, count(DISTINCT target_step) AS distinct_steps, count(DISTINCT target_step) <= 1 AS control_ok
          FROM (SELECT *, {_RUNS} FROM ttt) r WHERE reached AND target_step IS NOT NULL AND target_step <> 0 GROUP BY sweep""",
    "exp_hypothesis": _ctes("steps", "evals", extra=(_VALS, _TTT))
    + f""", r AS (SELECT *, {_RUNS}, run_id AS label, CASE WHEN reached THEN time_to_target_s END AS tt FROM ttt),
          p AS (SELECT 'sweep' || CAST(a.sweep AS VARCHAR) || ': ' || CAST(a.nodes AS VARCHAR) || 'n beats ' || CAST(b.nodes AS VARCHAR) || 'n' AS name,
                       a.label AS faster, b.label AS slower, a.tt AS a, b.tt AS b
                FROM r a JOIN r b ON a.sweep = b.sweep AND a.nodes = b.nodes * 2)
          SELECT name, faster, slower, a, b,
                 CASE WHEN a IS NULL OR b IS NULL THEN 'INCONCLUSIVE' WHEN a < b THEN 'TRUE' ELSE 'FALSE' END AS verdict,
                 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a <> 0 THEN b / a ELSE 'inf'::DOUBLE END END AS ratio FROM p""",
    "exp_preempt_stats": _ctes("steps", "lifecycle")
    + """, mk AS (SELECT run_id, CASE WHEN state = 'killed' THEN 'kill' WHEN state = 'provisioning' AND attempt > 0 THEN 'relaunch'
                                  WHEN state = 'training' THEN 'shrink_resume' WHEN state = 'epoch' AND world = 8 THEN 'full_world' END AS event, ts AS t
                  FROM lifecycle),
          f AS (SELECT run_id, min(t) FILTER (WHERE event = 'kill') AS kill, min(t) FILTER (WHERE event = 'shrink_resume') AS sr,
                       min(t) FILTER (WHERE event = 'full_world') AS fw, count(*) FILTER (WHERE event = 'kill') AS killed
                FROM mk WHERE event IS NOT NULL GROUP BY 1),
          mw AS (SELECT run_id, min(ws) AS min_world FROM steps WHERE ws IS NOT NULL AND ws <> 0 GROUP BY 1)
          SELECT coalesce(f.run_id, mw.run_id) AS run_id, coalesce(killed, 0) AS killed, min_world, fw - kill AS recovery_s, fw - sr AS degraded_s
          FROM f FULL JOIN mw ON f.run_id = mw.run_id""",
    "exp_sizing": _ctes("steps", "evals", extra=(_VALS,))
    + f""", a AS (SELECT run_id, list_sort(list(CAST(ms AS DOUBLE))) AS l, avg(tok_s) AS tok, last(ms ORDER BY step) AS last_ms
                FROM steps WHERE ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
          b AS (SELECT run_id, coalesce(CASE WHEN len(l[len(l) // 4 + 1 : len(l) - greatest(1, len(l) // 4)]) > 0
                                             THEN list_avg(l[len(l) // 4 + 1 : len(l) - greatest(1, len(l) // 4)]) END, CAST(last_ms AS DOUBLE)) AS ms, tok FROM a),
          c AS (SELECT run_id, ms AS ms_per_step_1gpu, CASE WHEN ms > 0 THEN 1000.0 / ms ELSE 0.0 END AS sps, tok FROM b),
          vf AS (SELECT run_id, step, loss, ln(CAST(greatest(1, step) AS DOUBLE)) AS lx FROM vals),
          fit0 AS (SELECT run_id, count(*) AS nv, avg(lx) AS mx, avg(loss) AS my, max(step) AS lv, last(loss ORDER BY step) AS probe_last_val FROM vf GROUP BY 1),
          fit AS (SELECT f.*, sum((lx - mx) * (loss - my)) / CASE WHEN sum((lx - mx) * (lx - mx)) <> 0 THEN sum((lx - mx) * (lx - mx)) ELSE 1.0 END AS bb
                  FROM fit0 f JOIN vf USING (run_id) GROUP BY ALL)
          SELECT c.run_id, ms_per_step_1gpu, sps AS steps_per_s_1gpu, CAST(floor(tok) AS BIGINT) AS tok_per_s_1gpu,
                 CAST(floor(sps * 1 * {X.SIZING_HAIRCUT} * {CAP_S}) AS BIGINT) AS proj_steps_1,
                 CAST(floor(sps * 2 * {X.SIZING_HAIRCUT} * {CAP_S}) AS BIGINT) AS proj_steps_2,
                 CAST(floor(sps * 4 * {X.SIZING_HAIRCUT} * {CAP_S}) AS BIGINT) AS proj_steps_4,
                 probe_last_val,
                 CASE WHEN nv >= 3 THEN (my - bb * mx) + bb * ln(CAST(greatest(1, greatest(lv * 2, floor(floor(sps * 2 * {X.SIZING_HAIRCUT} * {CAP_S}) / 2))) AS DOUBLE)) END AS suggested_target_loss
          FROM c LEFT JOIN fit USING (run_id)""",
    "exp_loss_fit": _ctes("steps")
    + """, p AS (SELECT run_id, step, loss, ln(CAST(step AS DOUBLE)) AS lx FROM steps WHERE loss IS NOT NULL AND step > 0),
          tl AS (SELECT p.* FROM p JOIN (SELECT run_id, max(step) AS last FROM p GROUP BY 1) m USING (run_id) WHERE step >= 0.4 * last),
          s AS (SELECT run_id, count(*) AS n, sum(lx) AS sx, sum(loss) AS sy, sum(lx * lx) AS sxx, sum(lx * loss) AS sxy FROM tl GROUP BY 1),
          f AS (SELECT run_id, n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sy, sx FROM s),
          f2 AS (SELECT run_id, n, b, (sy - b * sx) / n AS a FROM f)
          SELECT f2.run_id, f2.n, f2.a, f2.b, max(abs(tl.loss - (f2.a + f2.b * tl.lx))) AS max_resid FROM f2 JOIN tl USING (run_id) GROUP BY ALL""",
    "exp_stall_cycles": _ctes("steps", extra=(_MED, _IDX, _CYC)) + "SELECT * FROM cyc",
    "exp_clean_projection": _ctes("steps", "ledger", extra=(_MED, _IDX, _CYC, _PROJ)) + "SELECT * FROM full_proj",
    "exp_ab_compare": _ctes("steps", "lifecycle", "ledger", extra=(_MED, _IDX, _CYC, _PROJ))
    + """, fl AS (SELECT 'run-' || CAST(CAST(split_part(s.run_id, '-', 2) AS INTEGER) - 1 AS VARCHAR) AS clean_run,
                       CAST(max(step) AS DOUBLE) AS steps, sum(ms) / 1000.0 AS trained_s, any_value(k.kills) AS kills, any_value(k.events) AS events,
                       any_value(c.fixed_s) + sum(ms) / 1000.0 AS wall_s,
                       any_value(c.nodes) * (any_value(c.fixed_s) + sum(ms) / 1000.0 + any_value(c.overhead_s)) * any_value(c.hourly_usd) / 3600 AS usd
                FROM steps s LEFT JOIN (SELECT run_id, count(*) AS kills, count(DISTINCT floor(ts / 3600)) AS events FROM lifecycle WHERE state = 'killed' GROUP BY 1) k USING (run_id)
                LEFT JOIN facts c USING (run_id)
                WHERE CAST(split_part(s.run_id, '-', 2) AS INTEGER) % 2 = 1 GROUP BY s.run_id),
          rows_ AS (SELECT p.run_id AS clean_run, 'steps' AS metric, p.steps AS clean, f.steps AS failure, f.kills, f.events FROM proj p JOIN fl f ON f.clean_run = p.run_id
                    UNION ALL
                    SELECT p.run_id, 'trained_s', p.budget_s, f.trained_s, f.kills, f.events FROM proj p JOIN fl f ON f.clean_run = p.run_id
                    UNION ALL SELECT p.run_id, 'wall_s', p.wall_s, f.wall_s, f.kills, f.events FROM full_proj p JOIN fl f ON f.clean_run = p.run_id
                    UNION ALL SELECT p.run_id, 'usd', p.usd, f.usd, f.kills, f.events FROM full_proj p JOIN fl f ON f.clean_run = p.run_id)
          SELECT clean_run, metric, clean, failure, failure - clean AS delta,
                 CASE WHEN clean <> 0 THEN (failure - clean) / clean * 100 END AS delta_pct,
                 CASE WHEN kills > 0 THEN (failure - clean) / kills END AS per_kill, CASE WHEN events > 0 THEN (failure - clean) / events END AS per_event FROM rows_""",
    "exp_by_world": _ctes("steps")
    + """, w AS (SELECT run_id, ws, count(*) AS steps, median(ms) AS median_ms FROM steps WHERE ws IS NOT NULL AND ws > 0 GROUP BY 1, 2)
          SELECT w.*, t.top / median_ms AS rate_vs_full FROM w JOIN (SELECT run_id, first(median_ms ORDER BY ws DESC) AS top FROM w GROUP BY 1) t USING (run_id)""",
    "exp_world_transitions": _ctes("steps")
    + """, s AS (SELECT *, lag(ws) OVER w AS pws, lag(t) OVER w AS pt, lag(step) OVER w AS pstep
                 FROM steps WHERE ws > 0 WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id))
          SELECT run_id, pws AS from_ws, ws AS to_ws, t, t - pt AS gap_s, step - pstep AS gap_steps FROM s WHERE pws IS NOT NULL AND pws <> ws""",
    "exp_utilisation": _ctes("steps", extra=(_MED,))
    + """, g AS (SELECT s.run_id, sum(ms) / 1000.0 AS busy_s, max(t) - min(t) AS elapsed_s, sum(greatest(ms - m.med, 0.0)) / 1000.0 AS stall_s, count(*) AS n
                 FROM steps s JOIN med m USING (run_id) GROUP BY 1)
          SELECT run_id, busy_s, elapsed_s, CASE WHEN elapsed_s > 0 THEN busy_s / elapsed_s END AS utilisation, stall_s,
                 stall_s / n AS stall_per_step_s, CASE WHEN busy_s > 0 THEN stall_s / busy_s END AS stall_share FROM g""",
    "exp_recipe_guard": _ctes("steps")
    + f"""SELECT pair, count(DISTINCT ('documents', nodes)) AS recipes, count(DISTINCT ('documents', nodes)) = 1 AS comparable
          FROM (SELECT DISTINCT run_id, CAST(CAST(split_part(run_id, '-', 2) AS INTEGER) // 2 AS INTEGER) AS pair, {_RUNS} FROM steps) r GROUP BY pair""",
    "exp_kill_drift": _ctes("lifecycle")
    + """, k AS (SELECT run_id, node, ts, state, row_number() OVER (PARTITION BY run_id, node, state ORDER BY ts, event_id) AS ordinal
                 FROM lifecycle WHERE state IN ('stalled', 'killed'))
          SELECT p.run_id, p.node, p.ordinal, p.ts AS planned_t, f.ts AS fired_t, f.ts - p.ts AS drift_s, coalesce(abs(f.ts - p.ts) <= 21600.0, false) AS passed
          FROM k p LEFT JOIN k f ON f.run_id = p.run_id AND f.node = p.node AND f.ordinal = p.ordinal AND f.state = 'killed' WHERE p.state = 'stalled'""",
}

from skiff.plans.telemetry import ORACLE as _TEL  # noqa: E402

ORACLE["exp_phase_durations"] = (
    "WITH spans AS (" + _TEL["telemetry_node_spans"] + ")\n"
    "SELECT run_id, label, sum(duration) AS seconds FROM spans GROUP BY 1, 2\n"
    "UNION ALL SELECT run_id, 'total', sum(duration) FROM spans GROUP BY 1"
)
ORACLE["exp_comparison_rows"] = _ctes("steps") + (
    "SELECT * FROM (SELECT run_id, count(*) AS lines, max(step) AS last_step FROM steps GROUP BY 1) s\n"
    "LEFT JOIN (SELECT run_id, " + ", ".join(f"max(seconds) FILTER (label = '{p}') AS {p}" for p in PHASES)
    + " FROM (" + ORACLE["exp_phase_durations"] + ") d GROUP BY 1) p USING (run_id)\n"
    "LEFT JOIN (" + _TEL["telemetry_cost_totals"] + ") c USING (run_id)"
)
