"""Experiment analysis over the profiles of many runs (AG-34, AG-39 … AG-58,
FLT-07/08, JN-17/18/19, WN-20/21).

Step samples: ``(run_id, event_id, step, loss, ms, tok_s, ws, t)``;
validation samples: ``(run_id, step, loss)``; marks: ``(run_id, event, t)``.
Order-dependent trims and medians use the exact two-pass selection, never
a window over a whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.functions.percentile import kth_values, lower_median, upper_median
from skiff.operators.scan import scan

STALL_FACTOR = 1.8     # a step slower than 1.8 x median is a stall
STALL_GAP = 5          # stalls at most 5 steps apart are one checkpoint cycle
SIZING_HAIRCUT = 0.85  # comms / imbalance versus perfect weak scaling


def _trimmed_sum(df: DataFrame, key: str, value: str, lo: callable, hi: callable) -> DataFrame:
    """Sum and count of the values with 1-based rank in ``(lo(n), n - hi(n)]``
    per key, exactly: total minus the ``lo`` smallest minus the ``hi`` largest,
    each found through the k-th value (ties at the cut are counted out)."""
    ks = kth_values(df, [key], value, {"__vlo": lambda n: lo(n), "__vhi": lambda n: n - hi(n) + 1})
    j = df.join(ks, on=key)
    v = F.col(value)
    agg = j.groupBy(key).agg(
        F.first("n").alias("n"), F.first("__vlo").alias("vlo"), F.first("__vhi").alias("vhi"),
        F.sum(v).alias("total"),
        F.sum(F.when(v < F.col("__vlo"), v).otherwise(F.lit(0))).alias("s_lo"),
        F.count(F.when(v < F.col("__vlo"), F.lit(1))).alias("c_lo"),
        F.sum(F.when(v > F.col("__vhi"), v).otherwise(F.lit(0))).alias("s_hi"),
        F.count(F.when(v > F.col("__vhi"), F.lit(1))).alias("c_hi"),
    )
    k_lo, k_hi = lo(F.col("n")), hi(F.col("n"))
    low = F.col("s_lo") + F.coalesce((k_lo - F.col("c_lo")) * F.col("vlo"), F.lit(0))
    high = F.col("s_hi") + F.coalesce((k_hi - F.col("c_hi")) * F.col("vhi"), F.lit(0))
    return agg.select(
        key, "n", (F.col("total") - F.when(k_lo > 0, low).otherwise(F.lit(0)) - F.when(k_hi > 0, high).otherwise(F.lit(0))).alias("core_sum"),
        (F.col("n") - k_lo - k_hi).alias("core_n"), "total",
    )


def time_to_target(steps: DataFrame, vals: DataFrame, target: float) -> DataFrame:
    """AG-39 + JN-19: first validation at or below ``target`` (by step),
    wall seconds from the first training step to the first step sample at
    or beyond it (else the last); best validation otherwise."""
    s = steps.groupBy("run_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    v = vals.groupBy("run_id").agg(
        F.min_by(F.struct("step", "loss"), F.when(F.col("loss") <= target, F.struct("step", "loss"))).alias("hit"),
        F.min_by("loss", F.struct("loss", "step")).alias("best_val"),
        F.max("step").alias("last_step"),
    )
    j = s.join(v, on="run_id", how="inner")
    hit_step = F.col("hit.step")
    walls = steps.join(j.select("run_id", hit_step.alias("__hs")), on="run_id").filter(F.col("step") >= F.col("__hs")).groupBy("run_id").agg(
        F.min("t").alias("hit_t")
    )
    j = j.join(walls, on="run_id", how="left")
    reached = F.col("hit").isNotNull()
    hit_wall = F.coalesce(F.col("hit_t"), F.col("last_t"))
    return j.select(
        "run_id",
        reached.alias("reached"),
        F.lit(float(target)).alias("target"),
        F.when(reached, hit_step).alias("target_step"),
        F.when(reached, F.col("hit.loss")).alias("hit_val"),
        F.when(reached, hit_wall - F.col("first_t")).alias("time_to_target_s"),
        (F.col("last_t") - F.col("first_t")).alias("total_train_s"),
        F.when(~reached, F.col("best_val")).alias("best_val"),
        F.when(~reached, F.col("last_step")).alias("last_step"),
    )


def throughput(steps: DataFrame) -> DataFrame:
    """AG-40: trimmed mean ms/step (drop ``n // 4`` from each tail; all when
    that leaves none), mean tokens/s (truncated) and run time."""
    ms = steps.filter(F.col("ms").isNotNull() & (F.col("ms") != 0)).select("run_id", F.col("ms").cast("double").alias("ms"))
    tr = _trimmed_sum(ms, "run_id", "ms", lambda n: F.floor(n / 4), lambda n: F.floor(n / 4))
    mean = F.when(F.col("core_n") > 0, F.col("core_sum") / F.col("core_n")).otherwise(F.col("total") / F.col("n"))
    other = steps.groupBy("run_id").agg(
        F.floor(F.avg(F.when((F.col("tok_s").isNotNull()) & (F.col("tok_s") != 0), F.col("tok_s")))).cast("long").alias("tok_per_s"),
        F.when(F.count(F.lit(1)) >= 2, F.max("t") - F.min("t")).alias("run_time_s"),
    )
    return other.join(tr.select("run_id", mean.alias("ms_per_step")), on="run_id", how="left")


def run_nodes(run_id: Column) -> Column:
    """Driver-data recipe: node count and sweep of a run from its number."""
    no = F.substring_index(run_id, "-", -1).cast("int")
    return F.pow(F.lit(2), no % 4).cast("int")


def speedups(results: DataFrame, metric: str) -> DataFrame:
    """AG-42: per sweep, speed-up and efficiency of each node count against
    the fewest nodes (by a lower-is-faster ``metric``); the baseline is one
    row per sweep, joined back."""
    base = results.groupBy("sweep").agg(F.min_by(F.struct(F.col("nodes").alias("base_n"), F.col(metric).alias("base_m")), F.col("nodes")).alias("b"))
    j = results.join(base.select("sweep", "b.*"), on="sweep")
    sp = F.when(F.col(metric) > 0, F.col("base_m") / F.col(metric)).otherwise(F.lit(float("inf")))
    return j.select(
        "sweep", "nodes", "run_id", F.col(metric).alias("metric"), "base_n",
        F.when(F.col(metric).isNotNull() & F.col("base_m").isNotNull(), sp).alias("speedup"),
        F.when(F.col(metric).isNotNull() & F.col("base_m").isNotNull(), sp / (F.col("nodes") / F.col("base_n")) * 100).alias("efficiency_pct"),
    )


def control_check(ttt: DataFrame) -> DataFrame:
    """AG-43: steps to target must be equal across node counts of a sweep."""
    r = ttt.filter(F.col("reached") & F.col("target_step").isNotNull() & (F.col("target_step") != 0))
    return r.groupBy("sweep").agg(F.count_distinct("target_step").alias("distinct_steps")).withColumn(
        "control_ok", F.col("distinct_steps") <= 1
    )


def hypothesis(ttt: DataFrame, pairs: DataFrame) -> DataFrame:
    """AG-44: for each ``(name, faster, slower)`` pair of labels: TRUE when
    the faster label reaches the target sooner, FALSE if not, INCONCLUSIVE
    when either did not reach it."""
    t = ttt.select("label", F.when(F.col("reached"), F.col("time_to_target_s")).alias("tt"))
    a = t.select(F.col("label").alias("faster"), F.col("tt").alias("a"))
    b = t.select(F.col("label").alias("slower"), F.col("tt").alias("b"))
    j = pairs.join(a, on="faster", how="left").join(b, on="slower", how="left")
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit("INCONCLUSIVE")).when(F.col("a") < F.col("b"), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    ratio = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.col("a") != 0, F.col("b") / F.col("a")).otherwise(F.lit(float("inf"))))
    return j.select("name", "faster", "slower", "a", "b", verdict.alias("verdict"), ratio.alias("ratio"))


def preempt_stats(marks: DataFrame, steps: DataFrame) -> DataFrame:
    """AG-41: kills, smallest world any step ran at, and recovery /
    degraded seconds from the first occurrence of each mark."""
    first = marks.groupBy("run_id").agg(
        *[F.min(F.when(F.col("event") == e, F.col("t"))).alias(e) for e in ("kill", "shrink_resume", "relaunch", "full_world")],
        F.count(F.when(F.col("event") == "kill", F.lit(1))).alias("killed"),
    )
    mw = steps.filter(F.col("ws").isNotNull() & (F.col("ws") != 0)).groupBy("run_id").agg(F.min("ws").alias("min_world"))
    return first.join(mw, on="run_id", how="full").select(
        "run_id", F.coalesce(F.col("killed"), F.lit(0)).alias("killed"), "min_world",
        (F.col("full_world") - F.col("kill")).alias("recovery_s"),
        (F.col("full_world") - F.col("shrink_resume")).alias("degraded_s"),
    )


def loss_fit(points: DataFrame, frac: float = 0.4, key: str = "run_id", x: str = "step", y: str = "loss") -> DataFrame:
    """AG-47: ``loss ~ a + b ln(step)`` by least squares on the tail (steps
    at or beyond ``frac x`` the last step) and the largest residual."""
    p = points.filter(F.col(y).isNotNull() & (F.col(x) > 0))
    last = p.groupBy(key).agg(F.max(x).alias("__last"))
    tail = p.join(last, on=key).filter(F.col(x) >= F.lit(frac) * F.col("__last")).withColumn("__lx", F.log(F.col(x).cast("double")))
    sums = tail.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__lx").alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col("__lx") * F.col("__lx")).alias("sxx"), F.sum(F.col("__lx") * F.col(y)).alias("sxy"),
    )
    b = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = sums.withColumn("b", b).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n"))
    res = tail.join(fit.select(key, "a", "b"), on=key).groupBy(key).agg(
        F.max(F.abs(F.col(y) - (F.col("a") + F.col("b") * F.col("__lx")))).alias("max_resid")
    )
    return fit.select(key, "n", "a", "b").join(res, on=key)


def sizing(steps: DataFrame, vals: DataFrame, cap_s: int) -> DataFrame:
    """AG-46: mid-quartile ms/step (skip ``n // 4`` fastest and at least one
    slowest), projected steps at the cap for 1/2/4 GPUs with the 0.85
    haircut, and a target loss from a ``ln(step)`` fit of the validation
    curve at ``max(2 x last val step, proj2 // 2)``."""
    ms = steps.filter(F.col("ms").isNotNull()).select("run_id", F.col("ms").cast("double").alias("ms"))
    tr = _trimmed_sum(ms, "run_id", "ms", lambda n: F.floor(n / 4), lambda n: F.greatest(F.lit(1), F.floor(n / 4)))
    tr = tr.filter(F.col("n") >= 3)
    m = F.when(F.col("core_n") > 0, F.col("core_sum") / F.col("core_n"))
    tok = steps.groupBy("run_id").agg(F.avg("tok_s").alias("tok_per_s_1gpu"), F.max_by("ms", "step").alias("__last_ms"))
    out = tr.join(tok, on="run_id").withColumn("ms_per_step_1gpu", F.coalesce(m, F.col("__last_ms").cast("double")))
    out = out.withColumn("steps_per_s_1gpu", F.when(F.col("ms_per_step_1gpu") > 0, 1000.0 / F.col("ms_per_step_1gpu")).otherwise(F.lit(0.0)))
    for g in (1, 2, 4):
        out = out.withColumn(f"proj_steps_{g}", F.floor(F.col("steps_per_s_1gpu") * g * SIZING_HAIRCUT * cap_s).cast("long"))
    vf = vals.withColumn("__lx", F.log(F.greatest(F.lit(1), F.col("step")).cast("double")))
    fit = vf.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("__nv"), F.avg("__lx").alias("mx"), F.avg("loss").alias("my"),
        F.max("step").alias("__lv"), F.max_by("loss", "step").alias("probe_last_val"),
    )
    dev = vf.join(fit, on="run_id").groupBy("run_id").agg(
        F.sum((F.col("__lx") - F.col("mx")) * (F.col("__lx") - F.col("mx"))).alias("__den"),
        F.sum((F.col("__lx") - F.col("mx")) * (F.col("loss") - F.col("my"))).alias("__num"),
    )
    fit = fit.join(dev, on="run_id")
    bb = F.col("__num") / F.when(F.col("__den") != 0, F.col("__den")).otherwise(F.lit(1.0))
    fit = fit.withColumn("__b", bb).withColumn("__a", F.col("my") - F.col("__b") * F.col("mx"))
    out = out.join(fit, on="run_id", how="left")
    tstep = F.greatest(F.col("__lv") * 2, F.floor(F.col("proj_steps_2") / 2))
    suggest = F.col("__a") + F.col("__b") * F.log(F.greatest(F.lit(1), tstep).cast("double"))
    return out.select(
        "run_id", "ms_per_step_1gpu", "steps_per_s_1gpu", F.floor("tok_per_s_1gpu").cast("long").alias("tok_per_s_1gpu"),
        "proj_steps_1", "proj_steps_2", "proj_steps_4", "probe_last_val",
        F.when(F.col("__nv") >= 3, suggest).alias("suggested_target_loss"),
    )


def _indexed_with_median(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step samples numbered per run in time order, and each run's true
    median step time."""
    s = steps.withColumn("__one", F.lit(1))
    s = scan(s, ["run_id"], "t", ["event_id"], width=86400.0, sums={"idx": "__one"}).drop("__one")
    med = kth_values(s, ["run_id"], "ms", {"lo": lower_median(), "hi": upper_median()}).select(
        "run_id", ((F.col("lo") + F.col("hi")) / 2).alias("med")
    )
    return s, med


def stall_cycles(steps: DataFrame, width: float = 1e6, indexed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """FLT-08 + WN-20: per run, steps slower than 1.8 x the median ms are
    stalls (the first step excluded); stalls at most 5 step indices apart
    form one checkpoint cycle.  One row per cycle with its start index and
    excess seconds over the median."""
    s, med = indexed if indexed is not None else _indexed_with_median(steps)
    st = s.join(med, on="run_id").filter((F.col("ms") > F.col("med") * STALL_FACTOR) & (F.col("idx") > 1))
    st = st.withColumn("__i", F.col("idx").cast("double"))
    st = scan(st, ["run_id"], "__i", width=width, prevs={"__pi": F.col("idx")})
    st = st.withColumn("__new", F.when(F.col("__pi").isNull() | (F.col("idx") - F.col("__pi") > STALL_GAP), 1).otherwise(0))
    st = scan(st, ["run_id"], "__i", width=width, sums={"cycle": "__new"})
    return st.groupBy("run_id", "cycle").agg(
        F.min("idx").alias("start_idx"), F.sum((F.col("ms") - F.col("med")) / 1000.0).alias("excess_s"), F.count(F.lit(1)).alias("stalls")
    )


def clean_projection(steps: DataFrame, budget: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """AG-48: extrapolate a clean run to another run's trained seconds
    (``budget(run_id, budget_s)``): steady step time (mean of non-stall
    steps), warm-up excess of the first step, checkpoint-cycle excess
    amortised over the mean cycle period; steps by that model and naively,
    their mean and spread.  ``facts(run_id, fixed_s, overhead_s, nodes,
    hourly_usd)`` of the clean run (seconds outside training, seconds a machine
    bills beyond the run's clock, machines, rate) add the projected wall time,
    machine seconds and dollars."""
    s, med = _indexed_with_median(steps)
    j = s.join(med, on="run_id")
    base = j.groupBy("run_id").agg(
        (F.avg(F.when(F.col("ms") <= F.col("med") * STALL_FACTOR, F.col("ms"))) / 1000.0).alias("steady_s"),
        ((F.min_by("ms", "idx") - F.first("med")) / 1000.0).alias("warmup_s"),
        F.count(F.lit(1)).alias("n"), (F.sum("ms") / 1000.0).alias("sum_s"), F.first("med").alias("med"),
    )
    cyc = stall_cycles(steps, indexed=(s, med))
    # the mean distance of neighbouring cycles: the distances add up to last - first
    per = cyc.groupBy("run_id").agg(
        F.avg("excess_s").alias("cycle_excess_s"),
        F.try_divide(F.max("start_idx") - F.min("start_idx"), F.count(F.lit(1)) - 1).alias("cycle_period_steps"),
    )
    out = base.join(per, on="run_id", how="left").join(budget, on="run_id")
    amort = F.col("steady_s") + F.col("cycle_excess_s") / F.col("cycle_period_steps")
    out = out.withColumn("amortised_s", amort)
    model = (F.col("budget_s") - F.col("warmup_s")) / F.col("amortised_s")
    naive = F.col("budget_s") * (F.col("n") / F.col("sum_s"))
    cols = [
        "run_id", "budget_s", "steady_s", "warmup_s", "cycle_excess_s", "cycle_period_steps", "amortised_s",
        model.alias("steps_model"), naive.alias("steps_naive"), ((model + naive) / 2).alias("steps"),
        (F.abs(model - naive) / model * 100).alias("spread_pct"),
    ]
    if facts is None:
        return out.select(*cols)
    wall = F.col("fixed_s") + F.col("budget_s")
    machine = F.col("nodes") * (wall + F.col("overhead_s"))
    return out.join(facts, "run_id", "left").select(*cols, "fixed_s", wall.alias("wall_s"), machine.alias("instance_s"), (machine * F.col("hourly_usd") / 3600).alias("usd"))


def by_world(steps: DataFrame) -> DataFrame:
    """AG-50: steps, true-median step time and rate relative to the largest
    world, per (run, world size)."""
    s = steps.filter(F.col("ws").isNotNull() & (F.col("ws") > 0))
    cnt = s.groupBy("run_id", "ws").agg(F.count(F.lit(1)).alias("steps"))
    med = kth_values(s, ["run_id", "ws"], "ms", {"lo": lower_median(), "hi": upper_median()}).select(
        "run_id", "ws", ((F.col("lo") + F.col("hi")) / 2).alias("median_ms")
    )
    j = cnt.join(med, on=["run_id", "ws"])
    top = j.groupBy("run_id").agg(F.max_by("median_ms", "ws").alias("__top"))
    return j.join(top, on="run_id").select("run_id", "ws", "steps", "median_ms", (F.col("__top") / F.col("median_ms")).alias("rate_vs_full"))


def world_transitions(steps: DataFrame, width: float = 86400.0) -> DataFrame:
    """WN-21: world-size changes between consecutive step samples with the
    gap in seconds and steps."""
    s = steps.filter(F.col("ws") > 0)
    s = scan(s, ["run_id"], "t", ["event_id"], width=width, prevs={"__p": F.struct("ws", "t", "step")})
    return s.filter(F.col("__p").isNotNull() & (F.col("__p.ws") != F.col("ws"))).select(
        "run_id", F.col("__p.ws").alias("from_ws"), F.col("ws").alias("to_ws"), "t",
        (F.col("t") - F.col("__p.t")).alias("gap_s"), (F.col("step") - F.col("__p.step")).alias("gap_steps"),
    )


def utilisation(steps: DataFrame) -> DataFrame:
    """AG-55: Σ step time / elapsed, stall seconds over the run median."""
    med = kth_values(steps, ["run_id"], "ms", {"lo": lower_median(), "hi": upper_median()}).select(
        "run_id", ((F.col("lo") + F.col("hi")) / 2).alias("med")
    )
    j = steps.join(med, on="run_id")
    g = j.groupBy("run_id").agg(
        (F.sum("ms") / 1000.0).alias("busy_s"), (F.max("t") - F.min("t")).alias("elapsed_s"),
        (F.sum(F.greatest(F.col("ms") - F.col("med"), F.lit(0.0))) / 1000.0).alias("stall_s"), F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        "run_id", "busy_s", "elapsed_s", F.when(F.col("elapsed_s") > 0, F.col("busy_s") / F.col("elapsed_s")).alias("utilisation"),
        "stall_s", (F.col("stall_s") / F.col("n")).alias("stall_per_step_s"),
        F.when(F.col("busy_s") > 0, F.col("stall_s") / F.col("busy_s")).alias("stall_share"),
    )


def phase_durations(spans: DataFrame) -> DataFrame:
    """AG-34: seconds per phase and in total per run (from labelled spans)."""
    p = spans.groupBy("run_id", "label").agg(F.sum("duration").alias("seconds"))
    t = spans.groupBy("run_id").agg(F.sum("duration").alias("seconds")).withColumn("label", F.lit("total"))
    return p.unionByName(t)


def recipe_guard(profiles: DataFrame, pair: str, recipe_cols: list[str]) -> DataFrame:
    """FLT-07: runs compared as a pair must share one recipe."""
    return profiles.groupBy(pair).agg(F.count_distinct(F.struct(*recipe_cols)).alias("recipes")).withColumn(
        "comparable", F.col("recipes") == 1
    )


def ab_compare(clean: DataFrame, fail: DataFrame, key: str, metrics: list[str], kills: Column | None = None) -> DataFrame:
    """JN-17 + AG-49: clean projection vs failure run per metric: delta and
    percent, and the delta per kill and per kill event (kills at one time)."""
    rows = None
    for m in metrics:
        c = clean.select(key, F.lit(m).alias("metric"), F.col(m).cast("double").alias("clean"))
        e = fail.select(key, F.lit(m).alias("metric"), F.col(m).cast("double").alias("failure"), F.col("kills"), F.col("events"))
        r = c.join(e, on=[key, "metric"])
        rows = r if rows is None else rows.unionByName(r)
    d = F.col("failure") - F.col("clean")
    return rows.select(
        key, "metric", "clean", "failure", d.alias("delta"),
        F.when(F.col("clean") != 0, d / F.col("clean") * 100).alias("delta_pct"),
        F.when(F.col("kills") > 0, d / F.col("kills")).alias("per_kill"),
        F.when(F.col("events") > 0, d / F.col("events")).alias("per_event"),
    )


def kill_drift(planned: DataFrame, fired: DataFrame, tolerance_s: float = 90.0) -> DataFrame:
    """AG-58: planned kills joined with fired terminations on
    ``(run, node, ordinal)``; drift and pass within the tolerance."""
    j = planned.join(fired, on=["run_id", "node", "ordinal"], how="left")
    return j.select(
        "run_id", "node", "ordinal", "planned_t", "fired_t", (F.col("fired_t") - F.col("planned_t")).alias("drift_s"),
        F.coalesce(F.abs(F.col("fired_t") - F.col("planned_t")) <= tolerance_s, F.lit(False)).alias("passed"),
    )


def sample_grid(samples: DataFrame, max_prompts: int = 100_000) -> DataFrame:
    """JN-18: every prompt x run x step side by side; a missing completion
    stays visible as null, and every first sample (``sample_index`` 0) of a
    cell stays a row of its own under its ``sample_id``.  The prompt list is
    the evaluation set and enters each (run, step) as one array value, so the
    grid is built by ``explode`` rather than a cross join; more than
    ``max_prompts`` prompts are refused, as they aren't an evaluation set."""
    prompts = samples.agg(F.array_sort(F.collect_set("prompt"))).scalar()
    bounded = F.when(F.size("__p") <= max_prompts, F.col("__p")).otherwise(F.raise_error(F.lit(f"more than {max_prompts} prompts")))
    steps = samples.select("run_id", "step").distinct().withColumn("__p", prompts)
    grid = steps.select("run_id", "step", F.explode(bounded).alias("prompt"))
    first = samples.filter(F.col("sample_index") == 0).select("run_id", "step", "prompt", "sample_id", "completion")
    return grid.join(first, ["run_id", "step", "prompt"], "left")


def comparison_rows(summary: DataFrame, phases: DataFrame, cost: DataFrame, names: list[str] | None = None) -> DataFrame:
    """AG-52: the comparison table: summary facts, seconds per phase (one
    column per phase) and dollars, one row per run. ``names`` are the phases
    that become columns; without them a job looks them up first."""
    wide = phases.groupBy("run_id").pivot("phase", names).agg(F.first("seconds"))
    return summary.join(wide, "run_id", "left").join(cost, "run_id", "left")


def recovery_rounds(kills: DataFrame, epochs: DataFrame, full_world: int, ticks: DataFrame | None = None, width: float = 86400.0) -> DataFrame:
    """AG-53: kill rounds (kills sharing one time) with nodes lost, the first
    shrunken epoch after the round (detection, with its world size) and the
    first epoch back at the full world (kill -> full world), each only
    before the next round; with ``ticks`` also the smallest world and the gain
    of the durable step within the round.  Forward as-of joins on negated
    time, and epochs and ticks attached to the latest kill: no pairs."""
    from skiff.operators.asof import asof_join

    rounds = kills.groupBy("run_id", F.col("t").alias("kill_t")).agg(F.count(F.lit(1)).alias("nodes_lost"))
    rounds = scan(rounds, ["run_id"], "kill_t", width=width, nexts={"next_kill": F.col("kill_t")})
    e = epochs.select("run_id", F.col("t").alias("et"), F.size("members").alias("world"))
    neg = rounds.withColumn("__nt", -F.col("kill_t")).withColumn("__id", F.col("kill_t"))
    shr = e.filter(F.col("world") < full_world).withColumn("__nt", -F.col("et"))
    ful = e.filter(F.col("world") >= full_world).withColumn("__nt", -F.col("et"))
    j = asof_join(neg, shr, ["run_id"], "__nt", "__nt", ["et", "world"], prefix="s_", strict=True, left_tiebreak=["__id"], width=width)
    j = asof_join(j, ful, ["run_id"], "__nt", "__nt", ["et"], prefix="f_", strict=True, left_tiebreak=["__id"], width=width)
    before = lambda c: F.when(F.col("next_kill").isNull() | (F.col(c) <= F.col("next_kill")), F.col(c))
    j = j.withColumn("shrink_t", before("s_et")).withColumn("full_t", before("f_et"))
    out = j.select(
        "run_id", "kill_t", "nodes_lost", F.when(F.col("shrink_t").isNotNull(), F.col("s_world")).alias("shrunk_world"),
        (F.col("shrink_t") - F.col("kill_t")).alias("detection_s"), (F.col("full_t") - F.col("kill_t")).alias("kill_to_full_s"),
        (F.col("full_t") - F.col("shrink_t")).alias("degraded_s"),
    )
    if ticks is None:
        return out
    at = rounds.select("run_id", "kill_t")
    worlds = asof_join(epochs.select("run_id", "t", "event_id", F.size("members").alias("world")), at, ["run_id"], "t", "kill_t", ["kill_t"], prefix="k_", strict=True, left_tiebreak=["event_id"], width=width)
    worlds = worlds.filter(F.col("k_kill_t").isNotNull() & (F.col("world") < full_world)).groupBy("run_id", F.col("k_kill_t").alias("kill_t")).agg(F.min("world").alias("smallest_world"))
    durable = asof_join(ticks.select("run_id", "t", "event_id", "ckpt_step"), at, ["run_id"], "t", "kill_t", ["kill_t"], prefix="k_", strict=True, left_tiebreak=["event_id"], width=width)
    durable = durable.filter(F.col("k_kill_t").isNotNull()).groupBy("run_id", F.col("k_kill_t").alias("kill_t")).agg((F.max("ckpt_step") - F.min("ckpt_step")).alias("ckpt_gain"))
    return out.join(worlds, ["run_id", "kill_t"], "left").join(durable, ["run_id", "kill_t"], "left")
