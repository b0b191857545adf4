"""Registered fleet-state queries over the driver's tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.operators import fleet as FL
from skiff.operators import timeline as T
from skiff.plans.oracle_views import with_views
from skiff.sources import driver as D

RECOVERY_TIMEOUT_S = 36_000.0
KEEP = 3
WORLD_RANKS = 4


def _obs(spark, sf):
    return D.node_observations(spark, sf)


def _timeline(spark, sf):
    return T.epoch_timeline(D.tick_docs(spark, sf), D.epoch_log(spark, sf))


def q_health(spark, sf):
    return _obs(spark, sf).select("run_id", "t", "node", "attempt", FL.healthy().alias("healthy"))


def q_decisions(spark, sf):
    return FL.membership_decisions(_obs(spark, sf))


def q_sticky(spark, sf):
    return FL.sticky_states(_obs(spark, sf))


def q_masters(spark, sf):
    return FL.elect_masters(_timeline(spark, sf))


def q_stall(spark, sf):
    return FL.stall_alarms(FL.stall_clock(D.tick_docs(spark, sf), _timeline(spark, sf)), RECOVERY_TIMEOUT_S)


def q_listing(spark, sf):
    return FL.parse_listing(D.checkpoint_listing(spark, sf)).select("run_id", "tier", "rank", "name", "step", "size")


def q_restore(spark, sf):
    listing = D.checkpoint_listing(spark, sf)
    ranks = listing.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(WORLD_RANKS - 1))).alias("rank"))
    return FL.restore_point(listing, ranks)


def q_retention(spark, sf):
    return FL.retention(D.checkpoint_listing(spark, sf), KEEP)


QUERIES = {
    "fleet_health": q_health,
    "fleet_decisions": q_decisions,
    "fleet_sticky_states": q_sticky,
    "fleet_masters": q_masters,
    "fleet_stall_clock": q_stall,
    "fleet_checkpoints": q_listing,
    "fleet_restore_point": q_restore,
    "fleet_retention": q_retention,
}

# ------------------------------------------------------------------ SQL --


def _ctes(*views, extra=()):
    base = with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]
    return base + "".join(",\n" + e for e in extra) + "\n"


_H = "(coalesce(registered, false) AND aws_state = 'running' AND NOT (log_age_s IS NOT NULL AND log_age_s > 90.0))"
_TL = """tl0 AS (SELECT t.run_id, t.t, t.event_id, t.epoch FROM ticks t WHERE (t.run_id, t.epoch) IN (SELECT run_id, epoch FROM epoch_log)),
tl1 AS (SELECT *, lag(epoch) OVER (PARTITION BY run_id ORDER BY t, event_id) AS pe FROM tl0),
tl AS (SELECT tl1.run_id, tl1.t, tl1.event_id, tl1.epoch, l.members, l.master FROM tl1 JOIN epoch_log l USING (run_id, epoch)
       WHERE pe IS NULL OR pe <> tl1.epoch)"""
_CK = """ck AS (SELECT *, split_part(path, '/', -1) AS name,
            TRY_CAST(regexp_extract(split_part(path, '/', -1), '^ckpt-([0-9]+)\\.pt$', 1) AS BIGINT) AS step
          FROM ckpt_listing WHERE starts_with(split_part(path, '/', -1), 'ckpt-') AND NOT ends_with(split_part(path, '/', -1), '.tmp')
            AND regexp_matches(split_part(path, '/', -1), '^ckpt-[0-9]+\\.pt$'))"""

ORACLE = {
    "fleet_health": with_views(f"SELECT run_id, t, node, attempt, {_H} AS healthy FROM node_obs", "node_obs"),
    "fleet_decisions": with_views(
        f"""SELECT run_id, t, event_id, array_to_string(h, ',') AS healthy,
              array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(h, x))), ',') AS to_drop,
              array_to_string(list_sort(list_filter(h, lambda x: NOT list_contains(m, x))), ',') AS to_add,
              len(h) > 0 AND h <> m AS publish_epoch
            FROM (SELECT run_id, t, event_id, list_sort(list_distinct(coalesce(list(node) FILTER (WHERE {_H}), []))) AS h, list_sort(first(members)) AS m
                  FROM node_obs GROUP BY 1, 2, 3) g""",
        "node_obs",
    ),
    "fleet_sticky_states": with_views(
        f"""SELECT run_id, node, attempt, t, event_id,
              CASE WHEN ever = 1 THEN 'dead' WHEN {_H} THEN 'live' ELSE 'joining' END AS state,
              CASE WHEN seen = 1 THEN 'new' WHEN ever = 1 AND coalesce(prev_ever, 0) = 0 THEN 'dead' END AS transition
            FROM (SELECT *, lag(ever) OVER w AS prev_ever FROM (
                    SELECT *, max(CASE WHEN aws_state IN ('shutting-down','terminated','stopping','stopped') THEN 1 ELSE 0 END) OVER w2 AS ever,
                           count(*) OVER w2 AS seen
                    FROM node_obs WINDOW w2 AS (PARTITION BY run_id, node, attempt ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) a
                  WINDOW w AS (PARTITION BY run_id, node, attempt ORDER BY t, event_id)) b""",
        "node_obs",
    ),
    "fleet_stall_clock": _ctes("ticks", "epoch_log", extra=(_TL,))
    + f""", tk AS (SELECT run_id, t, event_id, ckpt_step, 1 AS src, 0 AS ep,
                   coalesce(ckpt_step > max(ckpt_step) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS progress
                 FROM ticks),
          u AS (SELECT run_id, t, event_id, ckpt_step, src, ep, progress FROM tk
                UNION ALL SELECT run_id, t, event_id, NULL, 0, 1, false FROM tl),
          u2 AS (SELECT *, sum(ep) OVER w AS e,
                   last(CASE WHEN progress THEN t END IGNORE NULLS) OVER w AS lp,
                   last(CASE WHEN ep = 1 THEN t END IGNORE NULLS) OVER w AS le
                 FROM u WINDOW w AS (PARTITION BY run_id ORDER BY t, src, event_id ROWS UNBOUNDED PRECEDING)),
          u3 AS (SELECT *, last(CASE WHEN progress THEN e END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t, src, event_id ROWS UNBOUNDED PRECEDING) AS elp FROM u2)
          SELECT run_id, t, event_id, ckpt_step, t - greatest(lp, le) AS no_progress_s, e - coalesce(elp, 0) AS epochs_without_progress,
                 CASE WHEN t - greatest(lp, le) > {RECOVERY_TIMEOUT_S} THEN 'no checkpoint progress'
                      WHEN e - coalesce(elp, 0) >= {FL.MAX_EPOCHS_WITHOUT_PROGRESS} THEN 'epochs without progress' END AS restart_reason
          FROM u3 WHERE src = 1""",
    "fleet_checkpoints": _ctes("ckpt_listing", extra=(_CK,)) + "SELECT run_id, tier, rank, name, step, size FROM ck",
    "fleet_restore_point": _ctes("ckpt_listing", extra=(_CK,))
    + f""", ranks AS (SELECT DISTINCT run_id, r.rank FROM ckpt_listing, range(0, {WORLD_RANKS}) r(rank)),
          bl AS (SELECT run_id, rank, max(step) AS bl FROM ck WHERE tier = 'local' GROUP BY 1, 2),
          bd AS (SELECT run_id, max(step) AS bd FROM ck WHERE tier = 'durable' GROUP BY 1),
          r AS (SELECT ranks.run_id, CAST(ranks.rank AS INTEGER) AS rank, greatest(coalesce(bl.bl, -1), coalesce(bd.bd, -1)) AS best
                FROM ranks LEFT JOIN bl ON bl.run_id = ranks.run_id AND bl.rank = ranks.rank LEFT JOIN bd ON bd.run_id = ranks.run_id),
          g AS (SELECT r.*, min(best) OVER (PARTITION BY run_id) AS group_step FROM r)
          SELECT run_id, rank, best, group_step,
                 CASE WHEN group_step < 0 THEN 'fresh'
                      WHEN EXISTS (SELECT 1 FROM ck WHERE ck.run_id = g.run_id AND ck.tier = 'local' AND ck.rank = g.rank AND ck.step = g.group_step) THEN 'local'
                      WHEN EXISTS (SELECT 1 FROM ck WHERE ck.run_id = g.run_id AND ck.tier = 'durable' AND ck.step = g.group_step) THEN 'durable'
                      ELSE 'error' END AS tier
          FROM g""",
    "fleet_retention": _ctes("ckpt_listing", extra=(_CK,))
    + f"""SELECT run_id, tier, rank, path, step FROM (
             SELECT *, row_number() OVER (PARTITION BY run_id, tier, coalesce(rank, -1) ORDER BY name DESC) AS rn FROM ck) x
          WHERE rn > {KEEP}""",
    "fleet_masters": "WITH RECURSIVE " + _ctes("ticks", "epoch_log", extra=(_TL,))[len("WITH "):]
    + """, e AS (SELECT run_id, t, epoch, list_sort(members) AS m, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) AS i FROM tl),
          r(run_id, i, t, epoch, m, master) AS (
            SELECT run_id, i, t, epoch, m, list_min(m) FROM e WHERE i = 1
            UNION ALL
            SELECT e.run_id, e.i, e.t, e.epoch, e.m,
                   CASE WHEN r.master IS NOT NULL AND list_contains(e.m, r.master) THEN r.master
                        WHEN len(list_filter(e.m, lambda x: list_contains(r.m, x))) > 0 THEN list_min(list_filter(e.m, lambda x: list_contains(r.m, x)))
                        ELSE list_min(e.m) END
            FROM r JOIN e ON e.run_id = r.run_id AND e.i = r.i + 1)
          SELECT run_id, t, epoch, master FROM r""",
}
