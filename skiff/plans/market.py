"""Registered capacity-market queries over the driver's tables, with the
DuckDB oracle for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skiff.operators import market as M
from skiff.plans.oracle_views import hour_sql, weekday_sql, with_views
from skiff.sources import driver as D

THRESHOLD = 7.0
HOME_REGION = D.HOME_REGION
HOME_TYPE = D.HOME_TYPE


def _records(spark, sf):
    return D.sps_records(spark, sf)


def q_scenarios(spark, sf):
    return M.scenarios(_records(spark, sf), THRESHOLD, HOME_REGION, HOME_TYPE, capacities=(8, 1))


def q_hourly(spark, sf):
    return M.hourly_odds(_records(spark, sf), THRESHOLD, HOME_REGION, HOME_TYPE, 8)


def q_dow_hour(spark, sf):
    return M.hourly_odds(_records(spark, sf), THRESHOLD, HOME_REGION, HOME_TYPE, 1, weekday=True)


def q_heatmap(spark, sf):
    rows = M.sps_rows(_records(spark, sf), 8, single_az=True)
    return M.heatmap(rows, "az_id")


def q_availability(spark, sf):
    return M.availability_order(M.availability(_records(spark, sf), 8, THRESHOLD))


def q_headline(spark, sf):
    return M.headline(_records(spark, sf), THRESHOLD, HOME_REGION)


def q_rank_pools(spark, sf):
    return M.rank_pools(_records(spark, sf), 1, THRESHOLD)


def q_prices(spark, sf):
    return M.price_summary(D.price_records(spark, sf))


def q_interruptions(spark, sf):
    return M.interruption_summary(D.interruption_records(spark, sf).drop("type"))


def q_leaderboard(spark, sf):
    return M.leaderboard(_records(spark, sf), 8)


def q_envelopes(spark, sf):
    """PRJ-01: every score record in its envelope."""
    r = D.sps_records(spark, sf).select("region", "az_id", "instance_type", "score", F.col("tick_id").alias("tick"), F.col("t").alias("at"))
    return M.record_envelope(r, "sps", F.col("tick"), F.col("at")).drop("at", "tick")


def q_coverage(spark, sf):
    recs = (
        _records(spark, sf)
        .unionByName(D.gap_records(spark, sf), allowMissingColumns=True)
        .unionByName(D.tick_records(spark, sf), allowMissingColumns=True)
    )
    return M.coverage(recs)


def q_calibration(spark, sf):
    return M.calibration(_records(spark, sf), D.probe_records(spark, sf), D.az_map_records(spark, sf))


def q_probe_bands(spark, sf):
    return M.success_by_band(q_calibration(spark, sf))


def q_az_names(spark, sf):
    return M.az_names(D.az_map_records(spark, sf))


def q_verdict(spark, sf):
    return M.verdict(_records(spark, sf), THRESHOLD, HOME_REGION, HOME_TYPE)


def q_home_az(spark, sf):
    return M.home_az(_records(spark, sf), HOME_REGION, HOME_TYPE, 8)


QUERIES = {
    "market_envelopes": q_envelopes,
    "market_scenarios": q_scenarios,
    "market_hourly_odds": q_hourly,
    "market_dow_hour_odds": q_dow_hour,
    "market_heatmap": q_heatmap,
    "market_availability": q_availability,
    "market_headline": q_headline,
    "market_rank_pools": q_rank_pools,
    "market_price_summary": q_prices,
    "market_interruptions": q_interruptions,
    "market_leaderboard": q_leaderboard,
    "market_coverage": q_coverage,
    "market_calibration": q_calibration,
    "market_probe_bands": q_probe_bands,
    "market_az_names": q_az_names,
    "market_verdict": q_verdict,
    "market_home_az": q_home_az,
}

# ------------------------------------------------------------------ SQL --

_ROWS = "SELECT * FROM sps WHERE capacity = {cap} AND score IS NOT NULL AND coalesce(scope, 'region') = '{scope}'{az}"
_SINGLE = " AND coalesce(single_az, false) = {v}"


def _rows(cap, single=None, scope="region"):
    az = "" if single is None else _SINGLE.format(v="true" if single else "false")
    return _ROWS.format(cap=cap, scope=scope, az=az)


def _home_az_sql(cap):
    return f"""(SELECT first(az_id ORDER BY mean DESC, az_id DESC) FROM (
        SELECT coalesce(az_id, '') AS az_id, avg(score) AS mean FROM ({_rows(cap, True)}) r
        WHERE region = '{HOME_REGION}' AND instance_type = '{HOME_TYPE}' GROUP BY 1))"""


def _scenarios_sql(caps=(8, 1)):
    conds = {
        1: f"region = '{HOME_REGION}' AND az_id = haz AND instance_type = '{HOME_TYPE}'",
        2: f"region = '{HOME_REGION}' AND az_id = haz AND instance_type <> 'any'",
        3: f"region = '{HOME_REGION}' AND instance_type = '{HOME_TYPE}'",
        4: f"region = '{HOME_REGION}' AND instance_type <> 'any'",
        5: "instance_type <> 'any'",
        6: f"region = '{HOME_REGION}' AND instance_type = 'any'",
    }
    parts = []
    for cap in caps:
        for o, c in conds.items():
            parts.append(
                f"SELECT {cap} AS capacity, {o} AS ordinal, tick_id, score FROM "
                f"(SELECT *, {_home_az_sql(cap)} AS haz FROM ({_rows(cap, True)}) r0) r WHERE {c}"
            )
    dom = " UNION ALL ".join(f"SELECT {c} AS capacity, {o} AS ordinal, '{n}' AS scenario" for c in caps for o, n in M.SCENARIOS)
    return f"""
    , tagged AS ({' UNION ALL '.join(parts)}),
    best AS (SELECT capacity, ordinal, tick_id, max(CAST(score AS DOUBLE)) AS best FROM tagged GROUP BY 1, 2, 3),
    stats AS (SELECT capacity, ordinal, count(*) AS ticks, avg(CASE WHEN best >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS p_good,
              avg(best) AS mean_best, max(best) AS max_best FROM best GROUP BY 1, 2),
    dom AS ({dom}),
    scen AS (SELECT d.capacity, d.ordinal, d.scenario, coalesce(s.ticks, 0) AS ticks, s.p_good, s.mean_best, s.max_best
             FROM dom d LEFT JOIN stats s ON d.capacity = s.capacity AND d.ordinal = s.ordinal)
    """


def _hourly_sql(cap, weekday=False):
    keys = f"{weekday_sql()} AS weekday, {hour_sql()} AS hour" if weekday else f"{hour_sql()} AS hour"
    kn = "weekday, hour" if weekday else "hour"
    return f"""SELECT {kn}, count(*) AS ticks, avg(CASE WHEN best >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS p_good,
          avg(best) AS mean_best, max(best) AS max_best FROM (
        SELECT {kn}, tick_id, max(CAST(score AS DOUBLE)) AS best FROM (
          SELECT {keys}, tick_id, score FROM ({_rows(cap, True)}) r
          WHERE region = '{HOME_REGION}' AND instance_type = '{HOME_TYPE}') x GROUP BY {kn}, tick_id) y
        GROUP BY {kn}"""


def _avail_sql(cap, region=None):
    reg = f" AND region = '{region}'" if region else ""
    return f"""(WITH r AS (SELECT coalesce(region,'') AS region, coalesce(az_id,'') AS az_id,
                   coalesce(instance_type,'') AS instance_type, t, CAST(score AS DOUBLE) AS score
                 FROM ({_rows(cap, True)}) q WHERE true{reg}),
      i AS (SELECT *, sum(CASE WHEN score >= {THRESHOLD} THEN 0 ELSE 1 END) OVER (
              PARTITION BY region, az_id, instance_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM r),
      runs AS (SELECT region, az_id, instance_type, grp, max(t) - min(t) AS secs, min(t) AS start, count(*) AS n
               FROM i WHERE score >= {THRESHOLD} GROUP BY ALL),
      lg AS (SELECT region, az_id, instance_type, max(secs) AS longest_good_s,
                    first(n ORDER BY secs DESC, start DESC) AS longest_good_samples FROM runs GROUP BY ALL),
      a AS (SELECT region, az_id, instance_type, max(score) AS best, avg(score) AS mean,
                   CAST(sum(CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END) AS BIGINT) AS good_samples,
                   count(*) AS samples FROM r GROUP BY ALL)
      SELECT a.*, coalesce(lg.longest_good_s, 0.0) AS longest_good_s,
             CAST(coalesce(lg.longest_good_samples, 0) AS BIGINT) AS longest_good_samples
      FROM a LEFT JOIN lg USING (region, az_id, instance_type))"""


def _calibration_sql():
    return f"""
    , names AS (SELECT az_id, first(az ORDER BY t DESC, az DESC) AS az_name FROM az_map
                WHERE az_id IS NOT NULL AND az_id <> '' GROUP BY az_id),
    scored AS ({_rows(1, False)}),
    az_scored AS (SELECT s.*, coalesce(n.az_name, '') AS s_az FROM ({_rows(1, True)}) s LEFT JOIN names n USING (az_id)),
    rs AS (SELECT p.event_id, max(s.score) AS region_score FROM probe p JOIN scored s
           ON s.region = p.region AND s.instance_type = p.instance_type AND abs(s.t - p.t) <= 900 GROUP BY 1),
    azs AS (SELECT p.event_id, max(s.score) AS az_score FROM probe p JOIN az_scored s
           ON s.region = p.region AND s.instance_type = p.instance_type AND abs(s.t - p.t) <= 900
              AND coalesce(p.az, '?') = s.s_az GROUP BY 1),
    cal AS (SELECT p.event_id, p.ts, p.region, coalesce(p.az, '') AS az, p.instance_type,
                   coalesce(p.capacity_available, false) AS capacity_available, coalesce(p.error_code, '') AS error_code,
                   rs.region_score, azs.az_score
            FROM probe p LEFT JOIN rs USING (event_id) LEFT JOIN azs USING (event_id))
    """


def _heatmap_sql():
    cols = ", ".join(f"avg(CAST(score AS DOUBLE)) FILTER (WHERE {hour_sql()} = {h}) AS h{h:02d}" for h in range(24))
    return with_views(f"SELECT coalesce(CAST(az_id AS VARCHAR), '') AS az_id, {cols} FROM ({_rows(8, True)}) r GROUP BY 1", "sps")


_VERDICT = f"""
    , named AS (SELECT * FROM scen WHERE ordinal <= 5),
    cap AS (SELECT CASE WHEN (SELECT sum(ticks) FROM named WHERE capacity = 8) > 0 THEN 8 ELSE 1 END AS c),
    ch AS (SELECT * FROM named WHERE capacity = (SELECT c FROM cap)),
    v AS (SELECT (SELECT c FROM cap) AS capacity,
            (SELECT scenario FROM ch WHERE coalesce(p_good, 0) >= 0.8 ORDER BY ordinal LIMIT 1) AS good,
            (SELECT scenario FROM ch WHERE coalesce(p_good, 0) >= 0.5 ORDER BY ordinal LIMIT 1) AS marginal,
            (SELECT max(coalesce(p_good, 0.0)) FROM ch) AS best_case_p),
    h AS ({_hourly_sql(8)}),
    hb AS (SELECT (SELECT hour FROM h ORDER BY coalesce(p_good, 0.0) DESC, hour LIMIT 1) AS best_hour,
                  (SELECT max(coalesce(p_good, 0.0)) FROM h) AS best_hour_p,
                  (SELECT avg(coalesce(p_good, 0.0)) FROM h) AS avg_hour_p)
    SELECT capacity, coalesce(good, marginal) AS winner,
           CASE WHEN good IS NOT NULL THEN 'good' WHEN marginal IS NOT NULL THEN 'marginal' ELSE 'never' END AS level,
           best_case_p,
           CASE WHEN best_hour_p > 0 THEN best_hour END AS best_hour,
           CASE WHEN best_hour_p > 0 THEN best_hour_p END AS best_hour_p,
           CASE WHEN best_hour_p > 0 THEN avg_hour_p END AS avg_hour_p
    FROM v, hb
"""


def _inject(sql_with_views: str, extra_ctes: str, final: str) -> str:
    """Append CTEs (text starting with ',') after the adapter CTEs."""
    head, _, _tail = sql_with_views.rpartition("\nSELECT 1")
    return head + "\n" + extra_ctes + "\n" + final


def _ctes(*views) -> str:
    return with_views("SELECT 1", *views).rpartition("\nSELECT 1")[0]


ORACLE = {
    "market_scenarios": _ctes("sps") + _scenarios_sql() + "SELECT * FROM scen",
    "market_hourly_odds": with_views(_hourly_sql(8), "sps"),
    "market_dow_hour_odds": with_views(_hourly_sql(1, weekday=True), "sps"),
    "market_heatmap": _heatmap_sql(),
    "market_availability": with_views(f"SELECT * FROM {_avail_sql(8)} x", "sps"),
    "market_headline": with_views(
        f"""SELECT (SELECT max(best) FROM {_avail_sql(8, HOME_REGION)} a) AS home_best,
              (SELECT coalesce(sum(CASE WHEN good_samples > 0 THEN 1 ELSE 0 END), 0) FROM {_avail_sql(8, HOME_REGION)} a)::BIGINT AS home_good_pools,
              (SELECT coalesce(max(longest_good_s), 0.0) FROM {_avail_sql(8, HOME_REGION)} a) AS home_longest_good_s,
              (SELECT max(best) FROM {_avail_sql(8)} a) AS world_best,
              (SELECT coalesce(sum(CASE WHEN good_samples > 0 THEN 1 ELSE 0 END), 0) FROM {_avail_sql(8)} a)::BIGINT AS world_good_pools,
              (SELECT max(best) FROM {_avail_sql(1, HOME_REGION)} a) AS home_cap1_best,
              (SELECT count(*) FROM {_avail_sql(8, HOME_REGION)} a) AS pools,
              CAST({THRESHOLD} AS DOUBLE) AS threshold""",
        "sps",
    ),
    "market_rank_pools": with_views(
        f"""SELECT coalesce(region,'') AS region, coalesce(az_id,'') AS az_id, coalesce(instance_type,'') AS instance_type,
              avg(CAST(score AS DOUBLE)) AS mean, avg(CASE WHEN score >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS p_good,
              count(*) AS samples
            FROM ({_rows(1, True)}) r WHERE instance_type <> 'any' GROUP BY 1, 2, 3
            ORDER BY mean DESC, p_good DESC, region, az_id, instance_type LIMIT 15""",
        "sps",
    ),
    "market_price_summary": with_views(
        """SELECT coalesce(region,'') AS region, coalesce(az,'') AS az, coalesce(instance_type,'') AS instance_type,
              median(price_usd) AS median_usd, min(price_usd) AS min_usd, max(price_usd) AS max_usd, count(*) AS samples
            FROM price GROUP BY 1, 2, 3 ORDER BY median_usd, region, az, instance_type LIMIT 12""",
        "price",
    ),
    "market_interruptions": with_views(
        """SELECT region, instance_type, t, record_id, interruption_range, interruption_index, savings_pct FROM (
              SELECT *, row_number() OVER (PARTITION BY region, instance_type ORDER BY t DESC, record_id DESC) AS rn
              FROM interruption) x WHERE rn = 1""",
        "interruption",
    ),
    "market_leaderboard": with_views(
        f"""SELECT coalesce(region,'') AS region, coalesce(az_id,'') AS az_id, coalesce(instance_type,'') AS instance_type,
              max(CAST(score AS DOUBLE)) AS best, avg(CAST(score AS DOUBLE)) AS mean, count(*) AS samples
            FROM ({_rows(8, True, 'global_top10')}) r GROUP BY 1, 2, 3
            ORDER BY best DESC, samples DESC, region, az_id, instance_type LIMIT 10""",
        "sps",
    ),
    "market_coverage": with_views(
        """SELECT (SELECT count(*) FROM tick) AS ticks,
              (SELECT CAST(coalesce(sum(sps_requests), 0) AS BIGINT) FROM tick) AS requested,
              (SELECT count(*) FROM sps_gap) AS gaps,
              (SELECT count(*) FROM sps_gap WHERE throttled) AS throttled,
              (SELECT count(*) FROM sps_gap WHERE config_capped) AS config_capped,
              (SELECT count(DISTINCT (coalesce(scope,'region'), coalesce(instance_type,''), capacity, coalesce(single_az, true),
                  CASE WHEN coalesce(scope,'region') = 'region' THEN coalesce(region,'') ELSE '*' END)) FROM sps) AS configs_ok,
              (SELECT count(DISTINCT (coalesce(scope,'region'), coalesce(instance_type,''), capacity, coalesce(single_az, true),
                  CASE WHEN coalesce(scope,'region') = 'region' THEN coalesce(region,'') ELSE '*' END)) FROM sps_gap WHERE config_capped) AS configs_refused,
              (SELECT coalesce(max(config_budget), 0) FROM tick) AS config_budget,
              (SELECT CASE WHEN sum(sps_requests) > 0 THEN (SELECT count(*) FROM sps_gap) / sum(sps_requests) END FROM tick) AS gap_pct,
              (SELECT coalesce((max(t) - min(t)) / 3600.0, 0.0) FROM tick) AS span_hours""",
        "tick", "sps_gap", "sps",
    ),
    "market_calibration": _ctes("sps", "probe", "az_map") + _calibration_sql() + "SELECT * FROM cal",
    "market_probe_bands": _ctes("sps", "probe", "az_map") + _calibration_sql()
    + """SELECT CASE WHEN region_score IS NULL THEN 'no score' ELSE 'score ' || CAST(CAST(region_score AS INTEGER) AS VARCHAR) END AS band,
           CAST(sum(CASE WHEN capacity_available THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, count(*) AS probes
         FROM cal GROUP BY 1""",
    "market_az_names": with_views(
        "SELECT az_id, first(az ORDER BY t DESC, az DESC) AS az_name FROM az_map WHERE az_id IS NOT NULL AND az_id <> '' GROUP BY az_id",
        "az_map",
    ),
    "market_verdict": _ctes("sps") + _scenarios_sql() + _VERDICT,
    "market_home_az": with_views(f"SELECT {_home_az_sql(8)} AS az_id", "sps"),
}
ORACLE["market_envelopes"] = with_views(
    """SELECT 'sps' AS type, tick_id, strftime(make_timestamp(CAST(floor(t) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, round(t, 3) AS t,
         region, az_id, instance_type, score FROM sps""",
    "sps",
)
