"""The adapter rules of ``skiff.sources.driver`` stated in DuckDB SQL.

Each entry is a CTE body; ``with_views(sql, names)`` prefixes a query with
the CTEs it needs (dependencies first).  Hours and weekdays are computed
arithmetically from epoch seconds so no session time zone is involved.
"""

from __future__ import annotations

_TYPE = (
    "CASE event_type WHEN 'signup' THEN 'g5.xlarge' WHEN 'view' THEN 'g4dn.xlarge' "
    "WHEN 'click' THEN 'g6.xlarge' WHEN 'error' THEN 'p3.2xlarge' WHEN 'purchase' THEN 'any' END"
)
_STATE = (
    "CASE event_type WHEN 'signup' THEN 'provisioning' WHEN 'view' THEN 'training' "
    "WHEN 'click' THEN 'stalled' WHEN 'error' THEN 'killed' WHEN 'purchase' THEN 'epoch' END"
)
_PTYPE = (
    "CASE {x} % 4 WHEN 0 THEN 'g5.xlarge' WHEN 1 THEN 'g4dn.xlarge' WHEN 2 THEN 'g6.xlarge' ELSE 'p3.2xlarge' END"
)
_REGION = "'region-' || CAST(({x} % 6) // 2 AS VARCHAR)"
_AZNAME = "'region-' || CAST(({x} % 6) // 2 AS VARCHAR) || CASE WHEN ({x} % 6) % 2 = 0 THEN 'a' ELSE 'b' END"

VIEWS: dict[str, tuple[list[str], str]] = {
    "ev": (
        [],
        """SELECT event_id, user_id, event_type, value,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
             epoch_us(ts) AS t_us, epoch_us(ts) / 1e6 AS t
           FROM events""",
    ),
    "sps": (
        ["ev"],
        f"""SELECT 'sps' AS type, t_us // 3600000000 AS tick_id, t,
             {_REGION.format(x='user_id')} AS region,
             'az-' || CAST(user_id % 6 AS VARCHAR) AS az_id,
             {_TYPE} AS instance_type,
             CASE WHEN event_id % 2 = 0 THEN 8 ELSE 1 END AS capacity,
             event_id % 5 <> 1 AS single_az,
             CASE WHEN event_id % 10 = 0 THEN 'global_top10' WHEN event_id % 10 = 5 THEN NULL ELSE 'region' END AS scope,
             1 + k % 10 AS score
           FROM ev""",
    ),
    "az_map": (
        ["ev"],
        f"""SELECT DISTINCT CAST((t_us // 86400000000) * 86400 AS DOUBLE) AS t,
             {_REGION.format(x='user_id')} AS region,
             'az-' || CAST(user_id % 6 AS VARCHAR) AS az_id,
             {_AZNAME.format(x='user_id')} AS az
           FROM ev""",
    ),
    "probe": (
        ["ev"],
        f"""SELECT event_id, t,
             strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS ts,
             {_REGION.format(x='user_id')} AS region,
             CASE WHEN k % 11 = 0 THEN NULL ELSE {_AZNAME.format(x='user_id')} END AS az,
             {_TYPE} AS instance_type,
             k % 3 <> 0 AS capacity_available,
             CASE WHEN k % 3 <> 0 THEN '' ELSE 'InsufficientInstanceCapacity' END AS error_code
           FROM ev WHERE event_type <> 'purchase'""",
    ),
    "price": (
        [],
        f"""SELECT epoch_us(l_shipdate) / 1e6 + l_linenumber AS t,
             {_REGION.format(x='l_suppkey')} AS region,
             {_AZNAME.format(x='l_suppkey')} AS az,
             {_PTYPE.format(x='l_partkey')} AS instance_type,
             l_extendedprice / l_quantity / 1000.0 AS price_usd
           FROM lineitem""",
    ),
    "interruption": (
        [],
        f"""SELECT epoch_us(o_orderdate) / 1e6 AS t, o_orderkey AS record_id,
             'region-' || CAST(o_custkey % 3 AS VARCHAR) AS region,
             {_PTYPE.format(x='o_orderkey')} AS instance_type,
             CASE o_orderkey % 5 WHEN 0 THEN '<5%' WHEN 1 THEN '5-10%' WHEN 2 THEN '10-15%'
                  WHEN 3 THEN '15-20%' ELSE '>20%' END AS interruption_range,
             CAST(o_orderkey % 5 AS INTEGER) AS interruption_index,
             CAST(50 + o_custkey % 40 AS INTEGER) AS savings_pct
           FROM orders""",
    ),
    "sps_gap": (
        ["ev"],
        f"""SELECT t_us // 3600000000 AS tick_id, t,
             {_REGION.format(x='user_id')} AS region, 'p3.2xlarge' AS instance_type,
             CASE WHEN event_id % 2 = 0 THEN 8 ELSE 1 END AS capacity,
             event_id % 5 <> 1 AS single_az, 'region' AS scope,
             k % 2 = 0 AS throttled, k % 5 = 0 AS config_capped
           FROM ev WHERE event_type = 'error'""",
    ),
    "tick": (
        ["ev"],
        """SELECT tick_id, min(t) AS t, CAST(count(*) AS INTEGER) AS sps_requests,
             CAST(20 + tick_id % 3 AS INTEGER) AS config_budget
           FROM (SELECT t_us // 3600000000 AS tick_id, t FROM ev) x GROUP BY tick_id""",
    ),
}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{sql}"


def hour_sql(t: str = "t") -> str:
    return f"CAST(floor({t} / 3600) AS BIGINT) % 24"


def weekday_sql(t: str = "t") -> str:
    return f"['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][CAST((floor({t} / 86400) + 4) AS BIGINT) % 7 + 1]"

VIEWS.update({
    "req": (
        ["ev"],
        """SELECT 'load-' || CAST(1 + user_id % 8 AS VARCHAR) AS test_id, CAST(1 + user_id % 8 AS INTEGER) AS level,
             event_id, t AS sent_at, 'w' || CAST(user_id % 10 AS VARCHAR) AS worker_id,
             20.0 + value * CAST(1 + user_id % 8 AS INTEGER) / 10.0 AS latency_ms,
             (event_type = 'error' AND k % 25 = 0) AS failed,
             CAST(CASE WHEN event_type = 'error' AND k % 25 = 0 THEN 500 + k % 4
                  WHEN event_type = 'error' AND k % 25 = 5 THEN NULL
                  WHEN event_type = 'click' AND k % 10 = 0 THEN 429 ELSE 200 END AS INTEGER) AS status,
             k % 7 = 0 AS rerouted, CAST(k AS BIGINT) AS tokens
           FROM ev""",
    ),
    "scrape": (
        ["ev"],
        """SELECT 'fleet-0' AS fleet, CAST(tick * 3600 AS DOUBLE) AS ts, worker_id, bad = 0 AS ok,
             tick // 168 AS counter_epoch, d_requests, d_tokens, d_gen, in_flight
           FROM (SELECT t_us // 3600000000 AS tick, 'w' || CAST(user_id % 10 AS VARCHAR) AS worker_id,
                   count(*) AS d_requests, CAST(sum(k) AS BIGINT) AS d_tokens, sum(value / 1000.0) AS d_gen,
                   CAST(max(k % 5) AS INTEGER) AS in_flight,
                   max(CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 1 ELSE 0 END) AS bad
                 FROM ev GROUP BY 1, 2) x""",
    ),
    "heartbeat": (
        ["ev"],
        """SELECT 'w' || CAST(user_id % 10 AS VARCHAR) AS worker_id,
             CASE WHEN k % 13 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id % 10 AS VARCHAR) || ':8000' END AS addr,
             'gpt2' AS model, CASE WHEN (user_id % 10) % 2 = 0 THEN 'spot' ELSE 'on-demand' END AS market,
             event_id AS requests_served, t AS last_seen
           FROM ev""",
    ),
})

_NODE = "CAST((user_id // 12) % 8 AS INTEGER)"
_ATT = "CAST(user_id // 96 AS INTEGER)"
_MEMBERS = "list_filter(range(0, 8), lambda i: ((({e}) * 37 + ({r}) * 11) % 256 >> i) & 1 = 1)"

VIEWS.update({
    "lifecycle": (
        ["ev"],
        f"""SELECT event_id, 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id,
             CASE WHEN event_type <> 'purchase' THEN {_NODE} END AS node,
             CASE WHEN event_type <> 'purchase' THEN {_ATT} END AS attempt,
             t AS ts, {_STATE} AS state,
             CASE WHEN event_type IN ('view', 'click') THEN CAST(k AS BIGINT) END AS step,
             CASE WHEN event_type = 'purchase' THEN CAST(1 + k % 8 AS INTEGER) END AS world,
             CASE WHEN event_type = 'purchase' THEN CAST(k % 3 AS INTEGER) END AS leader,
             CASE WHEN event_type = 'purchase' THEN 'orch' ELSE 'sidecar' END AS by
           FROM ev""",
    ),
    "steps": (
        ["ev"],
        f"""SELECT event_id, 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, {_NODE} AS node, {_ATT} AS attempt,
             CAST(CASE WHEN event_type = 'error' THEN greatest(event_id - 40, 0) ELSE event_id END AS BIGINT) AS step,
             value / 50.0 AS loss, CAST(100 + k * 10 AS INTEGER) AS ms, CAST((100 + k * 10) * 3 AS INTEGER) AS tok_s,
             CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 1 + k % 8 END AS INTEGER) AS ws, t
           FROM ev WHERE event_type <> 'purchase'""",
    ),
    "ticks": (
        ["ev"],
        f"""SELECT event_id, 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, t, t AS updated_at,
             CAST(event_id // 500 AS INTEGER) AS epoch,
             {_MEMBERS.format(e='event_id // 500', r='user_id % 12')} AS members,
             CAST(CASE WHEN event_id < 40 THEN -1 ELSE event_id // 2 END AS BIGINT) AS ckpt_step,
             false AS done, k, user_id % 12 AS run_no
           FROM ev WHERE event_type = 'purchase'""",
    ),
    "tick_nodes": (
        ["ticks"],
        """SELECT run_id, t, i AS node, epoch % 3 AS attempt,
             'i-' || lpad(CAST(run_no * 1000 + i * 10 + epoch % 3 AS VARCHAR), 8, '0') AS instance_id,
             CASE WHEN list_contains(members, i) THEN 'running' WHEN (k + i) % 3 = 0 THEN 'pending'
                  WHEN (k + i) % 3 = 1 THEN 'shutting-down' ELSE 'terminated' END AS aws_state
           FROM ticks, range(0, 8) r(i)""",
    ),
    "epoch_log": (
        ["ev"],
        f"""SELECT 'run-' || CAST(run_no AS VARCHAR) AS run_id, epoch,
             {_MEMBERS.format(e='epoch', r='run_no')} AS members,
             coalesce(list_min({_MEMBERS.format(e='epoch', r='run_no')}), 0) AS master
           FROM (SELECT DISTINCT user_id % 12 AS run_no, CAST(event_id // 500 AS INTEGER) AS epoch
                 FROM ev WHERE event_type = 'purchase') d""",
    ),
    "restart_log": (
        ["ev"],
        "SELECT 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, t FROM ev WHERE event_type = 'error'",
    ),
    "terminations": (
        ["ev"],
        f"""SELECT 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, event_id AS pos, {_NODE} AS node,
             'i-' || lpad(CAST((user_id % 12) * 1000 + {_NODE} * 10 + {_ATT} AS VARCHAR), 8, '0') AS instance_id
           FROM ev WHERE event_type = 'error'""",
    ),
    "ledger": (
        [],
        """SELECT 'run-' || CAST(o_custkey % 12 AS VARCHAR) AS run_id,
             'i-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS instance_id,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'spot' ELSE 'on-demand' END AS market,
             'region-' || CAST(o_custkey % 3 AS VARCHAR) || 'a' AS az,
             CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 100000.0 END AS hourly_usd,
             1704067200.0 + (epoch_us(o_orderdate) / 1e6 - 788918400.0) / 80.0 AS started_at,
             CASE WHEN l.last_ship > o_orderdate THEN 1704067200.0 + (epoch_us(l.last_ship) / 1e6 - 788918400.0) / 80.0 END AS stopped_at
           FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) l
             ON o.o_orderkey = l.l_orderkey""",
    ),
})

VIEWS.update({
    "evals": (
        ["ev"],
        """SELECT 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, CAST(event_id + 5 AS BIGINT) AS step, value / 60.0 AS loss
           FROM ev, (SELECT 1 AS c UNION ALL SELECT 2) x WHERE event_type = 'signup' AND (c = 1 OR k % 5 = 0)""",
    ),
    "rank_lines": (
        ["ev"],
        f"""SELECT event_id, 'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id, {_NODE} AS slot, {_ATT} AS gen,
             CAST(event_id + 3 AS BIGINT) AS step, CASE WHEN k % 2 = 0 THEN t END AS t
           FROM ev WHERE event_type = 'click'""",
    ),
})

VIEWS.update({
    "node_obs": (
        ["tick_nodes", "ticks"],
        """SELECT n.run_id, n.t, t.event_id, t.epoch, t.members, n.node, n.attempt, n.aws_state,
             (t.k + n.node) % 7 <> 0 AS registered,
             CASE WHEN (t.k + n.node) % 5 = 0 THEN NULL ELSE CAST((t.k * 3 + n.node * 17) % 200 AS DOUBLE) END AS log_age_s
           FROM tick_nodes n JOIN ticks t USING (run_id, t)""",
    ),
    "ckpt_listing": (
        [],
        """SELECT run_id, CASE WHEN tier = 'local' THEN rnk END AS rank, tier,
             'runs/' || run_id || '/ckpt/' || tier || CASE WHEN tier = 'local' THEN '/rank' || CAST(rnk AS VARCHAR) ELSE '' END
               || '/ckpt-' || lpad(CAST(step AS VARCHAR), 12, '0') || '.pt' || CASE WHEN l_suppkey % 17 = 0 THEN '.tmp' ELSE '' END AS path,
             CAST(l_quantity * 1000 AS BIGINT) AS size
           FROM (SELECT *, 'run-' || CAST(l_orderkey % 12 AS VARCHAR) AS run_id,
                        CASE WHEN l_partkey % 3 = 0 THEN 'local' ELSE 'durable' END AS tier,
                        CAST(l_linenumber % 4 AS INTEGER) AS rnk,
                        CAST((l_orderkey // 12) * 10 + l_linenumber AS BIGINT) AS step FROM lineitem) x""",
    ),
})

VIEWS.update({
    "marks": (
        ["lifecycle"],
        f"""SELECT run_id, 'launch' AS event, min(ts) AS t, CAST(-2 AS BIGINT) AS seq FROM lifecycle GROUP BY run_id
           UNION ALL SELECT run_id, 'train_start', min(ts), CAST(-1 AS BIGINT) FROM lifecycle WHERE state = 'training' GROUP BY run_id
           UNION ALL SELECT run_id, CASE WHEN state = 'killed' THEN 'kill' WHEN state = 'provisioning' AND attempt > 0 THEN 'relaunch'
                                         WHEN state = 'epoch' AND world < 8 THEN 'shrink_resume' WHEN state = 'epoch' AND world = 8 THEN 'full_world' END,
                            ts, event_id FROM lifecycle
                     WHERE state = 'killed' OR (state = 'provisioning' AND attempt > 0) OR state = 'epoch'
           UNION ALL SELECT run_id, 'metrics', max(ts), CAST({1 << 62} AS BIGINT) FROM lifecycle GROUP BY run_id""",
    ),
})
