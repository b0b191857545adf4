"""Cost ledger and fleet-state cases from the reference's tests."""

from pyspark.sql import functions as F

from skiff.operators import fleet as FL
from skiff.operators import runs as R

LEDGER = "run_id string, instance_id string, hourly_usd double, started_at double, stopped_at double"


def test_ledger_cases(spark):
    rows = [("r", "i-1", 1.0, 0.0, 3600.0), ("r", "i-2", 2.0, 1800.0, 5400.0), ("r", "i-3", 0.5, 0.0, None), ("r", "i-4", None, 0.0, 100.0)]
    led = spark.createDataFrame(rows, LEDGER)
    tot = R.cost_totals(led, 7200.0).collect()[0]
    assert tot.total_usd == 1.0 + 2.0 + 1.0 and tot.rate_unknown_count == 1
    per = {r.instance_id: r for r in R.cost_ledger(led, 7200.0).collect()}
    assert per["i-3"].billed_seconds == 7200.0 and per["i-4"].usd is None
    q = spark.createDataFrame([("r", 900.0), ("r", 3600.0), ("r", 7200.0)], "run_id string, t double")
    got = {r.t: r.usd for r in R.cost_at(q, led, "t").collect()}
    assert abs(got[900.0] - (0.25 + 0.125)) < 1e-9
    assert abs(got[3600.0] - (1.0 + 1.0 + 0.5)) < 1e-9
    assert abs(got[7200.0] - (1.0 + 2.0 + 1.0)) < 1e-9


def test_two_node_run_without_ledger(spark):
    # 400 s on two g4dn.xlarge at the on-demand rate without a ledger: $0.117
    led = spark.createDataFrame([("r", "a", 0.526, 0.0, 400.0), ("r", "b", 0.526, 0.0, 400.0)], LEDGER)
    assert round(R.cost_totals(led, 400.0).collect()[0].total_usd, 3) == 0.117


def _listing(spark, rows):
    return spark.createDataFrame(rows, "run_id string, rank int, tier string, path string, size long")


def test_restore_point_cases(spark):
    ck = lambda s: f"ckpt-{s:012d}.pt"
    rows = [
        ("newer_local", 0, "local", f"l/{ck(30)}", 1), ("newer_local", None, "durable", f"d/{ck(20)}", 1),
        ("fallback", None, "durable", f"d/{ck(20)}", 1), ("fallback", 0, "local", f"l/{ck(10)}", 1),
        ("disagree", 0, "local", f"l/{ck(30)}", 1), ("disagree", 1, "local", f"l/{ck(20)}", 1), ("disagree", None, "durable", f"d/{ck(20)}", 1),
        ("temp", None, "durable", f"d/{ck(20)}", 1), ("temp", None, "durable", f"d/{ck(40)}.tmp", 1),
    ]
    ranks = spark.createDataFrame([(r, k) for r in ("newer_local", "fallback", "temp", "fresh") for k in (0,)] + [("disagree", 0), ("disagree", 1)],
                                  "run_id string, rank int")
    got = {(r.run_id, r.rank): (r.group_step, r.tier) for r in FL.restore_point(_listing(spark, rows), ranks).collect()}
    assert got[("newer_local", 0)] == (30, "local")
    assert got[("fallback", 0)] == (20, "durable")
    assert got[("disagree", 0)] == (20, "durable") and got[("disagree", 1)] == (20, "local")
    assert got[("temp", 0)] == (20, "durable")
    assert got[("fresh", 0)] == (-1, "fresh")


def test_retention_keep_and_disable(spark):
    rows = [("r", None, "durable", f"d/ckpt-{s:012d}.pt", 1) for s in range(1, 7)] + [("r", None, "durable", "d/ckpt-000000000009.pt.tmp", 1)]
    lst = _listing(spark, rows)
    assert sorted(r.step for r in FL.retention(lst, 2).collect()) == [1, 2, 3, 4]
    assert FL.retention(lst, 0).count() == 0


def test_sticky_master(spark):
    tl = spark.createDataFrame(
        [("r", 1.0, 1, 1, [0, 1]), ("r", 2.0, 2, 2, [1]), ("r", 3.0, 3, 3, [0, 1]), ("r", 4.0, 4, 4, [2, 3])],
        "run_id string, t double, event_id long, epoch int, members array<int>",
    )
    got = [r.master for r in FL.elect_masters(tl).orderBy("t").collect()]
    assert got == [0, 1, 1, 2]


def test_health_and_sticky_death(spark):
    obs = spark.createDataFrame(
        [("r", 1.0, 1, 0, 0, "running", True, None), ("r", 2.0, 2, 0, 0, "terminated", True, 1.0),
         ("r", 3.0, 3, 0, 0, "running", True, 1.0), ("r", 1.0, 1, 1, 0, "running", True, 500.0)],
        "run_id string, t double, event_id long, node int, attempt int, aws_state string, registered boolean, log_age_s double",
    )
    h = {(r.node, r.t): r.h for r in obs.select("node", "t", FL.healthy().alias("h")).collect()}
    assert h[(0, 1.0)] and not h[(1, 1.0)]
    st = {r.t: (r.state, r.transition) for r in FL.sticky_states(obs).filter(F.col("node") == 0).collect()}
    assert st == {1.0: ("live", "new"), 2.0: ("dead", "dead"), 3.0: ("dead", None)}


def test_mark_timeline_with_stamps(spark):
    from skiff.operators import profiles as P

    marks = spark.createDataFrame(
        [("r", "launch", 0.0, 0), ("r", "train_start", 100.0, 1), ("r", "kill", 200.0, 2), ("r", "relaunch", 230.0, 3),
         ("r", "train_start", 300.0, 4), ("r", "metrics", 500.0, 5), ("r", "unknown", 600.0, 6)],
        "run_id string, event string, t double, seq long")
    seg = [(r.phase, r.seconds, r.offset_s) for r in P.mark_segments(marks).orderBy("start").collect()]
    assert seg == [("provisioning", 100.0, 0.0), ("training", 100.0, 100.0), ("downtime", 30.0, 200.0),
                   ("preemption_recovery", 70.0, 230.0), ("training", 200.0, 300.0)]
    stamps = spark.createDataFrame([("r", 150.0, 20.0, 30.0, None)], "run_id string, train_s double, save_s double, eval_s double, sample_s double")
    seg2 = [(r.phase, r.seconds) for r in P.mark_segments(marks, stamps).orderBy("start", "offset_s").collect()]
    assert seg2[-3:] == [("training", 150.0), ("final_saves", 20.0), ("evaluation", 30.0)]


def test_retention_moves_no_listing(spark, monkeypatch):
    """As a sort of each key's names says, repeated names included; only the cuts are joined, by broadcast."""
    rows = [(f"r{i % 3}", (i % 2) or None, "local" if i % 2 else "durable", f"{'ab'[i % 5 == 0]}/ckpt-{i * 7 % 40:012d}.pt", 1) for i in range(400)]
    rows += [("few", None, "durable", f"d/ckpt-{s:012d}.pt", 1) for s in (4, 4)]
    lst = _listing(spark, rows).repartition(5)
    for keep in (1, 3, 17, 2_000):
        want = []
        for key in {r[:3] for r in rows}:
            names = sorted(((r[3].rpartition("/")[2], r[3]) for r in rows if r[:3] == key), reverse=True)
            want += [(*key, path) for _, path in names[keep:]]
        for limit in (1_000, 1):  # by each task's newest, and by selection
            monkeypatch.setattr(FL, "GROUP_LIMIT", limit)
            got = [(r.run_id, r.rank, r.tier, r.path) for r in FL.retention(lst, keep).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    monkeypatch.setattr(FL, "GROUP_LIMIT", 1_000)
    plan = FL.retention(lst, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "WindowGroupLimit" in plan
