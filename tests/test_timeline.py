"""Lifecycle events -> timelines on a made-up run of three nodes: node 2 stalls
and dies, nodes 0 and 1 roll back from step 52 to step 40, node 2 comes back as
a second attempt, and the leader moves twice."""

from pyspark.sql import functions as F

from skiff.operators import timeline as T
from skiff.operators.asof import asof_join

COLS = "event_id long, run_id string, ts double, state string, node int, attempt int, world int, leader int, step long"
ROWS = [
    # ts, state, node, attempt, world, leader, step
    (0, "provisioning", 0, 0, None, None, None),
    (5, "provisioning", 1, 0, None, None, None),
    (7, "provisioning", 2, 0, None, None, None),
    (30, "epoch", None, None, 3, 2, None),
    (30, "training", 0, 0, 3, None, 0),
    (30, "training", 1, 0, 3, None, 0),
    (30, "training", 2, 0, 3, None, 0),
    (130, "stalled", 2, 0, 3, None, 50),
    (135, "killed", 2, 0, None, None, None),
    (136, "stalled", 0, 0, 3, None, 52),
    (136, "stalled", 1, 0, 3, None, 52),
    (140, "epoch", None, None, 2, 0, None),
    (141, "reconfiguring", 0, 0, 2, None, None),
    (141, "reconfiguring", 1, 0, 2, None, None),
    (150, "training", 0, 0, 2, None, 40),
    (150, "training", 1, 0, 2, None, 40),
    (160, "provisioning", 2, 1, None, None, None),
    (220, "epoch", None, None, 3, 0, None),
    (220, "training", 2, 1, 3, None, 75),
    (230, "provisioning", 1, 1, None, None, None),
    (260, "epoch", None, None, 3, 1, None),
]
END = 300.0


def events(spark):
    rows = [(i, "r", float(ts), state, node, attempt, world, leader, step) for i, (ts, state, node, attempt, world, leader, step) in enumerate(ROWS)]
    return spark.createDataFrame(rows, COLS).repartition(4)


def test_node_rows_labels_and_wasted(spark):
    ev = events(spark)
    rows = {}
    for s in T.node_spans(ev, END).orderBy("node", "attempt", "start").collect():
        rows.setdefault((s.node, s.attempt), []).append((s.label, round(s.start_rel, 6), round(s.duration, 6)))
    redo = 12 / (52 / 106)  # 12 steps lost at 52 steps in 106 seconds
    assert rows[(0, 0)] == [("prov", 0, 30), ("train", 30, 106), ("stalled", 136, 14), ("wasted", 150, round(redo, 6)), ("train", round(150 + redo, 6), round(150 - redo, 6))]
    assert [x[0] for x in rows[(1, 0)]] == ["prov", "train", "stalled", "wasted", "train"]
    assert rows[(2, 0)] == [("prov", 7, 23), ("train", 30, 100), ("stalled", 130, 5), ("down", 135, 165)]
    assert rows[(2, 1)] == [("prov", 160, 60), ("train", 220, 80)]
    assert sorted((w.node, w.attempt, w.wasted_steps) for w in T.wasted_totals(ev).collect()) == [(0, 0, 12), (1, 0, 12)]
    marks = sorted((m.marker, m.ts, m.node, m.attempt) for m in T.markers(ev).collect())
    assert marks == [("kill", 135.0, 2, 0), ("realized", 141.0, 0, 0), ("realized", 141.0, 1, 0)]


def test_world_staircase_and_degraded(spark):
    ws = T.world_spans(events(spark), END)
    assert sorted((r.start_rel, r.duration, r.world) for r in ws.collect()) == [(30.0, 110.0, 3), (140.0, 80.0, 2), (220.0, 80.0, 3)]
    assert [(d.start_rel, d.duration, d.min_world) for d in T.degraded_windows(ws).collect()] == [(140.0, 80.0, 2)]
    summary = T.degraded_summary(ws).collect()[0]
    assert (summary.full_world, summary.current, summary.total, summary.windows) == (3, 3, 80.0, 1)


def test_leader_handovers_current_and_row(spark):
    ev = events(spark)
    assert sorted((r.ts, r.leader) for r in T.leader_handovers(ev).collect()) == [(30.0, 2), (140.0, 0), (260.0, 1)]
    assert [T.current_leader(ev, t).collect()[0].leader for t in (100.0, 200.0, 299.0)] == [2, 0, 1]
    rows = sorted((r.ts, r.node, r.attempt) for r in T.leader_rows(ev).collect())
    assert rows == [(30.0, 2, 0), (140.0, 0, 0), (260.0, 1, 1)]


TIMELINE = "run_id string, t double, event_id long, epoch int, members array<int>, master int"


def test_member_changes_and_survivors(spark):
    rows = [("r", 1.0, 1, 1, [0, 1, 2, 3, 4], 0), ("r", 2.0, 2, 2, [0, 2, 4], 0), ("r", 3.0, 3, 3, [0, 2, 3, 4], 0), ("r", 5.0, 4, 4, [1, 2, 3, 4], 1)]
    tl = spark.createDataFrame(rows, TIMELINE)
    assert sorted((r.t, r.kind, r.node) for r in T.member_changes(tl).collect()) == [(2.0, "lost", 1), (2.0, "lost", 3), (3.0, "joined", 3), (5.0, "joined", 1), (5.0, "lost", 0)]
    assert sorted((r.t, tuple(r.survivors)) for r in T.survivors(tl).collect()) == [(2.0, (0, 2, 4)), (3.0, (0, 2, 4)), (5.0, (2, 3, 4))]


def test_epochs_missing_from_the_log_are_skipped(spark):
    ticks = spark.createDataFrame([("r", 1.0, 1, 1), ("r", 2.0, 2, 2), ("r", 3.0, 3, 2), ("r", 4.0, 4, 3), ("r", 5.0, 5, 1)], "run_id string, t double, event_id long, epoch int")
    log = spark.createDataFrame([("r", 1, [0, 1], 0), ("r", 3, [1], 1)], "run_id string, epoch int, members array<int>, master int")  # epoch 2 was never logged
    got = sorted((r.t, r.epoch, tuple(r.members), r.master) for r in T.epoch_timeline(ticks, log).collect())
    assert got == [(1.0, 1, (0, 1), 0), (4.0, 3, (1,), 1), (5.0, 1, (0, 1), 0)]


def test_asof_ties_go_to_the_last_in_order(spark):
    left = spark.createDataFrame([("k", 10.0, 1), ("k", 20.0, 2), ("k", 5.0, 3)], "k string, t double, id int")
    right = [("k", 10.0, 3, "c"), ("k", 10.0, 9, "a"), ("k", 10.0, 4, "d"), ("k", 20.0, 1, "x"), ("k", 20.0, 1, "y")]
    for order in (right, right[::-1]):
        df = spark.createDataFrame(order, "k string, t double, n int, v string").repartition(3)
        got = {r.id: r.v for r in asof_join(left, df, ["k"], "t", "t", ["v"], right_tiebreak=["n"]).collect()}
        assert got == {1: "a", 2: "y", 3: None}


def test_kill_pairs_follow_the_log_order(spark):
    rows = [("r", ("a.log", 0, 5), 1, "i-1"), ("r", ("a.log", 0, 9), 2, "i-2"), ("r", ("a.log", 128, 2), 0, "i-0"), ("r", ("b.log", 0, 1), 1, "i-1")]
    terms = spark.createDataFrame(rows, "run_id string, pos struct<file:string,block:long,seq:long>, node int, instance_id string").repartition(4)
    kills = spark.createDataFrame([("r", 30.0, 3), ("r", 10.0, 1), ("r", 20.0, 2), ("r", 40.0, 4)], "run_id string, ts double, event_id long")
    assert sorted((r.ordinal, r.node, r.ts) for r in T.kill_times(terms, kills).collect()) == [(1, 1, 10.0), (2, 2, 20.0), (3, 0, 30.0)]


def test_occupancy_grid_with_replacement(spark):
    tl = spark.createDataFrame([("r", 60.0, 1, 1, [0, 1, 2], 2), ("r", 500.0, 2, 2, [0, 1], 0), ("r", 700.0, 3, 3, [0], 0), ("r", 900.0, 4, 4, [0, 1, 2], 0)], TIMELINE)

    def nodes(*states):
        return [(i, 0, f"i-{i}", s) for i, s in enumerate(states)]

    ticks = spark.createDataFrame(
        [("r", 20.0, 10, nodes("pending", "pending", "terminated")), ("r", 400.0, 11, nodes("running", "running", "running")),
         ("r", 510.0, 12, nodes("running", "running", "terminated")), ("r", 710.0, 13, nodes("running", "terminated", "terminated")),
         ("r", 950.0, 14, nodes("running", "running", "running"))],
        "run_id string, t double, event_id long, nodes array<struct<node:int,attempt:int,instance_id:string,aws_state:string>>")
    # slot 1 (down 700-900) takes the machine of 600, slot 2 (down 500-900) the next, of 650
    ledger = spark.createDataFrame([("r", 0.0), ("r", 600.0), ("r", 650.0)], "run_id string, started_at double")
    rows = [(r.time, r.slot0, r.slot1, r.slot2) for r in T.occupancy(tl, ticks, ledger, 3).orderBy("time").collect()]
    assert rows == [
        (20000, "provisioning", "provisioning", "down"), (60000, "training", "training", "leader"),
        (500000, "leader", "training", "provisioning"), (510000, "leader", "training", "down"),
        (650000, "leader", "training", "provisioning"), (700000, "leader", "provisioning", "provisioning"), (900000, "leader", "training", "training"),
    ]


def _walk(downs, starts, lead=180.0, pre=60.0):
    """First fit one period after the other: slots ascending, each slot in time order."""
    out = []
    for run in {d[0] for d in downs}:
        mine = [d for d in downs if d[0] == run]
        firsts = [d[4] for d in mine if d[4] is not None]
        after = min(firsts) - pre if firsts else 0.0
        free = sorted(s for r, s in starts if r == run and s > after)
        for _, slot, t_out, t_in, _ in sorted(mine, key=lambda d: (d[1], d[2])):
            until = float("inf") if t_in is None else t_in
            fits = [s for s in free if t_out - lead <= s < until]
            if fits:
                free.remove(fits[0])
                out.append((run, slot, max(fits[0], t_out), until))
    return sorted(out)


def _replaced(spark, downs, starts, **kw):
    d = spark.createDataFrame(downs, "run_id string, slot int, t_out double, t_in double, first_epoch double").repartition(3)
    s = spark.createDataFrame(starts, "run_id string, started_at double").repartition(3)
    return sorted(tuple(r) for r in T.assign_replacements(d, s, **kw).select("run_id", "slot", "a", "b").collect())


def test_replacements_equal_a_walk_over_periods(spark):
    """Slots that flap within the lead time, machines that are scarce, equal starts, starts on
    a bound, open periods, a run without epochs, cut into short and long buckets."""
    import random

    rng = random.Random(7)
    downs, starts = [], []
    for r in range(12):
        run, first = f"r{r}", None if r == 0 else 100.0
        for slot in range(rng.randint(1, 5)):
            t = rng.randint(0, 20) * 20.0
            for _ in range(rng.randint(1, 25)):
                back = t + rng.randint(1, 12) * 20.0
                open_end = rng.random() < 0.05
                downs.append((run, slot, t, None if open_end else back, first))
                if open_end:
                    break
                t = back + rng.randint(0, 10) * 20.0
        starts += [(run, rng.randint(0, 300) * 20.0) for _ in range(rng.choice([0, 5, 20, 60, 150]))]
    want = _walk(downs, starts)
    assert len(want) > 100
    assert _replaced(spark, downs, starts, width=300.0) == want
    assert _replaced(spark, downs, starts) == want


def test_replacements_of_empty_tables(spark):
    assert _replaced(spark, [], [("r", 5.0)]) == []
    assert _replaced(spark, [("r", 0, 1.0, None, 0.0)], []) == []


def test_replacements_in_a_round_per_slot(spark, monkeypatch):
    """Each slot is fitted once, to rows that count the machines of one start; periods are folded
    in buckets of rows, whatever their times."""
    downs = [("r", slot, 1000.0 + 40 * i + slot, 1030.0 + 40 * i + slot, 100.0) for slot in range(2) for i in range(9)]
    starts = [("r", 1010.0)] * 7 + [("r", 1100.0)] * 2 + [("r", 1310.0)] * 500
    want = _walk(downs, starts)
    rounds, fit = [], T._first_fit

    def seen(periods, free, width):
        rounds.append((sorted({r.slot for r in periods.select("slot").collect()}), free.count()))
        return fit(periods, free, width)

    monkeypatch.setattr(T, "_first_fit", seen)
    monkeypatch.setattr(T, "FIT_ROWS", 4)
    assert _replaced(spark, downs, starts) == want
    assert [slots for slots, _ in rounds] == [[0], [1]] and all(rows <= 3 for _, rows in rounds)
