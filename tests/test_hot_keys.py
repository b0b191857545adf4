"""Operators that a dense stretch or a long run must not turn into one task: against plain definitions."""

import random

from pyspark.sql import functions as F

from skiff.functions import percentile
from skiff.operators import fleet, market


def test_near_max_equals_all_pairs_also_at_the_ends_of_the_window(spark):
    rng = random.Random(3)
    # a dense minute, sparse rows around it, exact distances of the window, null values and keys
    scores = [("a", 1000.0 + rng.random() * 60, rng.randint(1, 9)) for _ in range(1500)]
    scores += [(rng.choice("ab"), float(rng.randint(-4000, 6000)), rng.choice([1, 5, 9, None])) for _ in range(300)] + [(None, 10.0, 9)]
    probes = [(i, rng.choice("ab"), float(rng.randint(-4000, 6000))) for i in range(400)] + [(400 + i, "a", 1000.0 + i / 10) for i in range(600)] + [(2000, None, 10.0), (2001, "a", None)]
    left = spark.createDataFrame(probes, "event_id long, k string, t double")
    right = spark.createDataFrame(scores, "k string, s_t double, score int")
    found = market.near_max(left, right, ["k"], 900.0, "event_id", "score", "t", "s_t")
    expected = {}
    for i, k, t in probes:
        near = [v for sk, st, v in scores if k is not None and t is not None and sk == k and abs(t - st) <= 900 and v is not None]
        if near:
            expected[i] = max(near)
    assert {r.event_id: r.score for r in found.collect()} == expected
    # no pairs: rows out of every join are at most those of the marks and the scores
    plan = found._jdf.queryExecution()
    found.collect()
    sizes = joined_rows(plan.executedPlan())
    assert sizes and max(sizes) <= 3 * len(probes) + len(scores)


def joined_rows(node):
    """Rows out of the joins of an executed plan."""
    name, out = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return joined_rows(node.executedPlan())
    if "QueryStage" in name:
        return joined_rows(node.plan())
    if "Join" in name:
        out.append(node.metrics().apply("numOutputRows").value())
    children = node.children()
    for i in range(children.size()):
        out += joined_rows(children.apply(i))
    return out


def test_masters_of_a_long_run_equal_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = []
    for run in ("long", "short", "gone"):
        for i in range({"long": 400, "short": 3, "gone": 40}[run]):
            kind = rng.random()
            members = None if kind < 0.03 else [] if kind < 0.06 else rng.sample(range(8), rng.randint(1, 7))
            rows.append((run, float(i * 7 + rng.randint(0, 6)), i, i, members))
    expected = []
    for run in ("long", "short", "gone"):
        master, before = None, set()
        for _, t, _, epoch, members in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            now = set(members or [])
            if master not in now:
                master = min(now & before or now, default=None)
            expected.append((run, t, epoch, master))
            before = now
    df = spark.createDataFrame(rows, "run_id string, t double, event_id long, epoch int, members array<int>").repartition(5)
    for width in (20.0, 1e6):  # many buckets, one bucket
        got = sorted((tuple(r) for r in fleet.elect_masters(df, width).collect()), key=lambda r: (r[0], r[2]))
        assert got == sorted(expected, key=lambda r: (r[0], r[2]))
    assert fleet.elect_masters(df.limit(0)).count() == 0
    assert fleet.elect_masters(df, 20.0).select(F.countDistinct("run_id")).first()[0] == 3


def test_order_statistics_of_values_that_lie_close(spark):
    """A million distinct values within 0.1 % fill one bucket; two more levels leave few to the last scan."""
    n = 1_000_000
    near = spark.range(n).select(F.lit("a").alias("k"), (1000.0 + F.col("id") / F.lit(float(n))).alias("v"))
    rest = [("b", v) for v in (5.0, 5.0, -3.0, 0.0, 1e300, -1e300, 5.0)] + [("b", None), ("c", 7.0), ("d", None)]
    df = near.unionAll(spark.createDataFrame(rest, "k string, v double"))
    spec = {"p1": percentile.nearest_rank(1), "mid": percentile.upper_median(), "p99": percentile.rounded_index(99), "over": lambda c: c + 1}
    out = percentile.kth_values(df, ["k"], "v", spec, levels=3)
    got = {r.k: r for r in out.collect()}
    values = {"a": [1000.0 + i / float(n) for i in range(n)], "b": sorted(v for k, v in rest if k == "b" and v is not None), "c": [7.0]}
    assert set(got) == set(values)
    for k, x in values.items():
        m = len(x)
        assert (got[k].n, got[k].p1, got[k].mid, got[k].p99, got[k].over) == (m, x[max(1, -(-m // 100)) - 1], x[m // 2], x[round(0.99 * (m - 1))], None)
    # the last windows sort the parts of one bucket or what is left of it, not a million values
    plan = out._jdf.queryExecution()
    out.collect()
    sizes = sorted_rows(plan.executedPlan())
    assert sizes and max(sizes) <= 3 * 4096 + 100
    flat = percentile.kth_values(df, ["k"], "v", spec)
    plan = flat._jdf.queryExecution()
    flat.collect()
    assert max(sorted_rows(plan.executedPlan())) >= n
    same = percentile.kth_values(df.filter("k <> 'a'"), ["k"], "v", spec)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for k, r in got.items() if k != "a"}


def below(node):
    """The plans under one of an executed plan."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    if "QueryStage" in name:
        return [node.plan()]
    if name == "ReusedExchange":
        return [node.child()]
    return [node.children().apply(i) for i in range(node.children().size())]


def sorted_rows(node):
    """Rows that the exchanges (or counting nodes) under the windows of an executed plan passed on."""
    out = []
    if node.nodeName() == "Window":
        at = node
        while at is not None:
            metrics = at.metrics()
            counted = [m for m in ("shuffleRecordsWritten", "numOutputRows") if metrics.contains(m)]
            if counted:
                out.append(metrics.apply(counted[0]).value())
                break
            at = next(iter(below(at)), None)
    for child in below(node):
        out += sorted_rows(child)
    return out
