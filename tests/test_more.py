"""Remaining readers, writers and small operators."""

import json
import os

from pyspark.sql import functions as F

from skiff.functions.numeric import human_bytes, prep_estimate_usd
from skiff.functions.percentile import kth_values, rank_rule
from skiff.operators import experiments as X
from skiff.operators import market as M
from skiff.sinks import writers as W
from skiff.sources import files as S


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_profiles_samples_advisor_discover(spark, tmpdir_path):
    prof = {"run_id": "r1", "kind": "preempt", "market": "spot", "durations": {"total_s": 400.0},
            "events": [{"event": "kill", "t_wall": 10.0, "t_rel": 1.0, "segment": 0}],
            "loss_samples": [{"step": 1, "loss": 3.0, "ms_per_step": 80, "tok_s": 100, "t_rel": 1.0, "world_size": 2}],
            "cost": {"instances": [{"instance_id": "i-a", "hourly_usd": 0.526, "started_at": 0.0, "stopped_at": 400.0}], "total_usd": 0.06}}
    _write(f"{tmpdir_path}/p/r1.profile.json", json.dumps(prof, indent=1))
    _write(f"{tmpdir_path}/p/r2.profile.json", '{"run_id": "r2", "durations"')
    p = S.profiles(spark, f"{tmpdir_path}/p/*.json").collect()
    assert [r.run_id for r in p] == ["r1"] and p[0].durations["total_s"] == 400.0
    snap = {"run_id": "r1", "step": 100, "samples": [{"prompt": "a", "sample_index": 0, "completion": "x"},
                                                      {"prompt": "b", "sample_index": 0, "completion": "y"}]}
    _write(f"{tmpdir_path}/s/000000000100.json", json.dumps(snap))
    _write(f"{tmpdir_path}/s/000000000100b.json", json.dumps(dict(snap, samples=[{"prompt": "a", "sample_index": 0, "completion": "z"}])))
    ts = S.text_samples(spark, f"{tmpdir_path}/s/*.json").collect()
    assert sorted((r.prompt, r.completion) for r in ts) == [("a", "x"), ("b", "y")]
    adv = spark.read.json(spark.sparkContext.parallelize([json.dumps({
        "ranges": [{"index": 0, "label": "<5%"}, {"index": 1, "label": "5-10%"}],
        "spot_advisor": {"us-east-1": {"Linux": {"g5.xlarge": {"r": 1, "s": 60}, "m5.large": {"r": 0, "s": 50}}}}})]),
        schema="ranges array<struct<index:int,label:string>>, spot_advisor map<string,map<string,map<string,struct<r:int,s:int>>>>")
    a = S.advisor_records(adv, ["g5.xlarge"], F.lit("t1"), F.lit(5.0)).collect()
    assert [(r.region, r.instance_type, r.interruption_range, r.savings_pct) for r in a] == [("us-east-1", "g5.xlarge", "5-10%", 60)]
    status = spark.createDataFrame([("r1", 0, 0, True)], "run_id string, node int, attempt int, alive boolean")
    listing = spark.createDataFrame([("r1", 0, 0, 100), ("r1", 1, 0, 990)], "run_id string, node int, attempt int, modified long")
    d = sorted((r.node, r.source, r.alive) for r in S.discover_runs(status, listing, now=1000.0, heartbeat_timeout=60.0).collect())
    assert d == [(0, "status", True), (1, "listing", True)]


def test_advisor_documents_as_variants(spark):
    """Labels of the document's own ranges, other systems, torn and empty documents, missing numbers."""
    one = {"ranges": [{"index": 0, "label": "<5%"}, {"index": 1, "label": "5-10%"}, {"index": 1, "label": "5-9%"}],
           "spot_advisor": {"eu": {"Linux": {"a.large": {"r": 1, "s": 60}, "b.large": {"r": 0}, "c.large": {"r": 3, "s": 1}}, "Windows": {"a.large": {"r": 0, "s": 9}}},
                            "us": {"Windows": {"a.large": {"r": 0, "s": 8}}}}}
    two = {"ranges": [{"index": 1, "label": "other"}, {"index": 2}], "spot_advisor": {"eu": {"Linux": {"a.large": {"r": 1, "s": 5}, "b.large": {"r": 2, "s": 6}}}}}
    rows = [("t1", json.dumps(one)), ("t2", json.dumps(two)), ("t3", json.dumps(one)[:80]), ("t4", ""), ("t5", None), ("t6", "[]"), ("t7", '{"spot_advisor": null}'), ("t8", '{"spot_advisor": {"x": {"Linux": {"a.large": {"r": 0, "s": 2}}}}}')]
    lines = spark.createDataFrame(rows, "tick string, line string")
    types = spark.createDataFrame([("a.large",), ("b.large",), ("c.large",), ("d.large",)], "instance_type string")
    want = [("t1", "eu", "a.large", 1, 60, "5-9%"), ("t1", "eu", "b.large", 0, None, "<5%"), ("t1", "eu", "c.large", 3, 1, ""),
            ("t2", "eu", "a.large", 1, 5, "other"), ("t2", "eu", "b.large", 2, 6, ""), ("t8", "x", "a.large", 0, 2, "")]
    cols = ["tick_id", "region", "instance_type", "interruption_index", "savings_pct", "interruption_range"]
    got = S.advisor_documents(lines, types, F.col("tick"), F.lit(5.0)).select(*cols)
    assert sorted(tuple(r) for r in got.collect()) == want
    some = S.advisor_documents(lines, ["b.large"], F.col("tick"), F.lit(5.0)).select(*cols)
    assert sorted(tuple(r) for r in some.collect()) == [w for w in want if w[2] == "b.large"]
    typed = lines.filter("tick IN ('t1', 't2')").select("tick", F.from_json("line", "ranges array<struct<index:int,label:string>>, spot_advisor map<string,map<string,map<string,struct<r:int,s:int>>>>").alias("d")).select("tick", "d.*")
    assert sorted(tuple(r) for r in S.advisor_records(typed, types, F.col("tick"), F.lit(5.0)).select(*cols).collect()) == want[:5]
    assert S.advisor_documents(lines.limit(0), types, F.col("tick"), F.lit(5.0)).count() == 0


def test_writers_misc(spark, tmpdir_path):
    rec = spark.createDataFrame([("us-east-1", 1_700_000_000.12345)], "region string, t double")
    W.append_shards(rec, f"{tmpdir_path}/shards")
    W.append_shards(rec, f"{tmpdir_path}/shards")
    assert spark.read.json(f"{tmpdir_path}/shards").count() == 2
    env = M.record_envelope(spark.createDataFrame([("us",)], "region string"), "sps", F.lit("t1"), F.lit(1_700_000_000.12345)).collect()[0]
    assert env.ts == "2023-11-14T22:13:20Z" and env.t == 1_700_000_000.123
    series = spark.createDataFrame([("r", 1, 5.0, None), ("r", 2, None, None)], "run_id string, time long, train_loss double, usd double")
    sl = W.panel_slice(series, {"train_loss": "loss", "usd": "cost"}).collect()
    assert [(r.time, r.loss) for r in sl] == [(1, 5.0)]
    ev = spark.createDataFrame([("r", 10.0, 1, "killed", "scheduled-kill"), ("r", 12.5, 0, "training", None)],
                               "run_id string, ts double, node int, state string, cause string")
    lines = [r.line for r in W.event_listing(ev).collect()]
    assert lines == ["+0.0s node1 killed scheduled-kill", "+2.5s node0 training "]
    facts = spark.createDataFrame([("r", "GPT-2")], "run_id string, model string")
    assert [r.time for r in W.run_fact_rows(facts, F.lit(1.0), F.lit(2.0)).collect()] == [1000, 2000]
    W.report_table(spark.createDataFrame([("a", 1.234567)], "k string, v double"), f"{tmpdir_path}/report")
    assert spark.read.option("header", "true").csv(f"{tmpdir_path}/report").collect()[0].v == "1.2346"
    docs = W.profile_documents(
        spark.createDataFrame([("r",)], "run_id string"),
        spark.createDataFrame([("r", "training", 5.0, 1.0)], "run_id string, phase string, seconds double, start double"),
        spark.createDataFrame([("r", "kill", 3.0, 1.0)], "run_id string, event string, t_wall double, t_rel double"),
        spark.createDataFrame([("r", 1, 3.0, 80, 100, 1.0, 2)], "run_id string, step long, loss double, ms_per_step int, tok_s int, t_rel double, world_size int"),
        spark.createDataFrame([("r", 1, 2.5, 1.0)], "run_id string, step long, loss double, t_rel double"),
        spark.createDataFrame([("r", "i-a", 1.0, 0.0, 10.0)], "run_id string, instance_id string, hourly_usd double, started_at double, stopped_at double"),
    ).collect()[0]
    doc = json.loads(docs.json)
    assert doc["segments"] == [{"phase": "training", "seconds": 5.0}] and doc["schema_version"] == 1


def test_small_functions(spark):
    df = spark.createDataFrame([(0,), (1536,), (5 * 1024 ** 3,)], "b long")
    assert [r.h for r in df.select(human_bytes("b").alias("h")).collect()] == ["0.0 B", "1.5 KB", "5.0 GB"]
    est = spark.range(1).select(prep_estimate_usd(F.lit(0.68), F.lit(730.0), F.lit(100), F.lit(3000), F.lit(125)).alias("u")).collect()[0].u
    assert abs(est - (0.68 * 730 + 100 * 0.08)) < 1e-9
    vals = spark.createDataFrame([("g", float(v)) for v in [5, 1, 4, 2, 3]], "k string, v double")
    got = kth_values(vals, ["k"], "v", {"nr": rank_rule("nearest_rank", 50), "um": rank_rule("upper_median", 0)}).collect()[0]
    assert (got.nr, got.um) == (3.0, 3.0)
    lines = spark.createDataFrame([(f"l{i}", "f", 0, i) for i in range(10)], "line string, file_path string, block_start long, seq long")
    assert [r.line for r in S.tail_lines(lines, 3).orderBy("seq").collect()] == ["l7", "l8", "l9"]
    hours = spark.createDataFrame([(h, 10, h / 24.0) for h in range(24)], "hour int, ticks long, p_good double")
    assert [r.hour for r in M.top_hours(hours, 3).collect()] == [23, 22, 21]


def test_comparison_rows(spark):
    summary = spark.createDataFrame([("r", 100)], "run_id string, steps long")
    phases = spark.createDataFrame([("r", "training", 50.0), ("r", "downtime", 5.0)], "run_id string, phase string, seconds double")
    cost = spark.createDataFrame([("r", 1.5)], "run_id string, usd double")
    row = X.comparison_rows(summary, phases, cost).collect()[0]
    assert (row.steps, row.training, row.downtime, row.usd) == (100, 50.0, 5.0, 1.5)


def test_clean_projection_of_many_one_and_no_cycles(spark):
    """Steps of 100 ms, a warm-up of 900 ms and stalls of 500 ms: cycles that begin at 20, 50 (two
    stalls four apart) and 90, a run of one cycle, and one without."""
    stalls = {"many": {20, 50, 54, 90}, "one": {30}, "none": set()}
    rows = [(r, i, float(i), 900 if i == 1 else 500 if i in at else 100) for r, at in stalls.items() for i in range(1, 101)]
    steps = spark.createDataFrame(rows, "run_id string, event_id long, t double, ms int").repartition(3)
    budget = spark.createDataFrame([(r, 100.0) for r in stalls], "run_id string, budget_s double")
    got = {r.run_id: r for r in X.clean_projection(steps, budget).collect()}
    for run, excess, period in (("many", 1.6 / 3, 35.0), ("one", 0.4, None), ("none", None, None)):
        r = got[run]
        assert r.cycle_period_steps == period and abs(r.steady_s - 0.1) < 1e-9 and abs(r.warmup_s - 0.8) < 1e-9
        assert (r.cycle_excess_s is None) == (excess is None) and (excess is None or abs(r.cycle_excess_s - excess) < 1e-9)
    m = got["many"]
    assert abs(m.steps_model - (100.0 - 0.8) / (0.1 + 1.6 / 3 / 35)) < 1e-6 and got["one"].steps_model is None
    # 95 steps of 0.1 s, the warm-up and four stalls
    assert abs(m.steps_naive - 100.0 * 100 / (9.5 + 0.9 + 2.0)) < 1e-6
