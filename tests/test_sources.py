"""Raw layouts written to a temporary folder and read back (FIXTURES.md)."""

import json
import os

from pyspark.sql import functions as F

from skiff.sinks import writers as W
from skiff.sources import files as S

BOOT_LOG = """step 10: loss 3.3405, 3085ms/step, 996 tok/s
noise line without a step
step 20: loss 2.9876, 80ms/step, 15300 tok/s, ws 2
step 30: loss 2.9000, 80ms/step, 15300 tok/s, ws 2, t 1700000210.000
[rank 1] step 20 | loss 2.9876 | local 3.0012 | 81ms/step | ws 2 | t 1700000211.000
[rank 2] step 20 | loss 2.9876 | local 3.0012 | 81ms/step | ws 2
eval step 250: val_loss 2.1034
eval step 250: val_loss 2.1034
number of parameters: 123.69M
DATASET=webtext N_LAYER=12 N_HEAD=12 N_EMBD=768
num decayed parameter tensors: 50, with 124,318,464 parameters
num non-decayed parameter tensors: 98, with 121,344 parameters
[event] {"ts":152.0,"node":1,"state":"killed","cause":"scheduled-kill","by":"orch"}
[event] {"ts":160.5,"state":"training","step":40,"by":"trainer"}
[event] {"ts":"oops","state":"training"}
[event] {not json
step 40: loss 2.8"""


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_boot_logs(spark, tmpdir_path):
    root = f"{tmpdir_path}/runs/run-1700000000/logs"
    _write(f"{root}/boot-node0.log", BOOT_LOG)
    _write(f"{root}/boot-node1-r1.log", BOOT_LOG)
    lines = S.log_lines(spark, f"{tmpdir_path}/runs/*/logs/boot-node*.log")
    steps = S.step_lines(lines).collect()
    assert sorted((r.node, r.attempt, r.step, r.ws, r.t) for r in steps) == [(0, 0, 30, 2, 1700000210.0), (1, 1, 30, 2, 1700000210.0)]
    old = {(r.node, r.step): r for r in S.step_lines_any(lines).collect()}
    assert sorted(k[1] for k in old if k[0] == 0) == [10, 20, 30] and old[(0, 10)].ws is None and old[(0, 20)].ws == 2
    # reading the same log twice adds nothing
    twice = S.step_lines_any(lines.unionByName(lines))
    assert twice.count() == 6
    evals = S.eval_lines(lines).dropDuplicates(["run_id", "step", "loss"]).collect()
    assert [(r.step, r.loss) for r in evals] == [(250, 2.1034)]
    ranks = sorted((r.rank, r.step, r.t) for r in S.rank_lines(lines).filter(F.col("slot") == 0).collect())
    assert ranks == [(1, 20, 1700000211.0), (2, 20, None)]
    ev = sorted((r.node, r.attempt, r.state, r.ts) for r in S.event_lines(lines).collect())
    assert ev == [(0, 0, "training", 160.5), (1, 0, "killed", 152.0), (1, 1, "killed", 152.0), (1, 1, "training", 160.5)]
    facts = S.run_facts(lines).collect()[0]
    assert facts.params_m == "123.69" and facts.params_exact == 124_439_808 and facts.model == "GPT-2 · 12L/12H/768d"
    assert facts.run_id == "run-1700000000"


def test_decision_log(spark, tmpdir_path):
    log = "\n".join([
        "[supervisor] published epoch 1: members [0, 1] master=node0 (10.0.0.1:29401)",
        "[supervisor] terminated node 0 (i-aaa)",
        "[supervisor] published epoch 1: members [0, 1] master=node0 (10.0.0.1:29401)",
        "[supervisor] published epoch 2: members [1] master=node1 (10.0.0.2:29401)",
        "[supervisor] terminated node 0 (i-aaa)",
        "[supervisor] terminated node 3 (i-xyz)",
    ])
    _write(f"{tmpdir_path}/runs/r/run.log", log)
    epochs, terms = S.decision_log(spark, f"{tmpdir_path}/runs/*/run.log")
    assert sorted((r.epoch, tuple(r.members), r.master) for r in epochs.collect()) == [(1, (0, 1), 0), (2, (1,), 1)]
    # the hex id is required: i-xyz does not count
    assert sorted((r.node, r.instance_id) for r in terms.collect()) == [(0, "i-aaa"), (0, "i-aaa")]


def test_status_ticks_both_layouts(spark, tmpdir_path):
    launch = 1_700_000_000.0
    docs = []
    for dt, members in ((20, []), (60, [0, 1]), (190, [1]), (250, [1]), (330, [0, 1]), (390, [0, 1])):
        docs.append({"version": 1, "run_id": "r", "updated_at": launch + dt, "epoch": len(members), "members": members,
                     "ckpt_step": int(dt), "done": False,
                     "nodes": [{"node": 0, "attempt": 0 if dt < 200 else 1, "instance_id": "i-a" if dt < 200 else "i-b",
                                "aws_state": "running"}]})
    _write(f"{tmpdir_path}/hist.jsonl", "\n".join(json.dumps({"t": d["updated_at"], "doc": d}) for d in docs) + "\n{\"t\": 1")
    h = S.status_ticks(spark, f"{tmpdir_path}/hist.jsonl")
    assert h.count() == 6
    for d in docs[:2]:
        _write(f"{tmpdir_path}/ticks/{int(d['updated_at'] * 1000)}.json", json.dumps(d))
    _write(f"{tmpdir_path}/ticks/notes.json", json.dumps({**docs[2], "updated_at": launch + 999}))
    p = sorted(r.t for r in S.status_ticks(spark, f"{tmpdir_path}/ticks", jsonl=False).collect())
    assert p == [launch + 20, launch + 60, launch + 999]
    merged = S.merge_ticks(h.withColumn("run_id", F.lit("r")), h.withColumn("run_id", F.lit("r")).withColumn("t", F.col("t") + 1))
    assert merged.count() == 6 and merged.filter(F.col("t") != F.col("updated_at")).count() == 0


def test_spot_shards_window_and_corruption(spark, tmpdir_path):
    root = f"{tmpdir_path}/capacity"
    base = {"tick_id": "t1", "ts": "2024-01-01T00:00:00Z", "region": "us-east-1", "az_id": "use1-az1",
            "instance_type": "g5.xlarge", "capacity": 8, "single_az": True, "score": 7}
    rows = [dict(base, type="sps", t=1000.0, scope="region"), dict(base, type="sps", t=1000.0, scope="global_top10"),
            dict(base, type="sps", t=1000.0)]
    _write(f"{root}/2024-01-01/1000-t1.jsonl", "\n".join(json.dumps(r) for r in rows) + '\n{"type": "sps", "t": 10')
    _write(f"{root}/2023-12-31/10-t0.jsonl", json.dumps(dict(base, type="sps", t=10.0)))
    recs = S.spot_records(spark, root, since_t=500.0)
    assert recs.count() == 3
    from skiff.operators import market as M

    assert M.sps_rows(recs, 8, single_az=True).count() == 2  # the leaderboard row never counts


def test_load_manifest_points(spark, tmpdir_path):
    man = {"kind": "saturation", "url": "http://x", "slo_multiplier": 3.0, "points": [
        {"label": "warm", "offered_rps": 1, "workers": 1, "warmup": True, "report": {"p50_ms": 999}},
        {"label": "", "offered_rps": 2, "workers": 1, "warmup": False, "report": {"succeeded": 10, "p50_ms": 100, "duration_s": 5}},
        {"label": "n2", "offered_rps": 4, "workers": 2, "report": {"succeeded": 20}},
        {"label": "broken", "offered_rps": 8, "workers": 2},
    ]}
    _write(f"{tmpdir_path}/sweep.json", json.dumps(man))
    pts = {r.label: r for r in S.load_points(spark, f"{tmpdir_path}/sweep.json").collect()}
    assert set(pts) == {"rps2.0-n1", "n2"}
    assert pts["n2"].p50_ms == 0.0 and pts["rps2.0-n1"].succeeded == 10


def test_heartbeats_metrics_checkpoints(spark, tmpdir_path):
    _write(f"{tmpdir_path}/hb/w1.json", json.dumps({"worker_id": "w1", "addr": "a:1", "model": "m", "market": "spot",
                                                    "requests_served": 5, "last_seen": 100.0, "gpu": "a10g"}))
    _write(f"{tmpdir_path}/hb/w2.json", '{"worker_id": "w2", "addr"')
    hb = S.heartbeats(spark, f"{tmpdir_path}/hb/*.json").collect()
    assert [(r.worker_id, r.extra) for r in hb] == [("w1", {"gpu": "a10g"})]
    _write(f"{tmpdir_path}/metrics.txt", "\n".join([
        '# HELP fleet_router_upstream_attempts_total attempts',
        'fleet_router_upstream_attempts_total{worker_id="w1",result="ok"} 10.0',
        'fleet_router_upstream_attempts_total{worker_id="w1",result="server_error"} 2.0',
        'fleet_router_upstream_attempts_total{worker_id="w2",result="ok"} 7.0',
    ]))
    m = {r.worker_id: r.value for r in S.metric_samples(spark, f"{tmpdir_path}/metrics.txt", "fleet_router_upstream_attempts_total").collect()}
    assert m == {"w1": 12, "w2": 7}
    for name, size in (("ckpt-000000000010.pt", 4), ("ckpt-000000000020.pt", 4), ("ckpt-000000000030.pt.tmp", 2)):
        _write(f"{tmpdir_path}/ck/{name}", "x" * size)
    from skiff.operators import fleet as FL

    objs = S.checkpoint_objects(spark, f"{tmpdir_path}/ck").withColumn("run_id", F.lit("r")).withColumn("tier", F.lit("durable")).withColumn("rank", F.lit(None).cast("int"))
    assert sorted(r.step for r in FL.parse_listing(objs).collect()) == [10, 20]
    _write(f"{tmpdir_path}/bins/train.bin", "x" * 8)
    _write(f"{tmpdir_path}/bins/val.bin", "x" * 3)
    bins = {os.path.basename(r.path): (r.tokens, r.whole) for r in S.token_shards(spark, f"{tmpdir_path}/bins/*.bin").collect()}
    assert bins == {"train.bin": (4, True), "val.bin": (1, False)}


def test_sinks_roundtrip(spark, tmpdir_path):
    step_rows = spark.createDataFrame([("r", 1000, 5)], "run_id string, time long, current_step long")
    boot = spark.createDataFrame([("r", 10, 2)], "run_id string, time long, nodes_training int")
    series = W.run_series_table(step_rows, boot)
    assert series.columns == ["run_id"] + W.TS_COLUMNS and series.count() == 2
    W.write_run_series(series, f"{tmpdir_path}/series")
    back = spark.read.parquet(f"{tmpdir_path}/series")
    assert back.count() == 2
    snap = spark.createDataFrame([("r", 5, "a"), ("r", 6, "b")], "run_id string, step long, text string")
    W.write_snapshot(snap, f"{tmpdir_path}/snap", ["run_id", "step"])
    W.write_snapshot(snap.filter("step = 6").withColumn("text", F.lit("c")), f"{tmpdir_path}/snap", ["run_id", "step"])
    got = sorted((r.step_key, r.text) for r in spark.read.json(f"{tmpdir_path}/snap").collect())
    assert [(int(k), t) for k, t in got] == [(5, "a"), (6, "c")]
    idx = [r.run_id for r in W.run_index(spark.createDataFrame([("a-1700000000",), ("b-1800000000",), ("c",)], "run_id string")).collect()]
    assert idx == ["b-1800000000", "a-1700000000", "c"]
