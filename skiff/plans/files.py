"""Readers and writers on data rendered from the driver's tables.

Each reader query renders rows as the text its producers print (with cut and
foreign lines between), parses it with the reader's own expressions, and the
oracle states the parsed rows from the table.  Writer queries write to the
shared folder and return what a reader finds there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.operators import corpus as C
from skiff.plans import corpus as PC
from skiff.plans.oracle_views import with_views
from skiff.session import scratch_path
from skiff.sinks import writers as W
from skiff.sources import driver as D
from skiff.sources import files as R
from skiff.sources.tables import table

_RUN = "concat('run-', cast(user_id % 12 as string))"
_NODE = "cast((user_id div 12) % 8 as int)"
_ATT = "cast(user_id div 96 as int)"


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"


def _lines(spark, sf, line: str, when: str = "true") -> DataFrame:
    """One log line per event, placed in the boot log of its (run, node, attempt)."""
    ev = D.events_base(spark, sf).filter(when)
    return ev.selectExpr(
        f"{line} as line", f"concat('runs/', {_RUN}, '/logs/boot-node', {_NODE}, '-r', {_ATT}, '.log') as file_path",
        "0L as block_start", "event_id as seq", f"{_RUN} as run_id", f"{_NODE} as node", f"{_ATT} as attempt",
    )


_LOSS = "concat(cast(k div 10 as string), '.', cast(k % 10 as string), lpad(cast(user_id % 1000 as string), 3, '0'))"
_LOSS_SQL = "(k // 10) + (k % 10) / 10.0 + (user_id % 1000) / 10000.0"
_STEP = f"concat('[rank 0] step ', event_id, ': loss ', {_LOSS}, ', ', k + 5, 'ms/step, ', user_id + 1, ' tok/s, ws ', k % 8 + 1, ', t ', t_us div 1000000, '.5')"


def q_step_lines(spark, sf):
    cut = f"case event_type when 'view' then substring({_STEP}, 1, 30) when 'error' then 'Traceback: step x' else {_STEP} end"
    out = R.step_lines(_lines(spark, sf, cut))
    return out.select("run_id", "node", "attempt", "step", F.round("loss", 4).alias("loss"), "ms", "tok_s", "ws", "t")


def q_step_lines_any(spark, sf):
    # two reads of each step: the earlier line of the log wins
    line = f"concat('step ', event_id div 24 * 24 + user_id % 12, ':  loss ', {_LOSS}, ', ', k + 5, 'ms/step, ', user_id + 1, ' tok/s', if(k % 2 = 0, concat(', ws ', k % 8 + 1), ''))"
    out = R.step_lines_any(_lines(spark, sf, line))
    return out.select("run_id", "node", "attempt", "step", F.round("loss", 4).alias("loss"), "ms", "tok_s", "ws")


def q_eval_lines(spark, sf):
    line = f"if(event_type = 'view', concat('eval step ', event_id, ': val_loss ', {_LOSS}), {_STEP})"
    return R.eval_lines(_lines(spark, sf, line)).select("run_id", "node", "attempt", "step", F.round("loss", 4).alias("loss"))


def q_rank_lines(spark, sf):
    line = f"if(k % 4 = 0, {_STEP}, concat('[rank ', k % 4, '] step ', event_id, ' done | ws ', k % 8 + 1, if(k % 3 = 0, '', concat(' | t ', t_us div 1000000, '.25'))))"
    return R.rank_lines(_lines(spark, sf, line))


def q_event_lines(spark, sf):
    line = (
        "case when event_type = 'view' then concat('[event] {\"ts\": ', t_us div 1000000) when event_type = 'click' then '[event] {\"state\": \"training\"}' "
        "when event_type = 'error' then concat('x [event] {\"ts\": ', t_us div 1000000, '.5, \"state\": \"killed\", \"node\": ', k, ', \"attempt\": 7, \"cause\": \"c', user_id, '\"}') "
        "else concat('[event] {\"state\": \"epoch\", \"ts\": ', t_us div 1000000, ', \"world\": ', k % 8, ', \"epoch\": ', event_id, '}') end"
    )
    return R.event_lines(_lines(spark, sf, line)).select("run_id", "ts", "node", "attempt", "state", "epoch", "world", "cause")


def _decisions(spark, sf):
    line = (
        "case when event_type = 'purchase' then concat('[00:00:01] published epoch ', event_id div 50, ': members [', k % 4, ', ', k % 4 + 1, '] master=node', k % 4) "
        "when event_type = 'error' then concat('[00:00:02] terminated node ', k % 8, ' (i-', lpad(hex(user_id), 8, '0'), ')') else 'waiting' end"
    )
    return R.decision_lines(_lines(spark, sf, line.replace("hex(user_id)", "lower(hex(user_id))")))


def q_decision_epochs(spark, sf):
    return _decisions(spark, sf)[0].select("run_id", "epoch", F.array_join("members", ",").alias("members"), "master")


def q_decision_terminations(spark, sf):
    return _decisions(spark, sf)[1].select("run_id", "node", "instance_id", F.col("pos.seq").alias("seq"))


def q_status_ticks(spark, sf):
    doc = F.struct("run_id", "updated_at", "epoch", "members", "ckpt_step", "done")
    ticks = D.tick_docs(spark, sf).select("t", doc.alias("doc"), "event_id")
    text = F.when(F.col("event_id") % 5 == 0, F.substring(F.to_json(F.struct("t", "doc")), 1, 40)).otherwise(F.to_json(F.struct("t", "doc")))
    path = _new(spark, "ticks")
    ticks.select(text.alias("value")).write.text(path)
    return R.status_ticks(spark, path).select("run_id", "t", "updated_at", "epoch", F.size("members").alias("members"), "ckpt_step", "done")


def q_merged_ticks(spark, sf):
    t = D.tick_docs(spark, sf).select("run_id", F.floor("t").alias("updated_at"), "t", "ckpt_step", "event_id")
    # a third of the ticks is only in the durable objects, a third only polled, the others are both
    durable, polled = t.filter("event_id % 3 <> 1"), t.filter("event_id % 3 <> 0").withColumn("t", F.col("t") + 0.5)
    both = R.merge_ticks(durable.drop("event_id"), polled.drop("event_id"))
    return both.select("run_id", "updated_at", "t", "ckpt_step")


def q_run_facts(spark, sf):
    line = (
        "case k % 5 when 0 then concat('N_LAYER=', k % 7 + 1, ' N_HEAD=', k % 3 + 1) when 1 then concat('export N_EMBD=', k * 64) "
        "when 2 then concat('number of parameters: ', k, '.5M') when 3 then concat('num decayed parameter tensors: 50, with 1,', lpad(k, 3, '0'), ',000 parameters') "
        "else concat('num non-decayed parameter tensors: 9, with ', k, ',', lpad(user_id % 1000, 3, '0'), ' parameters') end"
    )
    lines = _lines(spark, sf, line).withColumn("file_path", F.lit("one.log"))
    return R.run_facts(lines).select("run_id", "N_LAYER", "N_HEAD", "N_EMBD", "params_m", "params_exact", "model")


#: Entries of a nested document that the queries below write.
DOC_EVENTS = 500


def q_profiles(spark, sf):
    """SNK-05 writes one document per run, SRC-09 reads them back; a run has up to ``DOC_EVENTS``
    events, so documents grow in number with the table, not in size."""
    ev = D.events_base(spark, sf).selectExpr(f"concat('run-', event_id div {DOC_EVENTS}) as run_id", "event_id", "event_type", "t", "k", "user_id")
    runs = ev.select("run_id").distinct().withColumn("kind", F.lit("spot"))
    seg = ev.filter("event_type = 'view'").selectExpr("run_id", "t as start", "concat('p', k % 5) as phase", "cast(k as double) as seconds")
    events = ev.filter("event_type = 'click'").selectExpr("run_id", "event_type as event", "t as t_wall", "t as t_rel")
    samples = ev.filter("event_type = 'signup'").selectExpr("run_id", "event_id as step", "k / 4.0D as loss", "k as ms_per_step", "cast(user_id as int) as tok_s", "t as t_rel", "k % 8 as world_size")
    vals = ev.filter("event_type = 'error'").selectExpr("run_id", "event_id as step", "k / 8.0D as loss", "t as t_rel")
    boxes = ev.filter("event_type = 'purchase'").selectExpr("run_id", "concat('i-', event_id) as instance_id", "k / 2.0D as hourly_usd", "t as started_at", "t + 60 as stopped_at")
    path = _new(spark, "profiles")
    W.profile_documents(runs, seg, events, samples, vals, boxes).select("json").write.option("maxRecordsPerFile", 1).text(path)
    d = R.profiles(spark, path)
    total = lambda c, x: F.aggregate(c, F.lit(0.0), lambda a, v: a + v[x])
    return d.select("run_id", "kind", F.size("segments").alias("segments"), total("segments", "seconds").alias("seconds"), F.size("events").alias("events"),
                    F.size("loss_samples").alias("samples"), total("loss_samples", "loss").alias("loss"), F.element_at("loss_samples", -1)["step"].alias("last_step"), total("val_samples", "loss").alias("val_loss"))


def q_text_samples(spark, sf):
    # a document per (run, step) of up to 50 conversations
    c = table(spark, sf, "conversations").selectExpr("concat('run-', conv_id div 200) as run_id", "conv_id % 4 as step", "conv_id", "turn", "text")
    s = F.struct(F.concat(F.lit("p"), F.col("conv_id")).alias("prompt"), F.col("turn").cast("int").alias("sample_index"), F.col("text").alias("completion"))
    docs = c.groupBy("run_id", "step").agg(F.collect_list(s).alias("samples"))
    path = _new(spark, "samples")
    docs.select(F.to_json(F.struct("run_id", "step", "samples")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.text_samples(spark, path).select("run_id", "step", "prompt", "sample_index", F.md5("completion").alias("completion_md5"))


def q_spot_records(spark, sf):
    """Shards by hour, rows from the third day on, cut lines and foreign files between."""
    rec = D.sps_records(spark, sf).withColumn("shard", (F.col("t") / 3600).cast("long") * 3600)
    doc = F.to_json(F.struct(*[F.col(c) if c != "tick_id" else F.col(c).cast("string").alias(c) for c in rec.columns if c not in ("shard", "event_id")]))
    cut = F.pmod(F.floor("t"), F.lit(5)) == 0
    name = F.when(F.col("score") == 1, F.lit("notes.txt")).otherwise(F.concat(F.col("shard").cast("string"), F.lit("-t.jsonl")))
    lines = rec.select(F.when(cut, F.substring(doc, 1, 25)).otherwise(doc).alias("line"), name.alias("file_name"))
    out = R.spot_lines(lines, since_t=SINCE)
    return out.select("type", "tick_id", "t", "region", "az_id", "instance_type", "capacity", "single_az", "scope", "score", "shard_epoch")


SINCE = 1_704_240_000.0  # 2024-01-03


def q_advisor(spark, sf):
    """Advisor documents as text, one a region, with the orders' customers as machine types; a
    region has up to 500 types, and records are taken of all types that the orders name."""
    o = table(spark, sf, "orders").selectExpr("concat('region-', o_custkey div 500) as region", "concat('m', o_custkey) as type", "cast(o_custkey % 5 as int) as r", "cast(o_custkey % 90 as int) as s").distinct()
    by = o.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct("r", "s").alias("v")))).alias("types"))
    ranges = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(f"{5 * i}%").alias("label")) for i in range(4)])
    doc = by.select(F.create_map("region", F.create_map(F.lit("Linux"), "types", F.lit("Windows"), "types")).alias("spot_advisor"), ranges.alias("ranges"))
    types = o.select(F.col("type").alias("instance_type"))
    lines = doc.select(F.to_json(F.struct("ranges", "spot_advisor")).alias("line"))
    return R.advisor_documents(lines, types, F.lit("t0"), F.lit(1.0)).select("region", "instance_type", "interruption_index", "interruption_range", "savings_pct")


def q_load_points(spark, sf):
    ev = D.events_base(spark, sf)
    report = F.when(F.col("k") % 9 != 0, F.struct(F.when(F.col("k") % 4 != 0, F.col("k").cast("string")).alias("rps"), F.col("user_id").cast("string").alias("requests"), F.concat(F.col("k"), F.lit(".5")).alias("p99_ms")))
    point = F.struct(F.when(F.col("k") % 2 == 0, F.concat(F.lit("l"), "event_id")).alias("label"), F.when(F.col("k") % 3 == 0, F.col("k").cast("double")).alias("offered_rps"),
                     F.when(F.col("k") % 5 != 0, F.col("k") % 8).alias("workers"), (F.col("event_id") % 7 == 0).alias("warmup"), report.alias("report"))
    docs = ev.groupBy(F.expr(f"event_id div {DOC_EVENTS}").alias("m")).agg(F.collect_list(point).alias("points"))
    path = _new(spark, "manifests")
    docs.select(F.to_json(F.struct(F.lit("sweep").alias("kind"), "points")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.load_points(spark, path).select("label", "workers", "rps", "requests", "p99_ms", "offered_rps", "failed")


def q_router_points(spark, sf):
    ev = D.events_base(spark, sf)
    doc = F.to_json(F.struct(F.col("event_id").cast("double").alias("rps"), (F.col("k") % 5).cast("double").alias("duration_s"), (F.col("user_id") * 4).alias("succeeded"),
                             F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("k")).alias("failed"), (F.col("k") % 2).alias("dropped"), (F.col("k") + 0.5).alias("p50_ms"), (F.col("k") * 2.0).alias("p99_ms")))
    name = F.concat(F.when(F.col("k") % 4 == 0, F.lit("python-")).otherwise(F.lit("go-")), "event_id", F.when(F.col("k") % 7 == 0, F.lit(".txt")).otherwise(F.lit(".json")))
    return R.router_points(ev.select(name.alias("file_name"), F.when(F.col("event_id") % 11 == 0, F.substring(doc, 1, 6)).otherwise(doc).alias("doc")), "go")


def q_heartbeats(spark, sf):
    s = table(spark, sf, "supplier")
    doc = F.concat(F.lit('{"worker_id": "w'), "s_suppkey", F.lit('", "market": "spot", "requests_served": '), "s_suppkey", F.lit(', "last_seen": 12.5, "zone": "z'), "s_nationkey", F.lit('"}'))
    docs = s.select(F.when(F.col("s_suppkey") % 4 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("doc"))
    return R.heartbeat_docs(docs).select("worker_id", "market", "requests_served", "last_seen", F.col("extra")["zone"].alias("zone"), F.size("extra").alias("others"))


def q_metric_samples(spark, sf):
    ev = D.events_base(spark, sf)
    line = F.concat(F.when(F.col("k") % 5 == 0, F.lit("other_total")).otherwise(F.lit("tokens_total")), F.lit('{model="m",worker_id="w'), F.col("user_id"), F.lit('"} '), F.col("k"), F.lit(".75"))
    path = _new(spark, "exposition")
    ev.select(line.alias("value")).write.text(path)
    return R.metric_samples(spark, path, "tokens_total")


def q_tail(spark, sf):
    return R.tail_lines(_lines(spark, sf, "concat('e', event_id)").repartition(8, "seq"), 3).select("file_path", "line")


def q_discovered(spark, sf):
    ev = D.events_base(spark, sf).selectExpr(f"{_RUN} as run_id", f"{_NODE} as node", f"{_ATT} as attempt", "t", "event_type")
    status = ev.filter("event_type = 'view' and node < 4").groupBy("run_id", "node", "attempt").agg((F.count("*") % 2 == 0).alias("alive"))
    listing = ev.groupBy("run_id", "node", "attempt").agg(F.max("t").alias("modified"))
    return R.discover_runs(status, listing, SINCE, 86400.0 * 20)


def q_appended(spark, sf):
    path = _new(spark, "shards")
    rec = D.sps_records(spark, sf).select("t", "region", "score")
    W.append_shards(rec.filter("score <= 5"), path)
    W.append_shards(rec.filter("score > 5"), path)  # a second append leaves the first as it is
    return spark.read.json(path).groupBy(F.col("date").cast("string").alias("date"), "region").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def q_snapshot(spark, sf):
    path = _new(spark, "snapshots")
    c = table(spark, sf, "conversations").selectExpr("concat('run-', conv_id % 12) as run_id", "turn as step", "conv_id", "length(text) as chars")
    W.write_snapshot(c.withColumn("pass", F.lit(1)), path, ["run_id", "step"])
    W.write_snapshot(c.filter("step < 2").withColumn("pass", F.lit(2)), path, ["run_id", "step"])  # only these partitions are replaced
    return spark.read.json(path).groupBy("run_id", F.col("step_key").cast("long").alias("step"), "pass").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def q_run_index(spark, sf):
    o = table(spark, sf, "orders").selectExpr("concat('run-', o_custkey) as run_id")
    ordered = W.run_index(o)
    return ordered.select("run_id", F.regexp_extract("run_id", "-([0-9]+)$", 1).cast("long").alias("suffix"))


def q_panel(spark, sf):
    s = D.events_base(spark, sf).selectExpr(f"{_RUN} as run_id", "t_us as time", "if(k % 2 = 0, k, null) as loss", "if(k % 3 = 0, value, null) as usd", "k")
    return W.panel_slice(s, {"loss": "train_loss", "usd": "dollars"})


def q_event_listing(spark, sf):
    ev = D.events_base(spark, sf).selectExpr(f"{_RUN} as run_id", "cast(t_us div 1000000 as double) as ts", f"{_NODE} as node", "event_type as state", "if(k % 2 = 0, concat('c', k), null) as cause")
    return W.event_listing(ev)


def q_fact_rows(spark, sf):
    ev = D.events_base(spark, sf).groupBy(F.expr(f"{_RUN} as run_id")).agg(F.min(F.expr("t_us div 1000000")).alias("a"), F.max(F.expr("t_us div 1000000")).alias("b"))
    return W.run_fact_rows(ev, F.col("a"), F.col("b")).select("run_id", "time")


def q_report(spark, sf):
    path = _new(spark, "report")
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.sum(F.col("p_size").cast("long")) / F.lit(8)).alias("eighths"))
    W.report_table(p, path, digits=4)
    return spark.read.option("header", "true").schema("p_brand string, n long, eighths double").csv(path)


def q_published(spark, sf):
    tokens = PC._tokens(spark, sf)
    # offsets are scanned in buckets of 100,000 ids: without the token ids, which come back by row
    packed, manifest = C.pack(C.prefix_offsets(tokens.drop("ids"), ["split"]))
    docs = packed.join(tokens.select("row", "ids"), on="row").drop("row")
    return C.publish(docs, manifest, _new(spark, "corpus"))


QUERIES = {
    "files_step_lines": q_step_lines,
    "files_step_lines_any": q_step_lines_any,
    "files_eval_lines": q_eval_lines,
    "files_rank_lines": q_rank_lines,
    "files_event_lines": q_event_lines,
    "files_decision_epochs": q_decision_epochs,
    "files_decision_terminations": q_decision_terminations,
    "files_status_ticks": q_status_ticks,
    "files_merged_ticks": q_merged_ticks,
    "files_run_facts": q_run_facts,
    "files_profiles": q_profiles,
    "files_text_samples": q_text_samples,
    "files_spot_records": q_spot_records,
    "files_advisor": q_advisor,
    "files_load_points": q_load_points,
    "files_router_points": q_router_points,
    "files_heartbeats": q_heartbeats,
    "files_metric_samples": q_metric_samples,
    "files_tail": q_tail,
    "files_discovered": q_discovered,
    "files_appended": q_appended,
    "files_snapshot": q_snapshot,
    "files_run_index": q_run_index,
    "files_panel": q_panel,
    "files_event_listing": q_event_listing,
    "files_fact_rows": q_fact_rows,
    "files_report": q_report,
    "files_published": q_published,
}

# ------------------------------------------------------------------ SQL --

_R = "'run-' || CAST(user_id % 12 AS VARCHAR) AS run_id"
_N = "CAST((user_id // 12) % 8 AS INTEGER) AS node"
_A = "CAST(user_id // 96 AS INTEGER) AS attempt"
_KEY = f"{_R}, {_N}, {_A}"
_S = "(t_us // 1000000)"


def _ev(sql: str) -> str:
    return with_views(sql, "ev")


ORACLE = {
    "files_step_lines": _ev(f"SELECT {_KEY}, event_id AS step, round({_LOSS_SQL}, 4) AS loss, k + 5 AS ms, user_id + 1 AS tok_s, k % 8 + 1 AS ws, {_S} + 0.5::DOUBLE AS t FROM ev WHERE event_type NOT IN ('view', 'error')"),
    "files_step_lines_any": _ev(f"""SELECT run_id, node, attempt, step, loss, ms, tok_s, ws FROM (
        SELECT {_KEY}, event_id // 24 * 24 + user_id % 12 AS step, round({_LOSS_SQL}, 4) AS loss, k + 5 AS ms, user_id + 1 AS tok_s, CASE WHEN k % 2 = 0 THEN k % 8 + 1 END AS ws,
               row_number() OVER (PARTITION BY user_id % 12, (user_id // 12) % 8, user_id // 96, event_id // 24 ORDER BY event_id) AS r FROM ev) WHERE r = 1"""),
    "files_eval_lines": _ev(f"SELECT {_KEY}, event_id AS step, round({_LOSS_SQL}, 4) AS loss FROM ev WHERE event_type = 'view'"),
    "files_rank_lines": _ev(f"SELECT {_R}, {_N.replace('node', 'slot')}, {_A.replace('attempt', 'gen')}, k % 4 AS rank, event_id AS step, k % 8 + 1 AS ws, CASE WHEN k % 3 <> 0 THEN {_S} + 0.25::DOUBLE END AS t FROM ev WHERE k % 4 <> 0"),
    "files_event_lines": _ev(f"""SELECT {_R}, {_S} + 0.5 AS ts, k AS node, 7 AS attempt, 'killed' AS state, NULL AS epoch, NULL AS world, 'c' || user_id AS cause FROM ev WHERE event_type = 'error'
        UNION ALL SELECT {_R}, {_S}::DOUBLE, {_N}, {_A}, 'epoch', event_id, k % 8, NULL FROM ev WHERE event_type IN ('signup', 'purchase')"""),
    "files_decision_epochs": _ev(f"""SELECT run_id, epoch, (k % 4) || ',' || (k % 4 + 1) AS members, k % 4 AS master FROM (
        SELECT *, {_R}, event_id // 50 AS epoch, row_number() OVER (PARTITION BY user_id % 12, event_id // 50 ORDER BY {{first}}) AS r FROM ev WHERE event_type = 'purchase') WHERE r = 1""".replace("{first}", "'runs/run-' || user_id % 12 || '/logs/boot-node' || (user_id // 12) % 8 || '-r' || user_id // 96 || '.log', event_id")),
    "files_decision_terminations": _ev(f"SELECT {_R}, k % 8 AS node, 'i-' || lpad(lower(to_hex(user_id)), 8, '0') AS instance_id, event_id AS seq FROM ev WHERE event_type = 'error'"),
    "files_status_ticks": with_views("SELECT run_id, t, updated_at, epoch, len(members) AS members, ckpt_step, done FROM ticks WHERE event_id % 5 <> 0", "ticks"),
    "files_merged_ticks": with_views("""SELECT run_id, updated_at, t, ckpt_step FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, updated_at ORDER BY src, t) AS r FROM (
            SELECT run_id, floor(t)::BIGINT AS updated_at, t, ckpt_step, 0 AS src FROM ticks WHERE event_id % 3 <> 1
            UNION ALL SELECT run_id, floor(t)::BIGINT, t + 0.5, ckpt_step, 1 FROM ticks WHERE event_id % 3 <> 0)) WHERE r = 1""", "ticks"),
    "files_run_facts": _ev(f"""SELECT run_id, min_by(k % 7 + 1, event_id) FILTER (k % 5 = 0) || '' AS N_LAYER, min_by(k % 3 + 1, event_id) FILTER (k % 5 = 0) || '' AS N_HEAD,
        min_by(k * 64, event_id) FILTER (k % 5 = 1) || '' AS N_EMBD, min_by(k, event_id) FILTER (k % 5 = 2) || '.5' AS params_m,
        min_by(1000000 + k * 1000, event_id) FILTER (k % 5 = 3) + min_by(k * 1000 + user_id % 1000, event_id) FILTER (k % 5 = 4) AS params_exact,
        'GPT-2 · ' || min_by(k % 7 + 1, event_id) FILTER (k % 5 = 0) || 'L/' || min_by(k % 3 + 1, event_id) FILTER (k % 5 = 0) || 'H/' || min_by(k * 64, event_id) FILTER (k % 5 = 1) || 'd' AS model
        FROM (SELECT *, {_R} FROM ev) GROUP BY run_id"""),
    "files_profiles": _ev(f"""SELECT run_id, 'spot' AS kind, count(*) FILTER (event_type = 'view') AS segments, sum(k) FILTER (event_type = 'view')::DOUBLE AS seconds, count(*) FILTER (event_type = 'click') AS events,
        count(*) FILTER (event_type = 'signup') AS samples, sum(k) FILTER (event_type = 'signup') / 4.0 AS loss, max_by(event_id, t) FILTER (event_type = 'signup') AS last_step, sum(k) FILTER (event_type = 'error') / 8.0 AS val_loss
        FROM (SELECT *, 'run-' || event_id // {DOC_EVENTS} AS run_id FROM ev) GROUP BY run_id"""),
    "files_text_samples": "SELECT 'run-' || conv_id // 200 AS run_id, conv_id % 4 AS step, 'p' || conv_id AS prompt, turn AS sample_index, md5(text) AS completion_md5 FROM conversations",
    "files_spot_records": with_views(f"""SELECT type, tick_id || '' AS tick_id, t, region, az_id, instance_type, capacity, single_az, scope, score, floor(t / 3600) * 3600.0::DOUBLE AS shard_epoch
        FROM sps WHERE score <> 1 AND floor(t) % 5 <> 0 AND floor(t / 3600) * 3600 >= {SINCE} AND t >= {SINCE}""", "sps"),
    "files_advisor": """SELECT DISTINCT 'region-' || o_custkey // 500 AS region, 'm' || o_custkey AS instance_type, o_custkey % 5 AS interruption_index,
        CASE WHEN o_custkey % 5 < 4 THEN 5 * (o_custkey % 5) || '%' ELSE '' END AS interruption_range, o_custkey % 90 AS savings_pct FROM orders""",
    "files_load_points": _ev("""SELECT coalesce(CASE WHEN k % 2 = 0 THEN 'l' || event_id END, 'rps' || offered_rps || '-n' || workers) AS label, workers, rps, user_id AS requests, k + 0.5::DOUBLE AS p99_ms, offered_rps, 0 AS failed
        FROM (SELECT *, coalesce(CASE WHEN k % 5 <> 0 THEN k % 8 END, 1) AS workers, CASE WHEN k % 4 <> 0 THEN k ELSE 0 END::DOUBLE AS rps,
                     coalesce(CASE WHEN k % 3 = 0 THEN k END, CASE WHEN k % 4 <> 0 THEN k ELSE 0 END)::DOUBLE AS offered_rps FROM ev WHERE event_id % 7 <> 0 AND k % 9 <> 0)"""),
    "files_router_points": _ev("""SELECT event_id::DOUBLE AS offered, user_id * 4 / (CASE WHEN k % 5 = 0 THEN 1 ELSE k % 5 END)::DOUBLE AS achieved, k + 0.5::DOUBLE AS p50, k * 2.0::DOUBLE AS p99,
        CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS errors, k % 2 AS dropped, k % 3 = 0 AND k % 2 = 0 AS clean FROM ev WHERE k % 4 <> 0 AND k % 7 <> 0 AND event_id % 11 <> 0"""),
    "files_heartbeats": "SELECT 'w' || s_suppkey AS worker_id, 'spot' AS market, s_suppkey AS requests_served, 12.5::DOUBLE AS last_seen, 'z' || s_nationkey AS zone, 1 AS others FROM supplier WHERE s_suppkey % 4 <> 0",
    "files_metric_samples": _ev("SELECT 'w' || user_id AS worker_id, sum(k)::BIGINT AS value FROM ev WHERE k % 5 <> 0 GROUP BY 1"),
    "files_tail": _ev("""SELECT file_path, 'e' || event_id AS line FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY event_id DESC) AS r FROM (
        SELECT event_id, 'runs/run-' || user_id % 12 || '/logs/boot-node' || (user_id // 12) % 8 || '-r' || user_id // 96 || '.log' AS file_path FROM ev)) WHERE r <= 3"""),
    "files_discovered": _ev(f"""WITH e AS (SELECT {_KEY}, t, event_type FROM ev), s AS (SELECT run_id, node, attempt, 'status' AS source, count(*) % 2 = 0 AS alive FROM e WHERE event_type = 'view' AND node < 4 GROUP BY 1, 2, 3)
        SELECT * FROM s UNION ALL SELECT run_id, node, attempt, 'listing', {SINCE} - max(t) <= 86400.0 * 20 FROM e WHERE (run_id, node, attempt) NOT IN (SELECT (run_id, node, attempt) FROM s) GROUP BY 1, 2, 3"""),
    "files_appended": with_views("SELECT strftime(make_timestamp((t * 1000000)::BIGINT), '%Y-%m-%d') AS date, region, count(*) AS n, sum(score)::BIGINT AS score FROM sps GROUP BY 1, 2", "sps"),
    "files_snapshot": "SELECT 'run-' || conv_id % 12 AS run_id, turn AS step, CASE WHEN turn < 2 THEN 2 ELSE 1 END AS pass, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2, 3",
    "files_run_index": "SELECT DISTINCT 'run-' || o_custkey AS run_id, o_custkey AS suffix FROM orders",
    "files_panel": _ev(f"SELECT {_R}, t_us AS time, CASE WHEN k % 2 = 0 THEN k END AS train_loss, CASE WHEN k % 3 = 0 THEN value END AS dollars FROM ev WHERE k % 2 = 0 OR (k % 3 = 0 AND value IS NOT NULL)"),
    "files_event_listing": _ev(f"""SELECT run_id, ts, ts - t0 AS t_rel, '+' || (ts - t0)::BIGINT || '.0s node' || node || ' ' || state || ' ' || coalesce(cause, '') AS line FROM (
        SELECT *, min(ts) OVER (PARTITION BY run_id) AS t0 FROM (SELECT {_R}, {_S}::DOUBLE AS ts, {_N}, event_type AS state, CASE WHEN k % 2 = 0 THEN 'c' || k END AS cause FROM ev))"""),
    "files_fact_rows": _ev(f"SELECT run_id, unnest([a * 1000, b * 1000]) AS time FROM (SELECT run_id, min({_S}) AS a, max({_S}) AS b FROM (SELECT *, {_R} FROM ev) GROUP BY 1)"),
    "files_report": "SELECT p_brand, count(*) AS n, round(sum(p_size) / 8.0, 4) AS eighths FROM part GROUP BY 1",
    "files_published": f"SELECT *, true AS ok FROM ({PC.ORACLE['corpus_guards']}) x",
}
for _name in ("files_discovered",):  # a WITH inside with_views' own
    ORACLE[_name] = ORACLE[_name].replace("\nWITH e AS", ",\ne AS")
