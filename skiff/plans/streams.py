"""Streaming operators driven over the driver's tables: records are written as
files to the shared folder, read as a stream until they are drained, and the
sink's rows are returned.  The oracles state the same rows in batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.functions.percentile import nearest_rank, percentiles
from skiff.plans.oracle_views import with_views
from skiff.session import scratch_path
from skiff.sources import driver as D
from skiff.streaming import live as L

#: All of a table's records are on time, in whatever order its files come.
ON_TIME = "36500 days"


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"


def _source(df: DataFrame) -> DataFrame:
    """The records as a file stream."""
    spark = df.sparkSession
    path = _new(spark, "stream-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has written when its source is drained.  Append mode goes to
    the file sink; complete mode replaces the result table with every batch."""
    spark = stream.sparkSession
    out, log = _new(spark, "stream-out"), _new(spark, "stream-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _phased(build, df: DataFrame, time: str, slices: int = 3) -> DataFrame:
    """``build`` over the records in order of ``time``: a slice of time is written to the
    source folder as several files, the query starts, drains it and is stopped, then the
    next slice comes and it starts again from its checkpoint.  Every slice is a batch,
    and state passes from one to the next through the restart."""
    spark = df.sparkSession
    path, out, log = _new(spark, "stream-in"), _new(spark, "stream-out"), _new(spark, "stream-log")
    df = _written(df)
    # a stream's state keeps the number of partitions that it starts with: twice the cores, not more
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    cuts = df.approxQuantile(time, [k / slices for k in range(1, slices)], 0.01)  # bounds of slices, whatever they are
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = (F.lit(True) if lo is None else F.col(time) >= lo) & (F.lit(True) if hi is None else F.col(time) < hi)
        df.filter(own).repartition(4).write.mode("append").parquet(path)
        stream = build(spark.readStream.schema(df.schema).parquet(path))
        writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", out)
        spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
        try:
            writer.start().awaitTermination()
        finally:
            spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(out)


def _written(df: DataFrame) -> DataFrame:
    path = _new(df.sparkSession, "records")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q_dedup(spark, sf):
    t = D.tick_docs(spark, sf).select("run_id", F.floor(F.col("t") / 600).cast("double").alias("updated_at"))
    return _drained(L.dedup_ticks(_source(t), ON_TIME), "append").select("run_id", "updated_at")


def q_sessions(spark, sf):
    t = D.tick_docs(spark, sf).select("run_id", F.floor("t").cast("double").alias("t"))
    return _drained(L.tick_sessions(_source(t), "20 minutes"), "complete")


def q_per_second(spark, sf):
    r = D.request_records(spark, sf).select("test_id", "sent_at", "failed", "latency_ms")
    sketch = _drained(L.latency_sketch(_source(r)), "complete").withColumn("second", F.unix_seconds(F.col("w.start")))
    rows = L.from_sketch(sketch, ["test_id", "second"]).withColumnRenamed("p_ms_approx", "p99_ms_approx")
    # its bound, against the exact percentile of the batch table
    exact = percentiles(r.filter(~F.col("failed")).withColumn("second", F.floor("sent_at").cast("long")), ["test_id", "second"], "latency_ms", {"exact": nearest_rank(99.0)})
    exact = exact.select("test_id", "second", "exact")
    off = F.abs(F.col("p99_ms_approx") - F.coalesce("exact", F.lit(0.0)))
    return rows.join(exact, ["test_id", "second"], "left").withColumn("p99_within", off <= L.SKETCH_ERROR * F.abs(F.coalesce("exact", F.lit(0.0))) + 1e-9).drop("exact")


def q_deltas(spark, sf):
    s = D.scrape_records(spark, sf).select("worker_id", "ts", "ok", F.col("d_requests").alias("requests"), F.col("d_tokens").alias("completion_tokens"), F.col("in_flight").cast("double").alias("generate_seconds"))
    return _phased(lambda d: L.counter_deltas(d, ON_TIME), s, "ts")


def q_sliding(spark, sf):
    d = D.events_base(spark, sf).select(F.concat(F.lit("w"), F.col("user_id") % 10).alias("worker_id"), F.col("t").alias("ts"), F.col("k").cast("long").alias("d_requests"))
    return _drained(L.sliding_rates(_source(d), "1 hour", "20 minutes"), "complete")


def q_rates(spark, sf):
    """Counters that start again with every thousandth event, in windows of a day."""
    c = D.events_base(spark, sf).select(F.concat(F.lit("w"), F.col("user_id") % 50).alias("worker_id"), F.col("t").alias("ts"), (F.col("event_id") % 1000).alias("requests"))
    return _phased(lambda d: L.extrapolated_rates(d, ["worker_id"], "requests", "24 hours", "6 hours", f"{LATE} seconds"), c, "ts")


def q_gauges(spark, sf):
    return _drained(L.latest_gauges(_source(D.scrape_records(spark, sf).select("worker_id", "ts", "ok", "in_flight"))), "complete")


def q_nodes(spark, sf):
    o = D.node_observations(spark, sf).select("run_id", "node", "attempt", "t", "aws_state")
    return _phased(lambda d: L.node_states(d, ON_TIME, idle=3.2e9), o, "t")


#: Seconds of silence after which a worker is down, and of lateness that the watermark waits.
TTL, LATE = 3600.5, 600


def q_liveness(spark, sf):
    beats = D.events_base(spark, sf).select(F.concat(F.lit("w"), F.col("user_id") % 50).alias("worker_id"), F.when(F.col("event_type") != "error", F.lit("10.0.0.1")).alias("addr"), F.col("t").alias("last_seen"))
    return _phased(lambda d: L.liveness(d, TTL, f"{LATE} seconds"), beats, "last_seen")


STALL_S, EPOCHS = 100_000.0, 2


def q_alarms(spark, sf):
    """Ticks whose durable step advances every 1,300 events; a run is done with its first tick of the greatest value after the tenth epoch."""
    done = (F.col("k") == 99) & (F.col("epoch") > 10)
    ticks = D.tick_docs(spark, sf).join(D.events_base(spark, sf).select("event_id", "k"), "event_id")
    ticks = ticks.select("run_id", "t", "epoch", F.expr("event_id div 1300").alias("ckpt_step"), done.alias("done"))
    return _phased(lambda d: L.stall_alarms(d, STALL_S, EPOCHS, idle=3.2e9), ticks, "t")


def q_step_dedup(spark, sf):
    """Step lines of which every other slice is read again: all are delivered twice, the second time a second later."""
    ev = D.events_base(spark, sf).selectExpr("concat('run-', cast(user_id % 12 as string)) as run_id", "cast((user_id div 12) % 8 as int) as node", "cast(user_id div 96 as int) as attempt", "event_id as step", "t")
    return _phased(lambda d: L.dedup_steps(d, "2 hours"), ev.unionAll(ev.withColumn("t", F.col("t") + 1)), "t").select("run_id", "node", "attempt", "step")


def q_spot_lines(spark, sf):
    """Complete lines of spot shards; those of whole seconds divisible by five are cut."""
    from skiff.sources.files import SPOT_SCHEMA

    rec = D.sps_records(spark, sf).select(F.lit("sps").alias("type"), "t", "region", "instance_type", "score")
    doc = F.to_json(F.struct(*rec.columns))
    path = _new(spark, "spot")
    rec.select(F.when(F.floor("t") % 5 == 0, F.substring(doc, 1, 25)).otherwise(doc).alias("value")).write.text(path)
    return _drained(L.spot_stream(spark, path, SPOT_SCHEMA).select(*rec.columns), "append")


def q_hourly(spark, sf):
    return _drained(L.hourly_best(_source(D.sps_records(spark, sf).select("t", "tick_id", "score")), 7.0), "complete")


def q_appended(spark, sf):
    root = _new(spark, "stream-shards")
    L.append_stream(_source(D.sps_records(spark, sf).select("t", "region", "score")), root, uuid.uuid4().hex).awaitTermination()
    return spark.read.parquet(root).groupBy(F.col("date").cast("string").alias("date"), "region").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def q_log_tail(spark, sf):
    """Step lines followed through three batches of writing; the query is stopped and restarted between them."""
    from skiff.plans import files as P
    from skiff.sources import files as R

    logs, out, log = _new(spark, "logs"), _new(spark, "stream-out"), _new(spark, "stream-log")
    lines = P._lines(spark, sf, P._STEP).select(F.concat_ws("|", "run_id", "node", "attempt", "line").alias("value"), F.col("seq"))
    types = D.events_base(spark, sf).select(F.col("event_id").alias("seq"), "event_type")
    lines = lines.join(types, "seq")
    for some in ("event_type = 'view'", "event_type = 'click'", "event_type NOT IN ('view', 'click')"):
        lines.filter(some).select("value").write.mode("append").text(logs)
        tail = L.log_tail(spark, logs).withColumn("p", F.split("line", r"\|", 4))
        tail = tail.select(F.col("p")[0].alias("run_id"), F.col("p")[1].cast("int").alias("node"), F.col("p")[2].cast("int").alias("attempt"), F.col("p")[3].alias("line"), "file_path", F.lit(0).alias("block_start"), F.col("position").alias("seq"))
        steps = R.step_lines(tail)
        steps.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(steps.schema).parquet(out).select("run_id", "node", "attempt", "step", F.round("loss", 4).alias("loss"), "ms", "tok_s", "ws", "t")


QUERIES = {
    "stream_log_tail": q_log_tail,
    "stream_tick_dedup": q_dedup,
    "stream_tick_sessions": q_sessions,
    "stream_per_second": q_per_second,
    "stream_counter_deltas": q_deltas,
    "stream_sliding_rates": q_sliding,
    "stream_extrapolated_rates": q_rates,
    "stream_latest_gauges": q_gauges,
    "stream_node_states": q_nodes,
    "stream_liveness": q_liveness,
    "stream_alarms": q_alarms,
    "stream_step_dedup": q_step_dedup,
    "stream_spot_lines": q_spot_lines,
    "stream_hourly_best": q_hourly,
    "stream_appended": q_appended,
}

_EVENT_KEY = "'run-' || user_id % 12 AS run_id, (user_id // 12) % 8 AS node, user_id // 96 AS attempt"

ORACLE = {
    "stream_log_tail": with_views(f"""SELECT {_EVENT_KEY}, event_id AS step, round((k // 10) + (k % 10) / 10.0 + (user_id % 1000) / 10000.0, 4) AS loss, k + 5 AS ms, user_id + 1 AS tok_s, k % 8 + 1 AS ws,
        (t_us // 1000000) + 0.5::DOUBLE AS t FROM ev""", "ev"),
    "stream_tick_dedup": with_views("SELECT DISTINCT run_id, floor(t / 600) AS updated_at FROM ticks", "ticks"),
    "stream_tick_sessions": with_views("""SELECT run_id, (min(s) * 1000000)::BIGINT AS start_us, (max(s) * 1000000)::BIGINT + 1200000000 AS end_us, count(*) AS ticks FROM (
        SELECT *, sum((p IS NULL OR s - p >= 1200)::INT) OVER (PARTITION BY run_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (
            SELECT run_id, floor(t) AS s, lag(floor(t)) OVER (PARTITION BY run_id ORDER BY t) AS p FROM ticks)) GROUP BY run_id, g""", "ticks"),
    "stream_per_second": with_views("""SELECT s.*, coalesce(q.p99, 0.0) AS p99_ms_approx, true AS p99_within FROM (
          SELECT test_id, floor(sent_at)::BIGINT AS second, count(*) AS sent, count(latency_ms) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS errors,
            coalesce(avg(latency_ms) FILTER (NOT failed), 0.0) AS mean_ms FROM req GROUP BY 1, 2) s
        LEFT JOIN (SELECT test_id, second, CASE WHEN latency_ms > 0 THEN 2 * pow(1.01::DOUBLE / 0.99, ceil(ln(latency_ms) / ln(1.01::DOUBLE / 0.99))) / (1.01::DOUBLE / 0.99 + 1) ELSE 0.0 END AS p99 FROM (
            SELECT test_id, floor(sent_at)::BIGINT AS second, latency_ms, row_number() OVER w AS r, count(*) OVER (PARTITION BY test_id, floor(sent_at)) AS n
            FROM req WHERE NOT failed AND latency_ms IS NOT NULL WINDOW w AS (PARTITION BY test_id, floor(sent_at) ORDER BY latency_ms))
          WHERE r = ceil(0.99::DOUBLE * n)) q USING (test_id, second)""", "req"),
    "stream_counter_deltas": with_views("""SELECT worker_id, ts, CASE WHEN g THEN greatest(d_requests - pr, 0) ELSE 0 END AS d_requests, CASE WHEN g THEN greatest(d_tokens - pt, 0) ELSE 0 END AS d_tokens,
        CASE WHEN g THEN greatest(in_flight - pg, 0) ELSE 0 END::DOUBLE AS d_gen, CASE WHEN g THEN ts - pts ELSE 0 END::DOUBLE AS dt FROM (
        SELECT *, coalesce(lag(ok) OVER w, false) AND ok AS g, lag(d_requests) OVER w AS pr, lag(d_tokens) OVER w AS pt, lag(in_flight) OVER w AS pg, lag(ts) OVER w AS pts
        FROM scrape WINDOW w AS (PARTITION BY worker_id ORDER BY ts))""", "scrape"),
    "stream_sliding_rates": with_views("""SELECT worker_id, start, sum(k)::BIGINT AS increase, sum(k) / 3600.0::DOUBLE AS rate FROM (
        SELECT 'w' || user_id % 10 AS worker_id, k, unnest([t_us // 1200000000 * 1200, t_us // 1200000000 * 1200 - 1200, t_us // 1200000000 * 1200 - 2400]) AS start FROM ev) GROUP BY 1, 2""", "ev"),
    "stream_extrapolated_rates": with_views(f"""SELECT worker_id, start, n AS samples, up * x / between AS increase, up * x / between / 86400 AS rate FROM (
        SELECT *, between + CASE WHEN up > 0 AND v0 >= 0 THEN least(before, between * v0 / up) ELSE before END + after AS x FROM (
          SELECT *, CASE WHEN t0 - start >= 1.1::DOUBLE * mean THEN mean / 2 ELSE t0 - start END AS before,
            CASE WHEN start + 86400 - t1 >= 1.1::DOUBLE * mean THEN mean / 2 ELSE start + 86400 - t1 END AS after FROM (
            SELECT worker_id, start, count(*) AS n, min(ts) AS t0, max(ts) AS t1, max(ts) - min(ts) AS between, (max(ts) - min(ts)) / (count(*) - 1) AS mean,
              first(v ORDER BY ts) AS v0, coalesce(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END), 0)::DOUBLE AS up FROM (
              SELECT *, lag(v) OVER (PARTITION BY worker_id, start ORDER BY ts) AS p FROM (
                SELECT worker_id, ts, max(v) AS v, unnest([floor(ts / 21600) * 21600 - 21600 * i for i in range(4)])::BIGINT AS start FROM (
                  SELECT 'w' || user_id % 50 AS worker_id, t AS ts, (event_id % 1000)::DOUBLE AS v FROM ev) GROUP BY worker_id, ts))
            GROUP BY worker_id, start HAVING count(*) > 1)))
        WHERE start + 86400 <= (SELECT max(t) FROM ev) - {LATE}""", "ev"),
    "stream_latest_gauges": with_views("SELECT worker_id, ts, greatest(in_flight - 1, 0) AS queued FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC) AS r FROM scrape) WHERE r = 1 AND ok", "scrape"),
    "stream_node_states": with_views("""SELECT run_id, node, attempt, t, CASE WHEN dead THEN 'dead' ELSE 'live' END AS state,
        CASE WHEN dead AND NOT coalesce(was, false) THEN 'dead' WHEN was IS NULL THEN 'new' END AS transition FROM (
        SELECT *, lag(dead) OVER (PARTITION BY run_id, node, attempt ORDER BY t) AS was FROM (
            SELECT *, bool_or(aws_state IN ('shutting-down', 'terminated', 'stopping', 'stopped')) OVER (PARTITION BY run_id, node, attempt ORDER BY t ROWS UNBOUNDED PRECEDING) AS dead FROM node_obs))""", "node_obs"),
    "stream_liveness": with_views(f"""SELECT worker_id, 'up' AS change, t AS at FROM hb WHERE p IS NULL OR t - p > {TTL}::DOUBLE
        UNION ALL SELECT worker_id, 'down', p + {TTL}::DOUBLE FROM hb WHERE t - p > {TTL}::DOUBLE
        UNION ALL SELECT worker_id, 'down', max(t) + {TTL}::DOUBLE FROM hb GROUP BY 1 HAVING max(t) + {TTL}::DOUBLE <= (SELECT max(t) FROM hb) - {LATE}""", "ev").replace("\nSELECT worker_id, 'up'", """,
        hb AS (SELECT 'w' || user_id % 50 AS worker_id, t, lag(t) OVER (PARTITION BY user_id % 50 ORDER BY t) AS p FROM ev WHERE event_type <> 'error')\nSELECT worker_id, 'up'""", 1),
    "stream_alarms": with_views(f"""SELECT run_id, t, CASE WHEN t - since > {STALL_S} THEN 'stall' ELSE 'flap' END AS alarm FROM (
        SELECT *, max(CASE WHEN progress OR moved = 1 OR r = 1 THEN t END) OVER w AS since, e - coalesce(max(CASE WHEN progress THEN e END) OVER w, 0) AS without_progress FROM (
          SELECT *, sum(moved) OVER w AS e FROM (
            SELECT *, row_number() OVER w AS r, c > coalesce(max(c) OVER b, -1) AS progress, CASE WHEN epoch <> lag(epoch) OVER w THEN 1 ELSE 0 END AS moved, coalesce(bool_or(fin) OVER b, false) AS over_before FROM (
              SELECT run_id, t, epoch, event_id // 1300 AS c, k = 99 AND epoch > 10 AS fin FROM ticks)
            WINDOW w AS (PARTITION BY run_id ORDER BY t), b AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          WINDOW w AS (PARTITION BY run_id ORDER BY t))
        WINDOW w AS (PARTITION BY run_id ORDER BY t)) WHERE NOT over_before AND (t - since > {STALL_S} OR without_progress >= {EPOCHS})""", "ticks"),
    "stream_step_dedup": with_views(f"SELECT {_EVENT_KEY}, event_id AS step FROM ev", "ev"),
    "stream_spot_lines": with_views("SELECT 'sps' AS type, t, region, instance_type, score FROM sps WHERE floor(t) % 5 <> 0", "sps"),
    "stream_hourly_best": with_views("""SELECT floor(t / 3600)::BIGINT * 3600 AS hour_start, count(DISTINCT tick_id) AS ticks, count(DISTINCT CASE WHEN score >= 7 THEN tick_id END) / count(DISTINCT tick_id)::DOUBLE AS p_good, max(score) AS max_best
        FROM sps GROUP BY 1""", "sps"),
    "stream_appended": with_views("SELECT strftime(make_timestamp((t * 1000000)::BIGINT), '%Y-%m-%d') AS date, region, count(*) AS n, sum(score)::BIGINT AS score FROM sps GROUP BY 1, 2", "sps"),
}
