"""Readers for the raw layouts the fleet writes (SRC-01 … SRC-20).

Every reader is a file scan plus column expressions: ``spark.read.text`` /
``json`` / ``binaryFile`` with the hidden ``_metadata`` column for the path,
``regexp_extract`` for line formats, ``from_json`` with a declared schema for
embedded JSON.  Malformed and half-written lines are dropped, never fatal.
Line order inside a file (needed for "first occurrence") is
``(file_path, file_block_start, monotonically_increasing_id)``: ids increase
within a split and splits of one file are ordered by their start offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line formats the trainer, the sidecar and the supervisor
# print (they must match the producers byte for byte).
STEP_RE = r"step (\d+): loss ([0-9.]+), (\d+)ms/step, (\d+) tok/s, ws (\d+), t ([0-9.]+)"
STEP_RE_OLD = r"step\s+(\d+):\s+loss\s+([0-9.]+),\s+(\d+)ms/step,\s+(\d+)\s+tok/s(?:,\s+ws\s+(\d+))?"
RANK_RE = r"\[rank (\d+)\] step (\d+) .*?\| ws (\d+)(?:\s*\| t ([0-9.]+))?"
EVAL_RE = r"eval\s+step\s+(\d+):\s+val_loss\s+([0-9.]+)"
NODE_RE = r"boot-node(\d+)(?:-r(\d+))?\.log"
EVENT_PREFIX = "[event] "
EPOCH_RE = r"published epoch (\d+): members \[([^\]]*)\] master=node(\d+)"
TERMINATED_RE = r"terminated node (\d+) \((i-[0-9a-f]+)\)"
RUN_FACT_KEYS = ["DATASET", "N_LAYER", "N_HEAD", "N_EMBD", "BLOCK_SIZE", "GLOBAL_BATCH_SIZE"]
PARAMS_RE = r"number of parameters:\s*([0-9.]+)M"
DECAYED_RE = r"num decayed parameter tensors: \d+, with ([\d,]+) parameters"
NON_DECAYED_RE = r"num non-decayed parameter tensors: \d+, with ([\d,]+) parameters"

EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()), T.StructField("node", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("state", T.StringType()),
    T.StructField("epoch", T.IntegerType()), T.StructField("world", T.IntegerType()),
    T.StructField("leader", T.IntegerType()), T.StructField("step", T.LongType()),
    T.StructField("cause", T.StringType()), T.StructField("by", T.StringType()),
])

NODE_DOC = T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("instance_id", T.StringType()), T.StructField("aws_state", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("log_key", T.StringType()),
    T.StructField("ip", T.StringType()), T.StructField("log_age_s", T.DoubleType()),
])
STATUS_DOC = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("run_id", T.StringType()),
    T.StructField("updated_at", T.DoubleType()), T.StructField("epoch", T.IntegerType()),
    T.StructField("members", T.ArrayType(T.IntegerType())), T.StructField("ckpt_step", T.LongType()),
    T.StructField("done", T.BooleanType()), T.StructField("nodes", T.ArrayType(NODE_DOC)),
])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path)
    return df.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _run_of(path: Column) -> Column:
    return F.regexp_extract(path, r"runs/([^/]+)/", 1)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of boot logs ``runs/<run_id>/logs/boot-node<N>[-r<k>].log`` with
    run, slot (node), generation (attempt) and an in-file order key."""
    d = _lines(spark, path)
    return d.select(
        "line", "file_path", "file_name", "block_start", "seq",
        _run_of(F.col("file_path")).alias("run_id"),
        F.regexp_extract("file_name", NODE_RE, 1).cast("int").alias("node"),
        F.coalesce(F.nullif(F.regexp_extract("file_name", NODE_RE, 2), F.lit("")).cast("int"), F.lit(0)).alias("attempt"),
    )


def _extract(col: str, pattern: str, groups: dict[str, tuple[int, str]]) -> list[Column]:
    out = []
    for name, (g, typ) in groups.items():
        raw = F.regexp_extract(col, pattern, g)
        out.append(F.nullif(raw, F.lit("")).cast(typ).alias(name))
    return out


def step_lines(lines: DataFrame) -> DataFrame:
    """SRC-01: rank-0 step lines with wall clock -> (step, loss, ms, tok_s, ws, t)."""
    m = lines.filter(F.col("line").rlike(STEP_RE))
    return m.select(
        "run_id", "node", "attempt", "file_path", "block_start", "seq",
        *_extract("line", STEP_RE, {"step": (1, "long"), "loss": (2, "double"), "ms": (3, "int"),
                                    "tok_s": (4, "int"), "ws": (5, "int"), "t": (6, "double")}),
    )


def step_lines_any(lines: DataFrame) -> DataFrame:
    """SRC-02: step lines in the older format (no clock, optional world
    size); repeated full reads are idempotent: the first observation of a
    ``(run, node, attempt, step)`` wins."""
    m = lines.filter(F.col("line").rlike(STEP_RE_OLD))
    s = m.select(
        "run_id", "node", "attempt", "file_path", "block_start", "seq",
        *_extract("line", STEP_RE_OLD, {"step": (1, "long"), "loss": (2, "double"), "ms": (3, "int"),
                                        "tok_s": (4, "int"), "ws": (5, "int")}),
    )
    first = s.groupBy("run_id", "node", "attempt", "step").agg(
        F.min_by(F.struct("loss", "ms", "tok_s", "ws"), F.struct("file_path", "block_start", "seq")).alias("x")
    )
    return first.select("run_id", "node", "attempt", "step", "x.*")


def eval_lines(lines: DataFrame) -> DataFrame:
    """SRC-03: validation lines (the clock comes from JN-02)."""
    m = lines.filter(F.col("line").rlike(EVAL_RE))
    return m.select("run_id", "node", "attempt", *_extract("line", EVAL_RE, {"step": (1, "long"), "loss": (2, "double")}))


def rank_lines(lines: DataFrame) -> DataFrame:
    """SRC-04: per-rank progress lines of the other nodes (clock optional)."""
    m = lines.filter(F.col("line").rlike(RANK_RE) & ~F.col("line").rlike(STEP_RE))
    return m.select(
        "run_id", F.col("node").alias("slot"), F.col("attempt").alias("gen"),
        *_extract("line", RANK_RE, {"rank": (1, "int"), "step": (2, "long"), "ws": (3, "int"), "t": (4, "double")}),
    )


def event_lines(lines: DataFrame) -> DataFrame:
    """SRC-05: ``[event] {json}`` records; node and attempt default to the
    log file's; malformed JSON or records without a numeric ``ts`` and a
    ``state`` are skipped."""
    m = lines.filter(F.instr("line", EVENT_PREFIX) > 0)
    payload = F.substring(F.col("line"), F.instr("line", EVENT_PREFIX) + len(EVENT_PREFIX), 1 << 30)
    ts_raw = F.get_json_object(payload, "$.ts")
    parsed = m.select(
        "run_id", F.col("node").alias("__fn"), F.col("attempt").alias("__fa"), "file_path", "block_start", "seq",
        F.from_json(payload, EVENT_SCHEMA).alias("e"), ts_raw.alias("__ts_raw"),
    )
    ok = F.col("e").isNotNull() & F.col("e.ts").isNotNull() & F.col("e.state").isNotNull() & F.col("__ts_raw").rlike(r"^-?[0-9.eE+-]+$")
    return parsed.filter(ok).select(
        "run_id", "e.ts", F.coalesce("e.node", "__fn").alias("node"), F.coalesce("e.attempt", "__fa").alias("attempt"),
        "e.state", "e.epoch", "e.world", "e.leader", "e.step", "e.cause", "e.by", "file_path", "block_start", "seq",
    )


def decision_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-06: supervisor ``run.log`` files -> see ``decision_lines``."""
    return decision_lines(_lines(spark, path).withColumn("run_id", _run_of(F.col("file_path"))))


def decision_lines(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of decision logs -> ``epochs(run_id, epoch, members, master)``
    (first publication of each epoch) and ``terminations(run_id, pos, node,
    instance_id)`` (log order)."""
    pos = F.struct("file_path", "block_start", "seq")
    ep = d.filter(F.col("line").rlike(EPOCH_RE)).select(
        "run_id", pos.alias("pos"),
        F.regexp_extract("line", EPOCH_RE, 1).cast("int").alias("epoch"),
        F.filter(
            F.transform(F.split(F.regexp_replace(F.regexp_extract("line", EPOCH_RE, 2), " ", ""), ","), lambda x: F.nullif(x, F.lit("")).cast("int")),
            lambda x: x.isNotNull(),
        ).alias("members"),
        F.regexp_extract("line", EPOCH_RE, 3).cast("int").alias("master"),
    )
    epochs = ep.groupBy("run_id", "epoch").agg(F.min_by(F.struct("members", "master"), "pos").alias("x")).select("run_id", "epoch", "x.*")
    terms = d.filter(F.col("line").rlike(TERMINATED_RE)).select(
        "run_id", pos.alias("pos"),
        F.regexp_extract("line", TERMINATED_RE, 1).cast("int").alias("node"),
        F.regexp_extract("line", TERMINATED_RE, 2).alias("instance_id"),
    )
    return epochs, terms


def status_ticks(spark: SparkSession, path: str, jsonl: bool = True) -> DataFrame:
    """SRC-07: status ticks.  JSONL history ``{t, doc}``, or one object per
    tick named ``<epoch-ms>.json`` whose event time is the file name (falling
    back to ``updated_at``)."""
    if jsonl:
        schema = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("doc", STATUS_DOC),
                               T.StructField("_corrupt_record", T.StringType())])
        d = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
        d = d.filter(F.col("_corrupt_record").isNull() & F.col("t").isNotNull())
        return d.select("t", "doc.*")
    schema = T.StructType(STATUS_DOC.fields + [T.StructField("_corrupt_record", T.StringType())])
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    name_ms = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.json$", 1)
    t = F.coalesce(F.nullif(name_ms, F.lit("")).cast("double") / 1000.0, F.col("updated_at"))
    return d.filter(F.col("_corrupt_record").isNull()).select(t.alias("t"), *[f.name for f in STATUS_DOC.fields])


def merge_ticks(durable: DataFrame, polled: DataFrame) -> DataFrame:
    """SET-05 / ST-02 in batch: ticks from the durable objects and from
    polling, one per ``(run_id, updated_at)``: durable wins, among polled
    the first poll wins."""
    a = durable.withColumn("__src", F.lit(0)).withColumn("__ord", F.col("t"))
    b = polled.withColumn("__src", F.lit(1)).withColumn("__ord", F.col("t"))
    u = a.unionByName(b, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in ("run_id", "updated_at", "__src", "__ord")]
    best = u.groupBy("run_id", "updated_at").agg(F.min_by(F.struct(*cols), F.struct("__src", "__ord")).alias("x"))
    return best.select("run_id", "updated_at", "x.*")


def run_facts(lines: DataFrame) -> DataFrame:
    """SRC-08: run facts, first occurrence in (file, line) order only (every
    rank prints the census: never summed), pivoted to one row per run."""
    pos = F.struct("file_path", "block_start", "seq")
    kv = []
    for key in RUN_FACT_KEYS:
        kv.append(F.struct(F.lit(key).alias("k"), F.nullif(F.regexp_extract("line", rf"\b{key}=(\S+)", 1), F.lit("")).alias("v")))
    kv.append(F.struct(F.lit("params_m").alias("k"), F.nullif(F.regexp_extract("line", PARAMS_RE, 1), F.lit("")).alias("v")))
    kv.append(F.struct(F.lit("decayed").alias("k"), F.nullif(F.regexp_replace(F.regexp_extract("line", DECAYED_RE, 1), ",", ""), F.lit("")).alias("v")))
    kv.append(F.struct(F.lit("non_decayed").alias("k"), F.nullif(F.regexp_replace(F.regexp_extract("line", NON_DECAYED_RE, 1), ",", ""), F.lit("")).alias("v")))
    e = lines.select("run_id", pos.alias("pos"), F.explode(F.array(*kv)).alias("kv")).filter(F.col("kv.v").isNotNull())
    first = e.groupBy("run_id", F.col("kv.k").alias("k")).agg(F.min_by("kv.v", "pos").alias("v"))
    keys = RUN_FACT_KEYS + ["params_m", "decayed", "non_decayed"]
    wide = first.groupBy("run_id").pivot("k", keys).agg(F.first("v"))
    exact = F.when(F.col("decayed").isNotNull() & F.col("non_decayed").isNotNull(), F.col("decayed").cast("long") + F.col("non_decayed").cast("long"))
    model = F.when(F.col("N_LAYER").isNotNull() & F.col("N_HEAD").isNotNull() & F.col("N_EMBD").isNotNull(),
                   F.concat(F.lit("GPT-2 · "), F.col("N_LAYER"), F.lit("L/"), F.col("N_HEAD"), F.lit("H/"), F.col("N_EMBD"), F.lit("d")))
    return wide.withColumn("params_exact", exact).withColumn("model", model).drop("decayed", "non_decayed")


PROFILE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("market", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("durations", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("phase", T.StringType()), T.StructField("seconds", T.DoubleType())]))),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("event", T.StringType()), T.StructField("t_wall", T.DoubleType()),
        T.StructField("t_rel", T.DoubleType()), T.StructField("segment", T.IntegerType())]))),
    T.StructField("loss_samples", T.ArrayType(T.StructType([
        T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("ms_per_step", T.IntegerType()),
        T.StructField("tok_s", T.IntegerType()), T.StructField("t_rel", T.DoubleType()), T.StructField("world_size", T.IntegerType())]))),
    T.StructField("val_samples", T.ArrayType(T.StructType([
        T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("t_rel", T.DoubleType())]))),
    T.StructField("cost", T.StructType([
        T.StructField("instances", T.ArrayType(T.StructType([
            T.StructField("instance_id", T.StringType()), T.StructField("market", T.StringType()), T.StructField("az", T.StringType()),
            T.StructField("hourly_usd", T.DoubleType()), T.StructField("started_at", T.DoubleType()),
            T.StructField("stopped_at", T.DoubleType()), T.StructField("billed_seconds", T.DoubleType()), T.StructField("usd", T.DoubleType())]))),
        T.StructField("total_usd", T.DoubleType()), T.StructField("rate_unknown_count", T.IntegerType())])),
    T.StructField("_corrupt_record", T.StringType()),
])


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: run profile documents (one JSON document per file); torn
    documents are dropped; a run without a profile simply has no row (left
    join from the run index keeps it)."""
    d = spark.read.schema(PROFILE_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return d.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


SAMPLES_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("samples", T.ArrayType(T.StructType([
        T.StructField("prompt", T.StringType()), T.StructField("sample_index", T.IntegerType()),
        T.StructField("completion", T.StringType())]))),
])


def text_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: text-sample snapshots; the first document per (run, step)
    wins; one row per sample."""
    d = spark.read.schema(SAMPLES_SCHEMA).option("multiLine", "true").json(path).withColumn("__f", F.col("_metadata.file_path"))
    first = d.groupBy("run_id", "step").agg(F.min_by("samples", "__f").alias("samples"))
    return first.select("run_id", "step", F.explode("samples").alias("s")).select("run_id", "step", "s.*")


SPOT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("tick_id", T.StringType()), T.StructField("ts", T.StringType()),
    T.StructField("t", T.DoubleType()), T.StructField("region", T.StringType()), T.StructField("az", T.StringType()),
    T.StructField("az_id", T.StringType()), T.StructField("instance_type", T.StringType()),
    T.StructField("capacity", T.IntegerType()), T.StructField("single_az", T.BooleanType()),
    T.StructField("score", T.IntegerType()), T.StructField("scope", T.StringType()),
    T.StructField("truncated", T.BooleanType()), T.StructField("retries", T.IntegerType()),
    T.StructField("error_code", T.StringType()), T.StructField("throttled", T.BooleanType()),
    T.StructField("config_capped", T.BooleanType()), T.StructField("price_usd", T.DoubleType()),
    T.StructField("quoted_at", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("interruption_range", T.StringType()), T.StructField("interruption_index", T.IntegerType()),
    T.StructField("savings_pct", T.IntegerType()), T.StructField("capacity_available", T.BooleanType()),
    T.StructField("fulfilled", T.BooleanType()), T.StructField("final_state", T.StringType()),
    T.StructField("seconds_to_state", T.DoubleType()), T.StructField("instance_id", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("daily", T.BooleanType()),
    T.StructField("sps_requests", T.IntegerType()), T.StructField("config_budget", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()), T.StructField("record_count", T.IntegerType()),
    T.StructField("error_count", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def spot_records(spark: SparkSession, root: str, since_t: float | None = None) -> DataFrame:
    """SRC-11 + FLT-10 + ST-13: append-only spot shards
    ``<root>/<YYYY-MM-DD>/<epoch>-<tick>.jsonl``.  Shards are chosen by the
    epoch in the file name (a predicate on ``_metadata.file_name``, before
    any row is parsed), rows at or after the cutoff are kept, and cut or
    corrupt lines are dropped."""
    d = spark.read.option("recursiveFileLookup", "true").text(root)
    return spot_lines(d.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name")), since_t)


def spot_lines(lines: DataFrame, since_t: float | None = None) -> DataFrame:
    """Records of spot shards from their lines (``line``, ``file_name``): the
    shard's name decides before a line is parsed."""
    shard_epoch = F.nullif(F.regexp_extract("file_name", r"^([0-9.]+)-[^/]*\.jsonl$", 1), F.lit("")).cast("double")
    d = lines.withColumn("shard_epoch", shard_epoch).filter(F.col("shard_epoch").isNotNull())
    if since_t is not None:
        d = d.filter(F.col("shard_epoch") >= since_t)
    d = d.select(F.from_json("line", SPOT_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), "shard_epoch").select("r.*", "shard_epoch")
    if since_t is not None:
        d = d.filter(F.col("t") >= since_t)
    return d.filter(F.col("_corrupt_record").isNull() & F.col("type").isNotNull()).drop("_corrupt_record")


def _advised(recs: DataFrame, types: list[str] | DataFrame, tick_id: Column, t: Column) -> DataFrame:
    """Records of the wanted types from ``(region, instance_type, r, s, ranges)``; the label is
    that of the document's own ``ranges`` (the last of an index), "" without one."""
    recs = recs.filter(F.col("instance_type").isin(types)) if isinstance(types, list) else recs.join(types, "instance_type", "left_semi")
    label = F.try_element_at(F.filter("ranges", lambda x: x["index"] == F.col("r")), F.lit(-1))["label"]
    return recs.select(
        F.lit("interruption").alias("type"), tick_id.alias("tick_id"), t.alias("t"), "region", "instance_type",
        F.col("r").alias("interruption_index"), F.col("s").alias("savings_pct"), F.coalesce(label, F.lit("")).alias("interruption_range"),
    )


def advisor_records(doc: DataFrame, types: list[str] | DataFrame, tick_id: Column, t: Column) -> DataFrame:
    """SRC-12: flatten ``spot_advisor: region -> os -> type -> {r, s}`` into
    one record per (region, type) for Linux, labels from ``ranges``.  Any number of
    documents; ``types`` is a short list or a DataFrame with ``instance_type``."""
    regions = doc.select("*", F.explode("spot_advisor").alias("region", "__by_os"))
    recs = regions.select("*", F.explode(F.col("__by_os")["Linux"]).alias("instance_type", "__v"))
    return _advised(recs.withColumns({"r": F.col("__v.r"), "s": F.col("__v.s")}), types, tick_id, t)


def advisor_documents(lines: DataFrame, types: list[str] | DataFrame, tick_id: Column, t: Column, doc: str = "line") -> DataFrame:
    """SRC-12 from the documents' text, one a row: parsed once into a variant, whose regions
    and types are then rows (``variant_explode``), so no schema names them and no map of a
    region is built.  Rows carry the wanted fields only; a document that isn't JSON (null,
    empty, torn) and a region without Linux have none.  Other columns of ``lines`` may make
    up ``tick_id`` and ``t``."""
    tvf = lines.sparkSession.tvf
    d = lines.select("*", F.try_parse_json(doc).alias("__d")).select(
        tick_id.alias("__id"), t.alias("__t"),
        F.try_variant_get("__d", "$.ranges", "array<struct<index:int,label:string>>").alias("ranges"),
        F.try_variant_get("__d", "$.spot_advisor", "variant").alias("__s"),
    )
    r = d.lateralJoin(tvf.variant_explode(F.col("__s").outer()))
    r = r.select("__id", "__t", "ranges", F.col("key").alias("region"), F.try_variant_get("value", "$.Linux", "variant").alias("__s"))
    r = r.lateralJoin(tvf.variant_explode(F.col("__s").outer()))
    r = r.select("__id", "__t", "ranges", "region", F.col("key").alias("instance_type"),
                 F.try_variant_get("value", "$.r", "int").alias("r"), F.try_variant_get("value", "$.s", "int").alias("s"))
    return _advised(r.filter(F.col("instance_type").isNotNull()), types, F.col("__id"), F.col("__t"))


REPORT_FIELDS = [
    ("rps", "double"), ("concurrency", "int"), ("duration_s", "double"), ("requests", "int"), ("succeeded", "int"),
    ("failed", "int"), ("dropped", "int"), ("error_rate", "double"), ("completion_tokens", "long"),
    ("tokens_per_second", "double"), ("mean_ms", "double"), ("p50_ms", "double"), ("p90_ms", "double"),
    ("p95_ms", "double"), ("p99_ms", "double"), ("start_unix", "double"), ("kill_at_s", "double"),
]


def load_points(spark: SparkSession, manifests: str) -> DataFrame:
    """SRC-13: sweep manifests -> normalised points: warm-up points skipped,
    points without a report skipped, missing numbers read 0."""
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("url", T.StringType()), T.StructField("slo_multiplier", T.DoubleType()),
        T.StructField("points", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("offered_rps", T.DoubleType()),
            T.StructField("workers", T.IntegerType()), T.StructField("warmup", T.BooleanType()),
            T.StructField("report", T.StructType([T.StructField(n, T.StringType()) for n, _ in REPORT_FIELDS] + [T.StructField("url", T.StringType())])),
        ]))),
    ])
    d = spark.read.schema(schema).option("multiLine", "true").json(manifests)
    p = d.select(F.explode("points").alias("p")).filter(~F.coalesce(F.col("p.warmup"), F.lit(False)) & F.col("p.report").isNotNull())
    cols = [F.coalesce(F.col("p.workers"), F.lit(1)).alias("workers")]
    for n, typ in REPORT_FIELDS:
        v = F.col(f"p.report.{n}").cast(typ)
        cols.append(v.alias(n) if n == "kill_at_s" else F.coalesce(v, F.lit(0).cast(typ)).alias(n))
    out = p.select(*cols, F.col("p.offered_rps").alias("__o"), F.col("p.label").alias("__l"))
    out = out.withColumn("offered_rps", F.coalesce(F.col("__o"), F.col("rps")))
    label = F.coalesce(F.nullif(F.col("__l"), F.lit("")), F.concat(F.lit("rps"), F.format_string("%s", F.col("offered_rps")), F.lit("-n"), F.col("workers")))
    return out.withColumn("label", label).drop("__o", "__l")


def router_points(reports: DataFrame, prefix: str) -> DataFrame:
    """SRC-13: router comparison reports ``<prefix>-<rps>.json`` (columns
    ``file_name``, ``doc``): offered and achieved rate, latencies, and whether
    nothing failed or was dropped; other files and torn documents are skipped."""
    name = F.col("file_name")
    d = reports.filter(name.startswith(prefix + "-") & name.endswith(".json"))
    d = d.select(F.from_json("doc", T.StructType([T.StructField(n, T.StringType()) for n, _ in REPORT_FIELDS])).alias("r")).filter(F.col("r.rps").isNotNull())
    v = {n: F.col(f"r.{n}").cast(typ) for n, typ in REPORT_FIELDS}
    seconds = F.when(F.coalesce(v["duration_s"], F.lit(0.0)) == 0, F.lit(1.0)).otherwise(v["duration_s"])
    return d.select(
        v["rps"].alias("offered"), (v["succeeded"] / seconds).alias("achieved"), v["p50_ms"].alias("p50"), v["p99_ms"].alias("p99"),
        v["failed"].alias("errors"), v["dropped"].alias("dropped"), ((v["failed"] == 0) & (v["dropped"] == 0)).alias("clean"),
    )


HEARTBEAT_SCHEMA = T.StructType([
    T.StructField("worker_id", T.StringType()), T.StructField("addr", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("market", T.StringType()), T.StructField("requests_served", T.LongType()), T.StructField("last_seen", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: worker heartbeat documents; torn documents skipped; unknown
    fields kept as a string map."""
    return heartbeat_docs(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))


def heartbeat_docs(raw: DataFrame) -> DataFrame:
    """Heartbeats from documents (column ``doc``)."""
    parsed = raw.select(F.from_json("doc", HEARTBEAT_SCHEMA, {"mode": "PERMISSIVE"}).alias("h"),
                        F.from_json("doc", T.MapType(T.StringType(), T.StringType())).alias("all"))
    known = [f.name for f in HEARTBEAT_SCHEMA.fields if f.name != "_corrupt_record"]
    ok = parsed.filter(F.col("h").isNotNull() & F.col("h._corrupt_record").isNull() & F.col("h.worker_id").isNotNull())
    return ok.select(*[F.col(f"h.{n}").alias(n) for n in known],
                     F.map_filter("all", lambda k, v: ~k.isin(known)).alias("extra"))


def metric_samples(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """SRC-15: Prometheus exposition text -> ``(worker_id, value)`` summed
    per worker for one counter family."""
    return exposition_lines(spark.read.text(path), metric)


def exposition_lines(lines: DataFrame, metric: str) -> DataFrame:
    """Per-worker sums of one counter family from exposition lines (``value``)."""
    d = lines.filter(F.col("value").startswith(metric + "{"))
    labels = F.regexp_extract("value", r"\{([^}]*)\}", 1)
    lab_map = F.str_to_map(F.regexp_replace(labels, '"', ""), F.lit(","), F.lit("="))
    val = F.regexp_extract("value", r"\}\s+([0-9.eE+-]+)", 1).cast("double")
    w = d.select(F.element_at(lab_map, "worker_id").alias("worker_id"), val.alias("v")).filter(F.col("worker_id").isNotNull() & (F.col("worker_id") != ""))
    return w.groupBy("worker_id").agg(F.sum(F.floor("v")).cast("long").alias("value"))


def token_shards(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: ``.bin`` token files by size only (content not read); a size
    that is not a whole number of uint16 tokens is flagged."""
    d = spark.read.format("binaryFile").load(path).select("path", "length")
    return d.withColumn("tokens", (F.col("length") / 2).cast("long")).withColumn("whole", F.col("length") % 2 == 0)


def checkpoint_objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: checkpoint listing from the store without reading content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def discover_runs(status: DataFrame, listing: DataFrame, now: float, heartbeat_timeout: float) -> DataFrame:
    """SRC-20: runs and logs from status documents, falling back to a file
    listing (liveness from file age) for logs the status does not name;
    status rows win (``left_anti``)."""
    from_status = status.select("run_id", "node", "attempt", F.lit("status").alias("source"), F.col("alive"))
    lst = listing.select(
        "run_id", "node", "attempt", F.lit("listing").alias("source"),
        ((F.lit(now) - F.col("modified").cast("double")) <= heartbeat_timeout).alias("alive"),
    )
    extra = lst.join(from_status.select("run_id", "node", "attempt"), on=["run_id", "node", "attempt"], how="left_anti")
    return from_status.unionByName(extra)


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """TK-03: the last ``n`` lines of each log file.  The last ``n`` of each
    input partition's share come first (a window per file and partition), so
    the second window sees at most ``n`` lines per file and partition however
    long a file is."""
    from pyspark.sql import Window

    by = [F.desc("block_start"), F.desc("seq")]
    d = lines.withColumn("__p", F.spark_partition_id())
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("file_path", "__p").orderBy(*by))).filter(F.col("__r") <= n)
    return d.withColumn("__r", F.row_number().over(Window.partitionBy("file_path").orderBy(*by))).filter(F.col("__r") <= n).drop("__r", "__p")
