"""Writers (SNK-01 … SNK-11).

All writes are partitioned file outputs committed by Spark's output
committer; "publish last" semantics (a manifest written after its data)
make the manifest the visibility point for readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.functions.numeric import round_half_up

# The run series' 19 columns, in the exporter's order (fixed values).
TS_COLUMNS = [
    "time", "durable_step", "current_step", "furthest_step", "steps_at_risk", "train_loss", "tokens_b",
    "nodes_training", "nodes_lost", "replacements", "below_full_world", "degraded_band", "goodput",
    "ms_per_step", "ms_per_step_typical", "whole_group_restarts", "usd", "usd_per_1k", "supervisor_up",
]


def run_series_table(step_rows: DataFrame, boot_rows: DataFrame, live_rows: DataFrame | None = None) -> DataFrame:
    """SNK-01 + SET-01: boot rows, step rows and a trailing live row under
    one schema (missing columns null), ordered columns."""
    u = boot_rows.unionByName(step_rows, allowMissingColumns=True)
    if live_rows is not None:
        u = u.unionByName(live_rows, allowMissingColumns=True)
    missing = {c: F.lit(None) for c in TS_COLUMNS if c not in u.columns}
    return u.withColumns(missing).select("run_id", *TS_COLUMNS)


def write_run_series(series: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-01: one folder per run; ranges of (run, time) go to several tasks, so
    a long run is several part files, each sorted and in order of time."""
    (series.repartitionByRange("run_id", "time").sortWithinPartitions("run_id", "time")
     .write.mode("overwrite").partitionBy("run_id").format(fmt).option("header", "true").save(path))


def append_shards(records: DataFrame, root: str) -> None:
    """SNK-02: append-only spot shards partitioned by UTC date; never a
    read-modify-write."""
    (records.withColumn("date", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"))
     .write.mode("append").partitionBy("date").json(root))


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-04: idempotent overwrite of exactly the ``(run_id, step)``
    partitions present in ``df`` (dynamic partition overwrite)."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        step = F.lpad(F.col("step").cast("string"), 12, "0") if "step" in keys else None
        out = df.withColumn("step_key", step) if step is not None else df
        parts = ["step_key" if k == "step" else k for k in keys]
        out.write.mode("overwrite").partitionBy(*parts).json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def profile_documents(runs: DataFrame, segments: DataFrame, events: DataFrame, samples: DataFrame,
                      vals: DataFrame, instances: DataFrame) -> DataFrame:
    """SNK-05: one profile document per run: child tables collected as
    arrays sorted by time (groups bounded by one run's profile)."""
    def nest(df: DataFrame, name: str, order: str, cols: list[str]) -> DataFrame:
        return df.groupBy("run_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in cols]))),
                        lambda x: x.dropFields("__o")).alias(name))

    doc = runs
    doc = doc.join(nest(segments, "segments", "start", ["phase", "seconds"]), "run_id", "left")
    doc = doc.join(nest(events, "events", "t_wall", ["event", "t_wall", "t_rel"]), "run_id", "left")
    doc = doc.join(nest(samples, "loss_samples", "t_rel", ["step", "loss", "ms_per_step", "tok_s", "t_rel", "world_size"]), "run_id", "left")
    doc = doc.join(nest(vals, "val_samples", "step", ["step", "loss", "t_rel"]), "run_id", "left")
    doc = doc.join(nest(instances, "instances", "started_at", ["instance_id", "hourly_usd", "started_at", "stopped_at"]), "run_id", "left")
    return doc.withColumn("schema_version", F.lit(1)).select("run_id", F.to_json(F.struct(*[c for c in doc.columns] + ["schema_version"])).alias("json"))


def annotations(regions: DataFrame, title: str, text: Column, tag: str) -> DataFrame:
    """SNK-06: interval annotations (epoch ms) with title, text and tags."""
    return regions.select("run_id", "time", "timeEnd", F.lit(title).alias("title"), text.alias("text"),
                          F.array(F.lit(tag)).alias("tags"))


def run_index(run_ids: DataFrame) -> DataFrame:
    """SNK-07: distinct runs, newest first by the epoch suffix of the id."""
    suffix = F.regexp_extract("run_id", r"-([0-9]+)$", 1)
    return run_ids.select("run_id").distinct().withColumn("__s", F.nullif(suffix, F.lit("")).cast("long")).orderBy(
        F.desc_nulls_last("__s"), F.desc("run_id")).drop("__s")


def panel_slice(series: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SNK-08: time plus chosen columns renamed; rows with no value in any
    chosen column dropped."""
    out = series.select("run_id", "time", *[F.col(src).alias(dst) for src, dst in columns.items()])
    return out.na.drop(how="all", subset=list(columns.values()))


def event_listing(events: DataFrame) -> DataFrame:
    """SNK-10: ordered event listing with time relative to the run's first
    event and a one-line description."""
    t0 = events.groupBy("run_id").agg(F.min("ts").alias("__t0"))
    e = events.join(t0, "run_id")
    line = F.concat_ws(" ", F.format_string("+%.1fs", F.col("ts") - F.col("__t0")),
                       F.concat(F.lit("node"), F.col("node").cast("string")), F.col("state"), F.coalesce(F.col("cause"), F.lit("")))
    return e.select("run_id", "ts", (F.col("ts") - F.col("__t0")).alias("t_rel"), line.alias("line")).orderBy("run_id", "ts")


def run_fact_rows(facts: DataFrame, launch: Column, end: Column) -> DataFrame:
    """SNK-11: run facts as two rows per run (at start and at end)."""
    return facts.select("*", F.explode(F.array(launch, end)).alias("__t")).withColumn(
        "time", F.floor(F.col("__t") * 1000).cast("long")).drop("__t")


def report_table(df: DataFrame, path: str, digits: int = 4) -> None:
    """SNK-09: a report table as one CSV file (bounded rows), doubles
    rounded as the report prints them."""
    cols = [round_half_up(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
