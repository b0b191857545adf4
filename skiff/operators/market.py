"""Capacity-market analysis (placement scores, prices, probes).

Input record families (one DataFrame each, see ``skiff.sources.spot``):
``sps(tick_id, t, region, az_id, instance_type, capacity, single_az, scope, score)``,
``probe``, ``price``, ``interruption``, ``az_map``, ``sps_gap``, ``tick``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.functions.percentile import median
from skiff.operators.scan import flag_runs, scan

POOL = ["region", "az_id", "instance_type"]

# Strategy order used by the verdict (fixed values chosen here): each widens
# what may change.  ``basket`` is the all-types request, a sanity row.
SCENARIOS = [
    (1, "never_switch"),
    (2, "switch_gpu"),
    (3, "switch_az"),
    (4, "switch_both"),
    (5, "switch_region"),
    (6, "basket"),
]


# ----------------------------------------------------------- filters/proj --

def sps_rows(sps: DataFrame, capacity: int, single_az: bool | None = None, scope: str | None = "region") -> DataFrame:
    """FLT-01/02: scored rows of one capacity / AZ mode / scope.  A missing
    scope means ``region``; the truncated leaderboard never enters rates."""
    rows = sps.filter((F.col("capacity") == capacity) & F.col("score").isNotNull())
    if scope is not None:
        rows = rows.filter(F.coalesce(F.col("scope"), F.lit("region")) == scope)
    if single_az is not None:
        rows = rows.filter(F.coalesce(F.col("single_az"), F.lit(False)) == F.lit(single_az))
    return rows


def record_config(scope: Column | None = None) -> Column:
    """PRJ-12: configuration identity (region only for region scope)."""
    sc = F.coalesce(F.col("scope"), F.lit("region")) if scope is None else scope
    return F.struct(
        sc.alias("scope"),
        F.coalesce(F.col("instance_type"), F.lit("")).alias("instance_type"),
        F.col("capacity").alias("capacity"),
        F.coalesce(F.col("single_az"), F.lit(True)).alias("single_az"),
        F.when(sc == "region", F.coalesce(F.col("region"), F.lit(""))).otherwise(F.lit("*")).alias("region"),
    )


def utc_hour(t: str = "t") -> Column:
    """PRJ-10: UTC hour of an epoch-seconds column."""
    return F.hour(F.timestamp_seconds(F.col(t)))


def utc_weekday(t: str = "t") -> Column:
    """PRJ-10: UTC weekday abbreviation (Mon..Sun)."""
    return F.date_format(F.timestamp_seconds(F.col(t)), "E")


# ------------------------------------------------------------- aggregates --

def per_tick_best(rows: DataFrame, predicate: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """AG-01: best acceptable score per tick (a tick counts once)."""
    if predicate is not None:
        rows = rows.filter(predicate)
    return rows.groupBy(*(by or []), "tick_id").agg(F.max(F.col("score").cast("double")).alias("best"))


def odds(best: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """AG-02: share of ticks >= threshold, mean and max best."""
    return best.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.avg((F.col("best") >= threshold).cast("double")).alias("p_good"),
        F.avg("best").alias("mean_best"),
        F.max("best").alias("max_best"),
    )


def home_az(sps: DataFrame, home_region: str, home_type: str, capacity: int) -> DataFrame:
    """AG-03: the pinned AZ: highest mean score, ties to the greater id.
    One row (``az_id``), or none."""
    rows = sps_rows(sps, capacity, single_az=True).filter(
        (F.col("region") == home_region) & (F.col("instance_type") == home_type)
    )
    by_az = rows.groupBy(F.coalesce(F.col("az_id"), F.lit("")).alias("az_id")).agg(F.avg("score").alias("mean"))
    return by_az.agg(F.max_by("az_id", F.struct("mean", "az_id")).alias("az_id"))


def scenarios(
    sps: DataFrame,
    threshold: float,
    home_region: str,
    home_type: str,
    capacities: tuple[int, ...] = (8,),
    az: str | None = None,
) -> DataFrame:
    """AG-04: the six strategies in one scan; an empty scenario stays as a
    row with ``ticks = 0`` and null rates.  Rows per capacity in ``capacities``."""
    spark = sps.sparkSession
    rows = sps.filter(F.col("capacity").isin(list(capacities)))
    rows = rows.filter(F.col("score").isNotNull() & (F.coalesce(F.col("scope"), F.lit("region")) == "region"))
    rows = rows.filter(F.coalesce(F.col("single_az"), F.lit(False)))
    home = F.col("region") == home_region
    same_type = F.col("instance_type") == home_type
    not_any = F.col("instance_type") != "any"
    # the pinned AZ per capacity: scalar subqueries keep this a single plan
    az_of = {}
    for cap in capacities:
        az_of[cap] = F.lit(az) if az else home_az(sps, home_region, home_type, cap).scalar()
    same_az = None
    for cap in capacities:
        c = (F.col("capacity") == cap) & (F.col("az_id") == az_of[cap])
        same_az = c if same_az is None else (same_az | c)
    conds = {
        1: home & same_az & same_type,
        2: home & same_az & not_any,
        3: home & same_type,
        4: home & not_any,
        5: not_any,
        6: home & (F.col("instance_type") == "any"),
    }
    tagged = rows.select(
        "capacity",
        "tick_id",
        "score",
        F.explode(F.array(*[F.when(c, F.lit(o)) for o, c in conds.items()])).alias("ordinal"),
    ).filter(F.col("ordinal").isNotNull())
    best = per_tick_best(tagged, by=["capacity", "ordinal"])
    stats = odds(best, threshold, by=["capacity", "ordinal"])
    # literal domain: 6 scenarios x len(capacities) rows, safe to broadcast
    domain = spark.createDataFrame(
        [(c, o, n) for c in capacities for o, n in SCENARIOS], "capacity int, ordinal int, scenario string"
    )
    out = F.broadcast(domain).join(stats, on=["capacity", "ordinal"], how="left")
    return out.select(
        "capacity",
        "ordinal",
        "scenario",
        F.coalesce(F.col("ticks"), F.lit(0)).alias("ticks"),
        "p_good",
        "mean_best",
        "max_best",
    )


def hourly_odds(sps: DataFrame, threshold: float, home_region: str, home_type: str, capacity: int, weekday: bool = False) -> DataFrame:
    """AG-05 (by UTC hour) / AG-06 (by weekday and hour) for the home pool."""
    rows = sps_rows(sps, capacity, single_az=True).filter(
        (F.col("region") == home_region) & (F.col("instance_type") == home_type)
    )
    keys = ["hour"]
    rows = rows.withColumn("hour", utc_hour())
    if weekday:
        rows = rows.withColumn("weekday", utc_weekday())
        keys = ["weekday", "hour"]
    return odds(per_tick_best(rows, by=keys), threshold, by=keys)


def heatmap(rows: DataFrame, row_key: str) -> DataFrame:
    """AG-07: mean score per (row_key, UTC hour), hours as 24 columns."""
    hours = list(range(24))
    return (
        rows.withColumn("hour", utc_hour())
        .groupBy(F.coalesce(F.col(row_key).cast("string"), F.lit("")).alias(row_key))
        .pivot("hour", hours)
        .agg(F.avg(F.col("score").cast("double")))
        .select(row_key, *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])
    )


def longest_good_run(rows: DataFrame, keys: list[str], threshold: float, width: float = 86400.0) -> DataFrame:
    """WN-09: longest unbroken run of samples >= threshold per key, in
    seconds and samples.  One sample is 0 s; ties take the later run."""
    flagged = rows.withColumn("__good", F.col("score") >= threshold)
    isl = flag_runs(flagged, keys, "t", "__good", width=width, out="__run")
    runs = (
        isl.filter("__good")
        .groupBy(*keys, "__run")
        .agg((F.max("t") - F.min("t")).alias("secs"), F.min("t").alias("start"), F.count(F.lit(1)).alias("n"))
    )
    return runs.groupBy(*keys).agg(
        F.max("secs").alias("longest_good_s"),
        F.max_by("n", F.struct("secs", "start")).alias("longest_good_samples"),
    )


def availability(
    sps: DataFrame, capacity: int, threshold: float, region: str | None = None, single_az: bool = True
) -> DataFrame:
    """AG-08: absolute availability per pool (best, mean, good samples,
    samples, longest good stretch)."""
    rows = sps_rows(sps, capacity, single_az=single_az)
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    rows = rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in POOL], "t", F.col("score").cast("double").alias("score")
    )
    agg = rows.groupBy(*POOL).agg(
        F.max("score").alias("best"),
        F.avg("score").alias("mean"),
        F.sum((F.col("score") >= threshold).cast("long")).alias("good_samples"),
        F.count(F.lit(1)).alias("samples"),
    )
    runs = longest_good_run(rows, POOL, threshold)
    return agg.join(runs, on=POOL, how="left").select(
        *POOL,
        "best",
        "mean",
        "good_samples",
        "samples",
        F.coalesce(F.col("longest_good_s"), F.lit(0.0)).alias("longest_good_s"),
        F.coalesce(F.col("longest_good_samples"), F.lit(0)).cast("long").alias("longest_good_samples"),
    )


def availability_order(df: DataFrame) -> DataFrame:
    """TK-02: ``(-best, -mean, region, az)``, extended to a total order."""
    return df.orderBy(F.desc("best"), F.desc("mean"), "region", "az_id", "instance_type")


def headline(sps: DataFrame, threshold: float, home_region: str) -> DataFrame:
    """AG-09: one row — at capacity 8, home and world; capacity 1 at home."""
    views = [("home8", 8, home_region), ("world8", 8, None), ("home1", 1, home_region)]
    parts = None
    for name, cap, reg in views:
        a = availability(sps, cap, threshold, region=reg).withColumn("view", F.lit(name))
        parts = a if parts is None else parts.unionByName(a)

    def _v(name, expr):
        return F.when(F.col("view") == name, expr)

    return parts.agg(
        F.max(_v("home8", F.col("best"))).alias("home_best"),
        F.coalesce(F.sum(_v("home8", (F.col("good_samples") > 0).cast("long"))), F.lit(0)).alias("home_good_pools"),
        F.coalesce(F.max(_v("home8", F.col("longest_good_s"))), F.lit(0.0)).alias("home_longest_good_s"),
        F.max(_v("world8", F.col("best"))).alias("world_best"),
        F.coalesce(F.sum(_v("world8", (F.col("good_samples") > 0).cast("long"))), F.lit(0)).alias("world_good_pools"),
        F.max(_v("home1", F.col("best"))).alias("home_cap1_best"),
        F.count(_v("home8", F.lit(1))).alias("pools"),
        F.lit(float(threshold)).alias("threshold"),
    )


def rank_pools(sps: DataFrame, capacity: int, threshold: float, top: int = 15) -> DataFrame:
    """AG-10 + TK-01: pools by sustained mean score, top ``top``."""
    rows = sps_rows(sps, capacity, single_az=True).filter(F.col("instance_type") != "any")
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in POOL], F.col("score").cast("double").alias("score"))
    agg = rows.groupBy(*POOL).agg(
        F.avg("score").alias("mean"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("p_good"),
        F.count(F.lit(1)).alias("samples"),
    )
    return agg.orderBy(F.desc("mean"), F.desc("p_good"), "region", "az_id", "instance_type").limit(top)


def az_names(az_map: DataFrame) -> DataFrame:
    """JN-06: AZ id -> AZ name, newest mapping per id."""
    return az_map.filter(F.col("az_id").isNotNull() & (F.col("az_id") != "")).groupBy("az_id").agg(
        F.max_by("az", F.struct("t", "az")).alias("az_name")
    )


def near_max(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    window_s: float,
    id_column: str,
    value: str,
    left_t: str = "t",
    right_t: str = "t",
    fine: int = 64,
) -> DataFrame:
    """Tolerance look-up: per left row (``id_column``) the greatest ``value`` among the
    right rows of equal ``keys`` with ``|t_l - t_r| <= window_s``; left rows
    without any are left out.

    Time is cut into blocks of ``window_s``.  The window of a left row at ``t`` is
    the end of the block before its own from ``t - window_s`` on, its own block and
    the beginning of the next up to ``t + window_s``: one suffix maximum and two
    prefix maxima of blocks.  A left row therefore becomes three marks among the
    right rows, and two scans inside (keys, block) give them their maxima; no pair
    of a left and a right row is formed.  The scans bucket a block once more, in
    ``fine`` parts, so a dense block isn't one task."""
    w = float(window_s)
    block = F.floor(F.col(left_t) / w).cast("long")
    value_type = right.schema[value].dataType

    def marks(at, own, order: int) -> DataFrame:
        return left.select(*keys, F.col(id_column).alias("__id"), own.cast("long").alias("__blk"), at.cast("double").alias("__t"), F.lit(order).alias("__o"), F.lit(None).cast(value_type).alias("__v"))

    rows = right.select(*keys, F.lit(None).cast(left.schema[id_column].dataType).alias("__id"), F.floor(F.col(right_t) / w).cast("long").alias("__blk"), F.col(right_t).cast("double").alias("__t"), F.lit(0).alias("__o"), F.col(value).alias("__v"))
    t = F.col(left_t)
    # at equal times rows come first: the window is closed at both ends
    ahead = rows.unionByName(marks((block + 1) * w, block, 1)).unionByName(marks(t + w, block + 1, 1))
    behind = rows.withColumn("__t", -F.col("__t")).unionByName(marks(w - t, block - 1, 1))
    found = None
    for side in (ahead, behind):
        s = scan(side, [*keys, "__blk"], "__t", ["__o"], width=w / fine, maxes={"__m": "__v"})
        s = s.filter("__o = 1 AND __m IS NOT NULL").select(F.col("__id").alias(id_column), F.col("__m").alias(value))
        found = s if found is None else found.unionByName(s)
    return found.groupBy(id_column).agg(F.max(value).alias(value))


def calibration(sps: DataFrame, probes: DataFrame, az_map: DataFrame, window_s: float = 900.0) -> DataFrame:
    """JN-05: score seen around each probe, at region level (capacity 1,
    multi-AZ) and at AZ level (capacity 1, single AZ, same AZ name).
    Unscored probes stay with null scores."""
    scored = sps_rows(sps, 1, single_az=False).select(
        F.col("region").alias("s_region"), F.col("instance_type").alias("s_type"), F.col("t").alias("s_t"), "score"
    )
    az_scored = (
        sps_rows(sps, 1, single_az=True)
        .join(az_names(az_map), on="az_id", how="left")
        .select(
            F.col("region").alias("s_region"),
            F.col("instance_type").alias("s_type"),
            F.col("t").alias("s_t"),
            F.coalesce(F.col("az_name"), F.lit("")).alias("s_az"),
            "score",
        )
    )
    p = probes.select(
        "event_id", "ts", "t", "region", "az", "instance_type", "capacity_available", "error_code",
        F.col("region").alias("s_region"), F.col("instance_type").alias("s_type"),
        F.coalesce(F.col("az"), F.lit("?")).alias("s_az"),
    )
    region_score = near_max(p, scored, ["s_region", "s_type"], window_s, "event_id", "score", "t", "s_t").withColumnRenamed("score", "region_score")
    az_score = near_max(p, az_scored, ["s_region", "s_type", "s_az"], window_s, "event_id", "score", "t", "s_t").withColumnRenamed("score", "az_score")
    return (
        p.join(region_score, on="event_id", how="left")
        .join(az_score, on="event_id", how="left")
        .select(
            "event_id", "ts", "region", F.coalesce(F.col("az"), F.lit("")).alias("az"), "instance_type",
            F.coalesce(F.col("capacity_available"), F.lit(False)).alias("capacity_available"),
            F.coalesce(F.col("error_code"), F.lit("")).alias("error_code"),
            "region_score", "az_score",
        )
    )


def success_by_band(cal: DataFrame) -> DataFrame:
    """AG-15: probe success by region-score band, with a no-score band."""
    band = F.when(F.col("region_score").isNull(), F.lit("no score")).otherwise(
        F.concat(F.lit("score "), F.col("region_score").cast("int").cast("string"))
    )
    return cal.groupBy(band.alias("band")).agg(
        F.sum(F.col("capacity_available").cast("long")).alias("succeeded"),
        F.count(F.lit(1)).alias("probes"),
    )


def price_summary(prices: DataFrame, top: int = 12) -> DataFrame:
    """AG-11 + TK-01: exact median, min, max, count per pool; cheapest ``top``."""
    keys = ["region", "az", "instance_type"]
    p = prices.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keys], F.col("price_usd").cast("double").alias("price_usd"))
    stats = p.groupBy(*keys).agg(
        F.min("price_usd").alias("min_usd"), F.max("price_usd").alias("max_usd"), F.count(F.lit(1)).alias("samples")
    )
    med = median(p, keys, "price_usd", out="median_usd", levels=2).drop("n")
    return (
        stats.join(med, on=keys, how="inner")
        .select(*keys, "median_usd", "min_usd", "max_usd", "samples")
        .orderBy("median_usd", *keys)
        .limit(top)
    )


def interruption_summary(rows: DataFrame) -> DataFrame:
    """AG-12: newest interruption row per (region, type); ties on time go
    to the greater record id."""
    cols = [c for c in rows.columns if c not in ("region", "instance_type")]
    newest = rows.groupBy("region", "instance_type").agg(
        F.max_by(F.struct(*cols), F.struct("t", "record_id")).alias("r")
    )
    return newest.select("region", "instance_type", "r.*").orderBy("region", "instance_type")


def leaderboard(sps: DataFrame, capacity: int, top: int = 10) -> DataFrame:
    """AG-13: the worldwide top-10 view, from the truncated scope only."""
    rows = sps_rows(sps, capacity, single_az=True, scope="global_top10")
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in POOL], F.col("score").cast("double").alias("score"))
    agg = rows.groupBy(*POOL).agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("samples"))
    return agg.orderBy(F.desc("best"), F.desc("samples"), "region", "az_id", "instance_type").limit(top)


def coverage(records: DataFrame) -> DataFrame:
    """AG-14: one row from the union of ``tick``, ``sps_gap`` and ``sps``
    records (columns absent from a type are null)."""
    typ = F.col("type")
    is_tick, is_gap, is_sps = typ == "tick", typ == "sps_gap", typ == "sps"
    capped = is_gap & F.coalesce(F.col("config_capped"), F.lit(False))
    asked = F.coalesce(F.sum(F.when(is_tick, F.coalesce(F.col("sps_requests"), F.lit(0)))), F.lit(0)).cast("long")
    n_gaps = F.count(F.when(is_gap, F.lit(1)))
    return records.agg(
        F.count(F.when(is_tick, F.lit(1))).alias("ticks"),
        asked.alias("requested"),
        n_gaps.alias("gaps"),
        F.count(F.when(is_gap & F.coalesce(F.col("throttled"), F.lit(False)), F.lit(1))).alias("throttled"),
        F.count(F.when(capped, F.lit(1))).alias("config_capped"),
        F.count_distinct(F.when(is_sps, record_config())).alias("configs_ok"),
        F.count_distinct(F.when(capped, record_config())).alias("configs_refused"),
        F.coalesce(F.max(F.when(is_tick, F.col("config_budget"))), F.lit(0)).alias("config_budget"),
        F.when(asked > 0, n_gaps / asked).alias("gap_pct"),
        F.coalesce((F.max(F.when(is_tick, F.col("t"))) - F.min(F.when(is_tick, F.col("t")))) / 3600.0, F.lit(0.0)).alias("span_hours"),
    )


def verdict(sps: DataFrame, threshold: float, home_region: str, home_type: str) -> DataFrame:
    """AG-16: first strategy (in order) good in >= 80 % of ticks, else
    >= 50 %, else none; at capacity 8, or capacity 1 when 8 has no data.
    Adds the best UTC hour (lowest on ties) against the hourly average."""
    sc = scenarios(sps, threshold, home_region, home_type, capacities=(8, 1))
    named = sc.filter(F.col("ordinal") <= 5)
    cap8 = named.filter(F.col("capacity") == 8).agg(F.sum("ticks")).scalar()
    chosen = named.filter(F.col("capacity") == F.when(cap8 > 0, F.lit(8)).otherwise(F.lit(1)))
    pg = F.coalesce(F.col("p_good"), F.lit(0.0))
    v = chosen.agg(
        F.first("capacity").alias("capacity"),
        F.min_by("scenario", F.when(pg >= 0.8, F.col("ordinal"))).alias("good"),
        F.min_by("scenario", F.when(pg >= 0.5, F.col("ordinal"))).alias("marginal"),
        F.max(pg).alias("best_case_p"),
    )
    hours = hourly_odds(sps, threshold, home_region, home_type, 8)
    hp = F.coalesce(F.col("p_good"), F.lit(0.0))
    h = hours.agg(
        F.min_by("hour", F.struct((-hp).alias("neg_p"), F.col("hour"))).alias("best_hour"),
        F.max(hp).alias("best_hour_p"),
        F.avg(hp).alias("avg_hour_p"),
    )
    has = F.col("best_hour_p") > 0
    best_hour = h.select(F.when(has, F.col("best_hour"))).scalar()
    best_hour_p = h.select(F.when(has, F.col("best_hour_p"))).scalar()
    avg_hour_p = h.select(F.when(has, F.col("avg_hour_p"))).scalar()
    return v.select(
        "capacity",
        F.coalesce(F.col("good"), F.col("marginal")).alias("winner"),
        F.when(F.col("good").isNotNull(), F.lit("good"))
        .when(F.col("marginal").isNotNull(), F.lit("marginal"))
        .otherwise(F.lit("never"))
        .alias("level"),
        "best_case_p",
        best_hour.alias("best_hour"),
        best_hour_p.alias("best_hour_p"),
        avg_hour_p.alias("avg_hour_p"),
    )


def record_envelope(df: DataFrame, kind: str, tick_id: Column, t: Column) -> DataFrame:
    """PRJ-01: the common record envelope: type, tick id, ISO-8601 UTC time
    and epoch seconds to 3 decimals."""
    return df.select(
        F.lit(kind).alias("type"), tick_id.alias("tick_id"),
        F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.round(t, 3).alias("t"), *df.columns,
    )


def top_hours(hours: DataFrame, k: int = 6, weekday: bool = False) -> DataFrame:
    """TK-01: the best hours (or weekday-hours) by odds, total tie order."""
    keys = ["weekday", "hour"] if weekday else ["hour"]
    return hours.orderBy(F.desc_nulls_last("p_good"), F.desc("ticks"), *keys).limit(k)
