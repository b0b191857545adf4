"""Serving analysis on the reference's saturation curve and load fixtures."""

from pyspark.sql import functions as F

from skiff.operators import serving as S


def _points(spark, rows, workers=1):
    data = [(f"p{i}", float(rps), workers, 100, 100, 0, 0, 0.0, float(p50), float(p99), 1000.0)
            for i, (rps, p50, p99) in enumerate(rows)]
    return spark.createDataFrame(
        data, "label string, offered_rps double, workers int, requests long, succeeded long, failed long, dropped long, "
              "error_rate double, p50_ms double, p99_ms double, tokens_per_second double")


def test_saturation_knee(spark):
    pts = _points(spark, [(1, 100, 120), (2, 102, 140), (4, 110, 190), (8, 130, 280), (16, 260, 900), (32, 800, 4000)])
    sat = {r.offered_rps: r for r in S.saturation(pts).collect()}
    assert sat[1.0].l0_ms == 100.0 and sat[1.0].slo_ms == 300.0
    knees = [r for r in sat.values() if r.is_knee]
    assert [k.offered_rps for k in knees] == [8.0]
    assert not knees[0].knee_beyond_sweep
    assert [sat[r].within_slo for r in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)] == [True, True, True, True, False, False]


def test_knee_leading_run_only(spark):
    # a lucky high-rate point above a breakdown never becomes the knee
    pts = _points(spark, [(1, 100, 120), (2, 100, 900), (4, 100, 150)])
    knees = [r.offered_rps for r in S.saturation(pts).collect() if r.is_knee]
    assert knees == [1.0]


def test_outcomes_and_attempts(spark):
    df = spark.createDataFrame([(200, False), (429, False), (503, False), (200, True), (None, False)], "status int, rerouted boolean")
    got = [(r.o, r.a) for r in df.select(S.outcome().alias("o"), S.attempt_result().alias("a")).collect()]
    assert got == [("ok", "ok"), ("ok", "client_error"), ("failed", "server_error"), ("rerouted", "ok"), ("failed", "error")]


def test_histogram_quantile_interpolates(spark):
    req = spark.createDataFrame([("t", float(ms), False) for ms in [40, 60, 70, 80, 90, 120, 200, 300, 400, 2000]],
                                "test_id string, latency_ms double, failed boolean")
    h = S.latency_histogram(req)
    cum = {r.le: r.cum_count for r in h.collect()}
    assert cum[0.05] == 1 and cum[0.1] == 5 and cum[0.25] == 7 and cum[0.5] == 9 and cum[float("inf")] == 10
    q = S.histogram_quantile(h, 0.5).collect()[0].q
    # rank 5 falls at the top of the (0.05, 0.1] bucket
    assert abs(q - 0.1) < 1e-12


def test_counter_rates_reset_and_new_worker(spark):
    rows = [
        ("f", 0.0, "a", True, 0, 10, 100, 1.0, 1), ("f", 10.0, "a", True, 0, 20, 300, 3.0, 1),
        ("f", 20.0, "a", True, 1, 5, 50, 0.5, 1), ("f", 20.0, "b", True, 0, 7, 70, 0.7, 1),
        ("f", 30.0, "b", False, 0, 9, 90, 0.9, 1),
    ]
    s = spark.createDataFrame(rows, "fleet string, ts double, worker_id string, ok boolean, counter_epoch long, "
                                    "requests long, completion_tokens long, generate_seconds double, in_flight int")
    r = {(x.ts, x.worker_id): x for x in S.counter_rates(s).collect()}
    assert r[(0.0, "a")].rps == 0.0
    assert r[(10.0, "a")].rps == 1.0 and r[(10.0, "a")].tok_s == 20.0 and r[(10.0, "a")].util == 0.2
    assert r[(20.0, "a")].rps == 0.0  # reset reads idle
    assert r[(20.0, "b")].rps == 0.0  # new worker
    assert r[(30.0, "b")].rps == 0.0  # failed scrape
