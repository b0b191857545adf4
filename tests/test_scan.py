"""The bucketed scans and the exact order statistics against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skiff.functions.percentile import kth_values, lower_median, nearest_rank, rounded_index, upper_median
from skiff.operators.scan import islands, scan, spans


def _rows(n=600, keys=3, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # one hot key holds most rows
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}"
        out.append((k, i, float(rnd.randrange(0, 5000)), rnd.randrange(0, 4), rnd.choice([None, 1.0, 2.0])))
    return out


def test_scan_matches_sequential(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, id long, t double, v int, x double")
    out = scan(df, ["k"], "t", ["id"], width=250.0, sums={"s": "v"}, maxes={"mx": "v"}, mins={"mn": "v"},
               lasts={"lx": "x"}, prevs={"pv": F.col("v")}, nexts={"nv": F.col("v")})
    got = {r["id"]: r for r in out.collect()}
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    for k, rs in by_key.items():
        s, mx, mn, lx = 0, None, None, None
        for i, r in enumerate(rs):
            s += r[3]
            mx = r[3] if mx is None else max(mx, r[3])
            mn = r[3] if mn is None else min(mn, r[3])
            lx = r[4] if r[4] is not None else lx
            g = got[r[1]]
            assert g["s"] == s and g["mx"] == mx and g["mn"] == mn and g["lx"] == lx
            assert g["pv"] == (rs[i - 1][3] if i > 0 else None)
            assert g["nv"] == (rs[i + 1][3] if i + 1 < len(rs) else None)


def test_islands_and_spans(spark):
    data = [("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 3.0, "y"), ("a", 9000.0, "y"), ("a", 9001.0, "x"), ("b", 5.0, "z")]
    df = spark.createDataFrame(data, "k string, t double, v string")
    isl = {(r.k, r.t): r.island for r in islands(df, ["k"], "t", ["v"], width=100.0).collect()}
    assert [isl[("a", t)] for t in (1.0, 2.0, 3.0, 9000.0, 9001.0)] == [1, 1, 2, 2, 3]
    sp = sorted((r.k, r.start, r.end, r.v) for r in spans(df, ["k"], "t", ["v"], as_of=10000.0, width=100.0).collect())
    assert sp == [("a", 1.0, 3.0, "x"), ("a", 3.0, 9001.0, "y"), ("a", 9001.0, 10000.0, "x"), ("b", 5.0, 10000.0, "z")]


@pytest.mark.parametrize("p", [50, 90, 95, 99])
def test_nearest_rank_and_rounded_index(spark, p):
    rnd = random.Random(p)
    rows = [(g, rnd.choice([rnd.uniform(-50, 50), float(rnd.randrange(10))])) for g in range(6) for _ in range(rnd.randrange(1, 80))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in kth_values(df, ["g"], "v", {"nr": nearest_rank(p), "ri": rounded_index(p),
                                                      "lo": lower_median(), "hi": upper_median()}).collect()}
    for g in range(6):
        vals = sorted(v for gg, v in rows if gg == g)
        n = len(vals)
        idx = max(0, min(n - 1, math.ceil(p / 100 * n) - 1))
        assert got[g].nr == vals[idx]
        assert got[g].ri == vals[min(int(round(p / 100 * (n - 1))), n - 1)]
        assert got[g].lo == vals[(n - 1) // 2] and got[g].hi == vals[n // 2]
