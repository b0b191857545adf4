"""Following logs that are still written: every line once, whatever is cut where and however often the query restarts."""

import io
import os
import random

import pytest

from skiff.sources import tail
from skiff.streaming import live


def _drain(spark, path, root, **options):
    rows = live.log_tail(spark, path, **options).select("file_path", "position", "line")
    writer = rows.writeStream.option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{root}/out").start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def test_an_open_file_is_followed_over_batches_and_a_restart(spark, tmpdir_path):
    logs, pattern = f"{tmpdir_path}/runs/r1/logs", f"{tmpdir_path}/runs/*/logs/*.log"
    os.makedirs(logs)
    with open(f"{logs}/boot-node0.log", "wb") as log, open(f"{logs}/notes.txt", "wb") as other:
        other.write(b"not a log\n")
        log.write("one\ntwo é\r\n\nhalf of ".encode())
        log.flush()
        assert _drain(spark, pattern, tmpdir_path) == 3
        assert _drain(spark, pattern, tmpdir_path) == 0  # nothing new, and the open line stays
        log.write(b"a line\n" + b"".join(b"line %d\n" % i for i in range(500)) + b"open")
        log.flush()
        with open(f"{logs}/boot-node1.log", "wb") as late:
            late.write(b"\xff late\n")
        assert _drain(spark, pattern, tmpdir_path, split_bytes="100") == 502
        log.write(b" end\n")
        log.flush()
        assert _drain(spark, pattern, tmpdir_path) == 1
    with open(f"{logs}/boot-node1.log", "wb") as late:  # replaced by a shorter one
        late.write(b"new\n")
    assert _drain(spark, pattern, tmpdir_path) == 1
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/out").selectExpr("right(file_path, 9)", "position", "line").collect())
    whole = open(f"{logs}/boot-node0.log", "rb").read()
    expected, at = [("node1.log", 0, "� late"), ("node1.log", 0, "new")], 0
    for line in whole.split(b"\n")[:-1]:
        expected.append(("node0.log", at, line.decode().removesuffix("\r")))
        at += len(line) + 1
    assert got == sorted(expected)


def test_a_query_may_begin_at_the_latest_line(spark, tmpdir_path):
    path = f"{tmpdir_path}/a.log"
    with open(path, "wb") as f:
        f.write(b"old\nopen")
    assert _drain(spark, path, tmpdir_path, first="latest") == 0
    with open(path, "ab") as f:
        f.write(b" line\n")
    assert _drain(spark, path, tmpdir_path, first="latest") == 1
    assert [tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/out").select("position", "line").collect()] == [(4, "open line")]
    assert _drain(spark, f"{tmpdir_path}/none/*.log", f"{tmpdir_path}/x") == 0


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_ranges_of_any_size_give_each_line_once(tmpdir_path, split):
    rng = random.Random(split)
    text = b"\n".join(bytes(rng.choice(b"ab\r") for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(120))
    with open(f"{tmpdir_path}/t.log", "wb") as f:
        f.write(text)
    reader = tail.TailReader({"path": f"{tmpdir_path}/t.log", "split_bytes": str(split)})
    end = reader.latestOffset()
    stop = end[f"{tmpdir_path}/t.log"][0]
    assert stop == text.rfind(b"\n") + 1
    for begin in (0, text.find(b"\n", 300) + 1):
        parts = reader.partitions({f"{tmpdir_path}/t.log": [begin, 0.0]}, end)
        got = [(p, line) for part in parts for b in reader.read(part) for p, line in zip(b["position"].to_pylist(), b["line"].to_pylist())]
        expected, at = [], 0
        for line in text[:stop].split(b"\n")[:-1]:
            if at >= begin:
                expected.append((at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        assert got == expected


def test_last_line_break_is_found_across_blocks(monkeypatch):
    monkeypatch.setattr(tail, "_BLOCK", 4)
    assert tail.line_end(io.BytesIO(b"ab\ncdefghijklmnop"), 0, 17) == 3
    assert tail.line_end(io.BytesIO(b"abcdefghij"), 0, 10) == 0 and tail.line_end(io.BytesIO(b"ab\ncdefghij"), 3, 11) == 3
