"""Packed token files: round trip, refusals, and a write that is ended half way."""

import os
import pickle
import time
import uuid
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skiff.operators import corpus as C
from skiff.sources.token_files import TokenFiles, TokenReader, TokenWriter, piece_name


def _docs(spark, n=300):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"))
    d = d.withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("doc_id") % 90), lambda k: ((F.col("doc_id") * 211 + k * 7) % 65536).cast("int")))
    d = d.withColumn("ids", F.when(F.col("doc_id") % 11 == 3, F.array().cast("array<int>")).otherwise(F.col("ids")))
    return d.withColumn("len", F.size("ids")).select("doc_id", "split", "len", "ids")


def _stream(docs, split):
    return [i for r in docs.filter(F.col("split") == split).orderBy("doc_id").collect() for i in r.ids]


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.bin")}


def test_round_trip(spark, tmpdir_path):
    docs = _docs(spark)
    man = C.publish_pieces(docs, tmpdir_path, piece_tokens=200, max_chunks=9).collect()
    assert len(man) > 20 and all(0 < m.tokens <= 200 + 90 for m in man)
    want = {split: _stream(docs, split) for split in ("train", "val")}
    for split, block, range_bytes in [("train", 1024, 64 << 20), ("val", 16, 64), ("train", 7, 100)]:
        got = spark.read.format("token_files").option("split", split).option("block", block).option("range_bytes", range_bytes).load(man[0].folder).orderBy("start").collect()
        assert [i for r in got for i in r.ids] == want[split]
        at = 0
        for r in got:
            assert r.start == at and 0 < len(r.ids) <= block
            at += len(r.ids)


def test_ended_write_goes_on(spark, tmpdir_path):
    docs = _docs(spark)
    folder = C.publish_pieces(docs, f"{tmpdir_path}/whole", 200, 9).first().folder
    whole = {os.path.basename(p) for p in _files(folder)}
    # the text of one document can't be fetched: its piece's task fails, other pieces are there
    late = F.when(F.col("doc_id") == 150, F.raise_error(F.lit("lost")).cast("array<int>")).otherwise(F.col("ids"))
    with pytest.raises(Exception, match="lost"):
        C.publish_pieces(docs.withColumn("ids", late).repartition(8, "doc_id"), f"{tmpdir_path}/out", 200, 9)
    assert not os.path.exists(f"{tmpdir_path}/out/manifest")
    # some pieces of the ended write, one of them torn
    folder2 = next(p for p in Path(f"{tmpdir_path}/out").iterdir() if p.name.startswith("corpus-"))
    assert folder2.name == Path(folder).name
    for k, p in enumerate(sorted(_files(folder))):
        if k % 3 == 0:
            to = folder2 / Path(p).relative_to(folder)
            to.parent.mkdir(parents=True, exist_ok=True)
            data = Path(p).read_bytes()
            to.write_bytes(data[:-2] if k == 0 else data)
    before = _files(folder2)
    torn = str(folder2 / Path(sorted(_files(folder))[0]).relative_to(folder))
    time.sleep(0.05)
    man = C.publish_pieces(docs, f"{tmpdir_path}/out", 200, 9)
    after = _files(folder2)
    assert {os.path.basename(p) for p in after} == whole
    assert [p for p in before if after[p] != before[p]] == [torn]
    assert man.count() == len(whole)
    assert [i for r in spark.read.format("token_files").option("split", "train").load(str(folder2)).orderBy("start").collect() for i in r.ids] == _stream(docs, "train")
    # a third run writes nothing
    C.publish_pieces(docs, f"{tmpdir_path}/out", 200, 9)
    assert _files(folder2) == after


def test_another_corpus_begins_anew(spark, tmpdir_path):
    a = C.publish_pieces(_docs(spark, 60), tmpdir_path, 200, 4).first().folder
    b = C.publish_pieces(_docs(spark, 61), tmpdir_path, 200, 4).first().folder
    assert a != b


def test_writer_gets_small_batches(spark, tmpdir_path, monkeypatch):
    """A worker's memory doesn't depend on how many rows its partition has."""
    sizes = Path(tmpdir_path) / "sizes"
    sizes.mkdir()
    folder = str(sizes)

    class Writer(TokenWriter):
        def write(self, iterator):
            def seen():
                for batch in iterator:
                    Path(folder, uuid.uuid4().hex).write_text(str(batch.nbytes))
                    yield batch

            return TokenWriter.write(self, seen())

    class Files(TokenFiles):
        def writer(self, schema, overwrite):
            return Writer(self.options)

    n, size = 2000, 4096
    ids = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: ((F.col("doc_id") * 211 + k * 7) % 65536).cast("int"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("train").alias("split"), F.lit(size).alias("len"), ids.alias("ids"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(C, "TokenFiles", Files)
    try:
        man = C.publish_pieces(docs, f"{tmpdir_path}/out", 1 << 20, 2).collect()
    finally:
        spark.dataSource.register(TokenFiles)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert sum(m.tokens for m in man) == n * size
    got = [int(p.read_text()) for p in sizes.iterdir()]
    assert sum(got) >= 4 * n * size and max(got) < 5 << 20


def _many(top, n, chunks=2):
    """``n`` pieces of one token each."""
    for k in range(n):
        p = Path(top, piece_name("train", k * chunks // n, k % (n // chunks), k, 1, zlib.crc32(k.to_bytes(2, "little"))))
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(k.to_bytes(2, "little"))


def test_plan_does_not_grow_with_files(tmpdir_path):
    sizes = []
    for n in (3000, 12000):
        top = f"{tmpdir_path}/{n}"
        _many(top, n)
        reader = TokenReader({"path": top})
        tasks = reader.partitions()
        sizes.append(sum(len(pickle.dumps(t)) for t in tasks) / len(tasks))
        assert n // 80 <= len(tasks) <= n // 50
        got = [(s, i) for t in tasks for b in reader.read(t) for s, ids in zip(b["start"].to_pylist(), b["ids"].to_pylist()) for i in ids]
        assert sorted(got) == [(k, k) for k in range(n)]
    assert max(sizes) < 800
    # small files beside one that is cut, empty ones, and a file that goes when the scan is planned
    top = Path(tmpdir_path, "mixed")
    top.mkdir()
    for k, name in enumerate("abcdef"):
        (top / f"{name}.bin").write_bytes(bytes(2 * (0, 1, 40, 0, 3, 2)[k]))
    reader = TokenReader({"path": str(top), "block": "2", "range_bytes": "16"})
    tasks = reader.partitions()
    got = [(s, n) for t in tasks for b in reader.read(t) for s, n in zip(b["split"].to_pylist(), (len(i) for i in b["ids"].to_pylist()))]
    assert {s: sum(n for t, n in got if t == s) for s, _ in got} == {"b": 1, "c": 40, "e": 3, "f": 2}
    only = TokenReader({"path": str(top), "split": "e"})
    assert [b["split"].to_pylist() for t in only.partitions() for b in only.read(t)] == [["e"]]
    (top / "e.bin").write_bytes(bytes(8))
    with pytest.raises(ValueError, match="changed since"):
        list(b for t in tasks for b in reader.read(t))


def test_pieces_listed_by_tasks(spark, tmpdir_path):
    """The driver has neither the names of the files nor, in a join, the listing."""
    _many(f"{tmpdir_path}/many", 500)
    there = C.durable_pieces(spark, f"{tmpdir_path}/many")
    assert there.inputFiles() == []
    assert [r.tok_offset for r in there.orderBy("tok_offset").collect()] == list(range(500))
    plan = spark.range(10).withColumnRenamed("id", "tok_offset").join(there, on="tok_offset", how="left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # files in the split's own folder are pieces too
    docs = _docs(spark)
    folder = C.publish_pieces(docs, f"{tmpdir_path}/out", 200, 9).first().folder
    flat = Path(tmpdir_path, "flat", os.path.basename(folder))
    for p in map(Path, _files(folder)):
        to = flat / p.parent.parent.name / p.name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(p.read_bytes())
    before = _files(flat)
    C.publish_pieces(docs, f"{tmpdir_path}/flat", 200, 9)
    assert _files(flat) == before
    assert [i for r in spark.read.format("token_files").option("split", "train").load(str(flat)).orderBy("start").collect() for i in r.ids] == _stream(docs, "train")


def test_refusals(spark, tmpdir_path):
    spark.dataSource.register(TokenFiles)

    def read():
        return spark.read.format("token_files").load(tmpdir_path).collect()

    one = Path(tmpdir_path) / "train.bin"
    one.write_bytes(b"\x01\x00\xff\xff")
    assert [(r.split, r.chunk_id, r.start, r.ids) for r in read()] == [("train", 0, 0, [1, 65535])]
    one.write_bytes(b"\x01\x00\xff")
    with pytest.raises(Exception, match="whole uint16"):
        read()
    one.write_bytes(b"")
    assert read() == []
    man = C.publish_pieces(_docs(spark, 40), tmpdir_path, 200, 4)
    piece = sorted(_files(man.first().folder))[0]
    data = Path(piece).read_bytes()
    Path(piece).write_bytes(data[:-2] + b"\x07\x07")
    with pytest.raises(Exception, match="checksum"):
        read()
    Path(piece).write_bytes(data[:-2])
    with pytest.raises(Exception, match="instead of"):
        read()
    for bad in (70_000, -1):
        docs = spark.createDataFrame([(1, "train", 2, [5, bad])], "doc_id long, split string, len int, ids array<int>")
        with pytest.raises(Exception, match="outside uint16"):
            C.publish_pieces(docs, f"{tmpdir_path}/bad{bad}", 200, 4)
    short = spark.createDataFrame([(1, "train", 3, [5, 6]), (2, "train", 1, [7])], "doc_id long, split string, len int, ids array<int>")
    with pytest.raises(Exception, match="ends at"):
        C.publish_pieces(short, f"{tmpdir_path}/short", 200, 1)
    none = spark.createDataFrame([], "doc_id long, split string, len int, ids array<int>")
    assert C.publish_pieces(none, f"{tmpdir_path}/none").count() == 0
