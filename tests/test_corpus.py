"""Corpus preparation: split sizes, contiguous packing, windows, tokenizers."""

import os
import pytest

import base64
import math

from pyspark.sql import functions as F

from skiff.functions.tokenize import bpe_ids, byte_ids, char_ids, char_lengths, char_vocab, decode_chars, tiktoken_from_ranks
from skiff.operators import corpus as C


def test_split_counts_match_published_numbers():
    assert C.split_counts(8_013_769) == (8_009_762, 4_007)


def test_holdout_exact_size(spark):
    docs = spark.range(0, 20_001).withColumnRenamed("id", "doc_id")
    s = C.holdout_split(docs)
    n_val = s.filter(F.col("split") == "val").count()
    assert n_val == math.ceil(20_001 * 0.0005)
    assert s.count() == 20_001


def test_pack_is_contiguous_sharding(spark):
    n, chunks = 2_500, 1024
    docs = spark.createDataFrame([(i, "train", 1 + i % 7) for i in range(n)], "doc_id long, split string, len long")
    off = C.prefix_offsets(docs, ["split"], width=300.0)
    d, man = C.pack(off, max_chunks=chunks)
    got = {r.doc_id: (r.chunk_id, r.tok_offset) for r in d.collect()}
    div, mod = divmod(n, chunks)
    start, expect = 0, {}
    for c in range(chunks):
        size = div + (1 if c < mod else 0)
        for p in range(start, start + size):
            expect[p] = c
        start += size
    assert all(got[i][0] == expect[i] for i in range(n))
    total = 0
    for i in range(n):
        assert got[i][1] == total
        total += 1 + i % 7
    m = man.collect()
    assert len(m) == chunks and sum(r.tokens for r in m) == total and {r.total_chunks for r in m} == {chunks}


def test_eval_windows_cover_stream(spark):
    lens = [5, 1, 9, 3, 12, 4]
    docs = spark.createDataFrame([(i, "val", L) for i, L in enumerate(lens)], "doc_id long, split string, len long")
    off = C.prefix_offsets(docs, ["split"])
    w = {r.win: r for r in C.eval_windows(off, block=4, batch=2).collect()}
    n = sum(lens)
    assert sorted(w) == list(range((n - 1) // 4))
    owner = [i for i, L in enumerate(lens) for _ in range(L)]
    for k, r in w.items():
        ds = set(owner[k * 4:(k + 1) * 4])
        assert (r.first_doc, r.last_doc, r.docs) == (min(ds), max(ds), len(ds)) and r.batch == k // 2


def test_capped_stream_and_split(spark):
    docs = spark.createDataFrame([(i, "all", 10) for i in range(10)], "doc_id long, split string, len long")
    off = C.prefix_offsets(docs, ["split"])
    c = sorted((r.doc_id, r.kept, r.val_tokens, r.train_tokens) for r in C.capped(off, 35, val_fraction=0.2).collect())
    assert c == [(0, 10, 7, 3), (1, 10, 0, 10), (2, 10, 0, 10), (3, 5, 0, 5)]


def test_char_vocab_roundtrip(spark):
    docs = spark.createDataFrame([(1, "abé"), (2, "ba")], "doc_id long, text string")
    v = char_vocab(docs)
    assert sorted((r.ch, r.id) for r in v.collect()) == [("a", 0), ("b", 1), ("é", 2)]
    ids = char_ids(docs, v)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {1: [0, 1, 2, 3], 2: [1, 0, 3]}
    back = {r.doc_id: r.text for r in decode_chars(ids, v).collect()}
    assert back == {1: "abé", 2: "ba"}


def test_byte_and_bpe_tokenizers(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, "hi é")], "doc_id long, text string")
    b = byte_ids(docs).collect()[0]
    assert list(b.ids) == list("hi é".encode()) + [256] and b.len == 6
    ranks = f"{tmpdir_path}/tiny.tiktoken"
    with open(ranks, "wb") as fh:
        for i in range(256):
            fh.write(base64.b64encode(bytes([i])) + b" " + str(i).encode() + b"\n")
    t = bpe_ids(docs, lambda: tiktoken_from_ranks(ranks)).collect()[0]
    assert list(t.ids) == list("hi é".encode()) + [256]


def _packed(spark, n=40):
    rows = [(i, "train" if i % 4 else "val", [i % 7] * (i % 5 + 1), i % 5 + 1) for i in range(n)]
    tokens = spark.createDataFrame(rows, "doc_id long, split string, ids array<int>, len int")
    return C.pack(C.prefix_offsets(tokens, ["split"]), max_chunks=3)


def test_publish_writes_the_manifest_last(spark, tmpdir_path):
    docs, manifest = _packed(spark)
    got = {r.split: r for r in C.publish(docs, manifest, tmpdir_path + "/good").collect()}
    assert set(got) == {"train", "val"} and all(r.ok and r.written == r.expected for r in got.values())
    shards = spark.read.parquet(tmpdir_path + "/good/shards")
    assert shards.count() == 40 and spark.read.parquet(tmpdir_path + "/good/manifest").count() == 6
    for split in ("train", "val"):  # a chunk's documents are contiguous
        ends = {}
        for r in shards.filter(F.col("split") == split).orderBy("tok_offset").collect():
            assert r.tok_offset == ends.get("at", 0) and r.chunk_id >= ends.get("chunk", 0)
            ends = {"at": r.tok_offset + r.len, "chunk": r.chunk_id}


def test_publish_refuses_short_output(spark, tmpdir_path):
    docs, manifest = _packed(spark)
    with pytest.raises(Exception, match="corpus guard failed"):
        C.publish(docs.filter("doc_id <> 7"), manifest, tmpdir_path + "/short")
    assert not os.path.exists(tmpdir_path + "/short/manifest")


def test_encoding_time_does_not_grow_with_the_vocabulary(spark):
    import time

    texts = spark.range(2000).selectExpr("id as doc_id", "repeat('abcdefghij', 100) as text").cache()
    texts.count()
    took = []
    for size in (20, 4000):
        vocab = spark.range(size).selectExpr("char(97 + cast(id as int)) as ch", "cast(97 + id as int) as code", "cast(id as int) as id")
        char_ids(texts, vocab).agg(F.sum("len")).collect()
        t = time.time()
        char_ids(texts, vocab).agg(F.sum("len")).collect()
        took.append(time.time() - t)
    assert took[1] < 4 * took[0] + 1


def test_sample_grid_keeps_all_rows_in_any_order(spark):
    from skiff.operators.experiments import sample_grid

    rows = [("r1", 1, "p", 0, 1, "a"), ("r1", 1, "p", 0, 2, "b"), ("r1", 1, "q", 1, 3, "second"), ("r2", 5, "q", 0, 4, "c")]
    want = sorted([("r1", 1, "p", 1, "a"), ("r1", 1, "p", 2, "b"), ("r1", 1, "q", None, None), ("r2", 5, "p", None, None), ("r2", 5, "q", 4, "c")], key=str)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "run_id string, step long, prompt string, sample_index int, sample_id long, completion string").repartition(3)
        assert sorted((tuple(r) for r in sample_grid(df).collect()), key=str) == want
    with pytest.raises(Exception, match="more than 1 prompts"):
        sample_grid(df, max_prompts=1).collect()


def test_lengths_without_ids(spark):
    """``len`` and ``unknown`` as ``char_ids`` has them: unknown characters, empty and null texts, an empty table."""
    vocab = char_vocab(spark.createDataFrame([("abc\u00e9 \U0001f600",)], "text string"))
    rows = [(1, "abc"), (2, ""), (3, None), (4, "xaxb\U0001f600\u00e9"), (5, "zzz"), (1, "abc"), (6, "ab " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in char_ids(docs, vocab).select("doc_id", "unknown", "len").collect())
    assert sorted(tuple(r) for r in char_lengths(docs, vocab).collect()) == want
    assert (4, 2, 5) in want and (3, 0, 1) in want and (5, 3, 1) in want
    assert char_lengths(docs.limit(0), vocab).count() == 0


def test_encoding_holds_a_stretch_of_a_batch(spark, monkeypatch):
    """Memory to encode a batch doesn't grow with the batch; rows and order are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    texts = ["", None, "a" * 9_000, "bé" * 2_000, "", "a€😀" * 700] * 800
    docs = spark.createDataFrame([(0, "abé€😀")], "doc_id long, text string")
    vocab, runs = char_vocab(docs), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    char_ids(docs, vocab)
    char_lengths(docs, vocab)
    ids = {c: k for k, c in enumerate("abé€😀")}
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for run in runs:
        tracemalloc.start()
        row = 0
        for part in run(iter([batch])):
            for k, n in zip(part["doc_id"].to_pylist(), part["len"].to_pylist()):
                assert k == row and n == len(texts[k] or "") + 1
                row += 1
            if "ids" in part.schema.names and part["doc_id"][0].as_py() == 0:
                assert part["ids"][:6].to_pylist() == [[*(ids[c] for c in t or ""), len(ids)] for t in texts[:6]]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert row == len(texts)
        assert peak < 100e6  # the whole batch at once: some 350 MB
    assert [p.num_rows for p in runs[0](iter([batch.slice(0, 0)]))] == [0]


def test_published_corpus_scans_no_token_ids(spark, tmpdir_path, monkeypatch):
    """Offsets are scanned without ids, which come back to their own rows, also where documents' ids repeat."""
    from skiff.plans import files as P

    docs = [(i % 50, "ab" * (i % 7) + "c") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    scanned, published = [], []
    offsets, publish = C.prefix_offsets, C.publish
    monkeypatch.setattr(C, "prefix_offsets", lambda t, *a, **k: scanned.append(t.columns) or offsets(t, *a, **k))
    monkeypatch.setattr(C, "publish", lambda d, *a, **k: published.append(d) or publish(d, *a, **k))
    assert P.QUERIES["files_published"](spark, tmpdir_path).filter("ok").count() == 2
    assert all("ids" not in columns for columns in scanned)
    rows = published[0].collect()
    assert sorted((r.doc_id, r.len) for r in rows) == sorted((d, len(t) + 1) for d, t in docs)
    assert all(len(r.ids) == r.len for r in rows) and "row" not in published[0].columns
