"""Registered corpus-preparation queries over ``documents``, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skiff.functions.tokenize import char_ids, char_lengths, char_vocab
from skiff.operators import corpus as C
from skiff.session import arrow_batches, scratch_path
from skiff.sources.tables import table

BLOCK = 1024        # context length of the evaluation windows
EVAL_BATCH = 12
CAP_TOKENS = 1_000_000
BASE_SEED = 1337
DATASET = "driver-corpus"
PIECE_TOKENS = 4096  # a chunk of the small tables has several pieces
PLACES = 1009


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _encoded(spark, sf):
    docs = _docs(spark, sf)
    return char_ids(C.holdout_split(docs), char_vocab(docs))


def _tokens(spark, sf):
    """Tokenized documents with their split, written once to the shared
    checkpoint folder as Parquet (the token cache of stages that read ids), with a
    number of its own for every ``row``: ids of documents may repeat."""
    path = f"{scratch_path(spark, 'tokens')}-{uuid.uuid4().hex}"
    with arrow_batches(spark):
        _encoded(spark, sf).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _lengths(spark, sf):
    """``(doc_id, split, len)`` of the tokenized documents, written once likewise: plans read
    them several times, and texts once."""
    docs = _docs(spark, sf)
    path = f"{scratch_path(spark, 'lengths')}-{uuid.uuid4().hex}"
    char_lengths(C.holdout_split(docs), char_vocab(docs)).select("doc_id", "split", "len").write.parquet(path)
    return spark.read.parquet(path)


def _offsets(spark, sf):
    return C.prefix_offsets(_lengths(spark, sf), ["split"])


def _packed(spark, sf):
    return C.pack(_offsets(spark, sf))


def q_split(spark, sf):
    return C.holdout_split(_docs(spark, sf)).select("doc_id", "split")


def q_split_counts(spark, sf):
    t = _lengths(spark, sf)
    return t.groupBy("split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("len").cast("long").alias("tokens"),
        (F.sum("len") * C.BYTES_PER_TOKEN).cast("long").alias("bytes"),
    )


def q_vocab(spark, sf):
    return char_vocab(_docs(spark, sf)).select("code", "id")


def q_checksum(spark, sf):
    t = _encoded(spark, sf)
    return t.groupBy("split").agg(
        F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum"),
        F.max(F.array_max("ids")).alias("max_id"),
        F.sum("len").cast("long").alias("tokens"),
        F.sum("unknown").cast("long").alias("unknown"),
    )


def q_offsets(spark, sf):
    docs, _ = _packed(spark, sf)
    return docs.select("split", "doc_id", "len", "tok_offset", "pos", "chunk_id")


def q_manifest(spark, sf):
    return _packed(spark, sf)[1]


def q_capped(spark, sf, cap=CAP_TOKENS):
    """CP-03/04: the stream of documents up to ``cap`` tokens (the cap is the operator's feature)."""
    t = _lengths(spark, sf).withColumn("stream", F.lit("all"))
    off = C.prefix_offsets(t, ["stream"])
    return C.capped(off, cap)


def q_eval_windows(spark, sf):
    off = _offsets(spark, sf).filter(F.col("split") == "train")
    return C.eval_windows(off, BLOCK, EVAL_BATCH)


def q_random_windows(spark, sf):
    off = _offsets(spark, sf).filter(F.col("split") == "train")
    req = off.select(
        (F.col("doc_id") % 8).cast("int").alias("rank"),
        F.floor(F.col("doc_id") / 8).cast("long").alias("step"),
        F.lit(0).alias("row"),
    ).withColumn("seed", C.request_seed(BASE_SEED, F.col("rank"), F.lit(0)))
    return C.random_windows(off, req, BLOCK)


def q_guards(spark, sf):
    t = _tokens(spark, sf)
    _, manifest = C.pack(C.prefix_offsets(t.drop("ids", "row"), ["split"]))
    return C.guards(t, manifest)


def q_readiness(spark, sf):
    return C.readiness(_packed(spark, sf)[1])


def q_staged(spark, sf):
    manifest = _packed(spark, sf)[1]
    listing = manifest.groupBy("split").agg((F.sum("tokens") * C.BYTES_PER_TOKEN).cast("long").alias("size")).select(
        F.lit(DATASET).alias("dataset"), F.concat(F.col("split"), F.lit(".bin")).alias("name"), "size"
    )
    expected = spark.createDataFrame([(DATASET, n) for n in ("train.bin", "val.bin", "meta.pkl")], "dataset string, name string")
    floors = spark.createDataFrame([(DATASET, "val.bin", 4_000_000)], "dataset string, name string, floor long")
    return C.staged_verdict(expected, listing, floors)


def q_resume(spark, sf):
    manifest = _packed(spark, sf)[1]
    # durable progress of an interrupted run: the first third of the train
    # chunks under the same header; val was written under another total
    durable = manifest.select(
        "split", "chunk_id",
        F.when(F.col("split") == "val", F.col("total_tokens") + 1).otherwise(F.col("total_tokens")).alias("total_tokens"),
        "total_chunks",
    ).filter(F.col("chunk_id") < F.floor(F.col("total_chunks") / 3))
    return C.resume_plan(manifest, durable).select("split", "chunk_id", "docs", "tokens", "tok_offset")


def _sums(blocks):
    """Tokens, sum of ids and sum of ids by place (modulo a prime) of every piece of a split."""
    tok = blocks.select("split", "chunk_id", "piece", F.posexplode("ids").alias("k", "id"), "start")
    place = (F.col("start") + F.col("k")) % PLACES + 1
    return tok.groupBy("split", "chunk_id", "piece").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("id").cast("long").alias("id_sum"), F.sum(F.col("id") * place).cast("long").alias("place_sum")
    )


def _token_files(spark, sf):
    """Where the packed token files of all documents are."""
    path = f"{scratch_path(spark, 'token-files')}-{uuid.uuid4().hex}"
    return C.publish_pieces(_tokens(spark, sf).select("doc_id", "split", "len", "ids"), path, PIECE_TOKENS)


def q_token_files(spark, sf):
    """SNK-03, SRC-17: the corpus written as packed token files and read back by blocks."""
    folder = _token_files(spark, sf).first()["folder"]
    return _sums(spark.read.format("token_files").load(folder))


def q_token_pieces(spark, sf):
    """CP-06: the manifest of the packed token files."""
    return _token_files(spark, sf).select("split", "chunk_id", "piece", "tok_offset", "tokens", "docs")


QUERIES = {
    "corpus_token_files": q_token_files,
    "corpus_token_pieces": q_token_pieces,
    "corpus_split": q_split,
    "corpus_split_counts": q_split_counts,
    "corpus_vocab": q_vocab,
    "corpus_token_checksum": q_checksum,
    "corpus_offsets": q_offsets,
    "corpus_manifest": q_manifest,
    "corpus_capped": q_capped,
    "corpus_eval_windows": q_eval_windows,
    "corpus_random_windows": q_random_windows,
    "corpus_guards": q_guards,
    "corpus_readiness": q_readiness,
    "corpus_staged": q_staged,
    "corpus_resume": q_resume,
}

# ------------------------------------------------------------------ SQL --

_SPLIT = f"""d AS (SELECT doc_id, text, ('0x' || substr(md5('{C.SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT AS h FROM documents),
nk AS (SELECT ceil(count(*) * CAST({C.VAL_FRACTION} AS DOUBLE)) AS k FROM d),
sp AS (SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT k FROM nk) THEN 'val' ELSE 'train' END AS split FROM d),
v AS (SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS id
      FROM (SELECT DISTINCT unicode(c) AS code FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) x) y),
vs AS (SELECT count(*) AS vsize FROM v),
tok AS (SELECT doc_id, split, length(text) + 1 AS len FROM sp),
off AS (SELECT *, sum(len) OVER w - len AS tok_offset, row_number() OVER w - 1 AS pos
        FROM tok WINDOW w AS (PARTITION BY split ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT split, count(*) AS n, CAST(sum(len) AS BIGINT) AS total_tokens, CAST(greatest(1, least({C.WRITE_CHUNKS}, count(*))) AS INTEGER) AS total_chunks
        FROM tok GROUP BY split),
ch AS (SELECT o.*, t.total_tokens, t.total_chunks,
         CAST(CASE WHEN pos < (n // total_chunks + 1) * (n % total_chunks) THEN pos // (n // total_chunks + 1)
              ELSE n % total_chunks + (pos - (n // total_chunks + 1) * (n % total_chunks)) // (n // total_chunks) END AS INTEGER) AS chunk_id
       FROM off o JOIN tot t USING (split)),
man AS (SELECT split, chunk_id, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, min(tok_offset) AS tok_offset,
               first(total_tokens) AS total_tokens, first(total_chunks) AS total_chunks FROM ch GROUP BY split, chunk_id)"""


def _q(sql: str) -> str:
    return f"WITH {_SPLIT}\n{sql}"


ORACLE = {
    "corpus_split": _q("SELECT doc_id, split FROM sp"),
    "corpus_split_counts": _q("SELECT split, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, CAST(sum(len) * 2 AS BIGINT) AS bytes FROM tok GROUP BY split"),
    "corpus_vocab": _q("SELECT code, id FROM v"),
    "corpus_token_checksum": _q(
        """, cs AS (SELECT doc_id, sum(v.id) AS s, max(v.id) AS m FROM (SELECT doc_id, unicode(unnest(string_split(text, ''))) AS code FROM documents) c
                    JOIN v USING (code) GROUP BY doc_id)
           SELECT split, CAST(sum(cs.s + (SELECT vsize FROM vs)) AS BIGINT) AS id_sum, greatest(max(cs.m), (SELECT vsize FROM vs)) AS max_id,
                  CAST(sum(len) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS unknown
           FROM tok JOIN cs USING (doc_id) GROUP BY split""".replace(", cs AS", "SELECT 1) , cs AS", 0)
    ),
    "corpus_offsets": _q("SELECT split, doc_id, len, tok_offset, pos, chunk_id FROM ch"),
    "corpus_manifest": _q("SELECT * FROM man"),
    "corpus_capped": _q(
        f""", s AS (SELECT doc_id, len, sum(len) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len AS tok_offset FROM tok),
           k AS (SELECT doc_id, tok_offset, least(len, {CAP_TOKENS} - tok_offset) AS kept FROM s WHERE tok_offset < {CAP_TOKENS}),
           nv AS (SELECT greatest(1, CAST(floor(sum(kept) * CAST({C.VAL_FRACTION} AS DOUBLE)) AS BIGINT)) AS n_val FROM k)
           SELECT doc_id, tok_offset, kept, greatest(0, least(kept, (SELECT n_val FROM nv) - tok_offset)) AS val_tokens,
                  kept - greatest(0, least(kept, (SELECT n_val FROM nv) - tok_offset)) AS train_tokens FROM k"""
    ),
    "corpus_eval_windows": _q(
        f""", tr AS (SELECT * FROM ch WHERE split = 'train'),
           nw AS (SELECT CAST((sum(len) - 1) // {BLOCK} AS BIGINT) AS nw FROM tr),
           sl AS (SELECT doc_id, unnest(range(CAST(tok_offset // {BLOCK} AS BIGINT), CAST(greatest(tok_offset // {BLOCK}, least((tok_offset + len - 1) // {BLOCK}, (SELECT nw FROM nw) - 1)) + 1 AS BIGINT))) AS win
                  FROM tr WHERE len > 0)
           SELECT win, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
                  CAST(win // {EVAL_BATCH} AS BIGINT) AS batch, win * {BLOCK} AS start
           FROM sl WHERE win < (SELECT nw FROM nw) GROUP BY win"""
    ),
    "corpus_random_windows": _q(
        f""", tr AS (SELECT * FROM ch WHERE split = 'train'),
           n AS (SELECT sum(len) AS n FROM tr),
           rq AS (SELECT CAST(doc_id % 8 AS INTEGER) AS rank, CAST(doc_id // 8 AS BIGINT) AS step, 0 AS row,
                         {BASE_SEED} + CAST(doc_id % 8 AS INTEGER) * 1000003 + 0 AS seed FROM tr),
           rs AS (SELECT *, CAST((('0x' || substr(md5(CAST(seed AS VARCHAR) || ':' || CAST(rank AS VARCHAR) || ':' || CAST(step AS VARCHAR) || ':' || CAST(row AS VARCHAR)), 1, 13))::BIGINT)
                             % ((SELECT n FROM n) - {BLOCK}) AS BIGINT) AS start FROM rq)
           SELECT rs.rank, rs.step, rs.row, rs.seed, rs.start, tr.doc_id, rs.start - tr.tok_offset AS doc_pos
           FROM rs ASOF LEFT JOIN tr ON rs.start >= tr.tok_offset"""
    ),
    "corpus_guards": _q(
        """, cs AS (SELECT doc_id, max(v.id) AS m FROM (SELECT doc_id, unicode(unnest(string_split(text, ''))) AS code FROM documents) c
                    JOIN v USING (code) GROUP BY doc_id),
           t AS (SELECT split, greatest(max(cs.m), (SELECT vsize FROM vs)) AS max_id, CAST(sum(len) AS BIGINT) AS written FROM tok JOIN cs USING (doc_id) GROUP BY split),
           m AS (SELECT split, first(total_tokens) AS expected, CAST(sum(tokens) AS BIGINT) AS chunked FROM man GROUP BY split)
           SELECT split, max_id, written, expected, max_id <= 65535 AS ids_fit, written = expected AS total_matches,
                  chunked >= expected AS not_short, written > 0 AS non_zero FROM t FULL JOIN m USING (split)"""
    ),
    "corpus_readiness": _q(
        """SELECT s.split, coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) * 2 AS bytes, coalesce(tokens, 0) > 0 AS ready
           FROM (VALUES ('train'), ('val')) s(split) LEFT JOIN (SELECT split, CAST(sum(tokens) AS BIGINT) AS tokens FROM man GROUP BY split) m USING (split)"""
    ),
    "corpus_staged": _q(
        f""", listing AS (SELECT '{DATASET}' AS dataset, split || '.bin' AS name, CAST(sum(tokens) * 2 AS BIGINT) AS size FROM man GROUP BY split),
           e AS (SELECT * FROM (VALUES ('{DATASET}', 'train.bin'), ('{DATASET}', 'val.bin'), ('{DATASET}', 'meta.pkl')) e(dataset, name)),
           f AS (SELECT * FROM (VALUES ('{DATASET}', 'val.bin', CAST(4000000 AS BIGINT))) f(dataset, name, floor))
           SELECT e.dataset, e.name, l.size, coalesce(f.floor, {C.DEFAULT_MIN_BYTES}) AS floor,
                  CASE WHEN l.size IS NULL THEN 'missing' WHEN l.size < coalesce(f.floor, {C.DEFAULT_MIN_BYTES}) THEN 'truncated' ELSE 'ok' END AS verdict
           FROM e LEFT JOIN listing l USING (dataset, name) LEFT JOIN f USING (dataset, name)"""
    ),
    "corpus_resume": _q(
        """SELECT split, chunk_id, docs, tokens, tok_offset FROM man
           WHERE NOT (split = 'train' AND chunk_id < total_chunks // 3)"""
    ),
}
ORACLE["corpus_token_checksum"] = _q(
    """, cs AS (SELECT doc_id, sum(v.id) AS s, max(v.id) AS m FROM (SELECT doc_id, unicode(unnest(string_split(text, ''))) AS code FROM documents) c
                JOIN v USING (code) GROUP BY doc_id)
       SELECT split, CAST(sum(cs.s + (SELECT vsize FROM vs)) AS BIGINT) AS id_sum, greatest(max(cs.m), (SELECT vsize FROM vs)) AS max_id,
              CAST(sum(len) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS unknown
       FROM tok JOIN cs USING (doc_id) GROUP BY split"""
)
_PIECES = f""", pc AS (SELECT split, chunk_id, CAST((tok_offset - min(tok_offset) OVER (PARTITION BY split, chunk_id)) // {PIECE_TOKENS} AS INTEGER) AS piece,
                doc_id, len, tok_offset FROM ch)"""
ORACLE["corpus_token_pieces"] = _q(
    _PIECES + """ SELECT split, chunk_id, piece, min(tok_offset) AS tok_offset, CAST(sum(len) AS BIGINT) AS tokens, count(*) AS docs FROM pc GROUP BY ALL HAVING sum(len) > 0"""
)
ORACLE["corpus_token_files"] = _q(
    _PIECES + f""", cp AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS k FROM documents WHERE length(text) > 0),
       ids AS (SELECT doc_id, k, v.id FROM cp JOIN v ON v.code = unicode(cp.c)
               UNION ALL SELECT doc_id, len - 1, (SELECT vsize FROM vs) FROM tok)
       SELECT split, chunk_id, piece, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum,
              CAST(sum(id * ((tok_offset + k) % {PLACES} + 1)) AS BIGINT) AS place_sum
       FROM ids JOIN pc USING (doc_id) GROUP BY ALL"""
)
