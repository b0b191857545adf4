"""Tokenizers for the corpus pipeline (CP-02, CP-13, UDF-02).

* ``char_vocab`` / ``char_ids`` — character-level vocabulary (sorted distinct
  characters -> ids, end-of-text = vocabulary size): the vocabulary is bounded
  by Unicode (< 1.2 M entries) and broadcast as a table by code point, through
  which Arrow batches are encoded, a megabyte of text at a time.
* ``byte_ids`` — UTF-8 bytes (end-of-text 256) as an Arrow-batched pandas UDF.
* ``bpe_ids`` — any BPE encoder with ``encode_ordinary`` (tiktoken), built
  once per Python worker from a user-supplied ranks file, through
  ``mapInPandas``.  The GPT-2 ranks are not shipped; tests use a tiny one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_EOT = 256
PART_BYTES = 1 << 20  # text encoded at a time


def chars(text: Column) -> Column:
    """Code-point characters of a string (Spark splits on code points)."""
    return F.split(text, "")


def char_vocab(docs: DataFrame, text: str = "text") -> DataFrame:
    """CP-13: ``(ch, code, id)`` for every distinct character, ids in code
    point order.  The global order runs over the distinct characters only
    (at most every code point, 1.1 M rows)."""
    # distinct characters per document first: the explode then carries only
    # a few hundred rows per document instead of every character
    d = docs.select(F.explode(F.array_distinct(chars(F.col(text)))).alias("ch")).distinct()
    d = d.withColumn("code", F.ascii("ch"))
    return d.withColumn("id", (F.row_number().over(Window.orderBy("code")) - 1).cast("int"))


def _vocab_codes(vocab: DataFrame) -> np.ndarray:
    """Code point of each id; Unicode bounds it to 4.5 MB."""
    got = vocab.select("code", "id").toArrow()
    codes = np.zeros(got.num_rows, np.uint32)
    codes[got["id"].to_numpy()] = got["code"].to_numpy()
    return codes


def char_ids(docs: DataFrame, vocab: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
    """CP-02 with the character vocabulary: ids per document plus end-of-text
    (= vocabulary size); ``unknown`` counts characters outside the vocabulary
    (the reference raises on them; callers filter or fail on it).  Null texts
    are end-of-text alone.

    A stretch of an Arrow batch is one array of code points, encoded by a table indexed by
    code point: the time per character doesn't depend on the vocabulary."""
    return _char_encoded(docs, vocab, text, out)


def char_lengths(docs: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """``unknown`` and ``len`` of ``char_ids`` alone, for plans that don't read the ids: they
    are neither formed nor handed back."""
    return _char_encoded(docs, vocab, text, None)


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of rows, each of ``PART_BYTES`` of text and one document at most:
    encoding holds some 30 bytes a character, and a batch of Spark's is up to 64 MB."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(size) - size) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _char_encoded(docs: DataFrame, vocab: DataFrame, text: str, out: str | None) -> DataFrame:
    codes = _vocab_codes(vocab)
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(0x110000, -1, np.int32)
        table[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for batch in (part for whole in batches for part in _parts(whole, text)):
            col = pc.fill_null(batch.column(text), "")
            n = pc.utf8_length(col).to_numpy().astype(np.int64)
            points = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = table[points]
            ends = np.cumsum(n)
            known = ids >= 0
            size = np.diff(np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], ends])]) + 1
            cols = [*(batch.column(c) for c in keep)]
            if out is not None:
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                values = np.full(offsets[-1], len(shared.value), np.int32)
                body = np.ones(len(values), bool)
                body[offsets[1:] - 1] = False
                values[body] = ids[known]
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            yield pa.record_batch([*cols, pa.array((n - size + 1).astype(np.int32)), pa.array(size.astype(np.int32))], names=names)

    made = [T.StructField("unknown", T.IntegerType()), T.StructField("len", T.IntegerType())]
    if out is not None:
        made.insert(0, T.StructField(out, T.ArrayType(T.IntegerType())))
    schema = T.StructType([docs.schema[c] for c in keep] + made)
    names = schema.names
    return docs.mapInArrow(run, schema)


def decode_chars(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """CP-13 decode: ids -> text; ids outside the vocabulary (such as the
    end-of-text id) are dropped."""
    shared = df.sparkSession.sparkContext.broadcast(_vocab_codes(vocab))

    @F.pandas_udf(T.StringType())
    def decode(col: pd.Series) -> pd.Series:
        codes = shared.value
        return col.map(lambda x: None if x is None else codes[x[(x >= 0) & (x < len(codes))]].tobytes().decode("utf-32-le", "surrogatepass"))

    return df.withColumn(out, decode(F.col(ids)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _utf8_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda s: np.append(np.frombuffer((s or "").encode("utf-8"), dtype=np.uint8).astype(np.int32), BYTE_EOT))


def byte_ids(docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
    """CP-02, byte level: UTF-8 bytes plus end-of-text 256, with ``len``."""
    return docs.withColumn(out, _utf8_bytes(F.col(text))).drop(text).withColumn("len", F.size(out))


def bpe_ids(docs: DataFrame, make_encoder: Callable[[], object], text: str = "text", out: str = "ids") -> DataFrame:
    """CP-02 with a BPE encoder (``encode_ordinary`` + ``eot_token``), built
    once per Python worker and applied to Arrow batches."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField("len", T.IntegerType())
    ])

    def run(batches):
        enc = make_encoder()
        eot = enc.eot_token
        for pdf in batches:
            ids = [list(enc.encode_ordinary(s or "")) + [eot] for s in pdf[text]]
            res = pdf[keep].copy()
            res[out] = ids
            res["len"] = [len(x) for x in ids]
            yield res

    return docs.mapInPandas(run, schema)


def tiktoken_from_ranks(path: str, name: str = "custom", eot: int | None = None) -> object:
    """A tiktoken encoder from a ranks file of ``<base64 token> <rank>`` lines
    (the format tiktoken publishes); the end-of-text id follows the ranks."""
    import base64

    import tiktoken

    ranks = {}
    with open(path, "rb") as fh:
        for line in fh:
            if line.strip():
                tok, rank = line.split()
                ranks[base64.b64decode(tok)] = int(rank)
    eot_id = len(ranks) if eot is None else eot
    return tiktoken.Encoding(
        name=name,
        pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
        mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": eot_id},
    )
