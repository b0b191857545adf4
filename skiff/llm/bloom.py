"""A Bloom filter of bounded size over a DataFrame's 64-bit hashes, for cheap pre-selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.textops import mix

#: Bits: a power of two above ``PER_KEY`` for each key, but never more than ``MOST`` (16 MB).
#: Beyond that the filter lets more rows through; whatever it lets through is joined exactly.
PER_KEY, MOST, HASHES = 10, 1 << 27, 4


def _places(hash: np.ndarray, size: int) -> list[np.ndarray]:
    h = hash.astype(np.int64).view(np.uint64)
    return [(mix(h + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(1, HASHES + 1)]


class Bloom:
    """Of the longs in column ``column``, none of them null.  The bits are or-ed word by
    word in Spark; only these words, not the keys, come to the driver."""

    def __init__(self, keys: DataFrame, column: str = "hash"):
        n = keys.count()
        size = 64
        while size < min(MOST, PER_KEY * n):
            size *= 2

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), size)))
                yield pa.record_batch([bit >> 6, np.left_shift(1, bit & 63)], names=["word", "bit"])

        one = keys.select(column).mapInArrow(words, "word long, bit long")
        got = one.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.int64)
        bits[got["word"].to_numpy()] = got["bits"].to_numpy()
        self.size = size
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def has(self, hash: np.ndarray) -> np.ndarray:
        """For each hash whether it may be a key: true for all keys and few others."""
        out = np.ones(len(hash), bool)
        for b in _places(hash, self.size):
            out &= (self.bits.value[b >> 6] >> (b & 63) & 1).astype(bool)
        return out

    def maybe(self, hash: Column) -> Column:
        """``has`` as a column; only the hashes go to Python."""

        @F.pandas_udf("boolean")
        def among(h: pd.Series) -> pd.Series:
            return pd.Series(self.has(h.to_numpy()))

        return among(hash)
