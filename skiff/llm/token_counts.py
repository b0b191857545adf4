"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary of a SentencePiece BPE model ranks its pieces by score.  A word
starts as a doubly linked list of characters; every adjacent pair whose
concatenation is a piece waits in a heap keyed by (rank, position).  The lowest
rank is popped again and again, stale entries are skipped, the pair becomes one
node and its two new neighbours enter the heap.  The count is the initial
symbols minus the merges, plus the extra bytes of symbols that no piece covers
(byte fallback).  No identifier is ever produced.

Texts are cut into words where no merge can cross: no piece of such a
vocabulary contains a space mark after another character (checked on loading),
and within a word at character pairs that no piece contains.  Two bounded caches
per worker keep the counts of words and of their parts.

Null and empty texts have no tokens.  Rows are counted one by one, so repeated
rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow
from skiff.llm.textops import held, slices

MARK = "▁"
#: Entries of each cache (about 100 bytes an entry); a full cache starts anew.
CACHE = 1_000_000
#: Ordinary pieces in the model file's protocol buffer; control, unknown and byte pieces are of other kinds.
NORMAL = 1


class PieceRanks:
    """Ranks of the pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or {p.type for p in model.pieces} & {4, 5}:
            raise ValueError(f"{model_file}: only BPE models with byte fallback, identity normalisation and no user-defined or unused pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        pieces = [p for p in model.pieces if p.type == NORMAL]
        order = sorted(range(len(pieces)), key=lambda i: -pieces[i].score)
        self.rank = {pieces[i].piece: r for r, i in enumerate(order)}
        self.pairs = {a + b for p in self.rank for a, b in zip(p, p[1:])}
        if any(x[1] == MARK != x[0] for x in self.pairs):
            raise ValueError(f"{model_file}: a piece continues over the start of a word")
        self.counts: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one stretch of text by popping the lowest-rank adjacent pair."""
        n = len(word)
        rank = self.rank
        sym = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if sym[i] == left else n
            if j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = left + right, ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(sym[i] + sym[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] + sym[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, sym[h], sym[i]))
        extra = sum(len(s.encode()) - 1 for s in sym if s and s not in rank)
        return n - merges + extra

    def word(self, word: str) -> int:
        """Tokens of a word, cut first where no piece can span."""
        pairs, total, start = self.pairs, 0, 0
        for i, pair in enumerate(map(str.__add__, word, word[1:]), 1):
            if pair not in pairs:
                total += self.part(word[start:i])
                start = i
        return total + self.part(word[start:])

    def part(self, part: str) -> int:
        count = self.parts.get(part)
        if count is None:
            count = self.merged(part)
            if len(part) <= 64:
                if len(self.parts) >= CACHE:
                    self.parts.clear()
                self.parts[part] = count
        return count

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = _WORDS.findall((" " if self.prefix else "") + text.replace(MARK, " "))
        counts = self.counts
        try:
            return sum(map(counts.__getitem__, words))
        except KeyError:
            pass
        if len(counts) >= CACHE:
            counts.clear()
        total = 0
        for w in words:
            c = counts.get(w)
            if c is None:
                c = self.word(w.replace(" ", MARK))
                if len(w) <= 64:
                    counts[w] = c
            total += c
        return total


#: Spaces and what follows them; a text without a prefix mark may begin without one.
_WORDS = re.compile(" +[^ ]*|[^ ]+")


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``model_file`` is a path that every executor can open."""
    key = f"ranks {model_file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(key, lambda: PieceRanks(model_file))
        for batch in batches:
            for part in slices(batch, "text", key=key):
                n = [pieces.text(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = narrow(docs, id_column, text_column).toDF("id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
