"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. A text is the set of its distinct ``words``-word shingles.  One pass makes a
   128-bit key of the set and ``TREES * DEPTH`` minhashes of 16 bits.  Texts of
   equal key are copies; from here on there is one representative of each.
2. Tree ``t`` is a prefix trie over the texts' ``t``-th strings of ``DEPTH``
   minhashes, kept as rows sorted by string (a string is one long, so texts below a
   trie node are neighbours).  Two texts match at their longest common prefix.  A
   pair's prefix is shortened from ``DEPTH`` only as far as its texts need: two
   different texts at the threshold have, by their numbers of shingles, some least
   possible similarity s, and a text needs the longest prefix k at which such a pair
   meets in one of the trees with probability ``recall`` (``needs``).  Texts too
   short to be at the threshold with any other text are in no trie.
3. Matched pairs whose whole signatures agree in under ``LEAST_AGREEMENT`` are
   passed over (at similarity 0.8 that is more than six standard deviations away);
   the others link representatives into candidate components, of which only
   spanning edges are written.  A node with many texts is split into blocks.
4. Candidates' shingle sets come from their texts, which a Bloom filter of their
   ids picks out; texts themselves are never shuffled.  Within each candidate
   component pairs are compared exactly; a component of many texts is first cut into
   bands of set size, as a pair at the threshold lies in the same or in neighbouring
   bands, and these into blocks.  What leaves a task is a number of links per
   representative and spanning edges, never the pairs of a group.
5. The verified links' components are the classes.

Result: one row per document with ``class_id`` (least id of its class),
``n_links`` (different texts at similarity ``threshold`` or more) and
``n_copies`` (documents with the same shingles, itself included).

Defined cases: null and empty texts have no shingles; they are copies of each
other and link to nothing else.  A text of fewer than ``words`` words has one
shingle of all its words.  Repeated rows are copies.  Links are between texts, so
a text that has only null ids is linked like any other; ``class_id`` is null only
where a whole class has no id.  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.llm.bloom import Bloom
from skiff.llm.common import dropped, kept, narrow, small_batches
from skiff.llm.components import components
from skiff.llm.textops import Texts, mix, slices

WORDS, THRESHOLD = 5, 0.8
#: Strings of ``DEPTH`` 16-bit minhashes fill a 64-bit number.
TREES, DEPTH, RECALL = 20, 4, 0.999999
LEAST_AGREEMENT = 0.5
#: Texts of a block; a trie node or band of n texts has n / BLOCK blocks, each pair of them a task's group.
BLOCK = 512
#: Groups up to this size are compared by shifting rows instead of by matrix.
SMALL = 8
_SEEDS = np.random.default_rng(17).integers(1, 2**63, (2, TREES * DEPTH), dtype=np.int64).astype(np.uint64)
_A, _B = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from ``depth``, at which a pair of this
    similarity meets in one of the trees with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity of ``threshold`` or more that a set of ``n`` can have with a
    different set; above 1 if there is none."""
    least = 2.0
    for m in range(max(1, math.ceil(threshold * n - 1e-9)), math.floor(n / threshold + 1e-9) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if both <= min(n, m) and both < max(n, m):
            least = min(least, both / (n + m - both))
    return least


def needs(threshold: float, recall: float = RECALL, sizes: int = 64) -> np.ndarray:
    """Prefix that texts of 0, 1, ... shingles need; the last entry is that of all larger ones.
    ``DEPTH + 1``, which no two texts share, where no other text is at the threshold."""
    of = [DEPTH + 1 if s > 1 else prefix_length(s, recall=recall) for s in (least_similarity(n, threshold) for n in range(1, sizes))]
    return np.array([DEPTH + 1, *of, prefix_length(threshold, recall=recall)])


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's first one (with the end)."""
    x = Texts(texts, "unicode")
    value, doc = x.shingles(x.hashes(), words)
    return value, np.searchsorted(doc, np.arange(x.n + 1))


def set_keys(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """128-bit keys of the sets: two sums of their mixed hashes."""
    key = np.stack([_sums(mix(value + np.uint64(s)), first) for s in (1, 2)], axis=1)
    return pa.array([r.tobytes() for r in key], pa.binary())


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def signatures(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(id, key, size, sig): the set's key, its number of shingles and its minhashes (little-endian unsigned 16-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, first = shingle_sets(part.column("text"), words)
                has = np.flatnonzero(np.diff(first))
                sig = np.zeros((part.num_rows, TREES * DEPTH), np.uint16)
                if len(has):
                    for j in range(TREES * DEPTH):
                        least = np.minimum.reduceat(((value * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), first[has])
                        sig[has, j] = least & np.uint32(0xFFFF)
                raw = pa.array([r.tobytes() if n else b"" for r, n in zip(sig, np.diff(first))], pa.binary())
                yield pa.record_batch([part.column("id"), set_keys(value, first), pa.array(np.diff(first).astype(np.int32)), raw], names=["id", "key", "size", "sig"])

    rows = narrow(docs, id_column, text_column).toDF("id", "text").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, size int, sig binary")


def strings(sig: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures as a matrix, and per tree the string as one number, first minhash highest: sorted by it, texts lie as in the trie."""
    all_of = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(len(sig), TREES * DEPTH)
    leaf = np.zeros((len(sig), TREES), np.uint64)
    for j in range(DEPTH):
        leaf = leaf << np.uint64(16) | all_of[:, j::DEPTH]
    return all_of, leaf


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading minhashes two strings share."""
    differ = a ^ b
    return sum((differ >> np.uint64(16 * (DEPTH - k)) == 0).astype(np.int8) for k in range(1, DEPTH + 1))


def _nodes(leaf: np.ndarray, shortest: int) -> np.ndarray:
    """A number for each tree's node at the ``shortest`` prefix."""
    prefix = leaf >> np.uint64(16 * (DEPTH - shortest))
    return mix(prefix * np.uint64(2 * TREES + 1) + np.arange(TREES, dtype=np.uint64)).view(np.int64)


def met_texts(reps: DataFrame, shortest: int) -> DataFrame:
    """(node, n, leaf, key, size, sig) of the representatives below trie nodes of ``n`` > 1 texts."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([_nodes(strings(batch.column("sig"))[1], shortest).ravel()], names=["node"])

    shared = kept(reps.select("sig").mapInArrow(nodes, "node long").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "nodes")
    bloom = Bloom(shared, "node")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = strings(batch.column("sig"))[1]
            node = _nodes(leaf, shortest).ravel()
            at = np.flatnonzero(bloom.has(node))
            own = batch.take(pa.array(at // TREES))
            yield pa.record_batch([pa.array(node[at]), pa.array(leaf.ravel().view(np.int64)[at]), *own.columns], names=["node", "leaf", "key", "size", "sig"])

    wanted = reps.select("key", "size", "sig").mapInArrow(below, "node long, leaf long, key binary, size int, sig binary")
    # a node of one block needs no count: what the filter lets through alone in its node meets nobody
    return wanted.join(shared.filter(F.col("n") > BLOCK), "node", "left").withColumn("n", F.coalesce("n", F.lit(1)))


def in_blocks(rows: DataFrame, size: str) -> DataFrame:
    """Rows of a group of ``size`` texts copied to every pair (low, high) of blocks that has their own."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("block", "other").cast("int"), "high": F.greatest("block", "other").cast("int")}).drop("blocks", "other")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 32 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups from rows sorted by ``columns``, with the first row of each group (and the end)."""
    wait: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in columns:
            a = rows.column(c)
            new[1:] |= np.asarray(pc.not_equal(a[1:], a[:-1]))
        return rows, np.flatnonzero(new)

    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        wait.append(b)
        held += b.nbytes
        if held >= most or len(wait) >= 64:
            rows, first = joined()
            if len(first) > 1:
                yield rows.slice(0, first[-1]), first
                rows = rows.slice(first[-1])
            wait, held = [rows], rows.nbytes if len(first) > 1 else 0
    if wait:
        rows, first = joined()
        yield rows, np.append(first, rows.num_rows)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each node's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agreeing(need: np.ndarray):
    """Spanning edges of matched texts whose signatures agree enough, node by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _groups(batches, ["node", "low", "high"]):
            key = rows.column("key").to_numpy(zero_copy_only=False)
            sig = strings(rows.column("sig"))[0]
            leaf = rows.column("leaf").to_numpy().view(np.uint64)
            depth = need[np.minimum(rows.column("size").to_numpy(), len(need) - 1)]
            group = np.repeat(np.arange(len(first) - 1), np.diff(first))
            size = np.diff(first)[group]
            a, b = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero((group[d:] == group[:-d]) & (size[d:] <= SMALL))
                i = i[common_prefix(leaf[i], leaf[i + d]) >= np.maximum(depth[i], depth[i + d])]
                i = i[(sig[i] == sig[i + d]).mean(axis=1) >= LEAST_AGREEMENT]
                a.append(i)
                b.append(i + d)
            for g in np.flatnonzero(np.diff(first) > SMALL):
                at = slice(first[g], first[g + 1])
                own = sig[at]
                same = np.zeros((len(own), len(own)), np.uint8)
                for j in range(own.shape[1]):
                    same += own[:, j, None] == own[None, :, j]
                matched = common_prefix(leaf[at, None], leaf[None, at]) >= np.maximum(depth[at, None], depth[None, at])
                root = _roots(matched & (same >= LEAST_AGREEMENT * own.shape[1]))
                linked = np.flatnonzero(root != np.arange(len(own)))
                a.append(first[g] + linked)
                b.append(first[g] + root[linked])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.record_batch([pa.array(key[a], pa.binary()), pa.array(key[b], pa.binary())], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that two sets or more share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    own = count[shingle] > 1
    owner, shingle = owner[own], shared[shingle[own]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    width = 8192
    for lo in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, width):
        a, b = np.searchsorted(shingle, [lo, lo + width])
        m = np.zeros((n, min(width, int(shingle[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], shingle[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _groups(batches, ["root", "band", "low", "high"]):
            keys, roots, links = [], [], []
            for lo, hi in zip(first[:-1], first[1:]):
                part = rows.slice(lo, hi - lo)
                names = part.column("key")
                if hi - lo > 1:  # repeated rows of a representative's id come next to each other
                    part = part.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(names[1:], names[:-1])]))
                key, block = part.column("key").to_pylist(), part.column("block").to_numpy()
                guest = part.column("guest").to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()]
                size = np.array([len(s) for s in sets], np.float64)
                both = overlaps(sets).astype(np.float64)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                linked &= ~(guest[:, None] & guest[None, :])  # pairs of guests are counted in their own band
                if part.column("low")[0].as_py() != part.column("high")[0].as_py():
                    linked &= block[:, None] != block[None, :]  # pairs of one block are counted in its own group
                root = _roots(linked)
                keys += key
                roots += [key[r] for r in root]
                links += linked.sum(axis=1).tolist()
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())], names=["key", "root", "links"])

    return run


def _sets(rows: DataFrame, words: int, bloom: Bloom) -> DataFrame:
    """(key, set) of the texts of rows (hash, text) whose hash may be among ``bloom``'s keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(bloom.has(batch.column("hash").to_numpy()))), "text"):
                value, first = shingle_sets(part.column("text"), words)
                own = pa.array([value[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
                yield pa.record_batch([set_keys(value, first), own], names=["key", "set"])

    return rows.mapInArrow(run, "key binary, set binary")


def places(candidates: DataFrame, threshold: float) -> DataFrame:
    """(key, root, band, guest, n) from (key, size, root): where a candidate is compared.
    A component of up to ``BLOCK`` texts is one band.  In larger ones a band holds the texts
    whose sizes are within ``threshold`` of each other and, as guests, those of the band below."""
    large = candidates.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    rows = candidates.join(large, "root", "left")
    band = F.when(F.col("m").isNull(), 0).otherwise(F.floor(F.log("size") / (-math.log(threshold) * 1.000001))).cast("int")
    rows = rows.withColumn("own", band).withColumn("band", F.explode(F.when(F.col("m").isNull(), F.array("own")).otherwise(F.array("own", F.col("own") + 1))))
    rows = rows.select("key", "root", "band", (F.col("band") != F.col("own")).alias("guest"), F.col("m").isNotNull().alias("wide"))
    sized = rows.filter("wide").groupBy("root", "band").agg(F.count("*").alias("n"))
    return rows.join(sized, ["root", "band"], "left").select("key", "root", "band", "guest", F.coalesce("n", F.lit(1)).alias("n"))


def _id_hash(column: str) -> Column:
    return F.coalesce(F.xxhash64(column), F.lit(0))


def _classes(docs: DataFrame, threshold: float, words: int, recall: float, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """The documents' keys, and per key: least id (null if all are), n_copies, root of its class, links."""
    need = needs(threshold, recall)
    signed = kept(signatures(docs, words, id_column, text_column), "signatures")
    able = signed.filter(F.col("size") > int(np.flatnonzero(need <= DEPTH)[0]) - 1)
    reps = able.groupBy("key").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.any_value("sig").alias("sig"))
    reps = kept(reps, "representatives")
    met = in_blocks(met_texts(reps, int(need.min())), "n").select("node", "low", "high", "leaf", "key", "size", "sig")
    near = met.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "leaf", "key")
    candidates = components(near.mapInArrow(_agreeing(need), "a binary, b binary")).withColumnRenamed("node", "key")
    candidates = kept(candidates.join(reps.select("key", "id", "size"), "key"), "candidates")
    dropped(reps)
    bloom = Bloom(candidates.select(_id_hash("id").alias("hash")))
    texts = narrow(docs, id_column, text_column).toDF("id", "text").select(_id_hash("id").alias("hash"), "text")
    own = _sets(texts, words, bloom).join(places(candidates, threshold), "key")
    blocks = in_blocks(own, "n").select("root", "band", "low", "high", "block", "guest", "key", "set")
    checked = blocks.repartition("root", "band", "low", "high").sortWithinPartitions("root", "band", "low", "high", "key").mapInArrow(_verified(threshold), "key binary, root binary, links long")
    checked = kept(checked, "verified")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(checked.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))).toDF("key", "root")
    sets = signed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")).join(classes, "key", "left").join(links, "key", "left")
    return signed.select("id", "key"), sets.withColumn("root", F.coalesce("root", "key"))


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, class_id, n_links, n_copies."""
    signed, sets = _classes(docs, threshold, words, recall, id_column, text_column)
    named = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    by_key = sets.join(named, "root").select("key", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.join(by_key, "key").select(F.col("id").alias(id_column), "class_id", "n_links", "n_copies")


def _with_keys(rows: DataFrame, hash: Column, words: int, bloom: Bloom) -> DataFrame:
    """Those of the rows, which have a column ``text``, whose ``hash`` may be among ``bloom``'s keys, with the ``key`` of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(bloom.has(batch.column(batch.num_columns - 1).to_numpy())))
            for part in slices(own.select(range(own.num_columns - 1)), "text"):
                yield part.append_column("key", set_keys(*shingle_sets(pc.fill_null(part.column("text"), ""), words)))

    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])
    return small_batches(rows).withColumn("hash", hash).mapInArrow(run, schema)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document, all its columns, of each class: that of least id (nulls last) and, of
    this id's texts, least key; among repeated rows of both, that of least columns."""
    signed, sets = _classes(docs, threshold, words, recall, id_column, text_column)
    least = sets.groupBy("root").agg(F.min(F.struct(F.isnull("least").alias("none"), F.col("least"), F.col("key"))).alias("first"), F.sum("n_copies").alias("rows"))
    first = sets.select("key", "root").join(least.filter("rows > 1"), "root").select("key", F.col("first.least").alias("first_id"), F.col("first.key").alias("first_key"))
    rows = signed.groupBy("id", "key").agg(F.count("*").alias("n")).join(first, "key")
    rows = rows.select(F.col("id").alias("of_id"), F.col("key").alias("of_key"), "n", (F.col("key").eqNullSafe(F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id"))).alias("stays"))
    rows = kept(rows.filter("not stays or n > 1"), "class-rows")
    c = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    named = docs.toDF(*c.values()).withColumn("text", F.col(c[text_column])).drop(c[text_column])
    # only rows whose id is among those need their key again
    gone = Bloom(rows.select(_id_hash("of_id").alias("hash")))
    others = named.filter(~gone.maybe(_id_hash(c[id_column])))
    keyed = _with_keys(named, _id_hash(c[id_column]), words, gone)
    same = F.col(c[id_column]).eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    out = others.unionByName(keyed.join(rows, same, "left_anti").drop("key"))
    repeated = rows.filter("stays")
    if not repeated.isEmpty():
        order = [f.name for f in keyed.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        row = F.struct(*named.columns)
        again = keyed.join(repeated, same, "left_semi").groupBy(c[id_column], "key").agg(F.min_by(row, F.struct(*order)).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out.select(*[F.col("text" if name == text_column else c[name]).alias(name) for name in docs.columns])
