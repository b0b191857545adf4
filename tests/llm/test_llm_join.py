"""Jaccard join, components, WARC archives, the pipeline and the registered queries."""

import collections
import gzip
import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skiff.llm import jaccard_join, warc
from skiff.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows):
    """(class, links, copies) per row, from all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = list(dict.fromkeys(sets))
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = collections.Counter()
    for a, b in itertools.combinations([s for s in distinct if s], 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        least[root(s)] = min(i, least.get(root(s), i))
    copies = collections.Counter(sets)
    return collections.Counter((i, least[root(s)], links[s], copies[s]) for (i, _), s in zip(rows, sets))


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # many blocks in a group of a few hundred
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(150):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 40 + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(100)]
    texts += [None, "", " \n", "one two", "ONE  two", "one two three four five", "x" * 100_000, " ".join(base * 30)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[200])]  # an id of two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "root": F.lit("r")}).repartition(7)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_join.join_similar(df).collect())
    assert got == brute_force(rows)
    assert jaccard_join.join_similar(df.limit(0)).count() == 0
    plain = df.filter("doc_id > 3")
    kept = jaccard_join.one_of_each(plain)
    assert kept.columns == plain.columns
    assert {r.doc_id for r in kept.collect()} == {c for i, c, _, _ in brute_force([r for r in rows if r[0] > 3])}


def test_one_of_each_with_repeated_rows_and_nulls(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    long = lambda: " ".join(word() for _ in range(80))
    a, b, c, d, e, f = (long() for _ in range(6))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (1, a), (2, near), (2, b), (None, c), (None, c), (None, d), (4, d), (None, a), (5, e), (6, e), (6, e), (7, f), (8, None), (8, None), (None, "")]
    df = spark.createDataFrame([(i, t, {"k": n}, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra map<string, int>, key int").repartition(5)
    kept = jaccard_join.one_of_each(df)
    assert kept.schema == df.schema
    got = kept.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(1, a), (2, b), (None, c), (4, d), (5, e), (7, f), (8, None)])
    assert all(r.extra == {"k": r.key} and rows[r.key] == (r.doc_id, r.text) for r in got)
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_join_equals_all_pairs_with_null_ids_and_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # bands of sizes, each of several blocks
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(260)]
    texts = [" ".join(base[:n]) for n in range(40, 260, 2) for _ in range(1 + n % 3)]
    texts += [" ".join(base[:n] + [word()]) for n in range(4, 60)]  # sizes from one shingle on
    texts += [" ".join(base[9:n]) for n in range(10, 40)]
    rng.shuffle(texts)
    rows = [(i if rng.random() < 0.5 else None, t) for i, t in enumerate(texts)]
    got = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    named = [(i, t) for i, (_, t) in enumerate(rows)]
    want = {i: (c, n, k) for i, c, n, k in brute_force(named)}
    ids = collections.defaultdict(list)  # of a class, by the brute force's own number for it
    for (real, _), (i, _) in zip(rows, named):
        if real is not None:
            ids[want[i][0]].append(real)
    expected = collections.Counter((real, min(ids[want[i][0]], default=None), *want[i][1:]) for (real, _), (i, _) in zip(rows, named))
    assert collections.Counter(tuple(r) for r in got) == expected


def test_a_text_of_a_null_id_is_linked_to_its_near_copy(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:-1], "other"])
    df = spark.createDataFrame([(1, " ".join(words)), (None, near), (7, "something else")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.join_similar(df).collect()} == {(1, 1, 1, 1), (None, 1, 1, 1), (7, 7, 0, 1)}
    assert {r.doc_id for r in jaccard_join.one_of_each(df).collect()} == {1, 7}


def test_a_chain_of_texts_is_one_class_of_few_links(spark):
    n = 5000
    words = [f"w{i}" for i in range(3 * n + 60)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(n)]  # 53 of 59 shingles with the next, 50 of 62 with the one after
    got = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, 0, min(i, 2) + min(n - 1 - i, 2)) for i in range(n)}


def test_needed_prefixes_follow_the_sizes():
    def plain(n):
        of = [(b / (n + m - b)) for m in range(1, 3 * n + 3) for b in range(0, min(n, m) + 1) if 5 * b >= 4 * (n + m - b) and not (b == n == m)]
        return min(of, default=2.0)

    for n in range(1, 40):
        assert jaccard_join.least_similarity(n, 0.8) == pytest.approx(plain(n))
    need = jaccard_join.needs(0.8)
    assert (need[:4] == jaccard_join.DEPTH + 1).all() and need[7] == 4 and need[4] == need[-1] == jaccard_join.prefix_length(0.8)


def test_recall_sets_the_prefix():
    assert jaccard_join.prefix_length(0.8, recall=0.5) == jaccard_join.DEPTH
    k = jaccard_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.RECALL


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(500, x) for x in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(root(x) == root(y) for y in parent if y != x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip_and_pushdown(spark, tmpdir_path):
    broken = "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "u\r\nx", "a" * 1000), (1, "u", "a" * 1000), (2, None, None), (None, "u", "a" * 1000), (3, "u", broken), (4, "v", "é" * 600), (5, "v", "é" * 600), (6, "w", "b" * 999), (7, "w", "b" * 999), (8, "w", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = tmpdir_path + "/w"
    warc.write_warc(pages, path, max_records=3)
    records = warc.read_warc(spark, path)
    got = {(warc_id(r.record_id), r.record_type, warc_id(r.refers_to), None if r.payload is None else bytes(r.payload).decode()) for r in records.collect()}
    assert got == {(1, "response", None, "a" * 1000), (2, "response", None, ""), (None, "revisit", 1, None), (3, "response", None, broken), (4, "revisit", 5, None), (5, "response", None, "é" * 600), (6, "response", None, "b" * 999), (7, "response", None, "b" * 999), (8, "response", None, "long " * 400_000)}
    assert records.count() == len(rows)
    wanted = records.filter("record_type = 'revisit' and refers_to is not null and content_length > 1")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[1].split("BatchScan")[0] and wanted.count() == 2  # the reader took the header predicates
    assert records.filter("record_id in ('<urn:page:6>', '<urn:page:7>')").count() == 2
    assert all(r.payload is None for r in warc.read_warc(spark, path, payload_types="resource").collect())
    os.makedirs(tmpdir_path + "/gz")
    for f in os.listdir(path):
        if f.startswith("part-"):
            with open(f"{path}/{f}", "rb") as a, gzip.open(f"{tmpdir_path}/gz/{f}.gz", "wb") as b:
                b.write(a.read())
    assert warc.read_warc(spark, tmpdir_path + "/gz", split_bytes="1000").filter("record_type = 'response'").count() == 8
    os.makedirs(tmpdir_path + "/none")
    assert warc.read_warc(spark, tmpdir_path + "/none").count() == 0


def warc_id(record_id):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def test_reader_seeks_over_refused_records(tmp_path):
    import io

    reader = warc.WarcReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == []
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 9\r\n\r\n123456789\r\n\r\n" % t for t in (b"request", b"response", b"metadata"))

    class Watched(io.BytesIO):
        got = 0

        def read(self, n=-1):
            Watched.got += n
            return super().read(n)

    rows = list(reader.records(Watched(raw), "f"))
    assert len(rows) == 1 and Watched.got == 9


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_queries_match_their_sql(spark):
    from skiff.llm.queries import ORACLE, QUERIES
    from tools.check_oracle import _digest

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert _digest(df.columns, rows)[0] == _digest(names, cur.fetchall())[0], name


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, before = start, {r.doc_id: r for r in start.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), "stage")
        assert docs.columns == start.columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "n-gram Jaccard join":
            least = {i: c for i, c, _, _ in brute_force([(i, r.text) for i, r in before.items()])}
            assert set(after) == {i for i, c in least.items() if i == c}
        if name == "secret scans":
            assert set(after) == set(before) and not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in after.values())
        else:
            assert all(before[i] == r for i, r in after.items())
        seen.append(len(after))
        before = after
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < start.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed}
