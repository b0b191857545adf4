"""Recompression grammars and periodic runs against plain word-by-word comparison."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skiff.llm import periodic_runs
from skiff.llm.recompression import Grammar
from skiff.llm.textops import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, least=12):
    """(start, length, period) of all runs, from the agreeing stretches of every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 90))]
        if len(w) > 5 and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randint(1, 1 + len(w) // 3)
            w[a:] = [w[a + i % p] if a + i % p < len(w) else "z" for i in range(len(w) - a)]
        out.append(rng.choice([" ", "\n", " \t x "]).join(w))
    return out


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_extensions_equal_plain_comparison(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters, 300)
    text[100:220] = np.tile(text[100:107], 18)[:120]
    seq = np.concatenate([[letters], text, [letters + 1], text[50:200], [letters + 2]])
    g = Grammar(seq)
    assert g.height < 60
    i, j = (x.ravel() for x in np.meshgrid(np.arange(0, len(seq), 3), np.arange(1, len(seq), 7)))
    i, j = i[i != j], j[i != j]
    for step in (1, -1):
        for a, b, got in zip(i, j, g.extend(i, j, step)):
            n = 0
            while 0 <= min(a, b) + step * n and max(a, b) + step * n < len(seq) and seq[a + step * n] == seq[b + step * n]:
                n += 1
            assert n == got


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_plain_comparison(monkeypatch, least):
    monkeypatch.setattr(periodic_runs, "PLACES", 500)  # many pieces of the grid
    for seed in range(20):
        texts = some_texts(seed, 12)
        x = Texts(pa.array(texts))
        got = [[] for _ in texts]
        for d, s, n, p in zip(*(a.tolist() for a in periodic_runs.runs_of(periodic_runs.word_names(x), x.n_words, least))):
            got[d].append((s, n, p))
        assert got == [all_runs(WORD.findall(t), least) for t in texts]


def expected(doc_id, text):
    """The row of the registered query, straight from its definition."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(w)
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(collapsed(w, runs)))


def test_query_rows_equal_their_definition(spark):
    rng = random.Random(9)
    rows = list(enumerate(some_texts(4, 400)))
    rows += [(400 + i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(100, 400)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (None, "a b " * 20), (None, None), (903, "a b " * 20), (903, "a b " * 20), (903, "c " * 13)]
    rows += [(904, "w " * 4000 + "x " + "y z " * 3000)]
    df = spark.createDataFrame([(i, t, 5, ["q"], "x") for i, t in rows], "doc_id long, text string, n_words int, runs array<string>, id string").repartition(3)
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.rewritten(df)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_empty_table_and_own_columns(spark):
    none = spark.createDataFrame([], "name string, body string")
    assert periodic_runs.find_runs(none, id_column="name", text_column="body").collect() == []
    row = periodic_runs.find_runs(spark.createDataFrame([("n", "a a a b")], "name string, body string"), least=2, id_column="name", text_column="body").first()
    assert (row["name"], row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == ("n", 4, [(0, 3, 1)], "a b")


def test_words_of_one_hash_are_told_apart(monkeypatch):
    x = Texts(pa.array(["aa bb aa", "bb cc"]))
    monkeypatch.setattr(Texts, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert periodic_runs.word_names(x).tolist() == [0, 1, 0, 1, 2]


def test_a_long_text_of_one_word_takes_memory_in_proportion(spark):
    text = "again " * 200_000
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("runs", F.length("collapsed").alias("n")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 1)] and row["n"] == 5
