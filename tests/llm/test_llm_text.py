"""Word passes, token counts, host rules, packing and chat formatting against brute force."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from skiff.llm import chat, host_rules, packing, textops, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "  a", "a  ", "\n\n\t x", "<s></s><unk>", "<0x0A> a\n", "日本語 😀😀", "▁ a▁b", "\0a\0", "a\r\nb", "x" * 5000, " " * 300 + "x", "<|endoftext|> z", "!!'s 12'S"]


def texts_of(seed, n, alphabet=" ab.,é\n\t<>s/0▁日'\"!|#", most=60):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_lines_and_shingles():
    texts = texts_of(1, 400)
    x = textops.Texts(pa.array(["skip", *texts])[1:])  # a sliced column has an offset
    assert x.n_words.tolist() == [len(WORD.findall(t or "")) for t in texts]
    start, end, doc = x.lines()
    lines = [(int(d), x.b[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc)]
    assert lines == [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    h = x.hashes()
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    value, of = x.shingles(h, 3)
    want = []
    for t in texts:
        w = WORD.findall(t or "")
        want.append(len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0)
    assert np.bincount(of, minlength=len(texts)).tolist() == want
    cut = list(textops.slices(pa.record_batch({"text": texts}), "text", 100))
    assert pa.Table.from_batches(cut)["text"].to_pylist() == texts


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = texts_of(2, 300)
    rows = [(i, t, t) for i, t in enumerate(texts)] + [(None, "null id", "x"), (0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing extra column
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, file, limit=50).collect())
    want = sorted((i is not None, i or 0, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t, _ in rows)
    assert got == want
    assert token_counts.count_tokens(df.limit(0), file).count() == 0


def host_rows():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        host = rng.choice(["good", "bad", None, ""])
        words = [rng.choice(("lorem ipsum dolor # $x é" if host == "bad" else "lorem ipsum dolor sit é").split()) + (str(rng.randint(0, 999)) if host != "bad" else "") for _ in range(rng.choice([3, 60, 200, 300, 80]))]
        text = "".join(w + rng.choice([" ", "\n", " \n", "\t"]) for w in words)
        rows.append((i, rng.choice([text] * 9 + [None]), host))
    return rows + [(7, "a b c " * 30, "good"), (None, "x\n" * 80, "bad")]


def test_host_rules_equal_sql(spark):
    rows = host_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "'z' as host")
    got = host_rules.judge(df, host_limit=0.5)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    cur = con.execute(host_rules.oracle_sql(0.5))
    names = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert got.filter("host_refused and not base_failed").count() > 0 and got.filter("kept").count() > 0
    assert host_rules.judge(df.limit(0)).count() == 0


def test_rates_shrink_towards_the_mean(spark):
    rows = [(i, f"h{i % 40}", 10 if i % 40 < 20 and i % 3 else 90, 0, 0, 1, 0, 0) for i in range(4000)] + [(-1, "lone", 10, 0, 0, 1, 0, 0)]
    rates = {r.host: r for r in host_rules.host_rates(spark.createDataFrame(rows, "id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")).collect()}
    assert 0.3 < rates["lone"].r_short < 0.9 and abs(rates["h1"].r_short - 2 / 3) < 0.05


def test_ids_equal_the_library():
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts_of(5, 1500, "aBcé 's!<|1\n²µªÀŽ’…İ日"):
        want = ids.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids.text(t or ""), "<u4").tolist() == want, t


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_runs_equal_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        plan = packing.best_fit(collections.Counter(sizes), capacity)
        open_bins, bins = [], 0
        for s in sorted(sizes, reverse=True):  # one document at a time
            i = bisect.bisect_left(open_bins, s)
            if i == len(open_bins):
                bins, room = bins + 1, capacity
            else:
                room = open_bins.pop(i)
            bisect.insort(open_bins, room - s)
        assert plan.bins == bins
        if not sizes:
            continue
        length = np.array(sizes)
        seen = collections.Counter()
        rank = []
        for s in sizes:
            rank.append(seen[s])
            seen[s] += 1
        check_places(*plan.place(length, np.array(rank)), length, capacity)


def check_places(sequence, offset, length, capacity):
    by = collections.defaultdict(list)
    for s, o, n in zip(sequence, offset, length):
        by[s].append((o, n))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity


def test_packing_whole_texts(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    library = packing.WordIds(file).library
    texts = texts_of(6, 150, most=200) + ["word " * 700] * 3
    rows = [(i % 90, t, i) for i, t in enumerate(texts)]  # ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(5)
    got = packing.pack(df, file, capacity=256).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for j, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want[(i, j, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_places([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got], 256)
    assert packing.pack(df.limit(0), file).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(7)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\s>", "[\\/INST]", "<<SYS>>", "<</SYS>>", " ", "\n", "é😀", "[ROLE]", "[/TURN]", "s>", "INST]"]
    say = lambda: rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 5, 5]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", "tool", None, "[/ROLE] x", "assistant\n"]), say()) for _ in range(1500)]
    rows += [(9, k, "assistant", "long " * 3000) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as formatted", "1 as id")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = b"".join(x for _, _, r, x in turns if r == b"assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in turns)).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said.decode()), hashlib.sha256(said).hexdigest())
    one = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(one).first().formatted == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"
    assert chat.digests(chat.format_conversations(one.limit(0))).count() == 0
