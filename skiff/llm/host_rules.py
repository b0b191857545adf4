"""Host-level quality rules.

Each text is measured once in bounded slices; the figures (one narrow row per
document) are written to the shared folder.  Failures of each rule are counted
per host, every host's rate is shrunk with a beta prior fitted to all hosts by
moments (rates of hosts with few documents move towards the common rate), and a
host is refused when a shrunk rate passes ``host_limit``.  Host verdicts join
back to the documents; a document is kept if it passes the base rules and its
host isn't refused.

Defined cases: null and empty texts have no words and fail the base rules; a
null host counts as the host ""; repeated rows are measured and counted each;
an empty table gives an empty result; columns other than the three named ones
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import kept, narrow
from skiff.llm.textops import Texts, mix, repeated, slices, spans_hash

#: The contract's symbol characters.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Failing conditions over the measured columns; the first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: A prior's weight in documents lies between these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def measure(x: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each text."""
    h = x.hashes()
    salt = mix(np.arange(1, x.n + 1))
    start, end, doc = x.lines()
    worded = np.searchsorted(x.start, end) > np.searchsorted(x.start, start)
    key = spans_hash(x.b, start, end)[worded] + salt[doc[worded]]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup = np.bincount(doc[worded][again], minlength=x.n)
    windows, inside = x.windows(h, 3)
    at = np.flatnonzero(inside)
    cover = np.zeros(len(h), bool)
    hit = at[repeated(windows[at] + salt[x.doc[at]])]
    for j in range(3):
        cover[hit + j] = True
    return {
        "n_words": x.n_words,
        "word_chars": x.per_text(x.word & ((x.b & 0xC0) != 0x80)),
        "n_symbols": x.per_text(SYMBOLS[x.b]),
        "n_lines": np.bincount(doc[worded], minlength=x.n),
        "n_dup_lines": dup,
        "n_repeat_words": x.per_words(cover),
    }


FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_figures(docs: DataFrame, id_column: str, host_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(Texts(part.column("text")))
                yield pa.record_batch([part.column("id"), part.column("host"), *(pa.array(m[c].astype(np.int64)) for c in FIGURES)], names=["id", "host", *FIGURES])

    rows = narrow(docs, id_column, host_column, text_column).toDF("id", "host", "text")
    rows = rows.withColumn("host", F.coalesce(F.col("host").cast("string"), F.lit("")))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in FIGURES))


def host_rates(figures: DataFrame) -> DataFrame:
    """Per host: documents, and per rule the failures and the shrunk failure rate."""
    fails = [F.sum(F.expr(f"int({cond})").cast("long")).alias(f"f_{r}") for r, cond in RULES.items()]
    hosts = figures.groupBy("host").agg(F.count("*").alias("n"), *fails)
    # the prior is one row of sums over all hosts; with rates r of n documents about their mean m
    sums = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"f_{r}").alias(f"s_{r}") for r in RULES), *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES)).first()
    out = hosts
    for r in RULES:
        n = sums["n"] or 0
        m = sums[f"s_{r}"] / n if n else 0.0
        v = sums[f"q_{r}"] / n - m * m if n else 0.0
        weight = min(max(m * (1 - m) / v - 1, LEAST_WEIGHT), MOST_WEIGHT) if v > 1e-12 else MOST_WEIGHT
        out = out.withColumn(f"r_{r}", (F.col(f"f_{r}") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))
    return out


def judge(docs: DataFrame, host_limit: float = 0.8, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """Per row: id, host, the figures, ``base_failed``, ``host_refused`` and ``kept``."""
    figures = kept(text_figures(docs, id_column, host_column, text_column), "host-figures")
    refused = host_rates(figures).filter(F.greatest(*(F.col(f"r_{r}") for r in RULES)) > host_limit).select("host", F.lit(True).alias("refused"))
    base = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    out = figures.join(refused, "host", "left").withColumns({"base_failed": base, "host_refused": F.coalesce("refused", F.lit(False))})
    return out.select(F.col("id").alias(id_column), F.col("host").alias(host_column), *FIGURES, "base_failed", "host_refused", (~F.col("base_failed") & ~F.col("host_refused")).alias("kept"))


def oracle_sql(host_limit: float = 0.8) -> str:
    rates = ", ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r}) AS r_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
f AS (SELECT w.k, doc_id, host, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.k = w.k),
h AS (SELECT host, count(*)::DOUBLE AS n, {", ".join(f"sum(({c})::INT)::DOUBLE AS f_{r}" for r, c in RULES.items())} FROM f GROUP BY host),
mv AS (SELECT {", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum(f_{r} * f_{r} / n) / sum(n) - (sum(f_{r}) / sum(n)) * (sum(f_{r}) / sum(n)) AS v_{r}" for r in RULES)} FROM h),
p AS (SELECT *, {", ".join(f"CASE WHEN v_{r} > 1e-12 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) ELSE {MOST_WEIGHT} END AS w_{r}" for r in RULES)} FROM mv),
bad AS (SELECT host FROM (SELECT host, {rates} FROM h, p) WHERE greatest({", ".join(f"r_{r}" for r in RULES)}) > {host_limit})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""
