"""Chat formatting by columnar byte assembly.

A conversation becomes one string: ``<s>``, then its turns in order, each a
header, the escaped text and a footer by role.  Per Arrow batch the lengths of
all segments, their cumulative offsets and the scatter positions are numpy
arrays; headers, texts and footers are copied into one preallocated buffer that
the output column uses as it is.  The loss mask is a list of byte spans, one per
assistant text.

Control strings inside roles and texts are escaped reversibly: a backslash goes
in after a control string's first character, and an already escaped one gets one
more, so unescaping takes exactly one away.  Headers and footers end and begin
with white space, which no control string contains; none can arise at a border.

Rows are dealt out by conversation and streamed in order of (turn, role, text):
a task holds the batch at hand and the conversation that is being assembled, as
every output value must hold its whole conversation.

Defined cases: null texts and roles are empty; null turns come first; equal
turns are ordered by role, then text, and repeated rows are all kept; a null
conversation id is one conversation; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import narrow

BEGIN = b"<s>"
#: Header and footer of a turn by role; other roles are named in theirs.
TURN = {"user": (b"[INST] ", b" [/INST]"), "assistant": (b" ", b" </s>"), "system": (b"<<SYS>>\n", b"\n<</SYS>>")}
OTHER = (b"[ROLE]", b"[/ROLE] ", b" [/TURN]")
_CONTROL = r"(<)(\\*)(s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])"
_ESCAPE = r"\1\4\\\2\5\3\6"
_ESCAPED = re.compile(r"(?:(<)\\(\\*)(s>|/s>|<SYS>>|</SYS>>)|(\[)\\(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\]))")
FLUSH_BYTES = 4 << 20


def escape(column: pa.Array) -> pa.Array:
    hit = pc.match_substring_regex(column, _CONTROL)
    if not pc.any(hit).as_py():
        return column
    return pc.replace_substring_regex(column, _CONTROL, _ESCAPE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "".join(g or "" for g in m.groups()), text) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's buffer and offsets."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy ``source[start:start+size]`` to ``out[to:]`` for all segments at once."""
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + at] = source[np.repeat(start, size) + at]


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Whole conversations (rows in order) to one row each: id, formatted, loss_start, loss_end (bytes)."""
    n = len(conv)
    same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], ~(same | (null[1:] & null[:-1]))])
    body, body_off = _bytes(escape(text))
    size = np.diff(body_off)
    coded = pc.dictionary_encode(role)
    heads, feet = [], []
    for r in coded.dictionary.to_pylist():
        own = escape(pa.array([r]))[0].as_py().encode()
        head, foot = TURN.get(r, (OTHER[0] + own + OTHER[1], OTHER[2]))
        heads.append(head)
        feet.append(foot)
    code = coded.indices.to_numpy()
    # one constant buffer: the opening, then every header and footer
    marks = np.frombuffer(BEGIN + b"".join(heads) + b"".join(feet), np.uint8)
    sizes = np.array([len(x) for x in heads + feet])
    starts = len(BEGIN) + np.cumsum(sizes) - sizes
    head_start, head_size = starts[code], sizes[code]
    foot_start, foot_size = starts[code + len(heads)], sizes[code + len(heads)]
    begin_size = np.where(first, len(BEGIN), 0)
    total = begin_size + head_size + size + foot_size
    end = np.cumsum(total)
    at = end - total
    out = np.empty(int(end[-1]), np.uint8)
    _scatter(out, at, marks, np.zeros(n, np.int64), begin_size)
    _scatter(out, at + begin_size, marks, head_start, head_size)
    _scatter(out, at + begin_size + head_size, body, body_off[:-1], size)
    _scatter(out, end - foot_size, marks, foot_start, foot_size)
    row = np.flatnonzero(first)
    offsets = np.concatenate([at[row], end[-1:]])
    formatted = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(out))
    spoken = np.isin(code, [i for i, r in enumerate(coded.dictionary.to_pylist()) if r == "assistant"])
    of = (np.cumsum(first) - 1)[spoken]
    lists = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(row)))]).astype(np.int32)
    begin = (at + begin_size + head_size)[spoken] - at[row][of]
    spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(v)) for v in (begin, begin + size[spoken])]
    return pa.record_batch([conv.take(pa.array(row)), formatted.cast(pa.string()) if len(out) < 2**31 else formatted, *spans], names=["id", "formatted", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_start`` and ``loss_end`` (byte spans of assistant texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            held += batch.nbytes
            if held < FLUSH_BYTES or _same(wait[0].column("id")[0], batch.column("id")[-1]):
                continue
            rows = pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
            ids = rows.column("id")
            last, cut = ids[-1], len(ids) - 1
            lo, hi = 0, cut  # ids are sorted: the last conversation begins at the first row equal to it
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if _same(ids[mid], last) else (mid + 1, hi)
            if lo:
                done = rows.slice(0, lo)
                yield assemble(done.column("id"), done.column("role"), done.column("text"))
            wait = [rows.slice(lo)]
            held = wait[0].nbytes
        if wait:
            rows = pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
            yield assemble(rows.column("id"), rows.column("role"), rows.column("text"))

    rows = narrow(turns, id_column, turn_column, role_column, text_column).toDF("id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce(F.col("role"), F.lit("")), "text": F.coalesce(F.col("text"), F.lit(""))})
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    out = rows.select("id", "role", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, formatted string, loss_start array<long>, loss_end array<long>")
    return out.withColumnRenamed("id", id_column)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn, read back from a formatted conversation."""
    at = len(BEGIN)
    while at < len(formatted):
        for role, (head, foot) in TURN.items():
            head, foot = head.decode(), foot.decode()
            if formatted.startswith(head, at):
                break
        else:
            begin = at + len(OTHER[0])
            at = formatted.index(OTHER[1].decode().strip(), begin)
            role, head, foot = unescape(formatted[begin:at]), OTHER[1].decode(), OTHER[2].decode()
        at += len(head)
        end = formatted.index(foot, at)
        yield role, unescape(formatted[at:end])
        at = end + len(foot)


def digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Figures read back from formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, turns, chars, loss, size = [], [], [], [], []
            for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_end"))):
                sha, count = hashlib.sha256(), 0
                for role, content in parse(text):
                    sha.update(f"{role}\n{content}\n".encode())
                    count += 1
                raw, under, own = text.encode(), hashlib.sha256(), 0
                for i, j in zip(starts, ends):
                    said = unescape(raw[i:j].decode())
                    under.update(said.encode())
                    own += len(said)
                n.append(count)
                turns.append(sha.hexdigest())
                chars.append(own)
                loss.append(under.hexdigest())
                size.append(len(text))
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.withColumnRenamed(id_column, "id")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_column)


def oracle_sql(extra: str) -> str:
    longer = lambda c: f"length(regexp_replace({c}, '{_CONTROL}', '\\0.', 'g'))"
    marks = {r: len(h) + len(f) for r, (h, f) in TURN.items()}
    cases = " ".join(f"WHEN '{r}' THEN {n}" for r, n in marks.items())
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {extra})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(BEGIN)} + sum({longer("text")} + CASE role {cases} ELSE {sum(map(len, OTHER))} + {longer("role")} END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
