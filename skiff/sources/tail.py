"""SRC-19: only the new bytes of growing logs, as a streaming Python data source.

``spark.readStream.format("log_tail").option("path", pattern)`` follows all files
that match a path or glob pattern, also files that are still written.  An offset is
a byte position per file, always just behind a line break: a line whose end isn't
written yet waits for the batch that sees its end, and a batch's rows are the bytes
between two offsets, so a restarted query reads every line exactly once.  Files are
cut into ranges of ``split_bytes`` (32 MB), read by one task each; a range holds the
lines that begin in it.

A file that has become shorter than its offset was replaced and is read from its
beginning; a file that is gone keeps its offset.  ``first`` (``earliest`` or
``latest``) says where a new query begins.  Bytes that aren't UTF-8 are replaced; a
carriage return before the line break belongs to the break; empty lines are rows.
Positions come from listing sizes and reading back from each grown file's end to its
last line break, in the driver; lines are read by the tasks only.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file_path string, position long, line string, written double"
_BLOCK = 1 << 16


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        head = path[: next((k for k, c in enumerate(path) if c in "*?["), len(path))].rsplit("/", 1)[0] or "/"
        store, top = pafs.FileSystem.from_uri(head)
        return store, top.rstrip("/") + path[len(head) :]
    return pafs.LocalFileSystem(), path


def _matching(store: pafs.FileSystem, pattern: str) -> list[pafs.FileInfo]:
    """Files that the pattern names, part by part, or that lie below a folder it names."""
    top = pattern[: next((k for k, c in enumerate(pattern) if c in "*?["), len(pattern))]
    if top != pattern:
        top = top.rsplit("/", 1)[0] or "/"
    info = store.get_file_info(top)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type == pafs.FileType.NotFound:
        return []
    want = pattern.strip("/").split("/")

    def named(path: str) -> bool:
        parts = path.strip("/").split("/")
        hidden = any(p.startswith(("_", ".")) for p in parts[len(top.strip("/").split("/")) :])
        return not hidden and len(parts) >= len(want) and all(fnmatch.fnmatchcase(p, w) for p, w in zip(parts, want)) and (len(parts) == len(want) or "*" not in want[-1])

    return [f for f in store.get_file_info(pafs.FileSelector(top, recursive=True)) if f.type == pafs.FileType.File and named(f.path)]


def line_end(raw, start: int, end: int) -> int:
    """The position behind the last line break of ``raw[start:end]``; ``start`` if there is none."""
    while end > start:
        at = max(start, end - _BLOCK)
        raw.seek(at)
        found = raw.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return start


def lines_of(raw, start: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in ``raw[start:end]``; ``first``: one begins at ``start``.
    Read block by block; the last of them may end behind ``end``."""
    at, rest = start, b""
    raw.seek(start if first else start - 1)
    skip = not first  # up to the break of the line that began before
    if skip:
        at -= 1
    while True:
        block = raw.read(1 << 20)
        if not block:
            return
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if skip:
                skip = False
            elif at < end:
                yield at, part.removesuffix(b"\r")
            at += len(part) + 1
            if at >= end:
                return


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool, written: float):
        self.path, self.start, self.end, self.first, self.written = path, start, end, first, written


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.store, self.pattern = _store(self.uri)
        self.split = int(options.get("split_bytes", 32 << 20))
        self.latest = options.get("first", "earliest") == "latest"
        self.known: dict[str, tuple[int, int, float]] = {}  # size, position behind the last line break, when written

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.latest else {}

    def latestOffset(self) -> dict:
        for f in _matching(self.store, self.pattern):
            size, end, _ = self.known.get(f.path, (0, 0, 0.0))
            if f.size != size:
                with self.store.open_input_file(f.path) as raw:
                    end = line_end(raw, end if f.size > size else 0, f.size)
                self.known[f.path] = f.size, end, f.mtime_ns / 1e9 if f.mtime_ns else 0.0
        return {path: [end, written] for path, (_, end, written) in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (stop, written) in sorted(end.items()):
            begin = start.get(path, [0])[0]
            begin = 0 if begin > stop else begin
            for at in range(begin, stop, self.split):
                out.append(Range(path, at, min(at + self.split, stop), at == begin, written))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            n = len(rows)
            text = [line.decode("utf-8", "replace") for _, line in rows]
            return pa.record_batch([pa.array([part.path] * n, pa.string()), pa.array([p for p, _ in rows], pa.int64()), pa.array(text, pa.string()), pa.array([part.written] * n, pa.float64())], names=["file_path", "position", "line", "written"])

        rows: list[tuple[int, bytes]] = []
        held = 0
        with self.store.open_input_file(part.path) as raw:
            for row in lines_of(raw, part.start, part.end, part.first):
                rows.append(row)
                held += len(row[1]) + 32
                if held >= 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def __getstate__(self) -> dict:  # a task opens the store anew
        return {k: v for k, v in self.__dict__.items() if k != "store"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.store = _store(self.uri)[0]


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
