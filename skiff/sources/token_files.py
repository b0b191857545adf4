"""SNK-03 / CP-06 / SRC-17: packed token files, as a Python data source.

A split is a stream of uint16 ids cut into chunks (``corpus.pack``) and a chunk into
pieces of about ``piece_tokens`` tokens: a document belongs to the piece it begins in,
so a piece is bounded by ``piece_tokens`` and one document. A piece is one file of bare
little-endian ids, named by what it holds::

    <path>/<split>/<chunk>/<chunk>-<piece>-<offset>-<tokens>-<crc32>.bin

(a folder per chunk, so that listings are of one chunk's pieces; files that lie in the
split's folder itself are pieces too).

Writing (``df.write.format("token_files")``) takes rows ``split, chunk_id, piece,
tok_offset, ids``, pieces whole and in order within a partition (``corpus.write_pieces``
sees to that). A file is put once, whole, under a name that depends on its content
alone: a task that is run again puts the same file, an aborted job leaves pieces that
are right, and a torn file is known by its size. Ids outside uint16, null ids and gaps
between documents fail the job.

Reading (``spark.read.format("token_files")``, option ``split`` for one of them) gives
``split, chunk_id, piece, start, ids``: blocks of ``block`` tokens (1,024) with their
place in the split; a piece's last block may be shorter. Tasks get ranges of
``range_bytes`` (64 MB) of a file, or stretches of small files; where a range is the whole
file its checksum is verified. A stretch is a folder with its first and last name, which
its task lists again: neither planning, a folder at a time, nor the plan grows with the
number of small files. Files of half a token, of another size than named, or with another name
(``train.bin``: chunk and piece 0 of split ``train``, from 0) are told apart when the
scan is planned: the first two fail, the last are read as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skiff.sources.tail import _store

SCHEMA = "split string, chunk_id int, piece int, start long, ids array<int>"
PIECE_TOKENS = 32 << 20
_OPEN = 1 << 20  # what opening a file counts for, in bytes
MOST_TASKS = 1024  # that opening files alone makes of a scan
#: split folder, chunk folder, chunk, piece, offset, tokens, crc32
NAME = r"([^/]+)/(?:(\d{5})/(?=\2-))?(\d{5})-(\d{5})-(\d+)-(\d+)-([0-9a-f]{8})\.bin$"


def piece_name(split: str, chunk: int, piece: int, offset: int, tokens: int, crc: int) -> str:
    return f"{split}/{chunk:05d}/{chunk:05d}-{piece:05d}-{offset}-{tokens}-{crc:08x}.bin"


def piece_of(path: str) -> tuple[str, int, int, int, int, str] | None:
    """Split, chunk, piece, offset, tokens and checksum that a file's name says; None for other names."""
    m = re.search(NAME, path)
    return (m[1], int(m[3]), int(m[4]), int(m[5]), int(m[6]), m[7]) if m else None


def listed(store: pafs.FileSystem, top: str, depth: int | None = None) -> Iterator[tuple[list[str], list[pafs.FileInfo]]]:
    """Of ``top`` and the folders below it, one at a time: folders left out for being
    ``depth`` below, and ``.bin`` files by name."""
    to = [(top, 1)]
    while to:
        folder, level = to.pop()
        found = sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path, reverse=True)
        below = [f.path for f in found if f.type == pafs.FileType.Directory]
        files = [f for f in reversed(found) if f.type == pafs.FileType.File and f.path.endswith(".bin")]
        yield (below if level == depth else []), files
        to += [] if level == depth else [(path, level + 1) for path in below]


@dataclass
class Written(WriterCommitMessage):
    tokens: int


class _Piece:
    """The ids of one piece while its rows pass."""

    def __init__(self, key: tuple[str, int, int], offset: int):
        self.key, self.offset, self.end = key, offset, offset
        self.parts: list[bytes] = []
        self.crc = 0

    def add(self, offset: int, ids: np.ndarray) -> None:
        if offset != self.end:
            raise ValueError(f"piece {self.key}: a document at {offset}, the one before ends at {self.end}")
        raw = ids.astype("<u2").tobytes()
        self.parts.append(raw)
        self.crc = zlib.crc32(raw, self.crc)
        self.end += len(ids)

    def put(self, store: pafs.FileSystem, top: str) -> int:
        if self.end == self.offset:  # empty documents alone
            return 0
        name = piece_name(*self.key, self.offset, self.end - self.offset, self.crc)
        store.create_dir(f"{top}/{name.rsplit('/', 1)[0]}", recursive=True)
        with store.open_output_stream(f"{top}/{name}") as out:
            for raw in self.parts:
                out.write(raw)
        return self.end - self.offset


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        now: _Piece | None = None
        done: set[tuple[str, int, int]] = set()
        tokens = 0
        for batch in iterator:
            at = {name: batch.column(name).to_pylist() for name in ("split", "chunk_id", "piece", "tok_offset")}
            lists = batch.column("ids")
            ids = lists.flatten()
            if lists.null_count or ids.null_count:
                raise ValueError("null ids in a document")
            ids = ids.to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                raise ValueError(f"id outside uint16: {ids.min()} to {ids.max()}")
            ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
            for k, key in enumerate(zip(at["split"], at["chunk_id"], at["piece"])):
                if now is None or now.key != key:
                    if now is not None:
                        tokens += now.put(store, top)
                        done.add(now.key)
                    if key in done:
                        raise ValueError(f"piece {key} isn't in one stretch")
                    now = _Piece(key, at["tok_offset"][k])
                now.add(at["tok_offset"][k], ids[ends[k - 1] if k else 0 : ends[k]])
        if now is not None:
            tokens += now.put(store, top)
        return Written(tokens)

    def commit(self, messages: list) -> None:
        """Files are whole as soon as they are there; ``corpus.publish_pieces`` checks and names them."""

    def abort(self, messages: list) -> None:
        """Pieces that are there are right, and the next run needn't write them."""


@dataclass
class Range:
    """Bytes ``begin`` to ``end`` of a file; ``crc`` only where they are the whole file."""

    path: str
    split: str
    chunk: int
    piece: int
    offset: int
    begin: int
    end: int
    crc: int | None


@dataclass
class Stretch:
    """Files of a folder from name ``first`` to ``last``, each read whole: how many, and their bytes."""

    folder: str
    first: str
    last: str
    files: int
    size: int


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range | Stretch]):
        self.ranges = ranges


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.block = int(options.get("block", 1024))
        self.only = options.get("split")
        # a range is a whole number of blocks
        self.range = max(1, int(options.get("range_bytes", 64 << 20)) // (2 * self.block)) * 2 * self.block

    def partitions(self) -> list[Ranges]:
        parts = list(self._parts())
        opened = sum(r.files for r in parts if isinstance(r, Stretch))
        most = max(self.range + _OPEN, opened * _OPEN // MOST_TASKS)
        tasks, held = [], 0
        for r in parts:
            cost = r.size + r.files * _OPEN if isinstance(r, Stretch) else r.end - r.begin + _OPEN
            if not tasks or held + cost > most:
                tasks.append(Ranges([]))
                held = 0
            held += cost
            last = tasks[-1].ranges[-1] if tasks[-1].ranges else None
            if isinstance(r, Stretch) and isinstance(last, Stretch) and last.folder == r.folder:
                tasks[-1].ranges[-1] = Stretch(r.folder, last.first, r.last, last.files + r.files, last.size + r.size)
            else:
                tasks[-1].ranges.append(r)
        return tasks

    def _parts(self) -> Iterator[Range | Stretch]:
        """Stretches and ranges in order. A stretch is a quarter of a task's part at most, as far as
        that is known from the files before: their number grows with the logarithm of the files'."""
        store, top = _store(self.path)
        opened = 0
        for _, found in listed(store, top):
            now: Stretch | None = None
            for f in filter(self._asked, found):
                ranges, opened = self._ranges(f), opened + 1
                most = max(self.range // 4, opened * _OPEN // MOST_TASKS // 4) + _OPEN
                if now and (f.size > self.range or now.size + f.size + (now.files + 1) * _OPEN > most):
                    yield now
                    now = None
                if f.size > self.range:
                    yield from ranges
                elif now:
                    now.last, now.files, now.size = f.base_name, now.files + 1, now.size + f.size
                else:
                    now = Stretch(f.path.removesuffix(f"/{f.base_name}"), f.base_name, f.base_name, 1, f.size)
            if now:
                yield now

    def _asked(self, f: pafs.FileInfo) -> bool:
        return self.only is None or self.only == (named[0] if (named := piece_of(f.path)) else f.base_name.removesuffix(".bin"))

    def _ranges(self, f: pafs.FileInfo) -> list[Range]:
        """The ranges of a file; refuses what is no token file."""
        named = piece_of(f.path)
        if f.size % 2:
            raise ValueError(f"{f.path}: {f.size} bytes aren't whole uint16 tokens")
        if named and f.size != 2 * named[4]:
            raise ValueError(f"{f.path}: {f.size} bytes instead of {named[4]} tokens")
        split, chunk, piece, offset = named[:4] if named else (f.base_name.removesuffix(".bin"), 0, 0, 0)
        crc = int(named[5], 16) if named and f.size <= self.range else None
        return [Range(f.path, split, chunk, piece, offset, at, min(at + self.range, f.size), crc) for at in range(0, f.size, self.range)]

    def read(self, part: Ranges | None) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for r in part.ranges if part else []:  # None: no file at all
            for one in self._again(store, r) if isinstance(r, Stretch) else [r]:
                yield from self._blocks(store, one)

    def _again(self, store: pafs.FileSystem, part: Stretch) -> Iterator[Range]:
        """The files that were seen when the scan was planned."""
        _, files = next(listed(store, part.folder))
        files = [f for f in files if part.first <= f.base_name <= part.last and self._asked(f)]
        if (len(files), sum(f.size for f in files)) != (part.files, part.size):
            raise ValueError(f"{part.folder}: files from {part.first} to {part.last} have changed since the scan was planned")
        for f in files:
            yield from self._ranges(f)

    def _blocks(self, store: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        step = self.block * 2 * max(1, (4 << 20) // (self.block * 2))
        crc = 0
        with store.open_input_file(part.path) as raw:
            raw.seek(part.begin)
            for at in range(part.begin, part.end, step):
                data = raw.read(min(step, part.end - at))
                if part.crc is not None:
                    crc = zlib.crc32(data, crc)
                    if at + step >= part.end and crc != part.crc:
                        raise ValueError(f"{part.path}: checksum {crc:08x}")
                ids = np.frombuffer(data, "<u2").astype(np.int32)
                cuts = np.append(np.arange(0, len(ids), self.block), len(ids)).astype(np.int32)
                n = len(cuts) - 1
                start = part.offset + at // 2 + cuts[:-1].astype(np.int64)
                yield pa.record_batch(
                    [pa.array([part.split] * n, pa.string()), pa.array([part.chunk] * n, pa.int32()), pa.array([part.piece] * n, pa.int32()),
                     pa.array(start), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))],
                    names=["split", "chunk_id", "piece", "start", "ids"],
                )


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        if overwrite:
            raise ValueError("token_files only adds pieces: use append")
        return TokenWriter(self.options)
