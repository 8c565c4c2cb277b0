"""Growing log files as a stream: each whole line once, in order, through restarts, rotation and truncation.

Spark's file source reads a file once, when it first sees it. This source follows files that go on growing. Its offset
holds, per file, how many bytes have been handed on and checksums of the first and last of them, so a file is known by
what was read of it and not by its name: a renamed file is continued, a file written anew under an old name is a new
one. A line is handed on when its line break is there, never a half one. A batch's byte ranges are cut into pieces that
tasks read side by side.

The offset also holds the time of the poll, and each batch starts with a row that tells it. What a reader does after a
time of silence then depends on logged offsets only: a repeated batch sees the same clock.
"""

from __future__ import annotations

import fnmatch
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_logs"
SCHEMA = "file string, file_no bigint, position bigint, value string, clock bigint"
MARK = 256  # bytes at either end of what was read of a file that tell it from others
PIECE = 16 << 20
BLOCK = 1 << 16
BATCH_LINES = 10_000


@dataclass(frozen=True)
class Known:
    """A file: its number, last path, bytes handed on, and lengths and checksums of their first and last part."""

    no: int
    path: str
    offset: int = 0
    head_bytes: int = 0
    head: int = 0
    tail_bytes: int = 0
    tail: int = 0


class LostLines(RuntimeError):
    """A range that was promised to a batch is no longer in any file."""


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path on it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(fs: pafs.FileSystem, pattern: str) -> list[pafs.FileInfo]:
    """Files that match a glob pattern, or that are anywhere below a folder, by path. Names with . or _ in front are not logs.

    A star of a pattern stands for characters of one name, not for folders.
    """
    special = [pattern.find(c) for c in "*?[" if c in pattern]
    base = pattern[:min(special)].rpartition("/")[0] if special else pattern
    found = fs.get_file_info(pafs.FileSelector(base or "/", recursive=True, allow_not_found=True))
    files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
    if special:
        files = [f for f in files if f.path.count("/") == pattern.count("/") and fnmatch.fnmatchcase(f.path, pattern)]
    return sorted(files, key=lambda f: f.path)


def read_range(fs: pafs.FileSystem, path: str, start: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def is_same(fs: pafs.FileSystem, known: Known, path: str, size: int) -> bool:
    """Whether the file at ``path`` begins with what was read of ``known``."""
    if size < known.offset:
        return False
    if not known.offset:
        return path == known.path
    return (zlib.crc32(read_range(fs, path, 0, known.head_bytes)) == known.head
            and zlib.crc32(read_range(fs, path, known.offset - known.tail_bytes, known.tail_bytes)) == known.tail)


def last_break(fs: pafs.FileSystem, path: str, start: int, end: int) -> int:
    """The end of the last whole line in [start, end), or ``start``. Reads backwards, a block at a time."""
    while end > start:
        low = max(start, end - BLOCK)
        at = read_range(fs, path, low, end - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        end = low
    return start


def advanced(fs: pafs.FileSystem, known: Known, size: int) -> Known:
    """``known`` up to the last whole line of a file of ``size`` bytes."""
    end = last_break(fs, known.path, known.offset, size)
    if end == known.offset:
        return known
    n = min(MARK, end)
    return replace(known, offset=end, head_bytes=n, head=zlib.crc32(read_range(fs, known.path, 0, n)),
                   tail_bytes=n, tail=zlib.crc32(read_range(fs, known.path, end - n, n)))


def recognised(fs: pafs.FileSystem, known: list[Known], files: list[pafs.FileInfo]) -> list[tuple[Known, int]]:
    """Each of ``files`` with its size, as the known file it is or as a new one with the next number.

    A file is the one known under its path if it begins as that did, else any other known one that it continues, which
    was renamed. New files are numbered by path.
    """
    free = {k.no: k for k in known}
    by_path = {k.path: k for k in known}
    found: dict[str, Known] = {}
    for f in files:
        k = by_path.get(f.path)
        if k and is_same(fs, k, f.path, f.size):
            found[f.path] = free.pop(k.no)
    for f in files:
        if f.path not in found:
            renamed = next((k for k in free.values() if k.offset and is_same(fs, k, f.path, f.size)), None)
            if renamed:
                found[f.path] = replace(free.pop(renamed.no), path=f.path)
    following = max((k.no for k in known), default=-1) + 1
    for f in files:
        if f.path not in found:
            found[f.path] = Known(following, f.path)
            following += 1
    return [(found[f.path], f.size) for f in files]


class Piece(InputPartition):
    """Lines of a known file that start in [start, stop); the file's whole lines of this batch begin at ``first``."""

    def __init__(self, known: Known | None, first: int = 0, start: int = 0, stop: int = 0, clock: int | None = None):
        self.known, self.first, self.start, self.stop, self.clock = known, first, start, stop, clock


def piece_lines(fs: pafs.FileSystem, path: str, first: int, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in [start, stop) of whole lines in [first, end)."""
    with fs.open_input_file(path) as f:
        at = start
        if start > first:  # the line that reaches into this piece belongs to the one before
            at = start - 1
            f.seek(at)
            while at < stop:
                block = f.read(min(BLOCK, end - at))
                found = block.find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += len(block)
        f.seek(at)
        rest, place = b"", at
        while place < stop and (block := f.read(min(BLOCK, end - at))):
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if place < stop:
                    yield place, line
                place += len(line) + 1
        if place < stop:
            raise LostLines(f"{path} ends before its line at {place} does")


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.fs, self.pattern = file_system(options["path"])
        self.store = file_system(options["positions"])
        self.piece = int(options.get("piecebytes", PIECE))
        self.tick = int(float(options.get("tickseconds", "60")) * 1000)
        self.end: dict | None = None
        self.sizes: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": [], "clock": 0}

    def _kept(self) -> dict:
        """The last offset of an earlier run: Spark doesn't tell it when it asks for the newest one."""
        fs, folder = self.store
        info = fs.get_file_info(f"{folder}/offset.json")
        if info.type == pafs.FileType.NotFound:
            return self.initialOffset()
        with fs.open_input_file(info.path) as f:
            return json.loads(f.read())

    def _keep(self, offset: dict) -> None:
        fs, folder = self.store
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/offset.new") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{folder}/offset.new", f"{folder}/offset.json")

    def latestOffset(self) -> dict:
        if self.end is None:
            self.end = self._kept()
        known = [Known(**k) for k in self.end["files"]]
        files = listed(self.fs, self.pattern)
        sizes = {f.path: (f.size, f.mtime_ns or 0) for f in files}
        now = int(time.time() * 1000)
        moved = False
        if sizes != self.sizes:
            newer = [advanced(self.fs, k, size) for k, size in recognised(self.fs, known, files)]
            moved, known, self.sizes = newer != known, newer, sizes
        if moved or now - self.end["clock"] >= self.tick:
            self.end = {"files": [asdict(k) for k in known], "clock": max(now, self.end["clock"])}
            self._keep(self.end)
        return self.end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before = {k["no"]: k["offset"] for k in start["files"]}
        out = [Piece(None, clock=end["clock"])] if start != end else []
        for k in (Known(**k) for k in end["files"]):
            first = before.get(k.no, 0)
            out += [Piece(k, first, at, min(at + self.piece, k.offset)) for at in range(first, k.offset, self.piece)]
        return out

    def _path(self, known: Known) -> str:
        """Where the file is now: it may have been renamed since its range was promised."""
        info = self.fs.get_file_info(known.path)
        for f in [info] if info.type == pafs.FileType.File else []:
            if is_same(self.fs, known, f.path, f.size):
                return f.path
        for f in listed(self.fs, self.pattern):
            if is_same(self.fs, known, f.path, f.size):
                return f.path
        raise LostLines(f"{known.path} was removed or cut before its lines up to byte {known.offset} were read")

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        known = partition.known
        if known is None:
            yield _batch([(None, None, None, None, partition.clock)])
            return
        rows = []
        path = self._path(known)
        for place, line in piece_lines(self.fs, path, partition.first, partition.start, partition.stop, known.offset):
            rows.append((known.path, known.no, place, line.decode("utf-8", "replace"), None))
            if len(rows) == BATCH_LINES:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_FIELDS = [("file", pa.string()), ("file_no", pa.int64()), ("position", pa.int64()), ("value", pa.string()), ("clock", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)],
                                      [n for n, _ in _FIELDS])


class GrowingLogs(DataSource):
    """Options: ``path`` (folder or glob), ``positions`` (a folder for this stream alone), ``pieceBytes``, ``tickSeconds``.

    A batch runs when there are whole new lines, and at most every ``tickSeconds`` without any.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))
