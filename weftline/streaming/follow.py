"""Lines of files that grow, as a stream whose progress is a number of bytes for each file."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes at a file's beginning by which it is known again, of a range that a task reads, and of one read.
HEAD, RANGE, STEP = 256, 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Whole lines of a file that begin from begin on and before end."""

    path: str
    begin: int
    end: int


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _listed(uri: str) -> tuple[pa.fs.FileSystem, dict[str, int]]:
    """Files of a path: one, those of a folder, or those that a pattern in the last part matches; with their sizes."""
    fs, path = _opened(uri)
    info = fs.get_file_info(path)
    if info.type == pa.fs.FileType.File:
        return fs, {path: info.size}
    folder, pattern = (path, "*") if info.type == pa.fs.FileType.Directory else posixpath.split(path)
    found = fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
    return fs, {f.path: f.size for f in found if f.type == pa.fs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))}


def _head(f: pa.NativeFile, n: int) -> str:
    return hashlib.sha256(f.read_at(n, 0)).hexdigest()[:32]


def _whole(f: pa.NativeFile, size: int) -> int:
    """Where the last whole line ends, looking from the end."""
    at = size
    while at > 0:
        low = max(0, at - STEP)
        k = f.read_at(at - low, low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    return 0


def place(fs: pa.fs.FileSystem, path: str, size: int) -> dict:
    """How far a file can be read: whole lines only; and what it begins with, so that another file of its name is told."""
    with fs.open_input_file(path) as f:
        at = _whole(f, size)
        return {"at": at, "head": min(HEAD, at), "mark": _head(f, min(HEAD, at))}


class _Reader(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, files = _listed(self.uri)
        out = {}
        for path, size in sorted(files.items()):
            try:
                out[path] = place(fs, path, size)
            except FileNotFoundError:  # it has gone since it was listed
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fs, _ = _opened(self.uri)
        out = []
        for path, to in end.items():
            begin = self._begin(fs, path, start.get(path), to)
            while begin < to["at"]:
                stop = min(to["at"], begin + RANGE)
                out.append(Range(path, begin, stop))
                begin = stop
        return out

    def _begin(self, fs: pa.fs.FileSystem, path: str, was: dict | None, to: dict) -> int:
        """Where reading goes on: at the byte reached, or at the first of a file that is shorter now or begins otherwise."""
        if was is None or to["at"] < was["at"]:
            return 0
        try:
            with fs.open_input_file(path) as f:
                return was["at"] if _head(f, was["head"]) == was["mark"] else 0
        except FileNotFoundError:  # it has gone since its end was noted
            return to["at"]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.uri)
        with fs.open_input_file(partition.path) as f:
            at, rest = partition.begin, b""
            if at and f.read_at(1, at - 1) != b"\n":  # the line that another range began ends here
                at = self._next(f, at)
            places: list[int] = []
            lines: list[bytes] = []
            where = at
            while at < partition.end or rest:
                more = f.read_at(STEP, where)
                where += len(more)
                *whole, rest = (rest + more).split(b"\n")
                for line in whole:
                    if at >= partition.end:
                        rest = b""
                        break
                    places.append(at)
                    lines.append(line)
                    at += len(line) + 1
                if lines:
                    yield self._batch(partition.path, places, lines)
                    places, lines = [], []
                if not more or at >= partition.end:
                    break

    def _next(self, f: pa.NativeFile, at: int) -> int:
        while more := f.read_at(STEP, at):
            if (k := more.find(b"\n")) >= 0:
                return at + k + 1
            at += len(more)
        return at

    def _batch(self, path: str, places: list[int], lines: list[bytes]) -> pa.RecordBatch:
        text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(text)), pa.array(places, pa.int64()), pa.array([len(x) for x in lines], pa.int64()), pa.array(text)], names=["source", "offset", "length", "value"])

    def commit(self, end: dict) -> None:
        pass


class FollowedFiles(DataSource):
    """The format of follow."""

    @classmethod
    def name(cls) -> str:
        return "weftline_follow"

    def schema(self) -> str:
        return "source string, offset bigint, length bigint, value string"

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of source, offset, length (in bytes) and value of each line that is added to a file, to the files of a
    folder, or to those that a pattern (of the last part of the path) matches, new ones too.

    A line counts once it has its line feed. Progress is kept in the stream's checkpoint, so that a restart goes on at the
    next byte. A file that has become shorter, or begins with other bytes, is another one and is read from its first byte;
    a file that was emptied and has since grown past where it was, beginning with the same bytes, can't be told. What a
    vanished file has given stays. Large additions are read in ranges, each by its own task."""
    spark.dataSource.register(FollowedFiles)
    return spark.readStream.format(FollowedFiles.name()).load(path)


def reloaded(index: int, before: int, after: int) -> tuple[int, int]:
    """Where a reader of rows stands after a reload, and by how many rows the source has grown: at the last row if it stood
    there, otherwise where it was, as far as there are rows."""
    last = max(0, after - 1)
    return (last if index >= before - 1 else min(index, last)), after - before
