"""Archives (.zip, .npz) as a Python data source: one partition a member, or a range of a member's entries.

Only the archive's directory is read when partitions are planned; members are then streamed, so
neither an archive nor a member need fit into memory, and there is no limit of 2 GB.  Files are
opened by pyarrow's file systems, which know local paths, hdfs://, s3:// and others by URI.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a batch of lines; entries of a range of an adjacency matrix; bytes of a range of a plain file.
BATCH, ENTRIES, RANGE = 1 << 20, 1 << 20, 32 << 20
#: Endings of members that hold edge lists; so do members without any.
LISTS = (".txt", ".csv", ".edges")


@dataclass
class Piece(InputPartition):
    path: str
    member: str
    start: int = 0
    stop: int = 0


def opened(path: str):
    """(file system, the path on it)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str, ending: str) -> list[str]:
    """The file itself, or a folder's files of an ending in name order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.lower().endswith(ending))


class _Seekable(io.RawIOBase):
    """A pyarrow file as Python's zipfile wants one: a place that isn't there is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    seekable = readable

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, place: int, whence: int = 0) -> int:
        at = place + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the beginning")
        return self.file.seek(at)


def archive_of(path: str) -> zipfile.ZipFile:
    system, at = opened(path)
    return zipfile.ZipFile(io.BufferedReader(_Seekable(system.open_input_file(at)), 1 << 20))


def header_of(stream) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and kind of the .npy member whose stream stands at its beginning; the stream then stands at the first entry."""
    version = np.lib.format.read_magic(stream)
    shape, _, kind = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    return shape, kind


def entries_of(archive: zipfile.ZipFile, member: str, start: int, stop: int) -> np.ndarray:
    """Entries start to stop of a one-dimensional .npy member."""
    with archive.open(member) as stream:
        _, kind = header_of(stream)
        stream.seek(start * kind.itemsize, 1)
        return np.frombuffer(stream.read((stop - start) * kind.itemsize), kind)


class LinesReader(DataSourceReader):
    """value: lines of the members that hold edge lists."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[Piece]:
        out = []
        for path in files_of(self.path, ".zip"):
            for info in archive_of(path).infolist():
                name = os.path.basename(info.filename)
                if name and (name.lower().endswith(LISTS) or "." not in name):
                    out.append(Piece(path, info.filename))
        return out or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        made = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        rest = b""
        try:
            with archive_of(piece.path).open(piece.member) as stream:
                while chunk := stream.read(BATCH):
                    whole, cut, rest = (rest + chunk).rpartition(b"\n")
                    if cut:
                        yield made(whole.decode("utf-8", "ignore").splitlines())
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):  # a member that can't be read is skipped from there on
            return
        if rest:
            yield made(rest.decode("utf-8", "ignore").splitlines())


class AdjacencyReader(DataSourceReader):
    """layer, n, u, v, w of compressed-sparse-row archives (members indptr, indices, data, shape)."""

    def __init__(self, options):
        self.path, self.entries = options["path"], int(options.get("entries", ENTRIES))

    def partitions(self) -> list[Piece]:
        out = []
        for path in files_of(self.path, ".npz"):
            with archive_of(path).open("data.npy") as stream:
                (count,), _ = header_of(stream)
            out += [Piece(path, "", i, min(i + self.entries, count)) for i in range(0, count, self.entries)]
        return out or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        archive = archive_of(piece.path)
        n = int(entries_of(archive, "shape.npy", 0, 1)[0])
        # Rows of the range: the row starts within it, and the last one before it.
        row, starts, first = 0, [], 0
        with archive.open("indptr.npy") as stream:
            _, kind = header_of(stream)
            while chunk := stream.read(BATCH * kind.itemsize):
                at = np.frombuffer(chunk, kind).astype(np.int64)
                first += int((at <= piece.start).sum())
                starts.append(at[(at > piece.start) & (at < piece.stop)])
                row += len(at)
        inner = np.concatenate(starts)
        u = first - 1 + np.searchsorted(inner, np.arange(piece.start, piece.stop), "right")
        v = entries_of(archive, "indices.npy", piece.start, piece.stop).astype(np.int64)
        w = entries_of(archive, "data.npy", piece.start, piece.stop).astype(float)
        layer = os.path.splitext(os.path.basename(piece.path))[0]
        yield pa.RecordBatch.from_arrays([pa.array([layer] * len(u), pa.string()), pa.array(np.full(len(u), n), pa.int64()), pa.array(u), pa.array(v), pa.array(w)], ["layer", "n", "u", "v", "w"])


class BytesReader(DataSourceReader):
    """path, start, content: ranges of plain files, multiples of `unit` bytes long."""

    def __init__(self, options):
        unit = int(options.get("unit", 1))
        self.path, self.ending = options["path"], options.get("ending", "")
        self.range = max(unit, int(options.get("range", RANGE)) // unit * unit)

    def partitions(self) -> list[Piece]:
        out = []
        for path in files_of(self.path, self.ending):
            system, at = opened(path)
            size = system.get_file_info(at).size
            out += [Piece(path, "", i, min(i + self.range, size)) for i in range(0, size, self.range)]
        return out or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        system, at = opened(piece.path)
        with system.open_input_file(at) as f:
            content = f.read_at(piece.stop - piece.start, piece.start)
        yield pa.RecordBatch.from_arrays([pa.array([piece.path]), pa.array([piece.start], pa.int64()), pa.array([content], pa.binary())], ["path", "start", "content"])


class _Source(DataSource):
    reads: type
    fields: str

    def schema(self) -> str:
        return self.fields

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class ZipLines(_Source):
    reads, fields = LinesReader, "value string"

    @classmethod
    def name(cls) -> str:
        return "zip_lines"


class Adjacency(_Source):
    reads, fields = AdjacencyReader, "layer string, n long, u long, v long, w double"

    @classmethod
    def name(cls) -> str:
        return "adjacency_archive"


class FileRanges(_Source):
    reads, fields = BytesReader, "path string, start long, content binary"

    @classmethod
    def name(cls) -> str:
        return "file_ranges"


def loaded(spark: SparkSession, source: type, path: str, **options) -> DataFrame:
    """The source's rows of a file or a folder's files."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)
