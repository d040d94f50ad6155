"""A data source over folders of text files: whole files, or the lines of large ones.

``folders`` maps an id to a folder with any scheme that Arrow knows.  Folders are listed one directory at a time, and
directories of an excluded name are never opened.  Files are packed into partitions of about ``partition_bytes``; in line mode
a file is cut into byte ranges, and a range holds the lines that begin in it.  A filter on the id decides which folders are
listed at all.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import fixed_values as V

PARTITION_BYTES = 32 << 20
#: Bytes read at once while lines are looked for.
CHUNK = 1 << 20
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop writes file:/a where Arrow wants file:///a."""
    scheme, _, rest = path.partition(":")
    return pafs.FileSystem.from_uri(path if rest.startswith("//") or not rest else f"{scheme}://{rest}")


@dataclass
class Piece:
    """A file, or the byte range of one."""

    id: str
    path: str
    uri: str  # folder as given; the file is below it
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(pieces)
        self.pieces = pieces


def listed(folder: str, glob: str, exclude: set[str]) -> Iterator[tuple[str, int]]:
    """(path below the folder, size) of its files, directory by directory, in path order within each."""
    fs, base = filesystem(folder)
    base = base.rstrip("/")
    waiting = [base]
    while waiting:
        below = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True)), key=lambda i: i.path):
            if info.type == pafs.FileType.Directory:
                if info.base_name not in exclude:
                    below.append(info.path)
            elif info.type == pafs.FileType.File and fnmatchcase(info.base_name, glob):
                yield info.path[len(base) + 1 :], info.size
        waiting += reversed(below)


def _lines(stream, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end)."""
    at, rest = start, b""
    if start:  # the line that begins before belongs to the range before, unless it ends right here
        at = start - 1
        while at < size:
            block = stream.read_at(min(CHUNK, size - at), at)
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
    begin = at
    while begin < end:
        cut = rest.find(b"\n")
        if cut >= 0:
            yield begin, rest[:cut]
            begin, rest = begin + cut + 1, rest[cut + 1 :]
        elif at < size and (block := stream.read_at(min(CHUNK, size - at), at)):
            at, rest = at + len(block), rest + block
        else:
            if rest:
                yield begin, rest
            return


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folders: dict[str, str] = json.loads(options["folders"])
        self.glob, self.lines = options.get("glob", "*"), options.get("lines", "false") == "true"
        self.exclude = set(json.loads(options.get("exclude", "[]")))
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                self.folders = {k: v for k, v in self.folders.items() if k == f.value}
            elif isinstance(f, In) and f.attribute == ("id",):
                self.folders = {k: v for k, v in self.folders.items() if k in f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        held, taken = [], 0
        for name, folder in sorted(self.folders.items()):
            for path, size in listed(folder, self.glob, self.exclude):
                cuts = range(0, max(size, 1), self.size) if self.lines else [0]
                for start in cuts:
                    end = min(start + self.size, size) if self.lines else size
                    if held and taken + end - start > self.size:
                        out.append(Pieces(held))
                        held, taken = [], 0
                    held.append(Piece(name, path, folder, start, end))
                    taken += end - start
        return [*out, Pieces(held)]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for p in partition.pieces:
            fs, base = filesystem(p.uri)
            with fs.open_input_file(f"{base.rstrip('/')}/{p.path}") as stream:
                if self.lines:
                    for offset, line in _lines(stream, p.start, p.end, stream.size()):
                        yield p.id, p.path, offset, line.decode("utf-8", "replace").removesuffix("\r")
                else:
                    yield p.id, p.path, p.end, stream.read().decode("utf-8", "replace")


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folders"

    def schema(self) -> str:
        return "id string, path string, offset long, line string" if self.options.get("lines") == "true" else "id string, path string, length long, content string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


def _read(spark: SparkSession, folders: dict[str, str], **options) -> DataFrame:
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on the id
    reader = spark.read.format("text_folders").option("folders", json.dumps(folders))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def read_folders(spark: SparkSession, folders: dict[str, str], glob: str = "*", exclude: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(id, path, length, content): every file below the folders whose name fits ``glob``."""
    return _read(spark, folders, glob=glob, exclude=json.dumps(V.EXCLUDED_DIRECTORIES if exclude is None else exclude), partition_bytes=str(partition_bytes))


def read_lines(spark: SparkSession, folders: dict[str, str], glob: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(id, path, offset, line): the lines of such files with their byte offsets, large files in many tasks."""
    return _read(spark, folders, glob=glob, lines="true", partition_bytes=str(partition_bytes))
