"""A8 as a data source: payload files of boards, a partition per board, read in batch and as a stream.

    spark.dataSource.register(PayloadSource)
    spark.read.format("board_payloads").load("/feeds")               # all boards
    spark.readStream.format("board_payloads").load("/feeds")         # new files of each board

A board's files are JSON lines in <path>/provider=<provider>/slug=<slug>/. Equality and IN filters on provider and slug are taken
by the source where spark.sql.python.filterPushdown.enabled is set: boards that they leave out are not listed, let alone
read. Spark keeps the partitions that a loaded source was first planned with, so with that setting each query loads its own. The stream's offset names the last file read of each board, by time of change and name; a board has one writer at a time,
and a file that is there does not change.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("fetched_at", T.TimestampType()),
    T.StructField("reported_total", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("body", T.StringType()),
])


#: Characters that Spark writes as %XX in the name of a partition's folder.
_ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}


def _escaped(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


class Board(InputPartition):
    """The files of a board that a task reads."""

    def __init__(self, provider: str, slug: str, files: list[str]):
        super().__init__((provider, slug))
        self.provider, self.slug, self.files = provider, slug, files


class _Folders:
    """Boards and their files below a path, on any file system that pyarrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _children(self, path: str) -> list:
        from pyarrow import fs

        return sorted(self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.path)

    def _named(self, path: str, key: str, only: set[str] | None) -> Iterator[tuple[str, str]]:
        if only is not None:
            # What is asked for is looked up, and the folder not listed.
            yield from ((v, f"{path}/{key}={_escaped(v)}") for v in sorted(only))
            return
        for x in self._children(path):
            name = x.path.rsplit("/", 1)[-1]
            if name.startswith(f"{key}="):
                yield unquote(name[len(key) + 1 :]), x.path

    def boards(self, providers: set[str] | None = None, slugs: set[str] | None = None) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
        """provider, slug and (time of change, path) of its files, oldest first."""
        for provider, folder in self._named(self.root, "provider", providers):
            for slug, board in self._named(folder, "slug", slugs):
                files = sorted((x.mtime_ns or 0, x.path) for x in self._children(board) if x.is_file and not x.path.rsplit("/", 1)[-1].startswith(("_", ".")))
                if files:
                    yield provider, slug, files

    def rows(self, board: Board | None) -> Iterator[tuple]:
        """The rows of a board; Spark reads None where there is no board at all."""
        for path in board.files if board else ():
            with self.fs.open_input_stream(path) as f:
                rest = b""
                while block := f.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from (_row(board, line) for line in lines if line.strip())
                if rest.strip():
                    yield _row(board, rest)


def _row(board: Board, line: bytes) -> tuple:
    x = json.loads(line)
    at = x.get("fetched_at")
    return board.provider, board.slug, x.get("page"), datetime.fromisoformat(at) if at else None, x.get("reported_total"), x.get("kind"), x.get("body")


class PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.asked: dict[str, set[str] | None] = {"provider": None, "slug": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in self.asked:
                before = self.asked[f.attribute[0]]
                self.asked[f.attribute[0]] = values if before is None else before & values
            else:
                yield f

    def partitions(self) -> list[Board]:
        return [Board(p, s, [path for _, path in files]) for p, s, files in _Folders(self.path).boards(self.asked["provider"], self.asked["slug"])]

    def read(self, partition: Board) -> Iterator[tuple]:
        return _Folders(self.path).rows(partition)


class PayloadStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {json.dumps([p, s]): list(files[-1]) for p, s, files in _Folders(self.path).boards()}

    def partitions(self, start: dict, end: dict) -> list[Board]:
        moved = {k: tuple(v) for k, v in end.items() if v != start.get(k)}
        out = []
        for key, last in moved.items():
            provider, slug = json.loads(key)
            first = tuple(start.get(key, (-1, "")))
            files = [path for _, _, own in _Folders(self.path).boards({provider}, {slug}) for at, path in own if first < (at, path) <= last]
            out.append(Board(provider, slug, files))
        return out

    def read(self, partition: Board) -> Iterator[tuple]:
        return _Folders(self.path).rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board_payloads"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PayloadReader:
        return PayloadReader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> PayloadStream:
        return PayloadStream(self.options["path"])
