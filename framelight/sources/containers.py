"""A data source that reads one video file in many tasks, and a sink of files with commit.

``spark.dataSource.register(VideoContainer)`` makes the format
``video_container``. A container plug-in (option ``container``, as
``module:class``) tells where the groups of frames that begin with a key frame
lie, from the file's index alone, and decodes one group; splits are runs of
groups of about ``split_bytes`` (option, 8 MB). Only the columns of the schema
that is asked for are returned, and the container is told of them, so it need not
decode others.

``spark.dataSource.register(FileSink)`` makes the format ``committed_files``:
rows (name, content) become files of a folder. A task writes into a folder of its
own attempt; the driver moves the files of the attempts that count and drops the
rest, so a task that ran twice leaves one copy of each file.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framelight.sources.video import DECODED

SPLIT_BYTES = 8 << 20


class Group(NamedTuple):
    """Where a key frame and the frames up to the next one lie, and the number of the first."""

    offset: int
    size: int
    first_frame: int


class Container(Protocol):
    """What a container format must offer."""

    def index(self, file: fs.NativeFile) -> list[Group]: ...

    def decode(self, data: bytes, columns: list[str]) -> Iterator[dict]: ...


class JsonGroups:
    """A stand-in format: a line with the index, ``[[size, frames], ...]``, then each group as a JSON list of frames."""

    def index(self, file: fs.NativeFile) -> list[Group]:
        head = b""
        while b"\n" not in head and (more := file.read(65536)):
            head += more
        line = head.split(b"\n", 1)[0]
        groups, offset, frame = [], len(line) + 1, 0
        for size, frames in json.loads(line or b"[]"):
            groups.append(Group(offset, size, frame))
            offset, frame = offset + size, frame + frames
        return groups

    def decode(self, data: bytes, columns: list[str]) -> Iterator[dict]:
        for frame in json.loads(data):
            yield {c: frame.get(c) for c in columns}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    store, base = _open(path)
    found = store.get_file_info(base)
    if found.type == fs.FileType.File:
        return [base]
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file)


@dataclass
class Split(InputPartition):
    """Successive groups of one file."""

    path: str
    groups: list[Group]


class VideoContainer(DataSource):
    """Frames of containers, a run of groups a task."""

    @classmethod
    def name(cls) -> str:
        return "video_container"

    def schema(self) -> str:
        return DECODED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ContainerReader(self.options, schema)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        module, _, name = options.get("container", f"{__name__}:JsonGroups").partition(":")
        self.path, self.schema = options["path"], schema
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.container: Container = getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[Split]:
        """Read the files' indexes and cut them between groups."""
        store, _ = _open(self.path)
        splits = []
        for path in _files(self.path):
            with store.open_input_file(path) as file:
                groups = self.container.index(file)
            held, size = [], 0
            for group in groups:
                if held and size + group.size > self.split_bytes:
                    splits.append(Split(path, held))
                    held, size = [], 0
                held.append(group)
                size += group.size
            if held:
                splits.append(Split(path, held))
        return splits

    def read(self, partition: Split) -> Iterator[Row]:
        store, _ = _open(self.path)
        names = self.schema.names
        wanted = [c for c in names if c not in ("path", "frame_idx")]
        with store.open_input_file(partition.path) as file:
            for group in partition.groups:
                for k, frame in enumerate(self.container.decode(file.read_at(group.size, group.offset), wanted)):
                    known = {"motion_vectors": [], **{c: v for c, v in frame.items() if v is not None}, "path": partition.path, "frame_idx": group.first_frame + k}
                    yield Row(**{c: _as(known.get(c), self.schema[c].dataType) for c in names})


def _as(value, kind: T.DataType):
    """Decoded values as Spark rows hold them: structs of vectors by name."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and value:
        return [Row(**{c: v.get(c) for c in kind.elementType.names}) for v in value]
    return value


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)


class FileSink(DataSource):
    """Rows (name, content) as files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


class FileWriter(DataSourceWriter):
    """Staged by attempt, moved on commit; equal names keep the last moved."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, base = _open(self.path)
        return store, base, f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, _, staging = self._staging()
        folder, names = f"{staging}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {row.name!r}")
            with store.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content or b""))
            names.append(row.name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base, staging = self._staging()
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.is_file:
                    store.delete_file(old.path)
        for message in messages:
            for name in dict.fromkeys(message.names if message else []):
                store.move(f"{message.folder}/{name}", f"{base}/{name}")
        self._drop(store, staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staging = self._staging()
        self._drop(store, staging)

    @staticmethod
    def _drop(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
