"""A folder as a message channel: a data source for batches and streams, each message once.

A writer's task puts its messages (JSON lines) into a file of its own; the commit of a batch writes one list that
names the batch's files, under the writer's name and the batch's number. Files that no list names (of tasks that
died, of aborted batches) are never read, and a batch that is committed again is dropped, so a query that is killed
and started again gives each message once. A reader's offset is the number of committed batches by writer; what is
between two offsets is fixed, so a batch that runs again reads the same.

The folder may be on any file system that pyarrow opens by URI and that all executors reach. Messages:
(topic, key, value); a reader adds writer, batch, file and line, which together are a message's place. Options:
``path``; ``writer`` (a name without slashes, needed for streams: the same after a restart); ``topic`` to read one.

Defined results: a folder that is not there is an empty channel; null members of a message stay null; values may hold
line breaks, since they are escaped; a batch without messages has an empty list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "message_folder"
MESSAGE = "topic string, key string, value string"
PLACED = f"{MESSAGE}, writer string, batch bigint, file int, line bigint"
#: Messages that a reader hands over at once.
ROWS = 5_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


@dataclass
class _Files(InputPartition):
    writer: str
    batch: int
    file: int
    name: str


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    n: int


class _Folder:
    def __init__(self, options: dict) -> None:
        self.path, self.topic = options["path"], options.get("topic")
        self.writer = options.get("writer") or uuid.uuid4().hex

    def _list(self, folder: str) -> list[str]:
        system, at = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{at}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def _committed(self) -> dict[str, int]:
        """Number of committed batches by writer."""
        out = {}
        for writer in self._list("commits"):
            numbers = [int(n.removesuffix(".json")) for n in self._list(f"commits/{writer}") if n.endswith(".json")]
            if numbers:
                out[writer] = max(numbers) + 1
        return out

    def _parts(self, start: dict[str, int], end: dict[str, int]) -> list[_Files]:
        system, at = _opened(self.path)
        out = []
        for writer, last in sorted(end.items()):
            for batch in range(start.get(writer, 0), last):
                info = system.get_file_info(f"{at}/commits/{writer}/{batch:012d}.json")
                if info.type == fs.FileType.File:
                    with system.open_input_stream(info.path) as f:
                        out += [_Files(writer, batch, k, name) for k, name in enumerate(json.loads(f.read()))]
        return out

    def _messages(self, part: _Files) -> Iterator[pa.RecordBatch]:
        system, at = _opened(self.path)
        rows: list[tuple] = []
        with system.open_input_stream(f"{at}/messages/{part.name}") as raw:
            for line, text in enumerate(_lines(raw)):
                topic, key, value = json.loads(text)
                if self.topic is None or topic == self.topic:
                    rows.append((topic, key, value, part.writer, part.batch, part.file, line))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _write(self, rows: Iterator) -> _Written:
        system, at = _opened(self.path)
        name, n, out = f"{self.writer}-{uuid.uuid4().hex}.jsonl", 0, None
        for row in rows:
            if out is None:
                system.create_dir(f"{at}/messages", recursive=True)
                out = system.open_output_stream(f"{at}/messages/{name}")
            out.write((json.dumps([row["topic"], row["key"], row["value"]], ensure_ascii=False) + "\n").encode())
            n += 1
        if out is not None:
            out.close()
        return _Written(name if n else None, n)

    def _commit(self, messages: list, batch: int) -> None:
        """The batch's list, whole under its name; what was written again for a batch that has one goes."""
        system, at = _opened(self.path)
        last = f"{at}/commits/{self.writer}/{batch:012d}.json"
        if system.get_file_info(last).type == fs.FileType.File:
            self._forget(messages)
            return
        system.create_dir(f"{at}/commits/{self.writer}", recursive=True)
        made = f"{at}/commits/{self.writer}/.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as f:
            f.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        system.move(made, last)

    def _forget(self, messages: list) -> None:
        system, at = _opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{at}/messages/{m.name}")


def _lines(raw) -> Iterator[bytes]:
    """Lines of a stream, which need not fit into memory together."""
    held = b""
    while chunk := raw.read(1 << 20):
        *lines, held = (held + chunk).split(b"\n")
        yield from lines
    if held:
        yield held


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
    names = ["topic", "key", "value", "writer", "batch", "file", "line"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[_Files]:
        return self._parts({}, self._committed()) or [_Files("", 0, 0, "")]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from self._messages(partition)


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._committed()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return self._parts(start, end)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield from self._messages(partition)


class _Writer(_Folder, DataSourceWriter):
    def write(self, iterator: Iterator) -> _Written:
        return self._write(iterator)

    def commit(self, messages: list) -> None:
        self._commit(messages, 0)

    def abort(self, messages: list) -> None:
        self._forget(messages)


class _StreamWriter(_Folder, DataSourceStreamWriter):
    def write(self, iterator: Iterator) -> _Written:
        return self._write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._forget(messages)


class MessageFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PLACED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a channel is appended to")
        return _Writer({k: v for k, v in self.options.items() if k != "writer"})

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if not self.options.get("writer"):
            raise ValueError("a stream needs a writer's name that stays the same after a restart")
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> str:
    """Makes the source known to the session; its format name."""
    spark.dataSource.register(MessageFolder)
    return NAME
