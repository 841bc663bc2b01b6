"""The data source `glyphward`: files of any size as chunks of text, in batch and as a stream, and documents written all or not at all.

    spark.dataSource.register(Texts)
    spark.read.format("glyphward").load(path)             # path, chunk, at, text
    df.write.format("glyphward").option("suffix", ".sarif").save(path)

Reads and writes go through pyarrow's file systems: local folders, and stores that pyarrow reaches from the workers. What only
Spark's own readers reach is for read_files().
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a chunk, and of what one task reads at least if there is so much.
CHUNK, TASK = 8 << 20, 64 << 20
#: Seconds that a file must have been left alone before a stream takes it.
SETTLED = 1.0
_STAGED = "_glyphward_staged"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[fs.FileInfo]:
    """The files of a path, by name; of folders all, but for hidden ones and those being written."""
    store, where = _place(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    inside = store.get_file_info(fs.FileSelector(where, recursive=True))
    plain = [f for f in inside if f.type == fs.FileType.File and not any(p[:1] in "._" for p in os.path.relpath(f.path, where).split("/"))]
    return sorted(plain, key=lambda f: f.path)


def border(around: bytes, before: int) -> int:
    """How many bytes to move a cut forward, which stands behind `before` bytes of what is around it.

    A character is not cut, nor CR from LF. Behind three bytes that go on with a character none can, so bad bytes decode alike
    on both sides of a cut.
    """
    i = before
    while i < len(around) and i - before < 3 and around[i] & 0xC0 == 0x80:
        i += 1
    if 0 < i < len(around) and around[i - 1 : i + 1] == b"\r\n":
        i += 1
    return i - before


def _cut(file, at: int, size: int) -> int:
    """The place of the cut that is meant to be at `at`."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    file.seek(at - 1)
    return min(size, at + border(file.read(8), 1))


def decoded(raw: bytes, newlines: bool) -> str:
    """UTF-8 with bad bytes replaced; newlines: CRLF and CR become LF."""
    text = raw.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if newlines else text


@dataclass
class Ranges(InputPartition):
    """(file, its size, number of the first chunk, first byte, end) of what a task reads."""

    own: tuple[tuple[str, int, int, int, int], ...]

    def __init__(self, own):
        self.own = tuple(own)
        super().__init__(self.own)


def _partitions(files: list[tuple[str, int]], chunk: int, task: int) -> list[Ranges]:
    """Files in runs of whole chunks: large ones in many tasks, small ones together in one."""
    out, own, held, per = [], [], 0, max(1, task // chunk)
    for path, size in files:
        chunks = max(1, -(-size // chunk))
        for first in range(0, chunks, per):
            end = min(size, (first + per) * chunk)
            own.append((path, size, first, first * chunk, end))
            held += end - first * chunk
            if held >= task:
                out.append(Ranges(own))
                own, held = [], 0
    return out + ([Ranges(own)] if own else [])


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.path = options["path"]
        self.chunk, self.task = int(options.get("chunkBytes", CHUNK)), int(options.get("taskBytes", TASK))
        self.newlines = str(options.get("newlines", "true")).lower() == "true"
        self.settled = float(options.get("settledSeconds", SETTLED))
        if self.chunk < 16:
            raise ValueError("chunkBytes must be 16 at least")

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _place(self.path)
        for path, size, number, start, end in partition.own:
            with store.open_input_file(path) as file:
                at = _cut(file, start, size)
                for n in range(number, number + max(1, -(-(end - start) // self.chunk))):
                    stop = _cut(file, min((n + 1) * self.chunk, size), size)
                    file.seek(at)
                    yield path, n, at, decoded(file.read(stop - at), self.newlines)
                    at = stop


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return _partitions([(f.path, f.size) for f in _files(self.path)], self.chunk, self.task)


class StreamReader(_Reading, DataSourceStreamReader):
    """Files in the order of their times, then names; an offset is the last file taken. New files must have new times."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[fs.FileInfo]:
        after, upto = (start["time"], start["path"]), end and (end["time"], end["path"])
        files = sorted((f for f in _files(self.path)), key=lambda f: (f.mtime_ns, f.path))
        return [f for f in files if (f.mtime_ns, f.path) > after and (upto is None or (f.mtime_ns, f.path) <= upto)]

    def latestOffset(self) -> dict:
        ripe = [f for f in self._between(self.initialOffset(), None) if f.mtime_ns <= (time.time() - self.settled) * 1e9]
        return {"time": ripe[-1].mtime_ns, "path": ripe[-1].path} if ripe else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return _partitions([(f.path, f.size) for f in self._between(start, end)], self.chunk, self.task)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


@dataclass
class Part(WriterCommitMessage):
    """The folder or file that a task has staged, and for which job; none if it had no rows."""

    name: str | None
    job: str


class _Writing:
    """What the batch and the stream writer share: tasks stage, the driver moves.

    Rows are (name, value). layout `files`: a file for each row, named by it with the suffix behind, in a folder of the task;
    `lines`: a file for each task, a value in each line (JSON values on one line each). What a task has staged moves in one step.
    """

    def __init__(self, options, schema: StructType, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.layout, self.suffix = options.get("layout", "files"), options.get("suffix", ".json")
        if self.layout not in ("files", "lines"):
            raise ValueError(f"layout {self.layout!r}; there are files and lines")
        if [f.name for f in schema.fields] != ["name", "value"] or {f.dataType.simpleString() for f in schema.fields} != {"string"}:
            raise ValueError("rows must be (name string, value string)")
        self.job, self.lazy = uuid.uuid4().hex, True

    def write(self, rows: Iterator[Row]) -> Part:
        store, root = _place(self.path)
        own, staged = f"part-{uuid.uuid4().hex}", f"{root}/{_STAGED}/{self.job}"
        try:
            return Part(self._stage(rows, store, own, staged), self.job)
        except BaseException:
            for f in store.get_file_info([f"{staged}/{own}", f"{staged}/{own}{self.suffix}l"]):
                if f.type != fs.FileType.NotFound:
                    store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
            raise

    def _stage(self, rows: Iterator[Row], store: fs.FileSystem, own: str, staged: str) -> str | None:
        file, seen = None, set()
        for row in rows:
            if self.layout == "lines":
                if file is None:
                    if self.lazy:
                        store.create_dir(staged, recursive=True)
                    file = store.open_output_stream(f"{staged}/{own}{self.suffix}l")
                file.write(f"{row['value'] or ''}".replace("\n", " ").encode() + b"\n")
                continue
            if not seen:
                store.create_dir(f"{staged}/{own}", recursive=self.lazy)
            name = re.sub(r"[^\w.-]+", "_", row["name"] or "null").lstrip("._") or "unnamed"
            while name in seen:
                name += "~"
            seen.add(name)
            with store.open_output_stream(f"{staged}/{own}/{name}{self.suffix}") as out:
                out.write((row["value"] or "").encode())
        if file is not None:
            file.close()
            return f"{own}{self.suffix}l"
        return own if seen else None

    def _move(self, messages: list[Part | None], into: str) -> None:
        store, root = _place(self.path)
        store.create_dir(into, recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{root}/{_STAGED}/{m.job}/{m.name}", f"{into}/{m.name}")
        self._clear(messages)

    def _clear(self, messages: list[Part | None]) -> None:
        """Removes what the job has staged; the writer that commits a stream's batch is not always the object that wrote it."""
        store, root = _place(self.path)
        jobs = {self.job, *(m.job for m in messages if m is not None)}
        for where in (*(f"{root}/{_STAGED}/{j}" for j in sorted(jobs)), f"{root}/{_STAGED}"):
            inside = store.get_file_info(where)
            if inside.type == fs.FileType.Directory and (where != f"{root}/{_STAGED}" or not store.get_file_info(fs.FileSelector(where))):
                store.delete_dir(where)


class Writer(_Writing, DataSourceWriter):
    """The job's folder is there before its tasks; once a failure has removed it, tasks that still run cannot stage any more."""

    def __init__(self, options, schema: StructType, overwrite: bool = False):
        super().__init__(options, schema, overwrite)
        self.lazy = False
        store, root = _place(self.path)
        store.create_dir(f"{root}/{_STAGED}/{self.job}", recursive=True)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if os.path.basename(f.path) != _STAGED:
                    store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        self._move(messages, root)
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Part | None]) -> None:
        for _ in range(20):
            try:
                return self._clear(messages)
            except OSError:  # a task has put something there meanwhile
                time.sleep(0.2)
        return self._clear(messages)


class StreamWriter(_Writing, DataSourceStreamWriter):
    """Each batch is a folder, moved into place whole; a batch that is there already is not written again."""

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        store, root = _place(self.path)
        final, staged = f"{root}/batch={batchId}", f"{root}/{_STAGED}/{self.job}-{batchId}"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            return self._clear(messages)
        self._move(messages, staged)
        store.move(staged, final)
        return self._clear(messages)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._clear(messages)


class Texts(DataSource):
    """The source itself. Options of reading: chunkBytes, taskBytes, newlines, settledSeconds (streams); of writing: layout, suffix."""

    @classmethod
    def name(cls) -> str:
        return "glyphward"

    def schema(self) -> str:
        return "path string, chunk long, at long, text string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, schema)


def register_source(spark: SparkSession) -> None:
    """Makes the format `glyphward` known to a session."""
    spark.dataSource.register(Texts)
