"""A sink that pushes outbox operations to a backend: a Python data source for writes.

Each operation goes to the backend once, in order of its id within its record's
task, with its id as the key under which the backend knows it again.  A task
writes down what it has pushed (a journal of its own, which a retried task
reads before it pushes), stops at the first operation that fails, and tells the
driver so in its commit message; the driver then fails the write, and what was
not pushed stays pending.  Only file names and counts go through the driver.

A task that is lost between a push and the next entry of its journal sends up
to ``JOURNAL_EVERY`` operations again, under their old keys.  A backend that
takes many operations in a request gets as many as an entry holds.  A task that
is through leaves one journal in place of its entries.

Options: ``root`` (a folder that driver and executors share), ``backend``
("module:factory", called with the option ``argument``), ``run`` (a name of the
write, by default a new one; a write that is done again keeps it).
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "outbox_push"
#: Operations between two entries of a journal.
JOURNAL_EVERY = 200
PUSHED = pa.schema([("id", pa.int64()), ("record_uuid", pa.string()), ("operation", pa.string()), ("orphan", pa.bool_()), ("remote_id", pa.string())])


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Backend(Protocol):
    """Where operations go.  ``key`` is the same whenever an operation is sent again; a backend does it once."""

    def upsert(self, key: str, record: dict) -> str | None:
        """Returns the remote id."""

    def delete(self, key: str, record: dict) -> None: ...


class BulkBackend(Protocol):
    """A backend that takes (key, operation, record) of many operations in one request; keys are as above."""

    def push(self, operations: list[tuple[str, str, dict]]) -> Iterable[str | None]:
        """Does them in their order; for each that is done its remote id, if any.  Raises at the first that fails."""


class _OneByOne:
    """A bulk request made of single ones."""

    def __init__(self, backend: Backend):
        self.backend = backend

    def push(self, operations: list[tuple[str, str, dict]]) -> Iterator[str | None]:
        for key, operation, record in operations:
            yield (self.backend.upsert if operation == "upsert" else self.backend.delete)(key, record)


class FolderBackend:
    """A backend of a shared folder: a file for each operation, named by its key and created once."""

    def __init__(self, root: str):
        self.fs, self.root = _file_system(root)
        self.fs.create_dir(self.root, recursive=True)

    def _once(self, key: str, body: dict) -> dict:
        path = f"{self.root}/{key}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.File:
            with self.fs.open_input_stream(path) as f:
                return json.loads(f.read())
        with self.fs.open_output_stream(path) as f:
            f.write(json.dumps(body).encode())
        return body

    def upsert(self, key: str, record: dict) -> str | None:
        return self._once(key, {"operation": "upsert", "uuid": record["record_uuid"], "remote_id": f"remote-{record['record_uuid']}"})["remote_id"]

    def delete(self, key: str, record: dict) -> None:
        self._once(key, {"operation": "delete", "uuid": record["record_uuid"]})


class BundleBackend:
    """A bulk backend of a shared folder: a Parquet file for each request, named by its keys and created once.

    A request that comes again finds its file.  Where one comes again cut at
    other places, its operations stand there twice; whoever reads the folder
    takes a key once.
    """

    KIND = pa.schema([("key", pa.string()), ("operation", pa.string()), ("uuid", pa.string()), ("remote_id", pa.string())])

    def __init__(self, root: str):
        self.fs, self.root = _file_system(root)
        self.fs.create_dir(self.root, recursive=True)

    def push(self, operations: list[tuple[str, str, dict]]) -> list[str | None]:
        path = f"{self.root}/{hashlib.blake2b(json.dumps([o[0] for o in operations]).encode(), digest_size=16).hexdigest()}.parquet"
        if self.fs.get_file_info(path).type == pafs.FileType.File:
            return pq.read_table(path, filesystem=self.fs, columns=["remote_id"], partitioning=None).column("remote_id").to_pylist()
        rows = [(key, operation, r["record_uuid"], f"remote-{r['record_uuid']}" if operation == "upsert" else None) for key, operation, r in operations]
        _write(self.fs, path, [pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.KIND)], schema=self.KIND)])
        return [r[3] for r in rows]


def _write(fs: pafs.FileSystem, path: str, tables: Iterable[pa.Table]) -> None:
    """Writes a file that nobody sees before it is whole."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
    writer = None
    for t in tables:
        writer = writer or pq.ParquetWriter(hidden, t.schema, filesystem=fs)
        writer.write_table(t)
    writer.close()
    fs.move(hidden, path)


@dataclass
class TaskDone(WriterCommitMessage):
    pushed: int
    failed: int | None = None
    error: str = ""


class PushFailed(RuntimeError):
    """An operation failed; those behind it in its task stay pending."""


def _load(spec: str, argument: str | None) -> Backend | BulkBackend:
    module, _, factory = spec.partition(":")
    made = getattr(importlib.import_module(module), factory)
    return made(argument) if argument is not None else made()


class _Pusher:
    def __init__(self, options: dict[str, str]):
        self.root, self.spec, self.argument, self.run = options["root"].rstrip("/"), options["backend"], options.get("argument"), options.get("run") or uuid.uuid4().hex

    def push(self, rows: Iterator[Row]) -> TaskDone:
        from pyspark import TaskContext

        fs, root = _file_system(self.root)
        backend, task = _load(self.spec, self.argument), TaskContext.get()
        mine = f"{root}/pushed/run={self.run}"  # the task of a number gets the same operations again when it is repeated
        fs.create_dir(mine, recursive=True)
        journals = [f for f in fs.get_file_info(pafs.FileSelector(mine)) if f.base_name.startswith(f"{task.partitionId()}-") and f.size]
        known = {i for f in journals for i in pq.read_table(f.path, filesystem=fs, columns=["id"], partitioning=None).column("id").to_pylist()}
        done: list[tuple] = []
        entries: list[str] = []
        pushed, held = 0, []
        at_once = JOURNAL_EVERY if hasattr(backend, "push") else 1
        bulk = backend if hasattr(backend, "push") else _OneByOne(backend)

        def write_down():
            nonlocal pushed
            if done:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*done), PUSHED)]
                entries.append(f"{mine}/{task.partitionId()}-{task.taskAttemptId()}-{len(entries)}.parquet")
                _write(fs, entries[-1], [pa.Table.from_arrays(columns, schema=PUSHED)])
                pushed += len(done)
                done.clear()

        def settle():
            """Entries become one file: Spark opens files one by one.  What a loss in between leaves twice is read once."""
            write_down()
            if len(entries) > 1:
                read = lambda lo: pa.concat_tables(pq.read_table(e, filesystem=fs, partitioning=None) for e in entries[lo : lo + 100])
                _write(fs, f"{mine}/{task.partitionId()}-{task.taskAttemptId()}-all.parquet", map(read, range(0, len(entries), 100)))
                for e in entries:
                    fs.delete_file(e)

        def send() -> TaskDone | None:
            asked = [(str(r.id), "upsert" if r.operation == "upsert" else "delete", r.asDict(True)) for r in held if not r.orphan]
            remote = None
            for r in held:
                try:
                    if not r.orphan:
                        remote = iter(bulk.push(asked)) if remote is None else remote
                        done.append((r.id, r.record_uuid, r.operation, r.orphan, next(remote)))
                    else:
                        done.append((r.id, r.record_uuid, r.operation, r.orphan, None))
                except Exception as error:  # whatever a backend raises stops the run
                    settle()
                    return TaskDone(pushed, r.id, f"{type(error).__name__}: {error}")
            held.clear()
            if len(done) >= JOURNAL_EVERY:
                write_down()
            return None

        for r in rows:
            if r.id not in known:
                held.append(r)
                if len(held) >= at_once:
                    failed = send()
                    if failed:
                        return failed
        failed = send()
        if failed:
            return failed
        settle()
        return TaskDone(pushed)


def _settle(messages: list[TaskDone | None]) -> None:
    failed = [m for m in messages if m and m.failed is not None]
    if failed:
        raise PushFailed("; ".join(f"operation {m.failed}: {m.error}" for m in failed[:10]))


class PushWriter(DataSourceWriter, _Pusher):
    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.push(iterator)

    def commit(self, messages) -> None:
        _settle(messages)

    def abort(self, messages) -> None:
        """What was pushed stays pushed; its journals say so."""


class PushSink(DataSource):
    """Rows: id, record_uuid, operation, orphan and the record's columns, those of one record in one task by id."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id bigint, record_uuid string, operation string, orphan boolean"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PushWriter(dict(self.options))
