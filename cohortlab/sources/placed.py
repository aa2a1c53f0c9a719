"""Files written by many tasks at once: each row says in which file and at which byte its text belongs.

A data source writer puts rows where they belong in unfinished files in a hidden folder; its commit checks that every byte was
written and gives the files their names, its abort removes the folder. Writing a row twice writes the same bytes, so repeated and
speculative tasks are harmless, and a reader never sees part of a file. Stores that cannot write at a place (object stores, HDFS)
get each file from one task that streams its rows in order.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cohortlab.functions.predicates import col

FORMAT = "placed_files"
# Files of one write; their names and sizes come to the driver.
MAX_FILES = 100_000
OPEN_FILES = 64


def local_path(folder: str) -> str | None:
    """The path of a folder that tasks open as files, or None for other stores."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None if "://" in folder else folder


def store_of(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    local = local_path(path)
    return (fs.LocalFileSystem(), os.path.abspath(local)) if local is not None else fs.FileSystem.from_uri(path)


def openable(path: str) -> bool:
    """Can tasks open files of this store themselves? Some stores are known to Spark alone."""
    try:
        store_of(path)
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False
    return True


@dataclass
class Written(WriterCommitMessage):
    """Bytes written by a task, and the files it streamed: (name, unfinished name)."""

    size: int
    files: list[tuple[str, str]] = field(default_factory=list)


class _Runs:
    """Rows of a batch in order, as stretches of bytes that belong together."""

    def __init__(self, batch: pa.RecordBatch):
        batch = batch.take(pc.sort_indices(batch, [("file", "ascending"), ("at", "ascending")]))
        value = batch.column("value").cast(pa.large_binary())
        self.offsets = np.frombuffer(value.buffers()[1], np.int64)[value.offset: value.offset + len(value) + 1] if len(value) else np.zeros(1, np.int64)
        self.data = value.buffers()[2] if len(value) else None
        at = batch.column("at").to_numpy(zero_copy_only=False)
        code = batch.column("file").dictionary_encode()
        self.names = code.dictionary.to_pylist()
        self.code = code.indices.to_numpy(zero_copy_only=False)
        size = np.diff(self.offsets)
        new = np.ones(len(at), bool)
        new[1:] = (self.code[1:] != self.code[:-1]) | (at[1:] != at[:-1] + size[:-1])
        self.first = np.flatnonzero(new)
        self.at = at

    def __iter__(self):
        for a, b in zip(self.first.tolist(), [*self.first[1:].tolist(), len(self.at)]):
            yield self.names[self.code[a]], int(self.at[a]), memoryview(self.data)[self.offsets[a]: self.offsets[b]]


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.token, self.size = options["path"], options["token"], int(options["size"])
        self.seek = local_path(self.folder) is not None

    def _hidden(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/.placed-{self.token}"

    def write(self, iterator):
        return self._write_at(iterator) if self.seek else self._stream(iterator)

    def _write_at(self, iterator) -> Written:
        root, size = self._hidden(local_path(self.folder)), 0
        handles: dict[str, int] = {}
        try:
            for batch in iterator:
                for name, at, data in _Runs(batch):
                    if name not in handles:
                        if len(handles) >= OPEN_FILES:
                            os.close(handles.pop(next(iter(handles))))
                        handles[name] = os.open(f"{root}/{name}", os.O_WRONLY)
                    size += len(data)
                    while len(data):
                        n = os.pwrite(handles[name], data, at)
                        at, data = at + n, data[n:]
        finally:
            for handle in handles.values():
                os.close(handle)
        return Written(size)

    def _stream(self, iterator) -> Written:
        """Rows of a file come in order and all to this task."""
        store, root = store_of(self._hidden(self.folder))
        out, now, end, size, files = None, None, 0, 0, []
        for batch in iterator:
            for name, at, data in _Runs(batch):
                if name != now:
                    if out:
                        out.close()
                    part = f"{root}/{uuid.uuid4().hex}"
                    out, now, end = store.open_output_stream(part), name, 0
                    files.append((name, part))
                if at != end:
                    raise ValueError(f"{name}: bytes {end} to {at} are missing")
                out.write(data)
                end += len(data)
                size += len(data)
        if out:
            out.close()
        return Written(size, files)

    def commit(self, messages):
        got = sum(m.size for m in messages if m is not None)
        if got != self.size:
            self.abort(messages)
            raise ValueError(f"{got} of {self.size} bytes were written")
        store, folder = store_of(self.folder)
        if self.seek:
            root = self._hidden(folder)
            for name in sorted(os.listdir(root)):
                os.replace(f"{root}/{name}", f"{folder}/{name}")
        else:
            for name, part in (f for m in messages if m is not None for f in m.files):
                store.move(part, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages):
        if self.seek:
            shutil.rmtree(self._hidden(local_path(self.folder)), ignore_errors=True)
        else:
            store, root = store_of(self._hidden(self.folder))
            store.delete_dir(root)


class PlacedFiles(DataSource):
    """The format `placed_files`; rows are (file, at, value)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "file string, at long, value string"

    def writer(self, schema, overwrite):
        return PlacedWriter(self.options)


def _valid(name: str | None) -> bool:
    return bool(name) and not name.startswith(".") and "/" not in name and "\x00" not in name


def write_placed(rows: DataFrame, sizes: dict[str, int], folder: str) -> None:
    """Write rows (file, at, value) as files of `folder`; `sizes` names all files with their bytes, of which each must be given once.

    Files of the same names are replaced, once all are complete; others stay.
    """
    if bad := [n for n in sizes if not _valid(n)]:
        raise ValueError(f"not a file name: {bad[0]!r}")
    from pyarrow import fs

    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(PlacedFiles)
    token = uuid.uuid4().hex
    store, root = store_of(folder)
    hidden = f"{root}/.placed-{token}"
    store.create_dir(hidden, recursive=True)
    rows = rows.select(F.col("file").cast("string"), F.col("at").cast("bigint"), F.col("value").cast("string")).where("value <> ''")
    if local_path(folder) is not None:
        for name, size in sizes.items():
            with open(f"{hidden}/{name}", "wb") as out:
                out.truncate(size)
    else:
        for name in (n for n, size in sizes.items() if not size):
            store.open_output_stream(f"{root}/{name}").close()
        rows = rows.repartition("file").sortWithinPartitions("file", "at")
    try:
        rows.write.format(FORMAT).mode("append").options(token=token, size=sum(sizes.values())).save(folder)
    except Exception:
        # A job that fails before its last stage never calls the writer's abort.
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)
        raise


def file_sizes(totals: DataFrame, name_col: str, size_col: str) -> dict[str, int]:
    """Names and sizes on the driver; too many are an error."""
    rows = totals.select(col(name_col), col(size_col)).limit(MAX_FILES + 1).collect()
    if len(rows) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    return {r[0]: r[1] for r in rows}
