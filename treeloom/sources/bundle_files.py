"""Python data sink that writes large text files from rows that know their place.

A row ``(filename, position, data)`` is written at byte ``position`` of its file, so many tasks write one
file side by side and no task or driver holds it as a whole. The folder must be on storage that all
executors mount. Usage::

    spark.dataSource.register(PlacedFiles)
    rows.write.format("placed_files").option("path", folder).mode("append").save()

Tasks write into a folder of their own job beside ``path``; commit checks the number of bytes and renames
it, abort removes it. A task that is run again writes the same bytes at the same places. A folder that
exists is refused, and replaced as a whole with ``mode("overwrite")``.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """Number of bytes a task wrote."""

    n_bytes: int


class PlacedFiles(DataSource):
    """Sink of rows ``(filename string, position long, data binary)``; a file name may have folders before it."""

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if names != ["filename", "position", "data"]:
            raise ValueError(f"placed_files takes filename, position and data, not {', '.join(names)}")
        return PlacedWriter(os.path.abspath(self.options["path"]), overwrite)


class PlacedWriter(DataSourceArrowWriter):
    """Writes bytes at their places; the folder appears when all are there."""

    def __init__(self, path: str, overwrite: bool):
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"Path exists: {path}")
        self.path = path
        self.pending = f"{path}._writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.pending, exist_ok=True)
        handle, open_name, n_bytes = None, None, 0
        try:
            # Values one by one: a batch of texts is not held again as Python objects.
            for name, position, data in (row for batch in batches for row in zip(*batch.columns)):
                name, position = name.as_py(), position.as_py()
                if name != open_name:  # rows come sorted by file, so each is opened once
                    if not name or os.path.isabs(name) or os.path.normpath(name) != name or name.split("/")[0] in (".", ".."):
                        raise ValueError(f"not a file name: {name}")
                    if handle is not None:
                        os.close(handle)
                    os.makedirs(os.path.dirname(f"{self.pending}/{name}"), exist_ok=True)
                    handle = os.open(f"{self.pending}/{name}", os.O_CREAT | os.O_WRONLY, 0o644)
                    open_name = name
                view = memoryview(data.as_buffer())
                while view:  # a call may write less than it is given
                    done = os.pwrite(handle, view, position)
                    view, position, n_bytes = view[done:], position + done, n_bytes + done
        finally:
            if handle is not None:
                os.close(handle)
        return Written(n_bytes)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.pending, exist_ok=True)
        want = sum(m.n_bytes for m in messages if m)
        got = sum(os.path.getsize(f"{folder}/{name}") for folder, _, names in os.walk(self.pending) for name in names)
        if got != want:
            raise RuntimeError(f"{want} bytes written, files hold {got}: places overlap or leave gaps")
        if os.path.exists(self.path):
            old = f"{self.pending}-old"
            os.replace(self.path, old)
            os.replace(self.pending, self.path)
            shutil.rmtree(old)
        else:
            os.replace(self.pending, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)
