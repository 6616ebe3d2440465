"""A sink of many small files: one for each row, in folders of the tasks that wrote them, and what reads them again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that ended well."""

    folder: str


class CorpusWriter(DataSourceArrowWriter):
    """Tasks write below a hidden folder; the commit removes what failed attempts left there and makes it visible by one
    rename, then the runs before it go.  Nothing of a job that fails is ever seen."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.uri, self.run, self.overwrite = path, uuid.uuid4().hex, overwrite

    def _open(self) -> tuple[files.FileSystem, str]:
        found, top = files.FileSystem.from_uri(self.uri)
        return found, top.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        found, top = self._open()
        folder = f"part-{uuid.uuid4().hex}"
        found.create_dir(f"{top}/.{self.run}/{folder}")
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                with found.open_output_stream(f"{top}/.{self.run}/{folder}/{name}.md") as out:
                    out.write(text.as_buffer())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        found, top = self._open()
        staged = f"{top}/.{self.run}"
        found.create_dir(staged)
        good = {m.folder for m in messages if m}
        before = [f.path for f in found.get_file_info(files.FileSelector(top)) if not f.base_name.startswith(".")]
        for f in found.get_file_info(files.FileSelector(staged)):
            if f.base_name not in good:
                found.delete_dir(f.path)
        found.move(staged, f"{top}/run-{self.run}")
        for old in before if self.overwrite else ():
            found.delete_dir(old) if found.get_file_info(old).type == files.FileType.Directory else found.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        found, top = self._open()
        if found.get_file_info(f"{top}/.{self.run}").type == files.FileType.Directory:
            found.delete_dir(f"{top}/.{self.run}")


@dataclass
class Folder(InputPartition):
    """The files of one task that wrote."""

    path: str


#: Bytes of files that are there at once, or a single file's.
READ = 4 << 20


class CorpusReader(DataSourceReader):
    """A task for each folder: the driver knows folders, not files.  Spark's own reader of files leaves out empty ones."""

    def __init__(self, path: str) -> None:
        self.uri = path

    def partitions(self) -> list[Folder]:
        found, top = files.FileSystem.from_uri(self.uri)
        within = lambda p: [f.path for f in found.get_file_info(files.FileSelector(p)) if f.type == files.FileType.Directory and not f.base_name.startswith(".")]
        return [Folder(p) for run in within(top.rstrip("/")) for p in within(run)]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        found, _ = files.FileSystem.from_uri(self.uri)
        names: list[str] = []
        contents: list[bytes] = []
        size = 0
        for f in found.get_file_info(files.FileSelector(partition.path)) if partition else ():
            with found.open_input_stream(f.path) as data:
                names.append(f.base_name.removesuffix(".md"))
                contents.append(data.read())
            size += len(contents[-1])
            if size >= READ or len(names) == 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
                names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])


class CorpusSink(DataSource):
    """Rows (name, text) as files name.md, read as (name, content); ``path`` is a URI that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "attesto_corpus"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        if schema.names != ["name", "text"]:
            raise ValueError(f"rows must be (name, text), not {schema.names}")
        return CorpusWriter(self.options["path"], overwrite)
