"""A sink of whole files: one for each row, visible only when all of them are written.

``df.write.format("document-files").mode("append").option("path", folder).option("extension", ".md").save()`` with columns name and content. Tasks write into a staging folder beside the
target; the driver renames that folder once when all tasks are done, and deletes it if one fails for good. ``spark.read`` of the same format gives the rows again: the driver lists the
target's folders, tasks what is in them. So millions of files are written into folders, and neither way names them all in one place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Ends of file names by output format; anything else is JSON, as the format is.
EXTENSIONS = {"json": ".json", "markdown": ".md", "summary": ".txt", "search-index": ".json"}
#: Folders for files that are as many as the rows of a large table.
FOLDERS = 1024
#: Where attempts write, in the staging folder; no escaped name has this sign.
ATTEMPTS = "+attempts"
#: Files, and bytes of them, of a batch that is read.
BATCH_FILES, BATCH_BYTES = 256, 4 << 20


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    store, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, top.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    """A name's file is its content as UTF-8, or its bytes. Names are escaped as in addresses, so none leaves the folder; they must be distinct. A null content is an empty file, a null name an error."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.extension, self.overwrite = options.get("path"), options.get("extension", ""), overwrite
        self.folders = int(options.get("folders", "0"))
        if not self.path:
            raise ValueError("a path is required")
        store, top = _store(self.path)
        from pyarrow import fs

        self.exists = store.get_file_info(top).type != fs.FileType.NotFound
        self.staging = f"{top}.staging-{uuid.uuid4().hex}"
        store.create_dir(f"{self.staging}/{ATTEMPTS}", recursive=True)

    def _place(self, name: str) -> str:
        own = quote(name, safe="") + self.extension
        if not self.folders:
            return own
        import zlib

        return f"{zlib.crc32(name.encode()) % self.folders:05d}/{own}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _store(self.path)
        own, n = f"{self.staging}/{ATTEMPTS}/{uuid.uuid4().hex}", 0
        # Not with its parents: a task that begins after the job was given up finds no staging folder and ends.
        store.create_dir(own, recursive=False)
        made = {self.staging}
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if name is None:
                    raise ValueError("a file without a name")
                data = content.encode() if isinstance(content, str) else content or b""
                with store.open_output_stream(f"{own}/file") as f:
                    f.write(data)
                # Whole before it has its name: an attempt that is lost leaves no part of a file under one.
                to = f"{self.staging}/{self._place(name)}"
                folder = to.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=False)
                    made.add(folder)
                store.move(f"{own}/file", to)
                n += 1
        store.delete_dir(own)
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        store.delete_dir(f"{self.staging}/{ATTEMPTS}")
        if self.overwrite and self.exists:
            # The old files go aside first, so that they are there until the new ones are.
            old = f"{self.staging}-old"
            store.move(top, old)
            store.move(self.staging, top)
            store.delete_dir(old)
        elif self.exists:
            store.move(self.staging, f"{top}/part-{self.staging.rpartition('-')[2]}")
        else:
            store.move(self.staging, top)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, _ = _store(self.path)
        # Tasks that are being ended may still write; a folder that gets a file while it goes is tried again.
        for wait in (0.1, 0.5, 2.0, 5.0, 0):
            try:
                if store.get_file_info(self.staging).type == fs.FileType.NotFound:
                    return
                store.delete_dir(self.staging)
            except OSError:
                if not wait:
                    raise
            time.sleep(wait)


@dataclass
class Share(InputPartition):
    """Folders and files that a task reads."""

    places: list[tuple[str, bool]]


class FileReader(DataSourceReader):
    """Rows of the files that a ``FileWriter`` wrote. What lies directly in the target is listed where the plan is made, what is in its folders by the tasks that read it."""

    def __init__(self, options: dict):
        self.path, self.extension, self.tasks = options.get("path"), options.get("extension", ""), int(options.get("tasks", "32"))
        if not self.path:
            raise ValueError("a path is required")

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, top = _store(self.path)
        found = sorted((f.path, f.type == fs.FileType.Directory) for f in store.get_file_info(fs.FileSelector(top)))
        n = max(1, min(self.tasks, len(found)))
        return [Share(found[len(found) * k // n : len(found) * (k + 1) // n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = _store(self.path)

        def files() -> Iterator[str]:
            for path, folder in partition.places:
                if folder:
                    yield from (f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)
                else:
                    yield path

        held, size = [], 0
        for path in files():
            own = path.rpartition("/")[2]
            if not own.endswith(self.extension):
                continue
            with store.open_input_stream(path) as f:
                data = f.read()
            held.append((unquote(own[: len(own) - len(self.extension)]), data.decode("utf-8", "replace")))
            size += len(data)
            if len(held) >= BATCH_FILES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["name", "content"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["name", "content"])


class FileSink(DataSource):
    """Options: path, extension (of all names), folders (so many by a hash of the name, 0 for none), and for reading tasks (at most so many). What is appended to a folder with files is a folder in it, as one rename makes it visible."""

    @classmethod
    def name(cls) -> str:
        return "document-files"

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if {f.name for f in schema.fields} != {"name", "content"}:
            raise ValueError("columns are name and content")
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def write_files(files: DataFrame, path: str, extension: str = "", overwrite: bool = True, folders: int = 0) -> None:
    """Writes rows of name and content as files under ``path``."""
    register(files.sparkSession)
    files.select("name", "content").write.format("document-files").mode("overwrite" if overwrite else "append").options(path=path, extension=extension, folders=str(folders)).save()


def read_files(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """Rows of name and content of the files that ``write_files`` wrote under ``path``, in folders or not."""
    register(spark)
    return spark.read.format("document-files").options(path=path, extension=extension, tasks=str(4 * spark.sparkContext.defaultParallelism)).load()
