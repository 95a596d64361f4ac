"""Files by their names, whatever those are: a Spark data source that lists and reads in tasks.

Spark's own file sources hide names that begin with ``_`` or ``.``. ``FolderFiles`` does not:
one partition per folder ``db_id=<id>`` (or per page of one) lists it where the task runs and
reads what is asked for. It also writes: one file per row, and a file that is there already
with other bytes is an error.

    spark.dataSource.register(FolderFiles)
    spark.read.format("folder_files").option("suffix", ".sql").load("s3a://lake/scripts")

Options: ``suffix`` keeps names that end so; ``at`` reads that one path inside every folder
instead of listing it; ``hidden`` keeps names that Spark hides only; ``content`` ``false``
leaves the bytes out; ``pages`` deals each folder to so many tasks by the hash of the name.

Plain paths and ``file:`` are reached by the operating system, everything else by
``pyarrow.fs``, which knows ``s3``, ``gs``, ``abfs`` and ``hdfs``.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FILES = "db_id string, name string, path string, content binary"
_FOLDER = "db_id="
_ROWS = 256
_BYTES = 32 << 20


class LocalFolder:
    """Names and bytes by the operating system; names that are no UTF-8 are kept readable."""

    def __init__(self, url: str):
        self.root = unquote(urlsplit(url).path) if url.startswith("file:") else url

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def names(self, *inside: str, folders: bool = False) -> Iterator[str]:
        try:
            with os.scandir(self.path(*inside)) as found:
                yield from sorted(e.name for e in found if (e.is_dir() if folders else e.is_file()))
        except FileNotFoundError:
            return

    def read(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def create(self, path: str, content: bytes) -> None:
        """A new file with all its bytes or none: written aside, then linked to its name."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with open(aside, "xb") as f:
            f.write(content)
        try:
            os.link(aside, path)
        except FileExistsError:
            if self.read(path) != content:
                raise
        finally:
            os.unlink(aside)


class RemoteFolder:
    """The same over ``pyarrow.fs``; objects appear whole, so no name aside is needed."""

    def __init__(self, url: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def names(self, *inside: str, folders: bool = False) -> Iterator[str]:
        from pyarrow import fs

        kind = fs.FileType.Directory if folders else fs.FileType.File
        found = self.store.get_file_info(fs.FileSelector(self.path(*inside), allow_not_found=True))
        yield from sorted(i.base_name for i in found if i.type == kind)

    def read(self, path: str) -> bytes | None:
        try:
            with self.store.open_input_stream(path) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def create(self, path: str, content: bytes) -> None:
        there = self.read(path)
        if there is None:
            self.store.create_dir(path.rpartition("/")[0], recursive=True)
            with self.store.open_output_stream(path) as f:
                f.write(content)
        elif there != content:
            raise FileExistsError(path)


def folder(url: str) -> LocalFolder | RemoteFolder:
    return RemoteFolder(url) if "://" in url and not url.startswith("file:") else LocalFolder(url)


def _readable(name: str) -> str:
    """Bytes that are no UTF-8 come as surrogates; Spark's text has none."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Page(InputPartition):
    def __init__(self, name: str, number: int):
        super().__init__((name, number))
        self.name, self.number = name, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.suffix, self.at = options.get("suffix", ""), options.get("at")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.with_content = options.get("content", "true").lower() == "true"
        self.pages = 1 if self.at else max(1, int(options.get("pages", "1")))

    def partitions(self) -> list[Page]:
        folders = [n for n in folder(self.root).names(folders=True) if n.startswith(_FOLDER)]
        return [Page(n, k) for n in folders for k in range(self.pages)] or [Page("", 0)]

    def _names(self, store, page: Page) -> Iterator[str]:
        if self.at:
            yield self.at
            return
        for name in store.names(page.name):
            mine = zlib.crc32(os.fsencode(name)) % self.pages == page.number
            if mine and name.endswith(self.suffix) and (not self.hidden or name[:1] in ("_", ".")):
                yield name

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if not page.name:
            return
        store = folder(self.root)
        db_id = _readable(page.name[len(_FOLDER) :])
        rows, size = [], 0
        for name in self._names(store, page):
            path = store.path(page.name, *name.split("/"))
            content = store.read(path) if self.with_content or self.at else None
            if content is None and (self.at or self.with_content):
                continue  # not there, or gone since it was listed
            rows.append((db_id, _readable(name), _readable(path), content))
            size += len(content or b"")
            if len(rows) >= _ROWS or size >= _BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["db_id", "name", "path", "content"])


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows) -> WriterCommitMessage:
        store = folder(self.root)
        for row in rows:
            if "/" in row.name or row.name in ("", ".", "..") or "/" in row.db_id:
                raise ValueError(f"no file name: {row.db_id}/{row.name}")
            store.create(store.path(_FOLDER + row.db_id, row.name), bytes(row.content))
        return WriterCommitMessage()


class FolderFiles(DataSource):
    """See the module's text.  A task that runs again finds its own files and leaves them."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """db_id, name, path, content of the files under ``root/db_id=<id>/``."""
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").options(**options).load(root)


#: Files that one task writes.
WRITTEN = 1_000


def dealt(files: DataFrame) -> DataFrame:
    """``files`` over as many tasks as their number asks for: making a file costs more than
    sending its bytes, and tables are split by their bytes only."""
    return files.repartition(-(-files.count() // WRITTEN) or 1)


def write_files(files: DataFrame, root: str) -> None:
    """One file ``root/db_id=<id>/<name>`` per row of db_id, name, content."""
    files.sparkSession.dataSource.register(FolderFiles)
    dealt(files.select("db_id", "name", "content")).write.format("folder_files").mode("append").save(root)
