"""A data source of whole files that has a row for every file of a folder, also for empty and unreadable ones, which Spark's
own file sources leave out or fail on."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes and files of a partition; a file is never cut.
PART_BYTES, PART_FILES = 64 << 20, 2000


@dataclass
class FileList(InputPartition):
    """Files of one partition: (path, modification time in microseconds, length)."""

    files: list[tuple[str, int | None, int]]


def _open(folder: str):
    """File system and path of a folder given as a path or URI (local or mounted folders, and what Arrow has drivers for)."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class WholeFiles(DataSource):
    """Options: ``path`` (folder, read with all its subfolders) and ``glob`` (of file names)."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return WholeFilesReader(self.options)


class WholeFilesReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.glob = options["path"], options.get("glob", "*")

    def partitions(self) -> list[FileList]:
        """Files in the order of their paths, dealt out by bytes and number. Names that begin with . or _ are not data."""
        from pyarrow import fs

        system, folder = _open(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type != fs.FileType.Directory]
        parts, size = [FileList([])], 0
        for info in sorted(found, key=lambda i: i.path):
            if not any(p[:1] in "._" for p in info.path[len(folder):].split("/") if p) and fnmatch.fnmatch(info.base_name, self.glob):
                if parts[-1].files and (size + (info.size or 0) > PART_BYTES or len(parts[-1].files) == PART_FILES):
                    parts.append(FileList([]))
                    size = 0
                parts[-1].files.append((info.path, info.mtime_ns and info.mtime_ns // 1000, info.size or 0))
                size += info.size or 0
        return parts

    def read(self, partition: FileList) -> Iterator[tuple]:
        import datetime as dt

        system, _ = _open(self.folder)
        for path, changed, length in partition.files:
            content = error = None
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            except OSError as problem:
                error = f"unreadable: {type(problem).__name__}"
            time = None if changed is None else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=changed)
            yield path, time, length, content, error


def whole_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content, error): one row per file below the folder; content is NULL where there is an
    error, and empty for an empty file. A folder without files gives no rows."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format("whole_files").option("glob", glob).load(folder)
