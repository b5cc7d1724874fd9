"""Every file below a folder, hidden ones included, as a Python data source.

Spark's readers leave out names that begin with a dot or an underscore.  ``spark.read.format("folder_listing").load(path)``
gives a row for each file: relative_path, length, modified, hidden (a part of the path begins with a dot) and error.  Each
entry of the top folder is a partition, listed by a task of its own; a folder that can't be listed gives a row that says so.

The folder is read by pyarrow's file systems (local paths, hdfs, s3 and others by URI).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LISTING = "relative_path string, length long, modified timestamp, hidden boolean, error string"


def file_system(uri: str) -> tuple:
    """(pyarrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    local = re.match(r"file:/+", uri)
    if local or ":/" not in uri:
        return fs.LocalFileSystem(), "/" + uri[local.end() :] if local else uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Entry(InputPartition):
    path: str
    folder: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def partitions(self) -> list[Entry]:
        from pyarrow import fs

        store, path = file_system(self.root)
        return [Entry(x.path, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(path))] or [Entry("", False)]

    def read(self, partition: Entry) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        store, root = file_system(self.root)
        relative = lambda path: path[len(root.rstrip("/")) + 1 :]
        try:
            found = store.get_file_info(fs.FileSelector(partition.path, recursive=True)) if partition.folder else [store.get_file_info(partition.path)]
        except OSError as e:
            yield relative(partition.path), None, None, False, f"{type(e).__name__}: {e}"
            return
        for x in found:
            if x.type == fs.FileType.File:
                name = relative(x.path)
                yield name, x.size, x.mtime, any(p.startswith(".") for p in name.split("/")), None


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"])


def listing(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(folder)
