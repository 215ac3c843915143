"""Small files of a store, through Hadoop's file systems: lists, texts, and an exclusive publish."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_schemas: dict[tuple[str, int, int], StructType] = {}


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its footers are read for the schema only when it has changed since it was last opened."""
    key = (path, *Files(spark, path).stamp())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


class Files:
    """Files under one root. A published file appears whole and once, or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(n for x in self._fs.listStatus(path) if not (n := x.getPath().getName()).startswith((".", "_"))) if self._fs.exists(path) else []

    def size(self, folder: str) -> int:
        path = self._path(folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def stamp(self, name: str = "") -> tuple[int, int]:
        """Time of the last change and length of a file or folder."""
        status = self._fs.getFileStatus(self._path(name))
        return status.getModificationTime(), status.getLen()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file anew."""
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """The file with this text, unless there is one of the name; then False.

        The text is written under another name and moved. The move is a hard link
        on a local disk and a rename without overwriting elsewhere, which HDFS does
        atomically; a store without such a rename isn't fit for several writers.
        """
        hidden = f"_tmp/{uuid.uuid4().hex}"
        self.write(hidden, text)
        source, target = self._path(hidden), self._path(name)
        self._fs.mkdirs(target.getParent())
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(source.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            if self._fs.exists(target):
                return False
            rename = self._jvm.org.apache.hadoop.fs.Options.Rename
            options = self._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
            try:
                context.rename(source, target, options)
            except Exception:
                if self._fs.exists(target):
                    return False
                raise
            return True
        finally:
            self._fs.delete(source, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))
