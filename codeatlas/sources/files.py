"""Small files and folders in whatever store Spark writes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    """A store by one of its paths: listing, small texts, moves and deletions on the driver; tables are read and written by Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; nothing where there is no folder."""
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        """Bytes of the data files in a folder, by name."""
        found = self._fs.listStatus(self._path(path))
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and s.getPath().getName()[0] not in "._"}

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name, whoever wrote it first."""
        p = self._path(path)
        if self._fs.exists(p):
            return False
        try:
            stream = self._fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def move(self, source: str, target: str) -> None:
        """A folder to a path that is free, whose parents are made."""
        to = self._path(target)
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(self._path(source), to):
            raise FileExistsError(f"'{source}' can't be moved to '{target}'")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def shared_top(spark: SparkSession) -> str:
    """The folder that the session names for all executors; only where every task runs on this machine may it be a local one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return f"file://{tempfile.gettempdir()}/code-lists/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that all executors see."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
