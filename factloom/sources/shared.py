"""Small files and folders in the file system that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    spark.sparkContext.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


class Files:
    """What is done to single files of any file system Spark reads: list, read, remove, and write once."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        at = self._at("")
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether name is now a file of this text: written aside and renamed, so no half of it is seen; not if it's there already."""
        to, aside = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        won = not self.fs.exists(to) and self.fs.rename(aside, to)
        if not won:
            self.fs.delete(aside, False)
        return bool(won)

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
