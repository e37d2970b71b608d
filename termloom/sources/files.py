"""Small control files and folders through Hadoop's file systems, so any store that Spark knows works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """One folder: reads, atomic writes, files that are created once, listing, deletion."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, name: str = "") -> tuple[int, int]:
        """Bytes and files below ``name``."""
        if not self._fs.exists(self._path(name)):
            return 0, 0
        summary = self._fs.getContentSummary(self._path(name))
        return summary.getLength(), summary.getFileCount()

    def read(self, name: str) -> str | None:
        """The content of a small file; None if it is not there."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _put(self, name: str, content: str, durable: bool) -> None:
        # without the local file system's checksum files, which would have to change in the same step
        stream = (self._fs.getRawFileSystem() if self._local else self._fs).create(self._path(name), True)
        try:
            stream.write(content.encode("utf-8"))
            if durable:
                stream.hsync()
        finally:
            stream.close()

    def temporary(self, name: str) -> str:
        """A hidden name beside ``name`` that nobody else has."""
        above, _, last = name.rpartition("/")
        return f"{above}/.{last}.{uuid.uuid4().hex}" if above else f".{last}.{uuid.uuid4().hex}"

    def _nio(self, name: str):
        return self._jvm.java.io.File(self._path(name).toUri().getPath()).toPath()

    def _rename(self, name: str, to: str, overwrite: bool) -> None:
        if self._local and overwrite:
            how = self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.CopyOption, 1)
            how[0] = self._jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            self._jvm.java.nio.file.Files.move(self._nio(name), self._nio(to), how)
            return
        kinds = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(name), self._path(to), options)

    def write(self, name: str, content: str, durable: bool = False) -> None:
        """Replaces a small file in one step: readers see the old content or the new."""
        temporary = self.temporary(name)
        self._put(temporary, content, durable)
        self._rename(temporary, name, True)

    def write_new(self, name: str, content: str, durable: bool = False) -> bool:
        """Creates a small file, whole from the start, unless it is there: of several writers only one is told True."""
        temporary = self.temporary(name)
        self._put(temporary, content, durable)
        return self.publish(temporary, name)

    def publish(self, temporary: str, name: str, keep: bool = False) -> bool:
        """Gives a written file or folder its name unless that is taken; the temporary one goes then too, but for ``keep``.

        Renaming without overwriting is one step in HDFS. A local file system would overwrite, so files get
        their name there as a link, which fails if the name exists; a folder cannot be renamed to one
        that is not empty.
        """
        try:
            if self._local and self._fs.getFileStatus(self._path(temporary)).isFile():
                self._jvm.java.nio.file.Files.createLink(self._nio(name), self._nio(temporary))
            else:
                self._rename(temporary, name, False)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.exists(name):
                return False
            raise
        finally:
            if not keep:
                self.delete(temporary)
