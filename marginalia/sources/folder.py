"""A shared folder with files that appear whole and only once."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

# Some local file systems check for the target and rename in two steps; writers of one process take turns.
_TURN = threading.Lock()


class Folder:
    """Names are relative to ``root``, which may be in any file system that Hadoop knows.

    ``publish`` is the one operation that decides between writers: it renames a file or directory
    that is written already, and fails when the name is taken. It is as atomic as the rename of the
    file system (HDFS, and local ones within a process); object stores without one are not enough.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._new_path = hadoop.Path
        self._options = getattr(hadoop, "Options$Rename")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)
        self._context = hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)

    def _path(self, name: str):
        return self._new_path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def scratch(self, folder: str) -> str:
        """A new name that readers of ``folder`` ignore."""
        return f"{folder}/_new-{uuid.uuid4().hex}"

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._files.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(path))

    def publish(self, written: str, name: str) -> bool:
        """Give what is written its name. False when the name is taken; then ``written`` is removed."""
        with _TURN:
            if not self._files.exists(self._path(name)):
                self._files.mkdirs(self._path(name).getParent())
                none = self.spark.sparkContext._gateway.new_array(self._options, 1)
                none[0] = self._options.NONE
                try:
                    self._context.rename(self._path(written), self._path(name), none)
                    return True
                except Exception as error:  # py4j wraps all of Java's errors alike
                    if "FileAlreadyExists" not in str(error):
                        raise
        self.remove(written)
        return False

    def create(self, name: str, content: str) -> bool:
        """A small file with ``content``; False when there is one of that name."""
        written = self.scratch(name.rsplit("/", 1)[0])
        stream = self._files.create(self._path(written), True)
        stream.write(bytearray(content.encode()))
        stream.close()
        return self.publish(written, name)

    def content(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            size = self._files.getFileStatus(self._path(name)).getLen()
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)
