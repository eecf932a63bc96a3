"""Small files in the file system that a session's data is in, whatever its scheme."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from weir.errors import StorageError


class Folder:
    """A folder, by path or URI, through Hadoop's file systems; failures are :class:`StorageError`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def of(self, *names: str) -> str:
        return "/".join((self.path, *names))

    def _at(self, *names: str):  # noqa: ANN202
        path = self._fs.Path(self.of(*names))
        return path, path.getFileSystem(self._conf)

    def folders(self) -> list[str]:
        """Names of the folders in this one."""
        path, fs = self._at()
        try:
            return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
        except Py4JJavaError as e:
            raise StorageError(str(e.java_exception)) from None

    def exists(self, *names: str) -> bool:
        path, fs = self._at(*names)
        return fs.exists(path)

    def read(self, *names: str) -> str:
        path, fs = self._at(*names)
        try:
            stream = fs.open(path)
            try:
                return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise StorageError(str(e.java_exception)) from None

    def write(self, text: str, *names: str) -> None:
        """Written beside its place and renamed over it: readers see the old or the new text whole."""
        path, fs = self._at(*names)
        made, _ = self._at(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}")
        try:
            stream = fs.create(made, True)
            try:
                stream.write(bytearray(text.encode()))
                stream.hsync()
            finally:
                stream.close()
            over = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
            over[0] = getattr(self._fs, "Options$Rename").OVERWRITE
            self._fs.FileContext.getFileContext(made.toUri(), self._conf).rename(made, path, over)
        except Py4JJavaError as e:
            raise StorageError(str(e.java_exception)) from None
