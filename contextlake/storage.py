"""Folders of any file system that Spark can reach: small texts, sizes and removal, by the same calls that Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URI; what lies in it is named relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def path(self, name: str) -> str:
        """The path of ``name``, as Spark reads and writes it."""
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str) -> tuple:
        where = self._hadoop.Path(self.path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        files, where = self._at(name)
        return files.exists(where)

    def read_text(self, name: str) -> str | None:
        """The text of a small file; None if there is none."""
        files, where = self._at(name)
        if not files.exists(where):
            return None
        stream = files.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Replace a small file as a whole: readers see the old text or the new one."""
        files, part = self._at(name + ".part")
        stream = files.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE
        context.rename(part, self._at(name)[1], options)

    def delete(self, name: str) -> None:
        files, where = self._at(name)
        files.delete(where, True)

    def size(self, name: str = "") -> int:
        """Bytes of all files beneath; 0 if there are none."""
        files, where = self._at(name)
        return files.getContentSummary(where).getLength() if files.exists(where) else 0
