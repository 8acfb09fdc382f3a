"""Small files on the Hadoop file system, and commits that refuse to replace one another."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published the name first."""


class Folder:
    """A folder of a store, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str, whole: bool = False):
        """A Hadoop path: of a name within the folder, or of a whole path."""
        return self._jvm.org.apache.hadoop.fs.Path(name if whole else f"{self.path}/{name}" if name else self.path)

    def make(self, name: str) -> None:
        """Create a folder unless it is there."""
        self.fs.mkdirs(self.at(name))

    def names(self, name: str) -> list[str]:
        """Names of what a folder holds, sorted; none if it is not there."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.at(name), True)

    def load(self, name: str):
        """A JSON file's value."""
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, name: str, value) -> None:
        """Write a value as a JSON file of a name that nobody else uses."""
        out = self.fs.create(self.at(name), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def publish(self, name: str, value) -> None:
        """Write a value as a JSON file whole and at once; Conflict if the name is taken.

        A hard link on a local file system, elsewhere a rename that refuses to
        replace; both are one step of the file system.
        """
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        self.save(temporary, value)
        try:
            if self.fs.getUri().getScheme() == "file":
                plain = lambda p: self._jvm.java.nio.file.Paths.get(self.fs.makeQualified(self.at(p)).toUri())
                self._jvm.java.nio.file.Files.createLink(plain(name), plain(temporary))
            else:
                self.rename(temporary, name)
        except Exception as error:
            if not self.exists(name):
                raise
            raise Conflict(f"{name} is there already") from error
        finally:
            self.fs.delete(self.at(temporary), False)

    def rename(self, old: str, new: str) -> None:
        """Rename that refuses to replace."""
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        refuse = self.spark.sparkContext._gateway.new_array(kinds, 1)
        refuse[0] = kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(self.at(old)), self.fs.makeQualified(self.at(new)), refuse)
