"""Small files in a folder that all executors share: any Hadoop file system (HDFS, object stores, local disks)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class SharedPath:
    """A path on a Hadoop file system, with the few operations a store needs."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.uri = spark, uri.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(self.uri)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> SharedPath:
        return SharedPath(self.spark, f"{self.uri}/{name}")

    def __str__(self) -> str:
        return self.uri

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def size(self) -> int:
        return self._fs.getFileStatus(self._path).getLen()

    def mkdir(self) -> None:
        self._fs.mkdirs(self._path)

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        """Write the file whole or not at all: a new file beside it takes its place in one step."""
        self._fs.mkdirs(self._path.getParent())
        new = SharedPath(self.spark, f"{self.uri}.{uuid.uuid4().hex}.tmp")
        new._create(text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new._path, self._path, options)

    def create(self) -> bool:
        """Create an empty file; False where there is one already. Of several writers one succeeds."""
        try:
            self._create("")
        except Exception as e:  # noqa: BLE001 - py4j wraps every error of the JVM
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _create(self, text: str) -> None:
        stream = self._fs.create(self._path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self) -> None:
        self._fs.delete(self._path, True)

    def files(self) -> Iterator[tuple[str, SharedPath]]:
        """(relative name, path) of the files below, in order of name."""
        if self.exists():
            found, base = self._fs.listFiles(self._path, True), self._fs.makeQualified(self._path).toString()
            names = []
            while found.hasNext():
                names.append(found.next().getPath().toString()[len(base) + 1 :])
            for name in sorted(names):
                if not name.endswith((".tmp", ".crc")):
                    yield name, self / name
