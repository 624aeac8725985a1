"""What a versioned folder holds now: numbered entries that are created once and never change; the highest one counts."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    """The few file operations of the driver, on any file system that Spark's Hadoop client knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._new = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self._new(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._new(path))

    def put(self, path: str, data: bytes) -> None:
        """A new file; an error if there is one. On local disks without a checksum beside it, so that users may edit it."""
        own = self.local(path)
        if own is not None:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            with open(own, "xb") as f:
                f.write(data)
            return
        out = self.fs.create(self._new(path), False)
        out.write(bytearray(data))
        out.close()

    def get(self, path: str) -> bytes:
        stream = self.fs.open(self._new(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self._new(path), True)

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self._new(old), self._new(new))

    def local(self, path: str) -> str | None:
        """The path for the operating system, if it is one of its files."""
        if self.fs.getUri().getScheme() != "file":
            return None
        return unquote(urlparse(path).path) if path.startswith("file:") else path


class Pointer:
    """A line of text that is replaced as a whole. Each value is a file of its own, numbered one above the one before, and
    whoever creates that number first has won; so of two writers that start from one value only one succeeds, and a crash
    leaves the old value or the new one. Entries are never deleted, so that no number can be won twice."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def latest(self) -> tuple[int, str | None]:
        """The highest number, and its text; (0, None) if there is none."""
        numbers = [int(n) for n in self.files.names(self.folder) if n.isdigit()]
        if not numbers:
            return 0, None
        return max(numbers), self.files.get(f"{self.folder}/{max(numbers):010d}").decode()

    def advance(self, number: int, text: str) -> bool:
        """Makes text the value of this number, whole or not at all; False if the number is taken. The text is written aside
        first: a link on local disks, elsewhere a rename, which stores refuse where the name is taken."""
        at, aside = f"{self.folder}/{number:010d}", f"{self.folder}/aside-{uuid.uuid4().hex}"
        self.files.put(aside, text.encode())
        try:
            local = self.files.local(at)
            if local is None:
                return not self.files.exists(at) and self.files.rename(aside, at)
            try:
                os.link(self.files.local(aside), local)
            except FileExistsError:
                return False
            return True
        finally:
            self.files.delete(aside)
