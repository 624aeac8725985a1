"""Extractors of book formats as Spark data sources: spark.read.format("epub").load(folder), and formats of one's own.

An extractor is one file's bytes to rows. The data source lists files, deals them out by their bytes, looks at each before and
after it was read, and holds the fingerprint that the extractor says it read against the file's own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import epub, pdf
from .binary import MAGIC, MOST_BYTES

#: Bytes of files in one partition, about; a larger file has one to itself.
PARTITION_BYTES = 64 << 20


class Extractor:
    """A format: its name, the suffix of its files, what they begin with, and the schema of its rows. The schema has path,
    fingerprint and error, strings, which the data source fills in."""

    name: str
    suffix: str
    magic: bytes = b""
    schema: str = epub.SCHEMA

    def extract(self, data: bytes) -> tuple[str, list[dict]]:
        """The SHA-256 of the bytes that were read, and rows without path, fingerprint and error. Whatever it raises makes an
        error row."""
        raise NotImplementedError


class Epub(Extractor):
    name, suffix, magic = "epub", ".epub", MAGIC["epub"]

    def extract(self, data: bytes) -> tuple[str, list[dict]]:
        meta, found = epub.read(data)
        return hashlib.sha256(data).hexdigest(), [meta | c for c in found]


class Pdf(Extractor):
    """Rows are pages."""

    name, suffix, magic, schema = "pdf", ".pdf", MAGIC["pdf"], pdf.SCHEMA

    def extract(self, data: bytes) -> tuple[str, list[dict]]:
        return hashlib.sha256(data).hexdigest(), pdf.pages_of(data)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def listed(path: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of the files under a folder, or of one file, by path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size, f.mtime_ns) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def dealt(files: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Files in groups of at most `most` bytes, the largest first; a larger file is a group of its own."""
    groups: list = []
    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        at = next((g for g in groups[-64:] if g[0] + f[1] <= most), None)
        if at is None:
            groups.append(at := [0, []])
        at[0] += f[1]
        at[1].append(f)
    return [g for _, g in groups]


class Reader(DataSourceReader):
    def __init__(self, extractor: Extractor, schema: T.StructType, options: dict):
        self.extractor, self.names = extractor, schema.fieldNames()
        self.path, self.most = options["path"], int(options.get("mostbytes", MOST_BYTES))
        self.each = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [Files(g) for g in dealt(listed(self.path, self.extractor.suffix), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{os.path.abspath(self.path)}"
        system, _ = fs.FileSystem.from_uri(uri)
        for path, size, changed in partition.files:
            own = {"path": path}
            if size > self.most:
                yield self.row(own | {"error": "EXTRACTION_FAILED"})
                continue
            with system.open_input_file(path) as f:
                data = f.read()
            after = system.get_file_info(path)
            if (len(data), after.size, after.mtime_ns) != (size, size, changed):
                yield self.row(own | {"error": "SOURCE_CHANGED"})
                continue
            own["fingerprint"] = hashlib.sha256(data).hexdigest()
            if not data.startswith(self.extractor.magic):
                yield self.row(own | {"error": "UNSUPPORTED_FORMAT"})
                continue
            try:
                echo, rows = self.extractor.extract(data)
            except pdf.Encrypted:
                yield self.row(own | {"error": "ENCRYPTED_DOCUMENT"})
                continue
            except Exception:
                yield self.row(own | {"error": "EXTRACTION_FAILED"})
                continue
            if echo != own["fingerprint"]:  # it read something else
                yield self.row(own | {"error": "SOURCE_CHANGED"})
                continue
            for r in rows or [{"error": "EXTRACTION_FAILED"}]:
                yield self.row(own | r)

    def row(self, values: dict) -> tuple:
        return tuple(_plain(values.get(n)) for n in self.names)


def _plain(value):
    if isinstance(value, dict):
        return Row(**value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


def source_of(extractor: Extractor) -> type[DataSource]:
    """The data source of an extractor. Options: path, partitionBytes, mostBytes."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return extractor.name

        def schema(self) -> str:
            return extractor.schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(extractor, schema, {k.lower(): v for k, v in self.options.items()})

    return Source


class Extractors:
    """Formats by name. Those of one's own may not take a built-in one's name or suffix, or each other's (ValueError); they give
    rows of epub.SCHEMA, a chapter each, if the library is to import them."""

    def __init__(self, spark: SparkSession, custom: list[Extractor] = ()):
        self.custom = list(custom)
        taken_names, taken_suffixes = {"epub", "pdf"}, {".epub", ".pdf"}
        for x in self.custom:
            if x.name in taken_names or x.suffix in taken_suffixes or not x.suffix.startswith("."):
                raise ValueError(f"the format {x.name} can't be registered")
            taken_names.add(x.name)
            taken_suffixes.add(x.suffix)
        for x in (Epub(), Pdf(), *self.custom):
            spark.dataSource.register(source_of(x))
