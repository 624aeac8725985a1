"""Formats as data sources: the same rows as by the operators, files dealt by bytes, own formats, and refusals."""

import hashlib
import os

import pytest
from test_library import book
from pyspark.sql import functions as F

from vellumlake.sources import binary, epub, extractors
from vellumlake.service import Service


def lines_format(lie=False):
    """A format of text files whose paragraphs are chapters; lie: it tells of bytes that it didn't read."""

    class Lines(extractors.Extractor):
        name, suffix, magic = ("lying" if lie else "lines"), (".lie" if lie else ".lines"), b"#"

        def extract(self, data):
            title, *parts = data.decode().split("\n\n")
            rows = [{"title": title, "author": "", "language": "en", "chapter_index": i, "chapter_title": p.split("\n")[0], "content": p, "source_locator": f"part:{i}"} for i, p in enumerate(parts)]
            return hashlib.sha256(data[: 10 if lie else None]).hexdigest(), rows

    return Lines()


def test_epub_source_is_the_operator(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "other.epub").write_bytes(b"text")
    extractors.Extractors(spark)
    got = spark.read.format("epub").option("partitionBytes", 1).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 6
    fields = [c for c in got.columns if c != "path"]
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    want = epub.chapters(binary.files(spark, str(tmp_path)).where("error is null")).select(name, *fields)
    assert sorted(map(tuple, got.where("error is null or error <> 'UNSUPPORTED_FORMAT'").select(name, *fields).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(os.path.basename(r.path), r.error) for r in got.where("error is not null").collect()} == {("bad.epub", "EXTRACTION_FAILED"), ("other.epub", "UNSUPPORTED_FORMAT")}
    large = spark.read.format("epub").option("mostBytes", 10).load(str(tmp_path)).collect()
    assert {r.error for r in large if os.path.basename(r.path) in "0123.epub"} == {"EXTRACTION_FAILED"}


def test_files_are_dealt_by_bytes():
    files = [(f"f{i}", n, 0) for i, n in enumerate([5, 90, 40, 60, 200, 10])]
    groups = extractors.dealt(files, 100)
    assert sorted(x for g in groups for x in g) == sorted(files)
    assert [sum(f[1] for f in g) for g in groups] == [200, 100, 100, 5] and extractors.dealt([], 10) == []


def test_own_formats_are_imported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.lines").write_text("# Book\n\nFirst part\nx\n\nSecond part\ny")
    (tmp_path / "in/a.epub").write_bytes(book())
    (tmp_path / "in/b.lie").write_text("# Book of another\n\nPart")
    s = Service(spark, str(tmp_path / "lib"), extractors=[lines_format(), lines_format(lie=True)])
    got = {os.path.basename(r.path): (r.book_id, r.error) for r in s.import_path(str(tmp_path / "in")).collect()}
    assert got["b.lie"] == (None, "SOURCE_CHANGED") and got["a.epub"][1] is None
    assert [(r.title, r.content) for r in s.get_chapter(got["a.lines"][0], 1).collect()] == [("Second part", "Second part\ny")]
    assert {r.format: r.total_chapters for r in s.tables["books"].read().collect()}["lines"] == 2
    again = {os.path.basename(r.path): r.book_id for r in s.import_path(str(tmp_path / "in")).collect()}
    assert again["a.lines"] == got["a.lines"][0] and s.tables["books"].read().count() == 2


def test_a_file_that_changes_is_told(tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.lines").write_text("# Book\n\nPart")
    reader = extractors.Reader(lines_format(), T.StructType([T.StructField(c.split()[0], T.StringType()) for c in epub.SCHEMA.split(", ")]), {"path": str(tmp_path)})
    (planned,) = reader.partitions()
    (tmp_path / "a.lines").write_text("# Book\n\nAnother part")
    assert [r[-1] for r in reader.read(planned)] == ["SOURCE_CHANGED"]


@pytest.mark.parametrize(("name", "suffix"), [("epub", ".x"), ("x", ".pdf"), ("x", "x")])
def test_names_that_are_taken(spark, name, suffix):
    own = lines_format()
    own.name, own.suffix = name, suffix
    with pytest.raises(ValueError, match="registered"):
        extractors.Extractors(spark, [own])
