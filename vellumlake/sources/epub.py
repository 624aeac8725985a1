"""EPUB archives as chapters. An archive is checked whole before any member is read."""

from __future__ import annotations

import io
import posixpath
import re
import stat
import unicodedata
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

from vellumlake.operators.xhtml import extract

#: Limits of an archive, and what nested archives are called and begin with.
MOST_MEMBERS, MOST_TOTAL, MOST_MEMBER, MOST_RATIO = 10_000, 1 << 30, 128 << 20, 100
ARCHIVES = (".zip", ".epub", ".jar", ".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".xz", ".txz", ".7z", ".rar", ".zst", ".lz", ".lzma", ".cab", ".iso", ".apk", ".war", ".ear", ".cbz", ".cbr", ".docx", ".xlsx", ".pptx", ".odt", ".odp", ".ods", ".deb", ".rpm", ".ipa", ".xpi", ".whl", ".ar", ".xar")
MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"\x28\xb5\x2f\xfd", b"LZIP", b"MSCF", b"\x5d\x00\x00\x80", b"!<arch>\n", b"xar!", b"\xed\xab\xee\xdb")
SCHEMA = "path string, fingerprint string, title string, author string, language string, chapter_index int, chapter_title string, content string, source_locator string, error string"


class Refused(ValueError):
    pass


def check(z: zipfile.ZipFile) -> None:
    names, total = set(), 0
    if len(z.infolist()) > MOST_MEMBERS:
        raise Refused("too many members")
    for m in z.infolist():
        name = unicodedata.normalize("NFC", m.filename)
        parts = name.rstrip("/").split("/")
        if not name or name.startswith("/") or "\\" in m.orig_filename or "\x00" in m.orig_filename or re.match(r"[A-Za-z]:", name) or any(p in ("", ".", "..") for p in parts):
            raise Refused("unsafe name")
        if name.casefold() in names:
            raise Refused("two members of one name")
        names.add(name.casefold())
        if m.flag_bits & 1:
            raise Refused("encrypted")
        if stat.S_ISLNK(m.external_attr >> 16):
            raise Refused("link")
        total += m.file_size
        if m.file_size > MOST_MEMBER or total > MOST_TOTAL or m.file_size > MOST_RATIO * max(m.compress_size, 1):
            raise Refused("too large")
        if not m.is_dir():
            if name.lower().endswith(ARCHIVES):
                raise Refused("nested archive")
            with z.open(m) as f:
                head = f.read(264)
            if head.startswith(MAGIC) or head[257:262] == b"ustar":
                raise Refused("nested archive")


def xml(data: bytes) -> ElementTree.Element:
    """A tree; document types and entities are refused."""

    def refuse(*_):
        raise Refused("document type")

    guard = expat.ParserCreate()
    guard.StartDoctypeDeclHandler = guard.EntityDeclHandler = refuse
    guard.Parse(data, True)
    return ElementTree.fromstring(data)


def resolve(base: str, href: str) -> tuple[str, str]:
    """(member, fragment) that a reference names from a member; only within the archive."""
    u = urlsplit(href)
    if u.scheme or u.netloc:
        raise Refused("outside reference")
    path = unquote(u.path)
    if path.startswith("/") or "\\" in path:
        raise Refused("outside reference")
    at = posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base
    if at.startswith(".."):
        raise Refused("outside reference")
    return at, u.fragment


OCF, OPF, DC, NCX, XH = "{urn:oasis:names:tc:opendocument:xmlns:container}", "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}", "{http://www.daisy.org/z3986/2005/ncx/}", "{http://www.w3.org/1999/xhtml}"
EPUB_TYPE = "{http://www.idpf.org/2007/ops}type"


def _one(x, tag):
    found = [c for c in x if c.tag == tag]
    if len(found) != 1:
        raise Refused(f"not one {tag}")
    return found[0]


def labels(z: zipfile.ZipFile, opf: str, manifest: dict, toc: str | None) -> dict[str, str]:
    """The first label of each member, from the navigation document, else from the NCX."""
    out: dict[str, str] = {}
    nav = next((m for m in manifest.values() if "nav" in m["properties"].split()), None)
    if nav is not None:
        for n in xml(z.read(nav["member"])).iter(f"{XH}nav"):
            if "toc" in n.get(EPUB_TYPE, "").split():
                for a in n.iter(f"{XH}a"):
                    text = " ".join("".join(a.itertext()).split())
                    if a.get("href") and text:
                        out.setdefault(resolve(nav["member"], a.get("href"))[0], text)
        return out
    ncx = manifest.get(toc) or next((m for m in manifest.values() if m["type"] == "application/x-dtbncx+xml"), None)
    if ncx is not None:
        for p in xml(z.read(ncx["member"])).iter(f"{NCX}navPoint"):
            text = " ".join((p.findtext(f"{NCX}navLabel/{NCX}text") or "").split())
            src = p.find(f"{NCX}content")
            if text and src is not None and src.get("src"):
                out.setdefault(resolve(ncx["member"], src.get("src"))[0], text)
    return out


def read(content: bytes) -> tuple[dict, list[dict]]:
    """Metadata, and the chapters in spine order; they are numbered after leaving out what isn't read."""
    z = zipfile.ZipFile(io.BytesIO(content))
    check(z)
    roots = [r for r in xml(z.read("META-INF/container.xml")).iter(f"{OCF}rootfile")]
    if not roots or not roots[0].get("full-path"):
        raise Refused("no package")
    opf, _ = resolve("", roots[0].get("full-path"))
    package = xml(z.read(opf))
    meta, items, spine = (_one(package, f"{OPF}{n}") for n in ("metadata", "manifest", "spine"))
    first = lambda n: next((t for x in meta if x.tag == f"{DC}{n}" and (t := " ".join("".join(x.itertext()).split()))), "")
    if not first("title"):
        raise Refused("no title")
    manifest = {}
    for x in items:
        if x.tag == f"{OPF}item":
            if x.get("id") in manifest or not x.get("href"):
                raise Refused("manifest")
            manifest[x.get("id")] = {"member": resolve(opf, x.get("href"))[0], "type": x.get("media-type", ""), "properties": x.get("properties", "")}
    named = labels(z, opf, manifest, spine.get("toc"))
    out = []
    for ref in spine:
        if ref.tag != f"{OPF}itemref" or ref.get("linear", "yes") == "no":
            continue
        m = manifest.get(ref.get("idref"))
        if m is None:
            raise Refused("spine")
        if m["type"] != "application/xhtml+xml":
            continue
        heading, text = extract(z.read(m["member"]).decode("utf-8", "replace"))
        if text is None:
            raise Refused("too deep")
        if text:
            out.append({"chapter_index": len(out), "chapter_title": (named.get(m["member"]) or heading or f"Chapter {len(out) + 1}")[:500], "content": text, "source_locator": f"epub:{m['member']}"})
    if not out:
        raise Refused("no chapters")
    return {"title": first("title")[:500], "author": first("creator")[:300], "language": first("language")[:40]}, out


def chapters(books: DataFrame) -> DataFrame:
    """A row for each chapter of books (path, fingerprint, content); a book that can't be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for df in batches:
            for path, fingerprint, content in zip(df["path"], df["fingerprint"], df["content"], strict=True):
                own = {"path": path, "fingerprint": fingerprint}
                try:
                    meta, found = read(bytes(content))
                    rows = [own | meta | c for c in found]
                except Exception:
                    rows = [own | {"error": "EXTRACTION_FAILED"}]
                out = pd.DataFrame(rows, columns=names).astype({"chapter_index": "Int32"}).astype(object)
                yield out.where(out.notna(), None)

    return books.select("path", "fingerprint", "content").mapInPandas(run, SCHEMA)
