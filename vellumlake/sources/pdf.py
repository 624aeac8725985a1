"""PDF text layers as page rows, by a small reader of objects, streams and text operators; the rest is operators.pages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.functions.text import lines, sanitized

#: Pages of a book at most, and the share of a page's height that is its edge.
MOST_PAGES, EDGE = 5000, 0.12
SCHEMA = "path string, fingerprint string, title string, author string, page int, pages int, raw string, top array<string>, bottom array<string>, outline array<struct<title:string,start:int>>, error string"

_obj = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
_stream = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_token = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_escape = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Encrypted(ValueError):
    pass


def string(raw: bytes) -> str:
    """A literal or hexadecimal string."""
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n", b"\r") else _escape.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


class Document:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise Encrypted
        self.objects = {int(m[1]): m[3] for m in _obj.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                raw, first, n = self.stream(body), self.number(body, b"First"), self.number(body, b"N")
                heads = [int(x) for x in raw[:first].split()][: 2 * n]
                ends = [*heads[3::2], len(raw) - first]
                for k, a, b in zip(heads[::2], heads[1::2], ends, strict=True):
                    self.objects.setdefault(k, raw[first + a : first + b])
        self.trailer = b" ".join(re.findall(rb"trailer(.*?)startxref", data, re.DOTALL)) + b" ".join(b for b in self.objects.values() if re.search(rb"/Type\s*/XRef", b))

    def number(self, body: bytes, key: bytes) -> int:
        return int(re.search(rb"/" + key + rb"\s+(\d+)", body)[1])

    def stream(self, body: bytes) -> bytes:
        m = _stream.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def ref(self, body: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(m[1]) if m else None

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def get(self, key: int | None) -> bytes:
        return self.objects.get(key, b"")

    def pages(self) -> list[int]:
        out, todo = [], [self.ref(self.get(self.ref(self.trailer, b"Root")), b"Pages")]
        while todo:
            k = todo.pop(0)
            if re.search(rb"/Type\s*/Pages\b", self.get(k)):
                todo = self.refs(self.get(k), b"Kids") + todo
            elif k in self.objects:
                out.append(k)
            if len(out) > MOST_PAGES:
                raise ValueError("too many pages")
        return out

    def text_of(self, body: bytes, key: bytes) -> str:
        m = re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", body, re.DOTALL)
        return string(m[1]) if m else ""

    def outline(self, pages: list[int]) -> list[tuple[str, int]]:
        place = {k: n for n, k in enumerate(pages)}
        out: list = []
        k = self.ref(self.get(self.ref(self.get(self.ref(self.trailer, b"Root")), b"Outlines")), b"First")
        todo, seen = [k], set()
        while todo:
            k = todo.pop()
            if k is None or k in seen:
                continue
            seen.add(k)
            body = self.get(k)
            dest = self.refs(body, b"Dest") or self.refs(body, b"D")
            out.append((self.text_of(body, b"Title"), place.get(dest[0], -1) if dest else -1))
            todo += [self.ref(body, b"Next"), self.ref(body, b"First")]
        return out

    def page(self, key: int) -> tuple[str, set, set]:
        """Text, and the lines in the upper and lower edge."""
        body = self.get(key)
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body)
        height = float(box[4]) if box else 792.0
        data = b"\n".join(self.stream(self.get(k)) for k in self.refs(body, b"Contents"))
        rows, stack, y, lead, last = [], [], 0.0, 0.0, None
        array = None

        def show(s):
            nonlocal last
            if last is not None and abs(last - y) < 0.01 and rows:
                rows[-1] = (y, rows[-1][1] + s)
            else:
                rows.append((y, s))
            last = y

        for m in _token.finditer(data):
            t = m[0]
            if t[:1] in b"(<":
                (stack if array is None else array).append(string(t))
            elif t == b"[":
                array = []
            elif t == b"]":
                stack.append(array)
                array = None
            elif t[:1] == b"/":
                stack.append(t)
            elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
                (stack if array is None else array).append(float(t))
            else:
                if t == b"BT":
                    y = 0.0
                elif t in (b"Td", b"TD") and len(stack) >= 2:
                    y += stack[-1]
                    lead = -stack[-1] if t == b"TD" else lead
                elif t == b"TL" and stack:
                    lead = stack[-1]
                elif t == b"Tm" and len(stack) >= 6:
                    y = stack[-1]
                elif t == b"T*":
                    y -= lead
                elif t in (b"Tj", b"'", b'"') and stack:
                    y -= lead if t != b"Tj" else 0
                    show(stack[-1] if isinstance(stack[-1], str) else "")
                elif t == b"TJ" and stack and isinstance(stack[-1], list):
                    show("".join(x if isinstance(x, str) else " " if x < -200 else "" for x in stack[-1]))
                stack = []
        edge = lambda keep: {s.rstrip() for y_, s in rows if keep(y_) and s.strip()}
        low = edge(lambda v: v <= height * EDGE)
        return "\n".join(s for _, s in rows), edge(lambda v: height * (1 - EDGE) <= v), low


def pages_of(content: bytes) -> list[dict]:
    """A row for each page: page, pages, raw, top and bottom, with title, author and outline on the first."""
    d = Document(content)
    keys = d.pages()
    info = d.get(d.ref(d.trailer, b"Info"))
    meta = {"title": d.text_of(info, b"Title"), "author": d.text_of(info, b"Author"), "outline": [{"title": a, "start": b} for a, b in d.outline(keys)]}
    rows = []
    for n, k in enumerate(keys):
        raw, top, bottom = d.page(k)
        rows.append({"page": n, "pages": len(keys), "raw": raw, "top": sorted(top), "bottom": sorted(bottom)} | (meta if n == 0 else {}))
    return rows


def page_rows(books: DataFrame) -> DataFrame:
    """A row for each page of books (path, fingerprint, content), with the book's metadata and outline on the first; a book
    that can't be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.sub(r"<.*?>+", "", SCHEMA).split(", ")]
        for df in batches:
            for path, fingerprint, content in zip(df["path"], df["fingerprint"], df["content"], strict=True):
                own = {"path": path, "fingerprint": fingerprint}
                try:
                    rows = [own | r for r in pages_of(bytes(content))] or [own | {"error": "EXTRACTION_FAILED"}]
                except Encrypted:
                    rows = [own | {"error": "ENCRYPTED_DOCUMENT"}]
                except Exception:
                    rows = [own | {"error": "EXTRACTION_FAILED"}]
                out = pd.DataFrame(rows, columns=names).astype({"page": "Int32", "pages": "Int32"})
                yield out.astype(object).where(out.notna(), None)

    out = books.select("path", "fingerprint", "content").mapInPandas(run, SCHEMA)
    return out.withColumn("raw", sanitized(F.col("raw"))).withColumn("lines", lines(F.col("raw")))


def chapters(rows: DataFrame) -> DataFrame:
    """(book, index, title, content, source_locator, profile, error) of page rows: outline ranges where a book has an
    outline, else blocks of 20 pages. A book without text in its pages needs OCR."""
    from vellumlake.operators import pages

    own = rows.where("error is null").withColumnRenamed("path", "book")
    clean = pages.clean_pages(own.select("book", "page", "lines", "top", "bottom"))
    meaning = clean.groupBy("book").agg(pages.has_meaning(F.collect_list("text")).alias("fine"))
    clean = clean.join(meaning, "book")
    outline = own.where("page = 0").select("book", "pages", F.posexplode("outline").alias("pos", "x")).select("book", "pos", F.col("x.title").alias("title"), F.col("x.start").alias("start"), "pages")
    starts = pages.outline_starts(outline)
    text = clean.where("fine").drop("fine")
    ranged = pages.outline_ranges(starts, text.join(starts.select("book").distinct(), "book", "left_semi"))
    blocks = pages.fixed_blocks(text.join(starts.select("book").distinct(), "book", "left_anti"))
    found = ranged.unionByName(blocks)
    found = found.join(pages.profile(found), "book").withColumn("error", F.lit(None).cast("string"))
    failed = rows.where("error is not null").select(F.col("path").alias("book"), "error").unionByName(meaning.where("not fine").select("book", F.lit("OCR_REQUIRED").alias("error")))
    return found.unionByName(failed, allowMissingColumns=True)
