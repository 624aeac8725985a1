"""Lossless splitting of chapters at Markdown block boundaries.

Blocks are fences, tables, headings and paragraphs, each with the blank lines after it. Fences and tables are never cut;
other blocks only if they alone are too long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_open = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL)
_rule = re.compile(r":?-+:?")

#: Rows whose chunks a worker holds as Python's strings.
ROWS = 200


def fence(line: str) -> str | None:
    """The run of marks that opens a fence, if the line does."""
    m = _open.match(line)
    return m[1] if m and not (m[1][0] == "`" and "`" in m[2]) else None


def closes(line: str, marks: str) -> bool:
    text = line.rstrip("\r\n")
    body = text.lstrip(" ")
    run = len(body) - len(body.lstrip(marks[0]))
    return len(text) - len(body) <= 3 and run >= len(marks) and not body[run:].strip(" \t")


def cells(line: str) -> list[str]:
    """The cells of a table row; none if no pipe stands after an even number of backslashes."""
    text = line.rstrip("\r\n").strip()
    pipes, slashes = [], 0
    for i, c in enumerate(text):
        if c == "|" and slashes % 2 == 0:
            pipes.append(i)
        slashes = slashes + 1 if c == "\\" else 0
    if not pipes or text == "|":
        return []
    inner = [p for p in pipes if 0 < p < len(text) - 1]
    starts = [1 if pipes[0] == 0 else 0, *(p + 1 for p in inner)]
    ends = [*inner, len(text) - 1 if pipes[-1] == len(text) - 1 else len(text)]
    return [text[a:b].strip() for a, b in zip(starts, ends, strict=True)]


def opens_table(lines: list[str], i: int) -> bool:
    if i + 1 >= len(lines) or "|" not in lines[i]:
        return False
    head, rule = cells(lines[i]), cells(lines[i + 1])
    return bool(head) and len(head) == len(rule) and all(map(_rule.fullmatch, rule))


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """The blocks in order, and whether each must stay whole."""
    lines = text.splitlines(keepends=True)
    i = 0
    while i < len(lines):
        start, marks, whole = i, fence(lines[i]), True
        i += 1
        if marks is not None:
            while i < len(lines) and not closes(lines[i], marks):
                i += 1
            i = min(i + 1, len(lines))
        elif opens_table(lines, start):
            i += 1
            while i < len(lines) and cells(lines[i]):
                i += 1
        else:
            whole = False
            if not lines[start].lstrip().startswith("#"):
                while i < len(lines) and lines[i].strip() and fence(lines[i]) is None and not opens_table(lines, i) and not lines[i].lstrip().startswith("#"):
                    i += 1
        while i < len(lines) and not lines[i].strip():
            i += 1
        yield "".join(lines[start:i]), whole


def split(text: str | None, most: int) -> list[str] | None:
    """Chunks that together are the text, packed greedily to at most `most` characters; a whole block may be longer."""
    if most < 1:
        raise ValueError("most must be positive")
    if text is None:
        return None
    chunks, held, size = [], [], 0

    def close():
        nonlocal held, size
        if size:
            chunks.append("".join(held))
        held, size = [], 0

    for block, whole in blocks(text):
        if size and (size + len(block) > most or (not whole and len(block) > most)):
            close()
        while not whole and len(block) > most:
            held, size = [block[:most]], most
            close()
            block = block[most:]
        held.append(block)
        size += len(block)
    close()
    return chunks


def chunk_array(c: Column, most: int) -> Column:
    """The array of a text's chunks; null for null, empty for an empty text."""

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array((split(x.as_py(), most) for x in a[k : k + ROWS]), kind) for k in range(0, len(a), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    if most < 1:
        raise ValueError("most must be positive")
    return run(c)


def chunk_count(c: Column, most: int) -> Column:
    """How many chunks a text has; null for null. A worker holds the chunks of one text at a time, and gives numbers back."""

    @F.arrow_udf("int")
    def run(a: pa.Array) -> pa.Array:
        chunks = (split(x.as_py(), most) for x in a)
        return pa.array((None if x is None else len(x) for x in chunks), pa.int32())

    if most < 1:
        raise ValueError("most must be positive")
    return run(c)


def chunks(df: DataFrame, text: str, most: int) -> DataFrame:
    """A row for each chunk: the columns of df but text, with number (from 1), count and chunk."""
    own = df.withColumn("_chunks", chunk_array(F.col(text), most))
    rest = [c for c in df.columns if c != text]
    return own.select(*rest, F.size("_chunks").alias("count"), F.posexplode("_chunks").alias("number", "chunk")).withColumn("number", F.col("number") + 1)
