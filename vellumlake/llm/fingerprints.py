"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes ends a piece where its low bits are zero, so pieces are found again after text was
put in, taken out or replaced elsewhere. A level of k bits makes pieces of 2**k bytes or so; a text's level follows from its
length, but for texts with few borders, which take a lower one. A fingerprint has the pieces' hashes at its level and at the
next, where each border is one of this level's too. Two fingerprints are compared where they have a level in common, by the
edit distance of the pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, annotate, free_name

#: Bytes that the rolling hash sees.
SEEN = 8
#: A text's level gives so many pieces of the expected length, to twice as many; and at least LEAST borders, else a lower one is
#: taken. The last of MOST pieces goes to the text's end: only texts that repeat a border's eight bytes over and over get there.
PIECES, LEAST, MOST = 48, 8, 512
#: Bytes that are hashed at once.
STRETCH = 1 << 20
#: The digits of a fingerprint, two for each piece.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-"

_M = np.uint32(0x9E3779B1)
_steps = [np.uint32(pow(int(_M), n, 1 << 32)) for n in (1, 2, 4)]


def _rolled(b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The mixed rolling hash after each byte of b; `before` are the SEEN - 1 bytes ahead of it."""
    h = np.concatenate([before, b]).astype(np.uint32) + np.uint32(1)
    for n, m in zip((1, 2, 4), _steps, strict=True):  # sums over 2, 4 and 8 bytes
        h = h[:-n] * m + h[n:]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h * np.uint32(0xC2B2AE35)


def _stretches(text: bytes):
    b, before = np.frombuffer(text, np.uint8), np.zeros(SEEN - 1, np.uint8)
    for at in range(0, len(b), STRETCH):
        part = b[at : at + STRETCH]
        yield _rolled(part, before)
        before = np.concatenate([before, part[-(SEEN - 1) :]])[-(SEEN - 1) :]


def _zeros(h: np.ndarray) -> np.ndarray:
    """How many low bits are zero; 32 at most."""
    low = (h & (~h + np.uint32(1))).astype(np.float64)
    return np.where(h == 0, 32, np.frexp(low)[1] - 1)


def _level(size: int, stretches) -> int:
    """The level by a text's size in bytes, or the highest below with LEAST borders, or 0; from stretches of (zeros, hashes)."""
    count = sum(np.bincount(z, minlength=33) for z, _ in stretches)
    enough = np.flatnonzero(np.cumsum(count[::-1])[::-1] >= LEAST)
    return min(int(enough[-1]) if len(enough) else 0, max(0, (size // PIECES).bit_length() - 1))


def _pieces(stretches, level: int) -> str:
    """The digits of the pieces at a level, from stretches of (zeros, hashes)."""
    sums, n = [], 0
    open_, empty = np.zeros(1, np.uint64), True  # of the piece that isn't over
    for z, h in stretches:
        ends = np.flatnonzero(z >= level)[: max(0, MOST - 1 - n)] + 1
        starts = np.concatenate([[0], ends])
        starts = starts[starts < len(h)]
        got = np.add.reduceat(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts)
        got[:1] += open_
        if len(ends) and ends[-1] == len(h):
            open_, empty = np.zeros(1, np.uint64), True
        else:
            open_, got, empty = got[-1:].copy(), got[:-1], False
        sums.append(got)
        n += len(got)
    if not empty:
        sums.append(open_)
    all_ = np.concatenate(sums)
    all_ = (all_ ^ (all_ >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return "".join(DIGITS[x >> 6] + DIGITS[x & 63] for x in (all_ >> np.uint64(52)).tolist())


def fingerprint(text: bytes) -> str:
    """level:pieces:pieces of the next level. Each byte counts, however long the text; an empty text has `0::`."""
    if not text:
        return "0::"
    made = lambda: ((_zeros(h), h) for h in _stretches(text))
    if len(text) <= STRETCH:
        held = list(made())
        made = lambda: held
    level = _level(len(text), made())
    return f"{level}:{_pieces(made(), level)}:{_pieces(made(), level + 1)}"


def _alike(a: str, b: str) -> float:
    """Twice the longest common subsequence of pieces over their number: 1 less the edit distance, without replacing, over the
    number. Bits of one long number stand for the places of a."""
    s, t = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (a, b))
    if not s or not t:
        return 1.0 if s == t else 0.0
    where: dict = {}
    for i, x in enumerate(s):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(s)) - 1
    v = full
    for x in t:
        hit = v & where.get(x, 0)
        if hit:
            v = ((v + hit) | (v - hit)) & full
    return 2 * (len(s) - v.bit_count()) / (len(s) + len(t))


def likeness(a: str, b: str) -> float:
    """How much of two fingerprints' pieces is the same and in order, 0 to 1, at the level that they have in common (the better
    of two). Without one, their texts' lengths differ by a factor of four or so, and it is 0. Equal ones give 1."""
    if a == b:
        return 1.0
    (la, *pa), (lb, *pb) = a.split(":"), b.split(":")
    gap = int(la) - int(lb)
    if gap == 0:
        return max(_alike(pa[0], pb[0]), _alike(pa[1], pb[1]) if min(len(pa[1]), len(pb[1])) > 2 * LEAST else 0.0)
    if gap == 1:
        return _alike(pa[0], pb[1])
    if gap == -1:
        return _alike(pa[1], pb[0])
    return 0.0


def points(text: bytes) -> int:
    """Code points of UTF-8."""
    b = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero((b[at : at + STRETCH] & 0xC0) != 0x80)) for at in range(0, len(b), STRETCH))


def head(text: bytes, n: int) -> bytes:
    """The first n code points, or all."""
    if n <= 0:
        return b""
    b, at = np.frombuffer(text, np.uint8), 0
    while at < len(b):
        first = np.flatnonzero((b[at : at + STRETCH] & 0xC0) != 0x80)
        if n < len(first):
            return text[: at + int(first[n])]
        n -= len(first)
        at += STRETCH
    return text


def with_fingerprints(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the fingerprint of text appended, and the name it got. A null text counts as empty; all rows and columns stay."""
    out, names = annotate(docs, "text", "fingerprint string", lambda: lambda texts: [(fingerprint(t or b""),) for t in texts])
    return out, names[0]


def with_likeness(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, str]:
    """rows with the likeness of the fingerprints in columns a and b appended (null where one is), and the name it got."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    name = free_name(rows, "likeness")
    at = rows.columns.index(a), rows.columns.index(b)

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.fingerprints import likeness

        for batch in batches:
            both = zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True)
            yield batch.append_column(name, pa.array([None if x is None or y is None else likeness(x, y) for x, y in both], pa.float64()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())])), name


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(own, after) -> tuple:
    """RESULT of a document (doc_id, text, fingerprint) before another."""
    import hashlib

    (doc_id, text, print_), (_, other, other_print) = own, after
    n = points(text)
    edited = head(text, n - n // 3) + head(other, n // 3)
    edited_print = fingerprint(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, other_print)


def edited_chain(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """RESULT for every row of docs (doc_id, text): its fingerprint beside that of an edited text and of the next document.

    The next is that of the next smaller doc_id, and the first after the last; of rows that share a doc_id, the one of the
    next larger text hash (equal rows are alike anyhow). Null doc_ids come last. The edited text has the last third of the
    code points, rounded down, replaced by as many of the next document's first ones, or all that it has. Null texts are
    empty; a single row is its own next; an empty table gives no rows; other columns are ignored.

    Texts move once, sorted by ranges of doc_id, and a task holds two of them. Of each part the first and the last row go to
    a table of their own, where the last is judged with the first of the next part.
    """
    scratch = scratch or Scratch(spark, "fingerprints")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    own = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{RESULT}, part int, place int, text string"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from vellumlake.llm.common import give_back, utf8
        from vellumlake.llm.fingerprints import _judged, fingerprint

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        part, last = TaskContext.get().partitionId(), None

        def edge(place, row):
            return (row[0], None, None, row[2], None, None, None, part, place, row[1].decode("utf-8", "replace"))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                row = (doc_id, text, fingerprint(text))
                if last is None:
                    yield batch_of([edge(0, row)])
                else:
                    out.append((*_judged(last, row), part, 2, None))
                last = row
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([edge(1, last)])
        give_back()

    judged = scratch.table(own.select("doc_id", "text").mapInArrow(run, schema), "judged")
    parts = sorted(r[0] for r in judged.where("place = 0").select("part").collect())  # one number for each part of the sort
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follows int")
    lasts = judged.where("place = 1").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follows), "part")
    firsts = judged.where("place = 0").select(F.col("part").alias("follows"), F.col("text").alias("other"), F.col("fingerprint").alias("other_print"))

    def ends(batches):
        import pyarrow as pa

        from vellumlake.llm.common import utf8
        from vellumlake.llm.fingerprints import _judged

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                (doc_id,), (text,), (print_,), (other,), (other_print,) = one.column(0).to_pylist(), utf8(one.column(1)), one.column(2).to_pylist(), utf8(one.column(3)), one.column(4).to_pylist()
                row = _judged((doc_id, text, print_), (None, other, other_print))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], fields[:7])

    joined = lasts.join(firsts, "follows").select("doc_id", "text", "fingerprint", "other", "other_print").mapInArrow(ends, RESULT)
    return judged.where("place = 2").select(*fields[:7]).unionByName(joined)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, beside that of its edited text and of the next document."""
    return edited_chain(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
