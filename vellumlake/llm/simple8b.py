"""Token ids in Simple-8b words, and their file format.

A 64-bit word is a selector (its top 4 bits) and 60 bits of payload that hold `COUNTS[selector]` values of
`BITS[selector]` bits each, the first in the lowest bits. Values of over 60 bits are escapes: a word of selector 0, then
the value as it is. A file is a Parquet table of blocks in ascending document order. Each block has its words, the
places of its escapes and, for every document, where its ids end, so that a block decodes alone and with array
operations only. Parquet is the container so that any store that Spark writes will do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the coding: by selector, how many values a word holds and of how many bits each (0: an escape).
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], dtype=np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], dtype=np.int64)

#: A block is closed at so many ids; a document is never cut, so a longer one makes a longer block.
BLOCK_IDS = 16384

BLOCKS = "shard int, block int, first long, n_ids long, doc_ids binary, has_id binary, ends binary, escapes binary, words binary"


#: By how many bits a value has (0 to 64): the lowest selector whose values have room for it; 15: an escape.
_NEED = np.array([min(s for s in range(1, 15) if BITS[s] >= b) if b <= 60 else 15 for b in range(65)], np.uint8)
_NEED_16 = _NEED[[int(i).bit_length() for i in range(1 << 16)]]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the ids (unsigned 64-bit) and the indices of escape words. Each word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if int(ids.max()) < 1 << 16:
        need = _NEED_16[ids]
    else:
        need = _NEED[np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), ids, side="right")]
    best = np.where(need == 15, 0, 14).astype(np.uint8)  # by position: the selector of a word that starts there
    most, span = need, 1  # most: the largest need among the next span ids
    for s in range(13, 0, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        while span < count:  # windows of twice the length, or as far as they go
            step = min(span, count - span)
            most = np.maximum(most[: len(most) - step], most[step:])
            span += step
        best[: len(most)][most <= s] = s
    hop, at, starts = np.maximum(COUNTS[best], 1).astype(np.uint8).tobytes(), 0, []
    put = starts.append
    while at < n:
        put(at)
        at += hop[at]
    starts = np.array(starts, dtype=np.int64)
    sel = best[starts]
    width = np.where(sel == 0, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.flatnonzero(np.bincount(sel)).tolist():
        here, to = starts[sel == s], place[sel == s]
        if s == 0:
            words[to + 1] = ids[here]
            continue
        word = np.full(len(here), np.uint64(s << 60))
        for k in range(COUNTS[s]):
            word |= ids[here + k] << np.uint64(k * BITS[s])
        words[to] = word
    return words, place[sel == 0]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of the words; escapes: the indices of escape words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    count[escapes] = 0
    count[escapes + 1] = 1
    sel[escapes] = 0
    sel[escapes + 1] = 0
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    out[place[escapes + 1]] = words[escapes + 1]
    for s in np.flatnonzero(np.bincount(sel)).tolist():
        if s:
            at = np.flatnonzero(sel == s)
            word, to, mask = words[at], place[at], np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[to + k] = word >> np.uint64(k * BITS[s]) & mask
    return out


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Writes the ids of every row's whole text, then end_id, in ascending doc_id order to the file at path.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. Rows of one doc_id
    all stay, in the order of their texts' hash; a null doc_id comes first. An empty table makes a file without blocks.
    Rows are dealt by ranges of (doc_id, hash of the text), so a doc_id with many rows is split too; a task holds one
    block and one batch of texts.
    """
    from .tokens import read_file

    spec = spark.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        from vellumlake.llm import simple8b
        from vellumlake.llm.common import give_back
        from vellumlake.llm.tokens import TEXT_BATCH, encoder

        enc, end, shard = encoder(spec.value), struct.pack("<I", end_id), TaskContext.get().partitionId()
        names = [x.split()[0] for x in simple8b.BLOCKS.split(", ")]
        block, first, docs_in, held, n = 0, 0, [], [], 0

        def flush():
            nonlocal block, first, docs_in, held, n
            words, escapes = simple8b.encode(np.frombuffer(b"".join(held), "<u4"))
            known = np.array([d is not None for d in docs_in], np.uint8)
            ends = np.cumsum([len(x) // 4 for x in held])
            row = (shard, block, first, n, np.array([d or 0 for d in docs_in], "<i8").tobytes(), known.tobytes(), ends.astype("<i8").tobytes(), escapes.astype("<i8").tobytes(), words.astype("<u8").tobytes())
            block, first, docs_in, held, n = block + 1, first + n, [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), *((x, pa.binary()) for x in names[4:])]))

        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_BATCH):
                batch = whole.slice(at, TEXT_BATCH)
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    docs_in.append(doc)
                    held.append(ids + end)
                    n += len(held[-1]) // 4
                    if n >= simple8b.BLOCK_IDS:
                        yield flush()
        if held:
            yield flush()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the file) and ids (little-endian unsigned 32-bit) of each.

    A block knows how many ids of its shard come before it; a running sum over the shards' totals (one row for each
    task that wrote, so it is broadcast) gives the rest. Blocks are decoded one at a time.
    """
    from pyspark.sql import Window

    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm import simple8b
        from vellumlake.llm.common import give_back

        for batch in batches:
            for first, doc_ids, has_id, ends, escapes, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<i8")).astype("<u4").tobytes()
                ends = np.frombuffer(ends, "<i8")
                begins = np.concatenate([[0], ends[:-1]])
                docs = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.frombuffer(has_id, np.uint8) == 0)
                own = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(begins + first), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])
        give_back()

    whole = blocks.join(F.broadcast(shards), "shard").select((F.col("before") + F.col("first")).alias("first"), "doc_ids", "has_id", "ends", "escapes", "words")
    return whole.mapInArrow(run, "doc_id long, start long, ids binary")


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a file in the shared folder and read back from it."""
    from public_tokenizers import path

    from .common import Scratch

    to = f"{Scratch(spark, 'simple8b').root}/ids"
    write_ids(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"), to)
    return read_ids(spark, to).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
