"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are the powers of two of its length in binary, the
longest `max_length`; each piece is a sequence of its own, and sequences of one length form a bucket, so a batch drawn
from a bucket needs no padding and no sequence crosses documents. `write_buckets` writes buckets apart, `batches` draws
arrays of one length from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract.
MAX_LENGTH, END_ID = 2048, 1

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """The powers of two, longest first, that add up to n, none over max_length (itself a power of two)."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << k for k in range(max_length.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    bucket (log2 of length), sequence_id, offset (always 0).

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone; repeated rows and
    repeated or null ids are packed row by row; an empty table gives no rows. sequence_id is unique, not dense: the
    task's number and the piece's number in the task.
    Nothing is shuffled and a task holds one batch of texts at a time.
    """
    from .tokens import read_file

    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    spec = spark.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        from vellumlake.llm.common import give_back
        from vellumlake.llm.tokens import TEXT_BATCH, encoder

        enc, end = encoder(spec.value), struct.pack("<I", end_id)
        seq = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_BATCH):
                batch = whole.slice(at, TEXT_BATCH)
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in lengths(n, max_length):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, piece, n, length.bit_length() - 1, seq, 0))
                        start += length
                        seq += 1
                if not rows:
                    continue
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, packed; the pieces' ids as a checksum."""
    from public_tokenizers import path

    out = pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path("word_bpe_49k.json"))
    return digest(out)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes pieces with all of one length in a folder of their own, so that whoever draws batches from one needs no padding."""
    packed.write.partitionBy("bucket").parquet(path)


def batches(spark: SparkSession, path: str, bucket: int, tokens: int):
    """The sequences of a bucket as arrays of one length, of about so many ids each: rows sequence_id, ids (a matrix, as bytes)
    and n (its rows). A task reads its part of the bucket and holds one batch."""
    size = max(1, tokens >> bucket)

    def run(rows):
        import pyarrow as pa

        held: list = []
        for batch in rows:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= size:
                yield _batch(pa, held[:size])
                held = held[size:]
        if held:
            yield _batch(pa, held)

    return spark.read.parquet(path).where(F.col("bucket") == bucket).select("sequence_id", "ids").mapInArrow(run, "sequence_ids array<long>, ids binary, n long")


def _batch(pa, some: list):
    columns = [pa.array([[x[0] for x in some]], pa.list_(pa.int64())), pa.array([b"".join(x[1] for x in some)], pa.binary()), pa.array([len(some)], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["sequence_ids", "ids", "n"])


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
