"""Book files as rows: validation, fingerprints, formats and changes, by metadata before content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file, and what each format's files begin with.
MOST_BYTES = 512 << 20
MAGIC = {"epub": b"PK\x03\x04", "pdf": b"%PDF-"}


def files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length, format, fingerprint, content and error of the files under path. Files over `most` bytes are told by
    their length, without reading them; error is null for files that can be read on."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fine = F.col("length") <= most
    kind = book_format(F.col("path"), F.col("content"))
    read = f.where(fine).select("path", "length", kind.alias("format"), F.sha2("content", 256).alias("fingerprint"), "content")
    read = read.withColumn("error", F.when(F.col("format").isNull(), "UNSUPPORTED_FORMAT"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    large = f.where(~fine).select("path", "length", none("string", "format"), none("string", "fingerprint"), none("binary", "content"), F.lit("EXTRACTION_FAILED").alias("error"))
    return read.unionByName(large)


def book_format(path: Column, content: Column) -> Column:
    """The format if both the suffix and the first bytes say so, else null."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(F.lower(path).endswith(f".{name}") & (F.substring(content, 1, len(magic)) == F.lit(magic)), name).otherwise(out)
    return out


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of the files whose fingerprint isn't what it was, or that are gone."""
    now = after.select("path", F.col("fingerprint").alias("now"))
    return before.select("path", "fingerprint").join(now, "path", "left").where(~F.col("fingerprint").eqNullSafe(F.col("now"))).select("path")
