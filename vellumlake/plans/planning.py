"""What a run over a book will cost, and whether a plan still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.functions.canonical import digest
from vellumlake.operators.chunking import chunk_count


def estimate(chapters: DataFrame, cached: DataFrame, book: str, key: str, text: str, most: int = 24_000, most_output: int = 4096) -> DataFrame:
    """By book: chapters, processed, pending, and the pending ones' model calls and tokens. cached: the keys that have an
    analysis. A chapter of one chunk is one call; a longer one a call for each chunk and one to merge."""
    flag = cached.select(key).distinct().withColumn("_hit", F.lit(True))
    n = chunk_count(F.col(text), most)
    own = chapters.select(book, key, F.ceil(F.length(text) / 4).alias("_in"), n.alias("_n")).join(flag, key, "left")
    todo = F.col("_hit").isNull()
    calls = F.when(todo, F.when(F.col("_n") <= 1, 1).otherwise(F.col("_n") + 1)).otherwise(0)
    out = own.groupBy(book).agg(
        F.count("*").alias("total_chapters"), F.sum((~todo).cast("long")).alias("processed_chapters"), F.sum(todo.cast("long")).alias("pending_chapters"),
        F.sum(calls).cast("long").alias("model_calls"), F.sum(F.when(todo, F.col("_in")).otherwise(0)).cast("long").alias("input_tokens"),
    )
    return out.withColumn("output_tokens", F.col("model_calls") * most_output)


def plan_digest(chapters: DataFrame, book: str, index: str, fingerprint: str) -> DataFrame:
    """(book, digest) of the ordered chapter fingerprints, which a plan is made for."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.col(fingerprint).alias("fingerprint"))))
    return chapters.groupBy(book).agg(digest(rows).alias("digest"))


def is_expired(created: Column, now: Column, minutes: int = 30) -> Column:
    """A plan holds for so many minutes."""
    return created + F.make_dt_interval(mins=F.lit(minutes)) <= now
