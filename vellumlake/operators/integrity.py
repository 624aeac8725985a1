"""Integrity of a library: all that refers to books and chapters in one union, one aggregation by chapter and one by book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What can be wrong, in the order that faults of a book are told in.
FAULTS = ["BOOK_REPEATED", "BOOK_MISSING", "CHAPTER_REPEATED", "CHAPTERS_INCOMPLETE", "ANALYSIS_WITHOUT_CHAPTER", "ANALYSIS_REPEATED", "SNAPSHOT_WITHOUT_CHAPTER", "SNAPSHOT_REPEATED"]


def missing_columns(df: DataFrame, schema: str) -> list[str]:
    """Columns of a schema that df lacks, or has of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = df.sparkSession.createDataFrame([], schema).schema
    return [f.name for f in want if have.get(f.name) != f.dataType.simpleString()]


def faults(books: DataFrame, chapters: DataFrame, analyses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(book_id, fault, n): what is wrong with a library's references, n times in the book.

    books: book_id, total_chapters. The others: book_id, chapter_index. A book has a row of its own and chapters 0 to total - 1,
    each once; a chapter has at most one analysis and one snapshot, and these have chapters. A null total isn't held against the
    chapters; nulls of chapter_index are a chapter that isn't there; rows without book_id are faults of the null book. An empty
    library has none.
    """
    row = lambda df, kind, index, total: df.select("book_id", F.lit(kind).alias("kind"), index.cast("int").alias("i"), total.cast("int").alias("total"))
    none = F.lit(None)
    both = row(books, "book", none, F.col("total_chapters"))
    for kind, df in (("chapter", chapters), ("analysis", analyses), ("snapshot", snapshots)):
        both = both.unionByName(row(df, kind, F.col("chapter_index"), none))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    one = both.groupBy("book_id", "i").agg(*(of(k).alias(k) for k in ("book", "chapter", "analysis", "snapshot")), F.max("total").alias("total"))
    there = F.col("chapter") > 0
    lonely = lambda kind: F.sum(F.when(~there | F.col("i").isNull(), F.col(kind)).otherwise(0))
    twice = lambda kind: F.count_if(F.col(kind) > 1)
    whole = (F.count_if(there & F.col("i").isNotNull()) == F.max("total")) & (F.coalesce(F.min(F.when(there, F.col("i"))), F.lit(0)) == 0)
    whole &= F.coalesce(F.max(F.when(there, F.col("i"))), F.lit(-1)) == F.max("total") - 1
    counts = {
        "BOOK_REPEATED": F.when(F.sum("book") > 1, 1).otherwise(0),
        "BOOK_MISSING": F.when(F.sum("book") == 0, 1).otherwise(0),
        "CHAPTER_REPEATED": twice("chapter"),
        "CHAPTERS_INCOMPLETE": F.when(whole, 0).when(F.max("total").isNull(), 0).otherwise(1),
        "ANALYSIS_WITHOUT_CHAPTER": lonely("analysis"),
        "ANALYSIS_REPEATED": twice("analysis"),
        "SNAPSHOT_WITHOUT_CHAPTER": lonely("snapshot"),
        "SNAPSHOT_REPEATED": twice("snapshot"),
    }
    found = one.groupBy("book_id").agg(*(counts[f].cast("long").alias(f) for f in FAULTS))
    told = F.explode(F.array(*(F.struct(F.lit(f).alias("fault"), F.col(f).alias("n")) for f in FAULTS)))
    return found.select("book_id", told.alias("x")).select("book_id", "x.fault", "x.n").where("n > 0")
