"""Books and chapters over the tables at hand: a source is a book, a document a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions.numbering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_system, external_book_id, chapter_index, title, content, source_locator, language. doc_ids are unique. Only
    ids are sorted to number chapters, whatever a source's size; texts are joined to them."""
    d = table(spark, sf_dir, "documents")
    d = d.join(numbered(d.select("doc_id", "source"), ["source"], ["doc_id"], "_index").select("doc_id", "_index"), "doc_id")
    index = F.col("_index").cast("int")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 500)
    return d.select("doc_id", F.lit("documents").alias("source_system"), F.col("source").alias("external_book_id"), index.alias("chapter_index"), title.alias("title"), F.col("text").alias("content"), F.concat(F.lit("doc:"), "doc_id").alias("source_locator"), F.col("lang").alias("language"))


#: The same in SQL.
CHAPTERS = """chapters AS (SELECT doc_id, 'documents' AS source_system, source AS external_book_id,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chapter_index,
  substr(split_part(text, chr(10), 1), 1, 500) AS title, text AS content, 'doc:' || doc_id AS source_locator, lang AS language
  FROM documents)"""
