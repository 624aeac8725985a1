"""The library: identities, snapshots, the analysis cache, and upserts as whole rewrites of versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pointer import Files, Pointer

KEY = ["source_system", "external_book_id", "chapter_index"]

#: Rows of either side of the join of stored snapshots with their sources that a task sorts.
SNAPSHOTS = 250_000


def completeness(snapshots: DataFrame) -> DataFrame:
    """By book (source_system, external_book_id): are its chapters 0 to total - 1, each once, with one metadata?"""
    out = snapshots.groupBy("source_system", "external_book_id").agg(
        F.count("*").alias("chapters"), F.countDistinct("chapter_index").alias("distinct_chapters"), F.min("chapter_index").alias("least"),
        F.max("chapter_index").alias("most"), F.countDistinct("book").alias("metadata"), F.max("book.total_chapters").alias("total"),
    )
    whole = (F.col("chapters") == F.col("total")) & (F.col("distinct_chapters") == F.col("total")) & (F.col("least") == 0) & (F.col("most") == F.col("total") - 1) & (F.col("metadata") == 1)
    return out.withColumn("complete", F.coalesce(whole, F.lit(False)))


def valid_cache_key(system: Column, book: Column, index: Column, fingerprint: Column) -> Column:
    return F.coalesce(F.length(system).between(1, 80) & F.length(book).between(1, 240) & index.between(0, 4999) & fingerprint.rlike("^[0-9a-f]{64}$"), F.lit(False))


def with_cache(snapshots: DataFrame, analyses: DataFrame) -> DataFrame:
    """snapshots (KEY, input_fingerprint, …) with analysis and cache_hit: a hit needs the key and the fingerprint."""
    found = analyses.select(*KEY, "input_fingerprint", F.col("analysis"), F.lit(True).alias("cache_hit"))
    return snapshots.join(found, [*KEY, "input_fingerprint"], "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def pending(snapshots: DataFrame, analyses: DataFrame) -> DataFrame:
    """The snapshots without a cached analysis of their fingerprint."""
    return snapshots.join(analyses.select(*KEY, "input_fingerprint"), [*KEY, "input_fingerprint"], "left_anti")


def latest(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """One row for each key: the first in the order given."""
    name = "_rank"
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col(name) == 1).drop(name)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it lacks."""
    return with_history(old, new, keys)


def upsert_analyses(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after storing new: one row a chapter, created_at of the first row stays."""
    new = latest(new, KEY, F.desc("updated_at"), F.desc("input_fingerprint"))
    created = old.select(*KEY, F.col("created_at").alias("first_at"))
    new = new.join(created, KEY, "left").withColumn("created_at", F.coalesce("first_at", "created_at")).drop("first_at")
    return upserted(old, new, KEY)


def upsert_books(old: DataFrame, new: DataFrame) -> DataFrame:
    """External books after new ones: identity, book_id and created_at stay, metadata is overwritten and the total never
    shrinks. Columns: source_system, external_book_id, book_id, title, author, language, total_chapters, created_at,
    updated_at."""
    keys = ["source_system", "external_book_id"]
    new = latest(new, keys, F.desc("updated_at"), F.desc("total_chapters"))
    was = old.select(*keys, F.col("book_id").alias("o_id"), F.col("total_chapters").alias("o_total"), F.col("created_at").alias("o_at"))
    made = F.substring(F.sha2(F.to_json(F.array(*keys)), 256), 1, 32)
    new = new.join(was, keys, "left").select(
        *keys, F.coalesce("o_id", made).alias("book_id"), "title", "author", "language",
        F.greatest("total_chapters", F.coalesce("o_total", F.lit(0))).alias("total_chapters"), F.coalesce("o_at", "created_at").alias("created_at"), "updated_at",
    )
    return upserted(old.select(new.columns), new, keys)


def import_books(old: DataFrame, new: DataFrame) -> DataFrame:
    """Managed books after importing new ones: the first record of (format, source_fingerprint) stays, in whatever mode."""
    keys = ["format", "source_fingerprint"]
    first = latest(new, keys, F.asc("created_at"), F.asc("book_id"))
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(old.columns))


def with_external_flag(books: DataFrame, external: DataFrame) -> DataFrame:
    """books with is_external: is there a row of the same book_id in external?"""
    flag = external.select("book_id").distinct().withColumn("is_external", F.lit(True))
    return books.join(flag, "book_id", "left").withColumn("is_external", F.coalesce("is_external", F.lit(False)))


def external_books(external: DataFrame, books: DataFrame) -> DataFrame:
    """external (book_id, identity, ...) with its books' columns; sources without a book are left out."""
    clash = [c for c in books.columns if c != "book_id" and c in external.columns]
    return external.join(books.drop(*clash), "book_id")


def external_faults(external: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, fault) of external sources (source_system, external_book_id, book_id) that cannot be taken over: BOOK_MISSING;
    MANAGED_PROVENANCE, if the book came from a file (format, mode or path aren't null); SEVERAL_IDENTITIES of one book."""
    managed = F.coalesce(F.col("format"), F.col("mode"), F.col("path")).isNotNull()
    own = books.select("book_id", managed.alias("_managed"))
    missing = F.when(F.col("_managed").isNull(), "BOOK_MISSING").when(F.col("_managed"), "MANAGED_PROVENANCE")
    joined = external.select("book_id").distinct().join(own, "book_id", "left").select("book_id", missing.alias("fault")).where("fault is not null")
    several = external.groupBy("book_id").agg(F.countDistinct("source_system", "external_book_id").alias("n")).where("n > 1")
    return joined.unionByName(several.select("book_id", F.lit("SEVERAL_IDENTITIES").alias("fault")))


def snapshot_faults(snapshots: DataFrame, external: DataFrame) -> DataFrame:
    """(external_source_id, chapter_index, fault) of stored snapshots (external_source_id, chapter_index, snapshot: JSON)
    that cannot be taken over: SOURCE_MISSING; INCONSISTENT, if the snapshot's own identity or index is another than its
    source's and row's, or can't be read. external: external_source_id, source_system, external_book_id. Both sides are dealt out by
    source and sorted, so many rows a task: sizes of files, which compress well, say little of the memory that rows take."""
    parts = max(1, -(-snapshots.count() // SNAPSHOTS), -(-external.count() // SNAPSHOTS))
    form = "external_identity struct<source_system:string,external_book_id:string>, chapter struct<index:string>"
    snapshots = snapshots.withColumn("_said", F.from_json("snapshot", form))  # once for all three
    said = lambda path: F.col(f"_said.{path}")
    placed = said("chapter.index").eqNullSafe(F.col("chapter_index").cast("string"))
    rows = snapshots.select("external_source_id", "chapter_index", said("external_identity.source_system").alias("_system"), said("external_identity.external_book_id").alias("_book"), placed.alias("_placed"))
    own = external.select("external_source_id", "source_system", "external_book_id", F.lit(True).alias("_have"))
    same = F.col("_placed") & F.col("_system").eqNullSafe(F.col("source_system")) & F.col("_book").eqNullSafe(F.col("external_book_id"))
    fault = F.when(F.col("_have").isNull(), "SOURCE_MISSING").when(~same, "INCONSISTENT")
    rows, own = rows.repartition(parts, "external_source_id"), own.repartition(parts, "external_source_id")
    return rows.join(own.hint("merge"), "external_source_id", "left").select("external_source_id", "chapter_index", fault.alias("fault")).where("fault is not null")


def historical(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of previous whose keys current lacks: what was rendered before stays."""
    return previous.join(current.select(*keys).distinct(), keys, "left_anti")


def with_history(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """current, and what of previous it doesn't replace."""
    return historical(previous, current, keys).unionByName(current)


def with_availability(books: DataFrame, files: DataFrame) -> DataFrame:
    """books (path, source_fingerprint, is_external) with source_available: external always; others if the file at path
    still has the fingerprint. files: path, sha256."""
    found = files.select("path", "sha256")
    same = F.col("is_external") | (F.col("sha256") == F.col("source_fingerprint"))
    return books.join(found, "path", "left").withColumn("source_available", F.coalesce(same, F.lit(False))).drop("sha256")


class Table:
    """A versioned table: every rewrite goes to a new folder, and then a pointer's next entry names it. Readers see the old
    version or the new one; a crash in between leaves the old. `owner` guards against a rewrite that another overtook."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.pointer = Pointer(self.files, f"{self.path}/_versions")

    def version(self) -> str | None:
        return self.pointer.latest()[1]

    def read(self, version: str | None = None) -> DataFrame:
        """The table, as it is now or in a version of its own."""
        v = version or self.version()
        if v is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{v}")

    def write(self, df: DataFrame, owner: str | None = None) -> str:
        """Writes df as the next version. owner: the version that df was made from (None: there was none); if another has
        come since, nothing changes and an error is raised."""
        number, was = self.pointer.latest()
        new = f"v-{uuid.uuid4().hex}"
        if owner == was:
            df.write.parquet(f"{self.path}/{new}")
            if self.pointer.advance(number + 1, new):
                return new
            self.files.delete(f"{self.path}/{new}")
        raise RuntimeError("the table has changed meanwhile")
