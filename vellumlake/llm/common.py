"""What the operators share: scratch tables in the shared folder, connected components, Arrow helpers."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of whole texts that a worker takes at once.
TEXT_BATCH, TEXT_BYTES = 500, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder, else, on a local
    master alone, one set here (tests). An error elsewhere, as executors don't see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellumlake-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder, so that a lost executor loses no work and no lineage is run twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}  # the frame too, so that no other gets its id

    def table(self, df: DataFrame, name: str = "t", codec: str = "zstd", batch: int | None = None) -> DataFrame:
        """Writes df and returns it as read from there. batch: rows that go to a Python worker at once, for wide rows, while
        this is written."""
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        was = self.spark.conf.get(key)
        if batch is not None:
            self.spark.conf.set(key, str(min(batch, int(was)) if int(was) > 0 else batch))
        try:
            path = self.write(df, name, codec)
        finally:
            self.spark.conf.set(key, was)
        out = self.read(path, df)
        self.paths[id(out)] = path, out
        return out

    def write(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> str:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", codec).parquet(path)
        return path

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no result still to be made reads. What results read stays in the shared folder until whoever
        owns it clears it."""
        for df in tables:
            found = self.paths.pop(id(df), None)
            if found is not None:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(found[0])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Each round maps every node to the neighbour (or itself) of the smallest hash under a fresh seed and contracts the
    edges, which shrinks paths and stars alike in a logarithmic number of rounds. Everything stays in DataFrames; each
    round's map and edges are written to the shared folder. Nulls and loops are dropped; no edges give no rows.
    """
    ends = [F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")]
    cur = edges.select(*ends).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cur = scratch.table(cur.distinct(), "edges")
    labels, used = None, [cur]
    for seed in itertools.count():
        if cur.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("id"))  # noqa: E731,B023
        both = cur.select("a", "b").union(cur.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        step = step.select("node", F.least(F.col("m"), rank(F.col("node")))["id"].alias("up"))
        step = scratch.table(step, "step")
        used.append(step)
        up = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731,B023
        nxt = cur.join(up("a"), "a").join(up("b"), "b").where("a_up <> b_up")
        nxt = nxt.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        if labels is None:
            labels = step.withColumnRenamed("up", "root")
        else:
            labels = labels.join(up("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root"))
        cur = scratch.table(nxt, "edges")
        used.append(cur)
    if labels is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = scratch.table(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = scratch.table(labels.join(least, "root").select("node", "component"), "components")
    scratch.drop(labels, *used)
    return out


def give_back() -> None:
    """Returns a worker's free memory to the system; called where large tables have gone, as workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def utf8(column) -> list:
    """An Arrow string column as a list of bytes; null stays None."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores in front until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch, column: int, rows: int = TEXT_BATCH, most: int = TEXT_BYTES):
    """An Arrow batch in slices of at most so many rows whose strings in the column take at most so many bytes, a row at least."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + most, "right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def annotate(df: DataFrame, text: str, fields: str, make, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df, or its columns `keep`, with columns appended that a worker derives from texts, and the names they got (changed if
    these columns have the like).

    text: the name of the column of texts. fields: "name type, ..." of the new columns. make(): run once in a task; gives a
    function from a list of texts (bytes or None) to a list of rows. A task holds one batch of texts; only texts that aren't
    strings, or aren't kept, travel in a column of their own.
    """
    from pyspark.sql import types as T

    out = df if keep is None else df.select(*keep)
    new = T._parse_datatype_string(fields)
    names = [free_name(out, f.name) for f in new]
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, new, strict=True))])
    kept = len(out.columns)
    at = out.columns.index(text) if text in out.columns and isinstance(df.schema[text].dataType, T.StringType) else kept
    sent = out if at < kept else df.select(*(F.col(f"`{c}`") for c in out.columns), F.col(text).cast("string").alias(free_name(df, "own_text")))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new]
        work = make()
        for whole in batches:
            for batch in slices(whole, at):
                rows = work(utf8(batch.column(at)))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names[:kept], *names])
        give_back()

    return sent.mapInArrow(run, schema), names
