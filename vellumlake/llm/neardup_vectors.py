"""Near-duplicate vectors by epsilon grid order join.

Unit vectors of cosine t or more are at most eps = sqrt(2 - 2t) apart, and so are their projections. Vectors are sorted by
the cells, eps wide, of their leading principal dimensions and cut into blocks of the sequence. Intervals of blocks, each
with the box around its vectors, make a tree; pairs of intervals are followed from its root down, and those whose boxes
are more than eps apart are skipped. The pairs of blocks that remain are compared with matrix products in double
precision, a tile of pairs at a time: the blocks of two strips of the sequence, each of which moves once. A pair of blocks
puts out each vector's number of links and a spanning forest of the links, never the links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Leading principal dimensions of the grid and the boxes.
DIMS = 8
#: Vectors in a block, and intervals that make one of the next level.
BLOCK, FAN = 1024, 8
#: Vectors for each range of the sort.
RANGE = 8192
#: Bytes of vectors, in double precision, of a strip of blocks; a task holds two strips.
STRIP_BYTES = 16 << 20


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component first, so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def vectors(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal(reps: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the leading principal directions of all unit vectors. Tasks sum products and put out one row for
    each pair of components, so the driver gets as many rows as a covariance has entries."""

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.neardup_vectors import unit, vectors

        sums: dict = {}
        for batch in batches:
            size = batch.column(0).to_numpy()
            for d in np.unique(size).tolist():
                x = unit(vectors(batch.column(1).filter(pa.array(size == d))))
                x = np.column_stack([np.ones(len(x)), x])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["dim", "i", "j", "s"])

    got = reps.select("dim", "embedding").mapInArrow(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, rows in got.groupby("dim"):
        s = np.zeros((d + 1, d + 1))
        s[rows["i"], rows["j"]] = rows["s"]
        s = np.maximum(np.abs(s), np.abs(s.T)) * np.sign(s + s.T)
        mean = s[0, 1:] / s[0, 0]
        _, w = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
        out[int(d)] = w[:, ::-1][:, :DIMS]
    return out


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = 0.93, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding, label).

    Two vectors of one label and length are linked if their cosine is at least `cosine`. n_links counts the other rows
    linked to; component_id is the smallest vec_id that can be reached, kept whether it is the row's own. A null label,
    a vector that is null, empty, zero or holds null or non-finite components, and a null vec_id link with nothing; the
    last has a null component and is kept. Equal vectors of a label are linked, and compared with others once. Rows that
    share a vec_id are vectors of their own in n_links and one in components. Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = scratch or Scratch(spark, "vectors")
    eps2 = 2 - 2 * cosine + 1e-9
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = own.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    keys = [F.xxhash64("label", "embedding").alias("g"), F.xxhash64(F.lit(17), "embedding", "label").alias("h")]
    good = own.where("fine").select("vec_id", "label", "embedding", *keys)
    reps = good.groupBy("g", "h").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # a class of equal vectors is a node of its own, also where classes have their least vec_id in common
    reps = scratch.table(reps.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "reps")
    axes = spark.sparkContext.broadcast(principal(reps))
    width = eps2**0.5
    double = dict(reps.dtypes)["embedding"] == "array<double>"

    def grid(batches):
        import pyarrow as pa

        from vellumlake.llm.neardup_vectors import unit, vectors

        for batch in batches:
            size, cells = batch.column("dim").to_numpy(), [None] * batch.num_rows
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = unit(vectors(batch.column("embedding").take(pa.array(at)))) @ axes.value[d]
                for i, c in zip(at.tolist(), np.floor(x / width).astype(np.int32).tolist(), strict=True):
                    cells[i] = c
            yield batch.append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    order = ["label", "dim", "cells", "id", "g"]
    placed = reps.select("label", "dim", F.col("node").alias("id"), "g", "copies", "embedding")
    placed_ = placed = scratch.table(placed.mapInArrow(grid, f"label string, dim int, id long, g long, copies long, embedding {dict(reps.dtypes)['embedding']}, cells array<int>"), "placed")
    n = placed.count()
    placed = placed.repartitionByRange(max(1, -(-n // RANGE)), *order).sortWithinPartitions(*order)
    bounds = [f"{x}{k}" for k in range(DIMS) for x in ("lo", "hi")]
    fields = f"block long, label string, dim int, n int, ids binary, copies binary, vectors binary, {', '.join(f'{b} double' for b in bounds)}"

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from vellumlake.llm.neardup_vectors import BLOCK, DIMS, unit, vectors

        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.float64()] * (2 * DIMS)]

        def flush():
            nonlocal number, held, count
            label, d = held[0][0], held[0][1]
            ids, copies, raw = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            x = unit(raw) @ axes.value[d]
            box = np.zeros((DIMS, 2))
            box[: x.shape[1]] = np.column_stack([x.min(0), x.max(0)])
            row = [number, label, d, len(ids), ids.astype("<i8").tobytes(), copies.astype("<i8").tobytes(), raw.astype("<f8" if double else "<f4").tobytes(), *box.ravel().tolist()]
            number, held, count = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            label, size = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            while start < len(label):
                end = start
                room = BLOCK - count
                while end < len(label) and end - start < room and label[end] == label[start] and size[end] == size[start]:
                    end += 1
                part = batch.slice(start, end - start)
                if held and (held[0][0] != label[start] or held[0][1] != size[start]):
                    yield flush()
                    continue
                held.append((label[start], size[start], part.column(2).to_numpy(), part.column(3).to_numpy(), vectors(part.column(4))))
                count += end - start
                start = end
                if count >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    blocks = scratch.table(placed.select("label", "dim", "id", "copies", "embedding").mapInArrow(cut, fields), "blocks")
    pairs = _block_pairs(blocks.select("block", "label", "dim", *bounds), eps2, scratch)
    found = scratch.table(_compare(_tiles(pairs, blocks), cosine, double), "found")
    scratch.drop(placed_, blocks, pairs)

    links = found.where("root is null").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    groups = reps.select("g", "h", "node", "id", "copies").join(links, "node", "left")
    groups = groups.select("g", "h", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    joined = found.where("root is not null").select(F.col("id").alias("x"), F.col("root").alias("y")).distinct()
    name = lambda c, as_: reps.select(F.col("node").alias(c), F.col("id").alias(as_))
    joined = joined.join(name("x", "a"), "x").join(name("y", "b"), "y").select("a", "b")
    # vec_ids of several classes join them
    several = good.groupBy("vec_id").agg(*(f(k).alias(f"{f.__name__}_{k}") for k in ("g", "h") for f in (F.min, F.max))).where("min_g <> max_g or min_h <> max_h").select("vec_id")
    several = good.join(several, "vec_id", "left_semi").join(reps.select("g", "h", "id"), ["g", "h"]).select(F.col("id").alias("a"), F.col("vec_id").alias("b"))
    comps = connected_components(joined.union(several), scratch)
    out = own.select("vec_id", "fine", *keys).join(groups, ["g", "h"], "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("fine"), F.coalesce("component", "id")).otherwise(F.col("vec_id"))
    links = F.when(F.col("fine"), F.col("n")).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _block_pairs(blocks: DataFrame, eps2: float, scratch: Scratch) -> DataFrame:
    """(tile, a, b), a <= b, of the blocks whose boxes are near enough, found from the root of the tree of intervals down. A
    tile is a pair of strips of the sequence, of as many blocks as bytes allow."""
    bounds = [c for c in blocks.columns if c[:2] in ("lo", "hi")]
    # a block's place in its sequence: blocks are numbered within the sort's parts, so only those are counted in a window
    own = blocks.withColumn("part", F.shiftright("block", 32))
    parts = own.groupBy("label", "dim", "part").agg(F.count("*").alias("n"), F.min("block").alias("least"))
    before = Window.partitionBy("label", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("label", "dim", "part", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = own.join(parts, ["label", "dim", "part"]).withColumn("node", (F.col("before") + F.col("block") - F.col("least")).cast("int"))
    level = scratch.table(placed.select("block", "label", "dim", "node", *bounds), "level")
    most = level.agg(F.max("node")).first()[0]
    if most is None:
        return blocks.select(F.col("block").alias("tile"), F.col("block").alias("a"), F.col("block").alias("b"))
    levels = [level.select("label", "dim", "node", F.floor(F.col("node") / FAN).cast("int").alias("up"), *bounds)]
    while most:
        most //= FAN
        joined = levels[-1].groupBy("label", "dim", F.col("up").alias("node")).agg(*((F.min if b[:2] == "lo" else F.max)(b).alias(b) for b in bounds))
        levels.append(joined.withColumn("up", F.floor(F.col("node") / FAN).cast("int")))
    far = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}")), 2) for k in range(len(bounds) // 2)), F.lit(0.0))
    pairs = levels[-1].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for down in reversed(levels[:-1]):
        side = lambda c: down.select("label", "dim", F.col("up").alias(c), F.col("node").alias(f"{c}_node"), *(F.col(b).alias(f"{c}_{b}") for b in bounds))  # noqa: E731,B023
        both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        both = both.where((F.col("a_node") <= F.col("b_node")) & (far <= eps2))
        pairs = both.select("label", "dim", F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    name = lambda c: level.select("label", "dim", F.col("node").alias(c), F.col("block").alias(f"{c}_block"))
    named = pairs.join(name("a"), ["label", "dim", "a"]).join(name("b"), ["label", "dim", "b"])
    wide = F.greatest(F.lit(1), F.floor(F.lit(STRIP_BYTES // (8 * BLOCK)) / F.col("dim")))
    tile = F.xxhash64("label", "dim", F.floor(F.col("a") / wide), F.floor(F.col("b") / wide)).alias("tile")
    return scratch.table(named.select(tile, F.col("a_block").alias("a"), F.col("b_block").alias("b")), "pairs")


def _tiles(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each tile's blocks (block, dim, ids, copies, vectors) and after them its pairs (a, b), by tile. A block comes once for
    each tile that it is in."""
    need = pairs.select("tile", F.col("a").alias("block")).union(pairs.select("tile", F.col("b").alias("block"))).distinct()
    own = need.join(blocks.select("block", "dim", "ids", "copies", "vectors"), "block")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = own.select("tile", "block", "dim", "ids", "copies", "vectors", none("long", "a"), none("long", "b"))
    asked = pairs.select("tile", none("long", "block"), none("int", "dim"), none("binary", "ids"), none("binary", "copies"), none("binary", "vectors"), "a", "b")
    return held.unionByName(asked).repartition("tile").sortWithinPartitions("tile", F.col("a").isNotNull(), "block", "a", "b")


def _compare(tiles: DataFrame, cosine: float, double: bool) -> DataFrame:
    """Of each pair of blocks: (id, null, n) the rows that a vector is linked to in the other block, and (id, root, null)
    a spanning forest of the links. id stands for its vector's equals."""

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.neardup_vectors import unit

        kind, last, held = "<f8" if double else "<f4", None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                tile, block, d, ids, copies, raw, a, b = (c[k].as_py() for c in batch.columns)
                if tile != last:
                    last, held = tile, {}
                if block is not None:
                    held[block] = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), unit(np.frombuffer(raw, kind).reshape(-1, d))
                    continue
                (ia, ca, x), (ib, cb, y) = held[a], held[b]
                hit = x @ y.T >= cosine
                if a == b:
                    np.fill_diagonal(hit, False)
                rows_, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if not len(rows_):
                    continue
                hit, ia, ib, ca, cb = hit[np.ix_(rows_, cols)], ia[rows_], ib[cols], ca[rows_], cb[cols]
                ids, n = [ia], [hit @ cb]
                if a != b:
                    ids, n = [ia, ib], [*n, ca @ hit]
                # the smallest id reached so far, until none changes
                ra, rb, top = ia.copy(), ib.copy(), np.iinfo(np.int64).max
                while True:
                    na = np.minimum(ra, np.where(hit, rb[None, :], top).min(1))
                    nb = np.minimum(rb, np.where(hit, na[:, None], top).min(0))
                    if (na == ra).all() and (nb == rb).all():
                        break
                    ra, rb = na, nb
                ends, roots = np.concatenate([ia, ib]), np.concatenate([ra, rb])
                ends, roots = np.unique(np.column_stack([ends, roots])[ends != roots], axis=0).T if (ends != roots).any() else (ends[:0], ends[:0])
                ids, n = np.concatenate(ids), np.concatenate(n)
                empty = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), empty(len(ids)), pa.array(n)], ["id", "root", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(roots), empty(len(ends))], ["id", "root", "n"])

    return tiles.mapInArrow(run, "id long, root long, n long")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH own AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM own a JOIN own b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.fine AND b.fine
    AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
  SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(reach.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(reach.least, vec_id)) AS kept
FROM own LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""
