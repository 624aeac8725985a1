"""Hard negatives by inner product over k-means inverted lists.

Vectors are listed by their nearest centroid, each list with its radius, the greatest distance of a vector from the
centroid. By Cauchy-Schwarz an anchor's inner product with a vector of the list is at most anchor . centroid + |anchor|
radius, and at least the same with a minus. A search visits lists by falling upper bound: first, for every query, the few
lists with the highest, which gives it a kth score; then all others, but those that lie outside the query's window of
scores, or whose bound is strictly below the kth score, are skipped. So results are exact, whatever the centroids are.

Queries go in blocks, lists in blocks of rows; the task of a pair of them is a matrix product. The stated queries against
all rows, in blocks: no pairs of rows ever come out but each block's best few.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Centroids are fitted on so many rows at most, those of the smallest hash; every row is listed.
SAMPLE = 20_000
#: About the square root of the number of rows, at most so many, which bounds what is broadcast.
CENTROIDS = 1024
ROUNDS = 8
#: Rows of a list, and queries, in one block.
BLOCK = 1024
#: Lists that each query visits first.
FIRST = 4
#: Rows whose squared length reaches this take no part: their scores wouldn't be 64-bit integers.
MOST_SQUARED = 2.0**62

FOUND = "q long, own long, id long, label long, score long"


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centroids of vectors, by Lloyd's rounds."""
    x = np.random.default_rng(12).permutation(np.unique(x, axis=0))
    c = x[:k].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        n, sums = np.bincount(near, minlength=len(c)), np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of integers in the least type that holds it."""
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if x.size == 0 or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.int64)


class Lists:
    """The table of lists in blocks, and the directory: by vector length, (centroids, radii, least and greatest label) of the
    lists, which is bounded, so it is broadcast."""

    def __init__(self, blocks: DataFrame, directory: dict):
        self.blocks, self.directory = blocks, directory


def listed(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> Lists:
    """Inverted lists of rows (own, id, label, v): own tells rows apart, v holds integers. A vector length that the sample lacks
    has the origin as its only centroid."""
    n = rows.count()
    taken = rows.select("v", F.xxhash64("own", F.lit(12)).alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    by: dict = {}
    for v in taken:
        by.setdefault(len(v), []).append(v)
    k = max(1, min(CENTROIDS, round(n**0.5)))
    centroids = {d: _fit(np.array(vs, np.float64), max(1, k * len(vs) // len(taken))) for d, vs in by.items()}
    known = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        import pyarrow as pa

        from vellumlake.llm.negatives import _matrix, _nearest

        for batch in batches:
            size = batch.column("dim").to_numpy()
            at, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d in np.unique(size).tolist():
                mine = np.flatnonzero(size == d)
                x = _matrix(batch.column("v").take(pa.array(mine))).astype(np.float64)
                c = known.value.get(d, np.zeros((1, d)))
                at[mine] = near = _nearest(x, c)
                far[mine] = np.sqrt(((x - c[near]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], [*batch.schema.names, "list", "far"])

    kept = rows.select("own", "id", "label", "v", F.size("v").alias("dim"))
    placed = scratch.table(kept.mapInArrow(assign, "own long, id long, label long, v array<long>, dim int, list int, far double"), "placed")
    directory: dict = {}
    for d, at, far, few, many in placed.groupBy("dim", "list").agg(F.max("far"), F.min("label"), F.max("label")).collect():  # a row for each list
        c = centroids.get(d, np.zeros((1, d)))
        one = directory.setdefault(d, (c, np.full(len(c), -1.0), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)))
        one[1][at], one[2][at], one[3][at] = far, few, many

    # a list's rows by label and id, in blocks; ranges of the order are dealt out, so that no task has a whole long list
    order = ["dim", "list", "label", "id", "own"]
    dealt = placed.select(*order, "v").repartitionByRange(max(1, -(-n // (8 * BLOCK))), *order).sortWithinPartitions(*order)
    fields = "dim int, list int, few long, many long, own array<long>, id array<long>, label array<long>, kind string, v binary"

    def cut(batches):
        import pyarrow as pa

        from vellumlake.llm.negatives import _in_blocks, _matrix, _packed

        for part in _in_blocks(batches, ["dim", "list"]):
            own, ids, label = (np.concatenate([b.column(c).to_numpy() for b in part]) for c in ("own", "id", "label"))
            kind, raw = _packed(np.concatenate([_matrix(b.column("v")) for b in part]))
            row = [part[0].column("dim")[0].as_py(), part[0].column("list")[0].as_py(), label.min(), label.max(), own, ids, label, kind, raw]
            yield _row(row, fields)

    blocks = scratch.table(dealt.mapInArrow(cut, fields).withColumn("block", F.monotonically_increasing_id()), "lists")
    scratch.drop(placed)
    return Lists(blocks, directory)


def _row(values: list, fields: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    named = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, named, strict=True)], [n for n, _ in named])


def _in_blocks(batches, keys: list[str]):
    """Sorted batches in lists of slices: at most BLOCK rows, equal in the columns keys."""
    held, size, last = [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s < e and held and tuple(c[s] for c in columns) != last:
                yield held
                held, size = [], 0
            while s < e:
                end = min(e, s + BLOCK - size)
                held.append(batch.slice(s, end - s))
                last = tuple(c[s] for c in columns)
                size, s = size + end - s, end
                if size == BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k first columns of the highest score among those that fit, of each row; ties by column."""
    lowest = np.iinfo(np.int64).min
    s = np.where(fits, score, lowest)
    rows, columns, at = [], [], np.flatnonzero(fits.any(1))
    for _ in range(k):
        c = s[at].argmax(1) if len(at) else at
        left = s[at, c] > lowest
        at, c = at[left], c[left]
        rows.append(at)
        columns.append(c)
        s[at, c] = lowest
    return np.concatenate(rows), np.concatenate(columns)


class Group:
    """A block of queries of one vector length, and how they visit lists: `top`, by query and list, is the highest score that is
    possible and wanted, -inf for lists to skip; `early` has the FIRST lists by it."""

    def __init__(self, row: dict, directory: dict, same: bool):
        self.q, self.anchor, self.label, self.lo, self.hi = (np.array(row[c], np.int64) for c in ("q", "anchor", "label", "lo", "hi"))
        self.kth = np.array(row["kth"], np.float64)
        self.x = _unpacked(row["kind"], row["v"], len(self.q))
        x = self.x.astype(np.float64)
        self.length = np.sqrt((x * x).sum(1))
        c, radius, few, many = directory.get(row["dim"], (np.zeros((0, row["dim"])), np.zeros(0), np.zeros(0), np.zeros(0)))
        mid, reach = x @ c.T, self.length[:, None] * np.maximum(radius, 0)
        slack = 1e-9 * (self.length[:, None] * np.sqrt((c * c).sum(1)) + reach) + 1e-6
        self.top = np.minimum(mid + reach + slack, self.hi[:, None].astype(np.float64))
        skip = (mid + reach + slack < self.lo[:, None]) | (mid - reach - slack > self.hi[:, None]) | (radius < 0)
        if same:
            skip |= (self.label[:, None] < few) | (self.label[:, None] > many)
        self.top[skip] = -np.inf
        first = np.argsort(-self.top, axis=1, kind="stable")[:, :FIRST]
        self.early = np.zeros(self.top.shape, bool)
        self.early[np.arange(len(first))[:, None], first] = True

    def wanted(self, first: bool) -> np.ndarray:
        """By query and list, those to visit: a bound strictly below the kth score ends a query's visits."""
        return (self.early == first) & np.isfinite(self.top) & (self.top >= self.kth[:, None])


GROUP = "dim int, q array<long>, anchor array<long>, label array<long>, lo array<long>, hi array<long>, kind string, v binary"


def search(spark: SparkSession, lists: Lists, queries: DataFrame, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """FOUND and rank: up to k rows of each query, those of the highest inner product with v, ties by smaller id, among the rows
    of the same label (or, not same, of another) whose score is from lo to hi, but none of the anchor's own id. queries: q, which
    tells them apart, near, a number that brings like queries together, anchor, label, lo, hi, v."""
    directory = spark.sparkContext.broadcast(lists.directory)

    def group(batches):
        from vellumlake.llm.negatives import GROUP, _in_blocks, _matrix, _packed, _row

        for part in _in_blocks(batches, ["dim"]):
            columns = [np.concatenate([b.column(c).to_numpy() for b in part]) for c in ("q", "anchor", "label", "lo", "hi")]
            yield _row([part[0].column("dim")[0].as_py(), *columns, *_packed(np.concatenate([_matrix(b.column("v")) for b in part]))], GROUP)

    shaped = queries.select(F.size("v").alias("dim"), "near", "q", "anchor", "label", "lo", "hi", "v")
    shaped = shaped.repartitionByRange(max(1, -(-queries.count() // BLOCK)), "dim", "near", "q").sortWithinPartitions("dim", "near", "q")
    groups = scratch.table(shaped.mapInArrow(group, GROUP).withColumn("group", F.monotonically_increasing_id()), "groups")

    def visits(first: bool):
        def run(batches):
            import pyarrow as pa

            from vellumlake.llm.negatives import Group

            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    own = Group(row, directory.value, same)
                    wanted = own.wanted(first)
                    at = np.flatnonzero(wanted.any(0))
                    bound = np.where(wanted, own.top, -np.inf).max(0)[at] if len(at) else np.empty(0)
                    columns = [np.full(len(at), row["group"], np.int64), np.full(len(at), row["dim"], np.int32), at.astype(np.int32), bound]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "dim", "list", "bound"])

        return run

    def tile(first: bool):
        """Of a group and the blocks of lists that came with it, by falling bound: each query's best k."""

        def run(batches):
            import pyarrow as pa

            from vellumlake.llm.negatives import Group, _best, _unpacked

            number, own, found = None, None, {}

            def out():
                rows = [(int(own.q[p]), *x) for p, best in found.items() for x in best]
                return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in list(zip(*rows, strict=True)) or [()] * 5], ["q", "own", "id", "label", "score"])

            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if number != row["group"]:
                        if own is not None:
                            yield out()
                        number, own, found = row["group"], Group(row, directory.value, same), {}
                    mine = own.wanted(first)[:, row["list"]]
                    if same:
                        mine &= (own.label >= row["few"]) & (own.label <= row["many"])
                    mine = np.flatnonzero(mine)
                    if not len(mine):
                        continue
                    turn = np.argsort(np.array(row["ids"], np.int64), kind="stable")  # ties by id
                    rows, ids, labels = (np.array(row[c], np.int64)[turn] for c in ("rows", "ids", "labels"))
                    x, y = own.x[mine], _unpacked(row["y_kind"], row["y"], len(ids))[turn]
                    z = y.astype(np.float64)
                    if own.length[mine].max() * np.sqrt((z * z).sum(1).max()) < 2.0**52:  # sums of doubles are exact then
                        score = (x.astype(np.float64) @ z.T).astype(np.int64)
                    else:
                        score = x @ y.T
                    fits = (score >= own.lo[mine, None]) & (score <= own.hi[mine, None]) & (own.anchor[mine, None] != ids)
                    fits &= (own.label[mine, None] == labels) == same
                    for p, c in zip(*_best(score, fits, k), strict=True):
                        found.setdefault(int(mine[p]), []).append((int(rows[c]), int(ids[c]), int(labels[c]), int(score[p, c])))
                    for p in mine[fits.any(1)].tolist():
                        found[p] = sorted(found[p], key=lambda t: (-t[3], t[1], t[0]))[:k]
                        if len(found[p]) == k:
                            own.kth[p] = max(own.kth[p], found[p][-1][3])
            if own is not None:
                yield out()

        return run

    strips = max(1, lists.blocks.count() // 16)

    def round_(state: DataFrame, first: bool) -> DataFrame:
        todo = scratch.table(state.mapInArrow(visits(first), "group long, dim int, list int, bound double"), "visits")
        side = lists.blocks.select("dim", "list", "block", "few", "many", F.col("own").alias("rows"), F.col("id").alias("ids"), F.col("label").alias("labels"), F.col("kind").alias("y_kind"), F.col("v").alias("y"))
        both = todo.join(side, ["dim", "list"]).join(state.drop("dim"), "group")
        both = both.withColumn("strip", F.pmod(F.xxhash64("block"), F.lit(strips))).repartition("group", "strip").sortWithinPartitions("group", "strip", F.desc("bound"), "block")
        return both.mapInArrow(tile(first), FOUND)

    def merged(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "own"))
        return found.withColumn("rank", rank).where(f"rank <= {int(k)}")

    none = F.transform("q", lambda x: F.lit(float("-inf")))
    early = scratch.table(merged(round_(groups.withColumn("kth", none), True)).drop("rank"), "early")
    kth = early.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n = {int(k)}").select("q", F.col("least").cast("double").alias("least"))
    known = groups.select("group", F.posexplode("q").alias("at", "q")).join(kth, "q", "left").groupBy("group")
    known = known.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("least", F.lit(float("-inf"))).alias("least")))).alias("known"))  # at most BLOCK
    state = groups.join(known, "group").withColumn("kth", F.col("known.least")).drop("known")
    late = scratch.table(round_(scratch.table(state, "state"), False), "late")
    return scratch.table(merged(early.unionByName(late)), "found")


def hard_negatives(
    spark: SparkSession, rows: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scratch: Scratch | None = None
) -> DataFrame:
    """Hard negatives of the anchors among rows (vec_id, label, v), v of integers: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score.

    An anchor is a row that the Column anchors holds for. Its positives are the first `positives` other rows of its label by
    score, the inner product with the anchor, ties by smaller vec_id. For each, the first `negatives` rows of another label
    come out whose score is from `low` to `high` percent of the positive's. Only vectors of one length meet.

    A null vec_id, label, vector or component, an empty vector, and one whose squared length reaches 2**62 (its scores might
    not be 64-bit integers) take no part. Repeated rows are one row; rows that share a vec_id but differ are rows of their own,
    but never partners of each other. An anchor without positives, or none fitting, gives no rows, as does an empty table.
    Other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "negatives")
    fine = F.size("v") > 0
    fine &= F.forall("v", lambda x: x.isNotNull()) & (F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < MOST_SQUARED)
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), anchors.alias("anchor"))
    own = own.where("id is not null and label is not null and v is not null").where(fine).withColumns({"g": F.xxhash64("v"), "h": F.xxhash64(F.lit(7), "v")})
    own = own.groupBy("id", "label", "g", "h").agg(F.first("v").alias("v"), F.max("anchor").alias("anchor"))
    own = scratch.table(own.select(F.monotonically_increasing_id().alias("own"), "id", "label", "v", "anchor"), "rows")
    lists = listed(spark, own, scratch)
    base = own.where("anchor").select("own", F.col("id").alias("anchor"), "label", "v")
    top = F.lit(1 << 62)
    found = search(spark, lists, base.select(F.col("own").alias("q"), F.col("anchor").alias("near"), "anchor", "label", (-top).alias("lo"), top.alias("hi"), "v"), True, positives, scratch)
    share = lambda p, up: (F.ceil if up else F.floor)(F.col("score").cast("decimal(20,0)") * F.lit(p).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    asked = found.select(F.col("q").alias("of"), F.col("id").alias("positive_id"), "score", share(low, True).alias("lo"), share(high, False).alias("hi"))
    asked = asked.where("lo <= hi").join(base.withColumnRenamed("own", "of"), "of").withColumn("q", F.monotonically_increasing_id())
    asked = scratch.table(asked, "asked")
    got = search(spark, lists, asked.select("q", F.col("of").alias("near"), "anchor", "label", "lo", "hi", "v"), False, negatives, scratch)
    pairs = asked.select("q", F.col("anchor").alias("anchor_id"), "positive_id", F.col("score").alias("positive_score"))
    out = got.select("q", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, after a part of the labels is changed."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = lambda c: c.cast("double")
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < 2.0**54))
    whole = F.when(good, F.transform("embedding", lambda c: F.floor(x(c) * 256)))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("v"))
    return hard_negatives(spark, rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
pos AS (SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
neg AS (
  SELECT pos.a, pos.b AS p, pos.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) AS r
  FROM pos JOIN scores n ON n.a = pos.a AND NOT n.same AND 50 * pos.s <= 100 * n.s AND 100 * n.s <= 95 * pos.s)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM neg WHERE r <= 3
"""
