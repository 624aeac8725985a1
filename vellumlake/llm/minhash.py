"""MinHash near-duplicates with odd sketches.

A document's MinHash samples give band keys and an odd sketch: each sample flips one bit, so the number of ones in the
XOR of two sketches tells how many samples differ. Documents that share a band key are candidates; those whose sketches
differ too much go; the rest are confirmed on their texts' full shingle sets.

No bucket's pairs are all put out. Texts of one shingle set are one node. First only neighbours in a bucket, in the order
of set sizes, are candidates; confirmed ones are joined to components. Then buckets that still hold several components
are compared in blocks, at first by sketches alone: who has no one across components that its sketch lets through is done
with. The others' hashed sets, and no more, are fetched and held against each other in blocks, and of those linked only
as many as join the components are put out and confirmed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, annotate, connected_components, free_name, give_back

#: Samples, and the band's width: a pair of similarity 0.8 shares none of the 32 bands once in 20 million.
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Pairs whose sketches put their similarity below this go: at 0.8, some six standard deviations.
LEAST_ESTIMATE = 0.6
#: Rows, and hashes, of a bucket in one block, about.
BLOCK, BLOCK_HASHES = 512, 1 << 18
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
#: Rows with whole texts or sets that go to a worker at once.
WIDE = 500
#: So many ids are broadcast at most (8 MB); more are joined by sorting.
BROADCAST_IDS = 1_000_000

SIGNATURE = "n_shingles long, set_id string, bands array<long>, sketch binary"

_PRIME = 0x9E3779B97F4A7C15
_PRIMES = _PRIME, 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict = {}


def most_bits(least: float = LEAST_ESTIMATE) -> int:
    """The most ones in the XOR of the sketches of two documents whose estimated similarity is at least this."""
    return math.floor(BITS / 2 * (1 - math.exp(-2 * (2 * SAMPLES * (1 - least)) / BITS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, prime: int = _PRIME) -> tuple[np.ndarray, np.ndarray]:
    """prime to the powers 0 to n - 1, and their inverses, modulo 2**64."""
    if len(_powers.get(prime, [()])[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[prime] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))]) for base in (prime, pow(prime, -1, 1 << 64))]
    up, down = _powers[prime]
    return up[:n], down[:n]


def words(text: bytes, prime: int = _PRIME) -> np.ndarray:
    """The hashes of the words in order, a stretch of the text at a time. A word's hash is a polynomial of its bytes, so one
    that goes on in the next stretch is added up."""
    b, out = np.frombuffer(text.lower(), np.uint8), []
    begun, length = 0, 0  # the sum so far, and the bytes, of a word that the last stretch ended in
    for at in range(0, len(b), STRETCH):
        c = b[at : at + STRETCH]
        up, down = _power(len(c), prime)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[c] * up, dtype=np.uint64)])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[c], [False]])))
        starts, ends = edge[::2], edge[1::2]
        h = (total[ends] - total[starts]) * down[starts]
        goes_on = length and len(starts) and starts[0] == 0
        if goes_on:
            h[0] = (begun + int(h[0]) * pow(prime, length, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
        elif length:
            out.append(np.array([begun], np.uint64))
        if len(ends) and ends[-1] == len(c):
            length = int(ends[-1] - starts[-1]) + (length if goes_on and len(starts) == 1 else 0)
            begun, h = int(h[-1]), h[:-1]
        else:
            length = 0
        out.append(h)
    if length:
        out.append(np.array([begun], np.uint64))
    return _mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The hashes of the distinct k-word shingles, sorted; with fewer words the whole sequence is one."""
    own = words(text)
    n = len(own)
    if not n:
        return own
    wide = min(k, n)
    h = own[: n - wide + 1]
    for i in range(1, wide):
        h = h * np.uint64(_PRIME) + own[i : n - wide + 1 + i]
    return np.unique(_mix(h + np.uint64(wide)))


def signature(text: bytes, k: int) -> tuple:
    """The fields of SIGNATURE."""
    import xxhash

    found = shingles(text, k)
    if not len(found):
        return 0, None, None, None
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[at : at + 2048, None] * _MULTIPLY + _ADD).min(0))
    drawn = least.astype(np.uint64)
    keys = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        keys = keys * np.uint64(_PRIME) + drawn[i::ROWS]
    keys = _mix(keys * np.uint64(_PRIME) + np.arange(BANDS, dtype=np.uint64))
    flips = np.bincount((_mix(drawn ^ _SALT) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return len(found), xxhash.xxh3_128_hexdigest(found.tobytes()), keys.view(np.int64).tolist(), np.packbits(flips.astype(np.uint8)).tobytes()


def sets(text: bytes, k: int) -> set:
    """The distinct shingles themselves."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def wide_shingles(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Two hashes of each distinct shingle, 128 bits in all, sorted by the first; None if two have only the first in common."""
    own = [words(text, p) for p in _PRIMES]
    n = len(own[0])
    wide = min(k, n)
    if not n:
        return own[0], own[1]
    both = []
    for w, p in zip(own, _PRIMES, strict=True):
        h = w[: n - wide + 1]
        for i in range(1, wide):
            h = h * np.uint64(p) + w[i : n - wide + 1 + i]
        both.append(_mix(h + np.uint64(wide)))
    at = np.argsort(both[0], kind="stable")
    x, y = both[0][at], both[1][at]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    if (~new[1:] & (y[1:] != y[:-1])).any():
        return None
    return x[new], y[new]


def alike(s: bytes, own, t: bytes, other, k: int, percent: int) -> bool:
    """Whether percent or more of the shingles of both texts are in common; own and other are their wide_shingles. Where these
    leave doubt, on the shingles themselves."""
    if own is not None and other is not None:
        _, i, j = np.intersect1d(own[0], other[0], assume_unique=True, return_indices=True)
        if (own[1][i] == other[1][j]).all():
            return 100 * len(i) >= percent * (len(own[0]) + len(other[0]) - len(i))
    a, b = sets(s, k), sets(t, k)
    return 100 * len(a & b) >= percent * len(a | b)


def confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b, text_a, text_b), a and b of those with percent or more of the union in common. A text takes 16 bytes a
    shingle."""

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.common import slices, utf8
        from vellumlake.llm.minhash import alike, wide_shingles

        last, own = None, None
        for whole in batches:
            for batch in slices(whole, 3):
                out = []
                for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                    if a != last:
                        last, own = a, wide_shingles(s, k)
                    if alike(s, own, t, wide_shingles(t, k), k, percent):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        give_back()

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, percent: int, hashed: bool) -> DataFrame:
    """Across components within a bucket, with hashed the pairs (a, b) that hashed sets say are linked, as few as join what
    can be joined; without, those (key, sid) that some sketch lets through. rows: key, i, j (a pair of blocks of the bucket, i <=
    j), block (the row's own), id, comp, n, sid, sketch and, with hashed, hashes (of the set's shingles, sorted, unsigned
    64-bit), dealt by (key, i, j) and sorted; a task holds two blocks."""
    limit = most_bits()
    names = ["a", "b"] if hashed else ["key", "sid"]

    def run(batches):
        import pyarrow as pa

        def linked(s, t):
            both = np.concatenate([s, t])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return 100 * common >= percent * (len(both) - common)

        def near(left, right, comp, n, sketch):
            """Pairs of the rows left and right across components whose sizes and sketches let them be linked."""
            open_ = comp[left, None] != comp[None, right]
            small, large = np.minimum(n[left, None], n[None, right]), np.maximum(n[left, None], n[None, right])
            open_ &= 100 * small >= percent * large
            x, y = np.nonzero(open_)
            for s in range(0, len(x), 1 << 16):
                u, v = left[x[s : s + (1 << 16)]], right[y[s : s + (1 << 16)]]
                fits = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64) <= limit
                yield u[fits], v[fits]

        def survivors(key, i, j, block, ids, comp, n, sid, sketch):
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            stay = np.zeros(len(ids), bool)
            for at in range(0, len(left), 256):
                for u, v in near(left[at : at + 256], right, comp, n, sketch):
                    stay[u] = stay[v] = True
            if stay.any():
                yield key[stay], sid[stay]

        def joined(key, i, j, block, ids, comp, n, sid, sketch, hashes):
            """Links that join components within the two blocks, as few as do."""
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            up: dict = {}
            out = []

            def find(c):
                while c in up:
                    c = up[c]
                return c

            for at in range(0, len(left), 256):
                now = np.fromiter(map(find, comp.tolist()), np.int64, len(comp))
                for u, v in near(left[at : at + 256], right, now, n, sketch):
                    for p, q in zip(u.tolist(), v.tolist(), strict=True):
                        a, b = find(comp[p]), find(comp[q])
                        if a != b and linked(hashes[p], hashes[q]):
                            up[max(a, b)] = min(a, b)
                            out.append((ids[p], ids[q]))
            if out:
                a, b = np.array(out, dtype=np.int64).T
                yield np.minimum(a, b), np.maximum(a, b)

        def done(held):
            columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for y in c for x in y] for c in zip(*held, strict=True)]
            return list((joined if hashed else survivors)(*columns)) if len(columns[0]) > 1 else []

        held: list = []
        for batch in batches:
            rows_ = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            rows_.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            if hashed:
                rows_.append([np.frombuffer(x, "<u8") for x in batch.column(9).to_pylist()])
            key, i, j = rows_[:3]
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = [0, *new.tolist(), len(key)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = tuple(c[a:b] for c in rows_)
                if held and any(held[-1][c][0] != part[c][0] for c in range(3)):
                    out += done(held)
                    held = []
                if b > a:
                    held.append(part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
        out = done(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
        held.clear()
        give_back()

    own = rows.select("key", "i", "j", "block", "id", "comp", "n", "sid", "sketch", *(["hashes"] if hashed else []))
    return own.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def paired(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (key, sid, ...) once for each pair of blocks of their bucket that they take part in; blocks: key, blocks."""
    out = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return out


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def neighbours(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of bucket rows (key, n, id, sid) those that share their key with others, and the next of their bucket (id, sid, n) by size.

    Ranges of (key, n, id, sid) are dealt out, so a bucket may take many tasks. Each part puts its first and its last row out
    beside the others; where a bucket goes on from one part to the next, these are brought together."""
    order = ["key", "n", "id", "sid"]
    after = "next struct<id:long,sid:long,n:long>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, shared = TaskContext.get().partitionId(), None, False

        def out(m, nexts, known, edge):
            """Rows m, a row of numbers each, nexts likewise where known."""
            fields = [pa.array(nexts[:, c]) for c in (2, 3, 1)]
            after_ = pa.StructArray.from_arrays(fields, ["id", "sid", "n"], mask=pa.array(~known))
            count = len(m)
            return pa.RecordBatch.from_arrays([*(pa.array(m[:, c]) for c in range(4)), after_, pa.array(np.full(count, part, np.int32)), pa.array(np.full(count, edge, np.int32))], [*order, "next", "part", "edge"])

        none = np.zeros((1, 4), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([c.to_numpy() for c in batch.columns])
            if last is None:
                yield out(m[:1], none, np.zeros(1, bool), 1)
            else:
                m = np.concatenate([last, m])
            same = m[1:, 0] == m[:-1, 0]  # with the next one
            before = np.concatenate([[shared], same])[:-1]
            stay = same | before
            if stay.any():
                yield out(m[:-1][stay], m[1:][stay], same[stay], 0)
            last, shared = m[-1:], bool(same[-1]) if len(same) else shared
        if last is not None:
            yield out(last, none, np.zeros(1, bool), 3 if shared else 2)

    spread = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.table(spread.mapInArrow(run, f"key long, n long, id long, sid long, {after}, part int, edge int"), "sorted")
    ends = found.where("edge > 0").select(*order, "part", "edge")
    parts = sorted(r[0] for r in ends.where("edge = 1").select("part").collect())  # one number for each part of the sort
    follows = F.broadcast(rows.sparkSession.createDataFrame(list(zip(parts[:-1], parts[1:], strict=True)), "part int, follows int"))
    firsts = ends.where("edge = 1").select(F.col("part").alias("follows"), F.col("key").alias("next_key"), F.struct("id", "sid", "n").alias("next"))
    lasts = ends.where("edge > 1").join(follows, "part", "left").join(firsts, "follows", "left")
    goes_on = F.coalesce(F.col("next_key") == F.col("key"), F.lit(False))
    # a part's last row stays if its bucket has others before or behind; its first too, when only the part before has them
    lasts = lasts.select(*order, F.when(goes_on, F.col("next")).alias("next"), "part", (goes_on | (F.col("edge") == 3)).alias("stay"), goes_on.alias("on"), "follows")
    met = lasts.where("on").select(F.col("follows").alias("part"))
    single = found.where("edge = 1").join(F.broadcast(met), "part", "left_semi").select(*order)
    out = found.where("edge = 0").select(*order, "next").unionByName(lasts.where("stay").select(*order, "next"))
    # a first row that no other row of its part shares the bucket with came out nowhere yet, but for parts of a single row
    missing = single.join(out.select(*order), order, "left_anti").withColumn("next", F.lit(None).cast("struct<id:long,sid:long,n:long>"))
    return scratch.table(out.unionByName(missing), "buckets")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id and kept.

    Two documents are linked if their sets of distinct k-word shingles have percent or more of the union in common; words
    are what ASCII's six white-space characters separate, A-Z lower-cased. component_id is the smallest doc_id that can
    be reached over links; kept says whether it is the row's own. A null or empty text has an empty set and no links.
    Rows that share a doc_id are one document. A null doc_id has no links, a null component and is kept. Other columns
    are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(spark, "minhash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, _ = annotate(own.withColumn("text_id", F.xxhash64("text")), "text", SIGNATURE, lambda: lambda texts: [signature(t or b"", k) for t in texts], ["doc_id", "text_id"])
    signed = scratch.table(signed.select("doc_id", "text_id", "n_shingles", "set_id", "bands", "sketch"), "signed", batch=WIDE)

    # one node for each set: the smallest doc_id that has it
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = with_set.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_id")).alias("m")).select("set_id", F.col("m.doc_id").alias("id"), F.col("m.text_id").alias("text_id"))
    nodes = scratch.table(nodes, "nodes")
    same = with_set.select("doc_id", "set_id").join(nodes.select("set_id", "id"), "set_id").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    same = scratch.table(same, "same")
    full = signed.join(nodes.select("set_id", F.col("id").alias("doc_id"), "text_id"), ["set_id", "doc_id", "text_id"], "left_semi")
    full = full.dropDuplicates(["set_id"]).select(F.col("doc_id").alias("id"), "text_id", "set_id", F.col("n_shingles").alias("n"), "bands", "sketch")

    # bucket rows, with the next in the bucket; sid stands for the set: should two have the same, there are candidates to spare
    full = full.withColumn("sid", F.xxhash64("set_id")).drop("set_id")
    rows = neighbours(full.select(F.explode("bands").alias("key"), "n", "id", "sid"), scratch)
    sketches = scratch.table(full.select("id", "text_id", "sid", "sketch").join(rows.select("sid").distinct(), "sid", "left_semi"), "sketches")

    pairs = rows.where("next is not null").where(f"next.id <> id and 100 * n >= {int(percent)} * next.n").select(F.col("sid").alias("s"), F.col("next.sid").alias("t")).distinct()
    side = lambda c: sketches.select(F.col("sid").alias(c), F.col("id").alias(f"{c}_id"), F.col("sketch").alias(f"{c}_sketch"))
    words = lambda c: [F.conv(F.hex(F.substring(c, 1 + 8 * i, 8)), 16, -10).cast("long") for i in range(BITS // 64)]
    differ = lambda x, y: sum((F.bit_count(p.bitwiseXOR(q)) for p, q in zip(words(x), words(y), strict=True)), F.lit(0))
    near = pairs.join(side("s"), "s").join(side("t"), "t").where((F.col("s_id") != F.col("t_id")) & (differ("s_sketch", "t_sketch") <= most_bits()))
    first = scratch.table(near.select(F.least("s_id", "t_id").alias("a"), F.greatest("s_id", "t_id").alias("b")).distinct(), "near")
    links = scratch.table(_confirmed(scratch, own, nodes, first, k, percent), "links", batch=WIDE)

    # buckets that still hold several components: sketches alone go through their blocks
    comps = connected_components(links, scratch)
    known = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "sid", "n", F.coalesce("component", "id").alias("comp"))
    known = scratch.table(known, "known")
    many = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    many = many.where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    light = paired(known, many).join(sketches.select("sid", "sketch"), "sid")
    stay = scratch.table(in_blocks(dealt(light), percent, False).distinct(), "stay")
    # sets of those that are left
    todo = scratch.table(known.join(stay, ["key", "sid"], "left_semi"), "todo")
    sizes = todo.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_HASHES)).cast("int").alias("blocks"))
    whole = sketches.join(todo.select("sid").distinct(), "sid", "left_semi")
    texts = _texts(scratch, own, whole.select("id", "text_id"))
    hashed, _ = annotate(texts, "text", "hashes binary", lambda: lambda some: [(shingles(t or b"", k).astype("<u8").tobytes(),) for t in some], ["doc_id", "text_id"])
    hashed = scratch.table(hashed.select(F.col("doc_id").alias("id"), "text_id", "hashes"), "hashed", batch=WIDE)
    heavy = paired(todo, sizes).join(whole.join(hashed, ["id", "text_id"]).select("sid", "sketch", "hashes"), "sid")
    second = scratch.table(in_blocks(dealt(heavy), percent, True).where("a <> b").distinct(), "linked", batch=WIDE).join(first, ["a", "b"], "left_anti")
    second = scratch.table(second, "second")
    more = scratch.table(_confirmed(scratch, own, nodes, second, k, percent), "links", batch=WIDE)
    scratch.drop(rows, sketches, first, known, stay, todo, texts, hashed, second)

    found = connected_components(links.union(more).union(same), scratch)
    scratch.drop(nodes, same, links, more, comps)
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _texts(scratch: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text_id and text of the nodes ids (id, text_id). Only these texts are moved."""
    ids = scratch.table(ids.distinct().withColumnRenamed("id", "doc_id"), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.withColumn("text_id", F.xxhash64("text")).join(F.broadcast(ids) if few else ids, ["doc_id", "text_id"], "left_semi")
    return scratch.table(texts.dropDuplicates(["doc_id", "text_id"]).select("doc_id", "text_id", "text"), "texts")


def _confirmed(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs of node ids, those that the texts confirm."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _texts(scratch, docs, nodes.select("id", "text_id").join(ids, "id", "left_semi"))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    return confirm(whole, k, percent).distinct()


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component, by 4-word shingles."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component does: that of the smallest doc_id, and of rows that
    share it the one of the smallest text. All columns stay; rows without doc_id stay."""
    scratch = Scratch(spark, "minhash")
    found = near_duplicates(spark, docs, k, percent, scratch)
    kept = scratch.table(found.where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    name = free_name(docs, "own_id")
    ids = kept.select(F.col("doc_id").alias(name))
    both = docs.join(F.broadcast(ids) if kept.count() <= BROADCAST_IDS else ids, F.col("doc_id") == F.col(name), "left")
    stay = both.where(F.col(name).isNotNull() | F.col("doc_id").isNull()).drop(name)
    twice = scratch.table(stay.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name)), "twice")
    if twice.isEmpty():
        return stay
    alike = stay.join(twice, F.col("doc_id") == F.col(name), "left_semi").withColumn(name, F.xxhash64("text"))
    return stay.join(twice, F.col("doc_id") == F.col(name), "left_anti").unionByName(alike.orderBy(name).dropDuplicates(["doc_id"]).drop(name))
