"""op2 and op7 against brute force, and connected components."""

import random

import numpy as np
import pytest

from vellumlake.llm import minhash, neardup_vectors
from vellumlake.llm.common import Scratch, connected_components


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none", "loops"])
def test_components(spark, shape):
    random.seed(4)
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(300)],
        "random": [(random.randrange(400), random.randrange(400)) for _ in range(250)],
        "none": [],
        "loops": [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4)],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)


def corpus():
    random.seed(9)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [random.choice(words) for _ in range(n)]
    rows, base, shared = [], text(300), text(80)
    for i in range(60):  # near copies of one text
        t = list(base)
        for _ in range(random.randrange(1, 14)):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]  # exact copies
    rows += [(200 + i, " ".join(shared + text(40 + 3 * i))) for i in range(60)]  # a passage in common
    rows += [(300, "One  TWO\tthree"), (301, "one two three"), (302, "one two three four"), (303, ""), (304, None), (305, " \n"), (306, "a"), (307, "a")]
    rows += [(None, "one two three"), (310, "again and again and"), (310, "again and again and"), (310, " ".join(base)), (311, "x " * 20_000), (312, "x " * 10_000)]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as sketch").repartition(6)
    got = minhash.near_duplicates(spark, df, k=k).collect()
    sets = [(i, minhash.sets((t or "").encode(), k)) for i, t in rows]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a is not None and b is not None and a != b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    own = groups({i for i, _ in rows if i is not None}, links)
    want = sorted(((i, len(s), own.get(i), i is None or own[i] == i) for i, s in sets), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = minhash.keep_one(spark, df, k=k)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(spark, df).count() == 0
    assert minhash.keep_one(spark, df).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    test_near_duplicates(spark, 5)


def test_sketch_estimates():
    random.seed(2)
    for kept in (1.0, 0.95, 0.9):
        a = [str(random.randrange(10**6)) for _ in range(600)]
        b = a[: int(600 * kept)] + [str(random.randrange(10**6)) for _ in range(600 - int(600 * kept))]
        x, y = (minhash.signature(" ".join(t).encode(), 4)[3] for t in (a, b))
        ones = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
        assert ones <= minhash.most_bits()


def vectors_table():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i % 2 else 1))
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(40)]  # equal vectors
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, rows[7][1], None), (605, [None, *rows[7][1][1:]], 1), (606, [float("inf")] * 16, 1), (607, rows[7][1][:3], 1), (608, [2 * x for x in rows[7][1]], rows[7][2]), (None, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    return rows


@pytest.mark.parametrize("kind,block", [("float", 1024), ("double", 16)])
def test_vectors(spark, monkeypatch, kind, block):
    monkeypatch.setattr(neardup_vectors, "RANGE", 64)
    monkeypatch.setattr(neardup_vectors, "FAN", 2)
    rows = vectors_table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", f"cast(embedding as array<{kind}>) embedding", "label", "1 as id", "2 as component_id")
    got = neardup_vectors.near_vectors(spark, df).collect()

    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [(i, np.array(r[1]), r[2], r[0]) for i, r in enumerate(rows) if fine(r)]
    n, links = [0] * len(rows), []
    for i, v, a, p in good:
        for j, w, b, q in good:
            if i < j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((p, q))
    own = groups({r[0] for r in rows if r[0] is not None}, links)
    want = sorted(((r[0], n[i], own.get(r[0]), r[0] is None or own[r[0]] == r[0]) for i, r in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup_vectors.near_vectors(spark, df).count() == 0
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in neardup_vectors.near_vectors(spark, df).collect()] == [(1, 0, 1, True)]
