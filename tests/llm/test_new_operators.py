"""Fingerprints, hard negatives and phrases against plain versions, with odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumlake.llm import fingerprints, negatives, phrases


def text(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}{'.' * (rng.random() < 0.1)}" for _ in range(n))


# fingerprints


def edit_distance(a, b):
    """Without replacing, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def plain_fingerprint(data):
    """Byte by byte."""
    if not data:
        return "0::"
    hashes = []
    for i in range(len(data)):
        seen = [0] * max(0, 7 - i) + [*data[max(0, i - 7) : i + 1]]
        h = sum((x + 1) * pow(0x9E3779B1, 7 - j, 1 << 32) for j, x in enumerate(seen)) % (1 << 32)
        h ^= h >> 16
        h = h * 0x85EBCA6B % (1 << 32)
        h ^= h >> 13
        hashes.append(h * 0xC2B2AE35 % (1 << 32))
    zeros = [next((k for k in range(32) if h >> k & 1), 32) for h in hashes]
    level = max(0, (len(data) // 48).bit_length() - 1)
    while level and sum(z >= level for z in zeros) < 8:
        level -= 1

    def pieces(k):
        sums, now, n = [], 0, 0
        for z, h in zip(zeros, hashes, strict=True):
            now, n = now + h * 0x9E3779B97F4A7C15, n + 1
            if z >= k and len(sums) < 511:
                sums.append(now)
                now = n = 0
        out = ""
        for s in [*sums, now] if n else sums:
            s %= 1 << 64
            s = (s ^ (s >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            out += fingerprints.DIGITS[s >> 58] + fingerprints.DIGITS[s >> 52 & 63]
        return out

    return f"{level}:{pieces(level)}:{pieces(level + 1)}"


def test_fingerprint_is_the_plain_one(monkeypatch):
    rng = random.Random(3)
    texts = [b"", b"a", b"ab" * 400, b"\x00" * 100, *(text(rng, n).encode() for n in (1, 5, 60, 700)), rng.randbytes(3000)]
    want = [plain_fingerprint(t) for t in texts]
    assert [fingerprints.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(fingerprints, "STRETCH", 64)  # texts of many stretches
    assert [fingerprints.fingerprint(t) for t in texts] == want


def test_likeness_is_an_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(f"{rng.choice('ab')}{rng.choice('xy')}" for _ in range(rng.randrange(1, 30))) for _ in range(2))
        s, t = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (a, b))
        assert fingerprints._alike(a, b) == pytest.approx(1 - edit_distance(s, t) / (len(s) + len(t)))
    base = text(rng, 3000).encode()
    f = fingerprints.fingerprint(base)
    assert fingerprints.likeness(f, f) == 1
    for other in (base[:5000] + b" put in " + base[5000:], base[:9000] + base[9300:], b"ahead " + base):
        assert fingerprints.likeness(f, fingerprints.fingerprint(other)) > 0.9
    assert 0.5 < fingerprints.likeness(f, fingerprints.fingerprint(base[: len(base) // 2])) <= 0.75
    assert fingerprints.likeness(f, fingerprints.fingerprint(rng.randbytes(len(base)))) < 0.1
    assert fingerprints.likeness("0::", "0::") == 1
    assert fingerprints.likeness("0::", "3:AAAA:AA") == 0
    assert fingerprints.likeness("9:AAAA:AA", "3:AAAA:AA") == 0


def test_edited_chain(spark):
    rng = random.Random(5)
    rows = [(i * 3, text(rng, rng.randrange(0, 300)), "x") for i in range(60)]
    rows += [(7, None, "x"), (8, "", "x"), (10, "é" * 5000, "x"), (11, "\U0001f600 long " * 200_000, "x"), (6, rows[2][1], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.edited_chain(spark, df).collect()}
    order = sorted((r for r in rows if r[0] is not None and r[0] != 6), key=lambda r: -r[0])
    assert len(got) == len({r[0] for r in rows})
    for (a, s, _), (b, t, _) in pairwise(order):
        if 6 in (a, b) or (a > 6 > b):
            continue  # two rows share the id: their order is by hash
        s, t = s or "", t or ""
        n = len(s) // 3
        edited = (s[: len(s) - n] + t[:n]).encode()
        r = got[a]
        assert (r["n_chars"], r["edited_sha256"]) == (len(s), hashlib.sha256(edited).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.fingerprint(s.encode()), fingerprints.fingerprint(edited))
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(t.encode()))
    # the last one's next is the first: no id comes last, after the smallest
    first = order[0][1]
    assert got[None]["edited_sha256"] == hashlib.sha256(("no id"[:4] + first[:1]).encode()).hexdigest()
    same = fingerprints.edited_chain(spark, spark.createDataFrame([(1, "ab cd")] * 3, "doc_id long, text string")).collect()
    assert len(same) == 3 and {r["near_next"] for r in same} == {1.0}
    assert fingerprints.edited_chain(spark, df.limit(0)).count() == 0


def test_fingerprint_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "mine"), (2, None, None)], "doc_id long, text string, Fingerprint string")
    out, name = fingerprints.with_fingerprints(df)
    assert name == "_fingerprint" and [r[name] for r in out.orderBy("doc_id").collect()] == [fingerprints.fingerprint(b"a b c"), "0::"]
    both, like = fingerprints.with_likeness(out.withColumn("other", F.when(F.col("doc_id") == 1, F.col(name))), name, "other")
    assert [r[like] for r in both.orderBy("doc_id").collect()] == [1.0, None]


# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    fine = {(i, y, tuple(v)) for i, y, v in rows if None not in (i, y, v) and v and None not in v}
    out = []
    for i, y, v in fine:
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: E731,B023
        others = [(-score(w), j, z) for j, z, w in fine if j != i and len(w) == len(v)]
        for s, p, _ in sorted(o for o in others if o[2] == y)[:positives]:
            fits = sorted(o for o in others if o[2] != y and -low * s <= -100 * o[0] <= -high * s)[:negatives_]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 7])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), rng.integers(-9, 10, 4).tolist()) for i in range(160)]
    rows += [(200 + i, i % 2, [3, 3, 3, 3]) for i in range(40)]  # equal vectors, ties
    rows += [(300 + i, i % 2, rng.integers(-5, 6, 6).tolist()) for i in range(12)]  # another length
    rows += [(400, 1, [2**30, 1, 0, 0]), (410, 0, [2**25, 3, 0, 0])]  # sums beyond doubles
    rows += [(500, None, [1, 2, 3, 4]), (None, 1, [1, 2, 3, 4]), (501, 1, None), (502, 1, [1, None, 2, 3]), (503, 1, [])]
    rows += [(0, rows[0][1], rows[0][2])] * 3  # repeated rows
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, v array<long>, anchor string").repartition(3)
    got = negatives.hard_negatives(spark, df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert negatives.hard_negatives(spark, df.limit(0), F.lit(True)).count() == 0
    if block == 7:
        return
    far = spark.createDataFrame([(5, 1, [2**40, 2**40]), (6, 1, [1, 1])], "vec_id long, label int, v array<long>")
    assert negatives.hard_negatives(spark, far, F.lit(True)).count() == 0


def test_bounds_hold():
    """No row of a list scores more than the list's bound for a query, nor less than what makes it skipped."""
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, (400, 5))
    c = negatives._fit(x.astype(float), 12)
    near = negatives._nearest(x.astype(float), c)
    radius = np.array([max([np.linalg.norm(v - c[k]) for v in x[near == k]], default=-1) for k in range(12)])
    kind, raw = negatives._packed(x[:20])
    row = {"q": range(20), "anchor": range(20), "label": [0] * 20, "lo": [1500] * 20, "hi": [2500] * 20, "kth": [-np.inf] * 20, "kind": kind, "v": raw, "dim": 5}
    group = negatives.Group(row, {5: (c, radius, np.zeros(12), np.zeros(12))}, True)
    score = x[:20] @ x.T
    for k in range(12):
        inside = np.where((score >= 1500) & (score <= 2500) & (near == k), score, -np.inf).max(1)
        assert (inside <= group.top[:, k]).all()
    assert not np.isfinite(group.top).all()  # something is skipped


# phrases


def plain_phrases(rows, least=10, most=3, percent=50, top=2000):
    f, total = Counter(), Counter()
    for s, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in cands.items():
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        if any(z == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (z, v), b in cands.items()):
            continue
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(got)


@pytest.mark.parametrize(("block", "stretch", "most", "top"), [(1 << 20, 1 << 20, 3, 2000), (50, 40, 3, 5), (300, 100, 4, 2000), (50, 40, 2, 2000)])
def test_collocations(spark, monkeypatch, block, stretch, most, top):
    rng = random.Random(8)
    rows = [(text(rng, rng.randrange(0, 90), 12), rng.choice(["en", "de", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("A B  a\tb\na b, A b", "fr"), ("é\x01 x y " * 30, "und"), ("same same same " * 40, "en"), ("W1 w2 " * 3000, "de")]
    rows += [rows[0]] * 20
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, rank int").repartition(3)
    # tasks read the module's own figures: they are set in the workers by way of the functions' closures
    run = phrases._windows
    monkeypatch.setattr(phrases, "_windows", lambda *a: _with(block, stretch, run(*a)))
    monkeypatch.setattr(phrases, "_word_counts", _with(block, stretch, phrases._word_counts))
    got = phrases.collocations(spark, df, most=most, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, most=most, top=top)
    if block > 1 << 19:
        assert phrases.collocations(spark, df.limit(0)).count() == 0


def _with(block, stretch, task):
    def run(batches):
        from vellumlake.llm import phrases

        old = phrases.BLOCK, phrases.STRETCH
        phrases.BLOCK, phrases.STRETCH = block, stretch
        try:
            yield from task(batches)
        finally:
            phrases.BLOCK, phrases.STRETCH = old

    return run


def test_tokens_of_long_texts(monkeypatch):
    data = ("word, " * 50 + "x" * 500 + " a\tb\n" + "tail").encode()
    whole = [w for p in phrases.tokens(data) for w in p if w]
    monkeypatch.setattr(phrases, "STRETCH", 16)
    assert [w for p in phrases.tokens(data) for w in p if w] == whole
    assert whole[:4] == [b"word", b"\n", b"word", b"\n"] and whole[-5:] == [b"x" * 500, b"a", b"b", b"\n", b"tail"]
