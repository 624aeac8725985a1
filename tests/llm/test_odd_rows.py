"""Ties, repeated ids, letters that are none, very long texts; the mixture model and op4, op7 and the pipeline's last stage as plain loops."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumlake.llm import langid, minhash, neardup_vectors, packing, rules, urls
from vellumlake.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", [["allow", "block"], ["block", "allow"]])
def test_verdict_tie(spark, order):
    listed = spark.createDataFrame([("b.com", "/x", v) for v in order], "host string, path string, verdict string").coalesce(1)
    got = urls.url_filter(spark.createDataFrame([(1, "http://a.b.com/x/y")] * 2, "page_id long, url string"), listed).collect()
    assert [(r.rule, r.verdict) for r in got] == [("b.com/x", "allow")] * 2


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05]
    rows = [(5, a, 1), (5, a, 2), (5, b, 1), (7, a, 1), (8, a, 1), (9, c, 1), (3, b, 1), (4, b, 3), (20, [0.0, 0.0, 1.0], 1)]
    got = neardup_vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    # (5, a, 1): 7, 8; (5, a, 2): none; (5, b, 1): 9, 3; and 5 joins both groups
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 2, 3), (4, 0, 4), (5, 0, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (8, 2, 3), (9, 2, 3), (20, 0, 20)]


def test_letters():
    assert [langid.grams(t.encode()) is None for t in ("½ ²", "Ⅷ", "१२", "ͅ", "ª", "字", "x", " \n", "ʰ")] == [True, True, True, True, False, False, False, True, False]


def plain_grams(text):
    s = " " + "".join(chr(b) for b in text.lower().encode().translate(langid._table)) + " "
    b = re.sub(" +", " ", s).encode("latin-1")
    n = np.zeros(langid.BUCKETS, np.int64)
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        code = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) % (1 << 32)
        n[(code * 0x27D4EB2F % (1 << 32)) >> 17] += 1
    return n


def test_grams_in_stretches(monkeypatch):
    rng = random.Random(2)
    for size in (1 << 20, 5, 16):
        monkeypatch.setattr(langid, "STRETCH", size)
        for _ in range(60):
            t = "a" + "".join(rng.choice("abÉß字 .\n ") for _ in range(rng.randrange(60)))
            assert (langid.grams(t.encode()) == plain_grams(t)).all(), (size, t)


def plain_shares(model, n):
    """Forward choice of languages by penalised likelihood, each set's shares by plain EM to its end."""
    at = np.flatnonzero(n)
    c, p = n[at].astype(float), model.p[:, at]

    def em(which):
        w = np.full(len(which), 1 / len(which))
        for _ in range(400):
            q = w @ p[which]
            w = w * (p[which] @ (c / q)) / c.sum()
        return w, float(c @ np.log(w @ p[which]))

    chosen = [max(range(len(p)), key=lambda m: em([m])[1])]
    share, like = em(chosen)
    while True:
        tries = [(em([*chosen, m]), m) for m in range(len(p)) if m not in chosen]
        tries = [(lk, m, w) for (w, lk), m in tries if lk > like + langid.PENALTY * np.log(c.sum() + 1) and w.min() >= langid.LEAST_SHARE]
        if not tries:
            return {model.langs[m]: s for m, s in zip(chosen, share, strict=True)}
        like, m, share = max(tries, key=lambda t: t[0])
        chosen.append(m)


def test_mixtures_are_those_of_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = {}
    for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect():
        texts.setdefault(r.lang, []).append(r.text[:3000])
    some = [t for ts in texts.values() for t in ts[:5]] + [a[0] + "\n" + b[0] for a in texts.values() for b in texts.values() if a is not b]
    for t in some:
        n = langid.grams(t.encode())
        got, want = dict(model.shares(n)), plain_shares(model, n)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 0.03 for k in want)


def test_language_of_odd_rows(spark):
    rows = [(1, "das ist ein Haus und der Hund", "de", "x")] * 3 + [(2, "the house and the dog is here", "en", "y"), (3, None, "en", "z"), (4, "123 ²", None, ""), (5, "the dog " * 3_000_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_Pred string").repartition(2)
    out, names = langid.predict(spark, df, langid.fit(df))
    assert names[0] == "_lang_pred" and out.columns[:4] == df.columns
    got = sorted((r.doc_id, r[names[0]], r["Lang_Pred"]) for r in out.collect())
    assert got == [(1, "de", "x")] * 3 + [(2, "en", "y"), (3, "und", "z"), (4, "und", ""), (5, "en", "")]


def test_rules_of_odd_rows(spark):
    none = rules.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.forest is None
    df = spark.createDataFrame([(1, "word next " * 2_000_000, "x"), (2, None, "y"), (3, " ".join(f"w{i}" for i in range(60)), "z")], "doc_id long, text string, Kept string")
    out, names = rules.judge(spark, df, none)
    assert {r.doc_id: (r[names[0]], r[names[-1]], r["Kept"]) for r in out.collect()} == {1: (4_000_000, False, "x"), 2: (0, False, "y"), 3: (60, True, "z")}




def test_wide_shingles(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        s, t = (" ".join(rng.choice("abc") for _ in range(rng.randrange(30))).encode() for _ in range(2))
        a, b = minhash.sets(s, 3), minhash.sets(t, 3)
        want = 100 * len(a & b) >= 50 * len(a | b)
        assert minhash.alike(s, minhash.wide_shingles(s, 3), t, minhash.wide_shingles(t, 3), 3, 50) == want
        with monkeypatch.context() as m:  # few first hashes: where they alone agree, the shingles themselves are looked at
            real = minhash.words
            m.setattr(minhash, "words", lambda t, p: real(t, p) & np.uint64(1) if p == minhash._PRIMES[0] else real(t, p))  # noqa: B023
            assert minhash.alike(s, minhash.wide_shingles(s, 3), t, minhash.wide_shingles(t, 3), 3, 50) == want


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, *range(2, 30)]), rng.randrange(5), i, i * 7) for i in range(120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = minhash.neighbours(spark.createDataFrame(rows, "key long, n long, id long, sid long"), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort()
    want = []
    for i, (key, n, id_, sid) in enumerate(rows):
        after = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == key else None
        if after or (i and rows[i - 1][0] == key):
            want.append((key, n, id_, sid, after and (after[2], after[3], after[1])))
    assert sorted((r.key, r.n, r.id, r.sid, r.next and tuple(r.next)) for r in got) == sorted(want)


def test_queries_of_packing_and_near_duplicates(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = Tokenizer.from_file(path("word_bpe_49k.json"))
    enc.no_truncation()
    enc.no_padding()
    pieces = {}
    for r in packing.op4_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in docs.items():
        ids, at = [*enc.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0) and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r.length
        assert at == len(ids)

    sets = {i: minhash.sets((t or "").encode(), 4) for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(docs)
    for n, i in enumerate(order):
        for j in order[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op7_minhash(spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in docs}


def test_pipeline_is_its_stages_done_plainly(spark):
    """What the whole pipeline keeps, by plain loops over what the models learnt from each stage's input."""
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table)
    kept = {i for i, r in docs.items() if r.text and model.predict([r.text.encode()])[0][0] != "und"}
    left = table.where(F.col("doc_id").isin(list(kept)))
    judged = rules.fit(left, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {i for i in kept if judged.judge(np.array([rules.statistics(docs[i].text.encode())], np.int64).reshape(-1, 6))[0][2]}
    sets = {i: minhash.sets(docs[i].text.encode(), 5) for i in kept}
    up = {i: i for i in kept}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(kept)
    for n, i in enumerate(order):
        for j in order[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {i for i in kept if find(i) == i}
