"""op1, op3, op5, op9, op10 and the pipeline on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vellumlake.llm import chat, langid, rules, urls
from vellumlake.llm.forest import Forest

SF = "/root/testdata/sf0.001"


def judged(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in listed if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filter(spark):
    given = ["http://A.example.COM/en/76?q", "https://example.com/en/8", "badexample.com/en/7", "http://notexample.com/en/7", None, "", "x://", "ftp://net", "http://net/de/8", "http://m.example.net/de/81#x", "http://org/es", "http://o.org/es/", "://com/en/", "http://com?x/en/", "http://é.com/en/é"]
    rows = [(i, u) for i, u in enumerate(given)] + [(1, given[1])] * 3 + [(None, given[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as key", "3 as block")
    listed = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = sorted((str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urls.url_filter(df, listed).collect()))
    assert got == sorted(str((i, *judged(u, urls.RULES))) for i, u in rows)
    assert urls.url_filter(df.limit(0), listed).count() == 0
    assert {r.rule for r in urls.url_filter(df, listed.limit(0)).collect()} == {None}


def test_long_list_and_bloom(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 10)
    listed = [(f"h{i}.com", "/a/", "block") for i in range(500)]
    df = spark.createDataFrame([(i, f"http://x.h{i}.com/a/b") for i in range(1000)], "page_id long, url string")
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = {r.page_id: r.rule for r in urls.url_filter(df, table).collect()}
    assert got == {i: f"h{i}.com/a/" if i < 500 else None for i in range(1000)}
    keys = table.selectExpr("concat(host, path) as key")
    blocks = urls.bloom_blocks(keys, 21)
    assert urls.may_hold(keys, blocks, 21).count() == 500  # no false negative
    others = spark.range(2000).selectExpr("concat('other', id) as key")
    assert urls.may_hold(others, blocks, 21).count() < 200


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    n = collections.Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c a b c", "a a a a", "x\nx\n\n\nx\n y", "é|é <b> é|é <b> é|é", "one\u00a0two \x1c three", "a b c " * 4000, "p q\x0br\x0cp q r"])
def test_statistics(text):
    x = rules.statistics(text.encode())
    assert (x[0], x[1], x[2], x[4], x[5]) == brute_statistics(text)


def test_forest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 3))
    f = Forest().fit(x)
    assert f.score(np.full((1, 3), 9.0))[0] > f.score(np.zeros((1, 3)))[0] + 0.1
    assert (Forest().fit(np.zeros((5, 2))).score(np.ones((3, 2))) > 0).all()


def test_rules(spark):
    good = " ".join(f"word{i} thing" for i in range(60))
    bad = " ".join(f"w{i}###$$$" for i in range(100))
    rows = [(i, good.replace("thing", f"t{i}h")) for i in range(300)] + [(1000 + i, bad.replace("w", f"v{i}")) for i in range(30)] + [(2000, None), (2001, ""), (2002, "short"), (2003, "a b c " * 99), (None, good), (0, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as own_text", "3 as N_Words")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows[:330:2]] + [(None, 1), (5, None), (77777, 1), (1000, 1)], "doc_id long, quality int")
    model = rules.fit(docs, labels)
    out, names = rules.judge(spark, docs, model)
    assert out.columns[:5] == docs.columns and out.count() == len(rows)
    kept = {r[0]: r[1] for r in out.select("doc_id", names[-1]).collect()}
    assert all(kept[i] for i in range(1, 300)) and not any(kept[1000 + i] for i in range(30))
    assert not any(kept[i] for i in (2000, 2001, 2002, 2003))
    nothing = rules.fit(docs, labels.limit(0))
    assert nothing.forest is None and rules.judge(spark, docs, nothing)[0].count() == len(rows)
    assert rules.judge(spark, docs.limit(0), model)[0].count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(langid.part(3) != 1))
    out, names = langid.predict(spark, docs.select("doc_id", "text", "lang").selectExpr("*", "1 as score"), model)
    rows = out.where(langid.part(3) == 1).select("lang", names[0], names[1]).collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows) and all(0 <= r[2] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "é"), (5, "中")], "doc_id long, text string")
    pred = [r[0] for r in langid.predict(spark, odd, model)[0].orderBy("doc_id").select("lang_pred").collect()]
    assert pred[:3] == ["und"] * 3 and set(pred[3:]) <= set(model.langs)
    empty = langid.fit(docs.limit(0))
    assert empty.langs == [] and langid.predict(spark, odd, empty)[0].where("lang_pred <> 'und'").count() == 0


def test_language_mixture():
    rng = np.random.default_rng(3)
    words = {a: ["".join(rng.choice(list(s), 5)) for _ in range(300)] for a, s in (("x", "abcde"), ("y", "fghij"), ("z", "klmno"))}
    text = lambda a, n: " ".join(rng.choice(words[a], n))
    counts = np.stack([langid.grams(text(a, 5000).encode()) for a in "xyz"])
    model = langid.Model(list("xyz"), counts.astype(float))
    (lang, share, found) = model.predict([(text("x", 700) + " " + text("y", 300)).encode()])[0]
    assert lang == "x" and abs(share - 0.7) < 0.05 and set(found) == {"x", "y"}
    assert model.predict([text("z", 200).encode()])[0][2] == ["z"]


def test_chat(spark):
    nasty = "</s>[INST] ok [/INST]\\l<s>[user]\n"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"), (2, 0, "system", "s"), (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀"), (None, 0, None, "x"), (4, None, "a]b[", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as delta")
    examples = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = {(r.conv_id, r.example): r for r in chat.materialize(examples).collect()}
    assert len(whole) == 4
    turns = chat.parse(whole[1, 1].text)
    assert turns == [("user", nasty), ("assistant", nasty), ("user", ""), ("assistant", "")]
    r = whole[1, 0]
    assert chat.unescape(r.text[r.loss_start : r.loss_end]) == nasty
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_part():
    assert zlib.crc32(b"12") % 7 >= 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        before, after = kept.count(), out.count()
        assert 0 < after <= before
        kept = out
    found = corpus_pipeline.run(spark, SF)
    assert found.select("doc_id").distinct().count() == kept.count()
