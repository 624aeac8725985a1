"""Long conversations, buckets, long hosts and stretches of text."""

import hashlib
import random

import numpy as np
import pytest

from vellumlake.llm import chat, minhash, packing, urls


def test_examples_hold_their_context(spark):
    long = "x" * (5 << 20)
    rows = [(1, i, "user", long) for i in range(3)] + [(1, 3, "assistant", "yes"), (1, 4, "user", "more"), (1, 5, "assistant", "no"), (2, 0, "user", long), (2, 1, "user", "end")]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert sorted((r.conv_id, r.example, r.part, r.trainable) for r in examples.select("conv_id", "example", "part", "trainable").collect()) == [(1, 0, 0, False), (1, 0, 1, False), (1, 0, 2, False), (1, 0, 3, True), (1, 1, 0, True), (2, 0, 0, False), (2, 0, 1, False)]
    got = {r.conv_id: r for r in chat.digest(examples.orderBy("context_sha256")).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[2].loss_chars) == (6, 5, 2, 0)
    assert got[1].loss_sha256 == hashlib.sha256(b"yesno").hexdigest()
    whole = {(r.conv_id, r.example): r for r in chat.materialize(examples).collect()}
    assert set(whole) == {(1, 0), (1, 1)}
    r = whole[1, 1]
    assert [t[1] for t in chat.parse(r.text)] == [long, long, long, "yes", "more", "no"] and r.text[r.loss_start : r.loss_end] == "no"
    with pytest.raises(Exception, match="isn't whole"):
        chat.digest(examples.where("not (conv_id = 1 and part = 1)")).collect()
    examples.unpersist()


def test_buckets(spark, tmp_path):
    from public_tokenizers import path

    docs = spark.createDataFrame([(i, "tree river house " * (i % 7)) for i in range(40)], "doc_id long, text string")
    packed = packing.pack(spark, docs, path("word_bpe_49k.json"))
    packing.write_buckets(packed, str(tmp_path / "p"))
    want = {r.sequence_id: bytes(r.ids) for r in packed.collect()}
    got = {}
    for bucket in {len(x).bit_length() - 3 for x in want.values()}:
        for r in packing.batches(spark, str(tmp_path / "p"), bucket, 16).collect():
            m = np.frombuffer(r.ids, "<u4").reshape(r.n, 1 << bucket)
            assert r.n <= max(1, 16 >> bucket)
            got |= {s: row.tobytes() for s, row in zip(r.sequence_ids, m, strict=True)}
    assert got == want


def test_long_hosts_and_other_letters(spark):
    listed = spark.createDataFrame([("ÉX.com", "/a", "block"), ("B.org", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://ÉX.com/a/b"), (2, "http://éx.com/a"), (3, "http://" + "a." * 20_000 + "b.ORG/x"), (4, "http://" + "a" * 1_000_000 + ".b.org/" + "y" * 1_000_000)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert got == {1: ("Éx.com/a", "block"), 2: (None, "allow"), 3: ("b.org/", "block"), 4: ("b.org/", "block")}


def test_words_in_stretches(monkeypatch):
    random.seed(1)
    for _ in range(300):
        t = bytes(random.choice(b"abC \n") for _ in range(random.randrange(60)))
        whole = minhash.words(t)
        with monkeypatch.context() as m:
            m.setattr(minhash, "STRETCH", 7)
            assert (minhash.words(t) == whole).all() and len(whole) == len(t.split())
