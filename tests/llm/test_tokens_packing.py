"""op4, op6, op8: tokenising, packing, BPE and the id file."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from vellumlake.llm import bpe, packing, simple8b
from vellumlake.llm.tokens import Encoder, read_file, words_of

ODD = ["", " ", "a", "  a  b ", "\n", "a\nb", "\nA.\n\nB\t c", "x\x1cy\x85z", "it's 'll 12 a0 b", "é É e\u0301 ſ", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|>", "\x00\x01", "word, stop.", "...,,", " , .", "中文 テスト", "😀" * 40, "a" * 5000, "\u00a0 b\u2003c", "A\rB\r\nC", "1.5, x."]


def packed(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_the_library(name):
    spec = read_file(path(name))
    library, own = Tokenizer.from_str(spec), Encoder(spec)
    random.seed(1)
    texts = ODD + ["".join(random.choice(ODD) for _ in range(5)) for _ in range(500)]
    assert own.encode(pa.array([*texts, None])) == [packed(library, t) for t in [*texts, None]]
    column = pa.array([*texts, None])
    assert [x for k in range(0, len(column), 7) for x in own.encode(column.slice(k, 7))] == own.encode(column)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_encoding_of_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, library = _pair(name)
        assert own.encode(pa.array([text])) == [packed(library, text)]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_bpe_of_any_text(text):
    own, library = _bpe(), _pair("byte_bpe_50k.json")[1]
    ids = own.encode(pa.array([text]))
    assert ids == [packed(library, text)]
    assert own.decode(ids)[0].decode() == library.decode(list(struct.unpack(f"<{len(ids[0]) // 4}I", ids[0])), skip_special_tokens=False)


_known: dict = {}


def _pair(name):
    if name not in _known:
        spec = read_file(path(name))
        _known[name] = (Encoder(spec), Tokenizer.from_str(spec))
    return _known[name]


def _bpe():
    if "bpe" not in _known:
        _known["bpe"] = bpe.Bpe(read_file(path("byte_bpe_50k.json")))
    return _known["bpe"]


def test_words_of():
    words, codes, borders = words_of(pa.array(["A b\ta ", None, "", "  é B"]))
    words = words.to_pylist()
    texts = [[words[c] for c in codes[a:b]] for a, b in zip(borders[:-1], borders[1:], strict=True)]
    assert texts == [[b"a", b"b", b"a"], [], [], ["é".encode(), b"b"]]


def table(spark, extra=False):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (99, None), (50, "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return (df.selectExpr("*", "1 as ids", "'x' as start", "2 as Doc_Tokens") if extra else df), rows


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    df, rows = table(spark, extra)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = packing.pack(spark, df, path("word_bpe_49k.json")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    found = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length
        assert r.bucket == r.length.bit_length() - 1
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    want = {}
    for i, t in rows:
        ids = packed(library, t) + struct.pack("<I", 1)
        want.setdefault((i, len(ids) // 4), []).append(ids)
    assert found.keys() == want.keys()
    for k, ids in want.items():
        assert sum(len(p) for _, p in found[k]) == sum(map(len, ids))
        if len(ids) == 1:
            assert b"".join(p for _, p in sorted(found[k])) == ids[0]


def test_packing_digest_and_empty(spark):
    df, _ = table(spark)
    out = packing.pack(spark, df, path("word_bpe_49k.json"))
    whole = {(r.doc_id, r.start, r.sequence_id): bytes(r.ids) for r in out.collect()}
    for r in packing.digest(out).collect():
        assert zlib.crc32(whole[r.doc_id, r.start, r.sequence_id]) == r.ids_crc32
    assert packing.pack(spark, df.limit(0), path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark, df, path("word_bpe_49k.json"), max_length=1000)


def test_lengths():
    assert packing.lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert packing.lengths(0) == [] and packing.lengths(1) == [1]


@pytest.mark.parametrize("extra", [False, True])
def test_bpe_table(spark, extra):
    df, rows = table(spark, extra)
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded).decode()) for r in bpe.encode_decode(spark, df, path("byte_bpe_50k.json")).collect())
    want = sorted((i is None, i or 0, packed(library, t), library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)
    assert got == want
    assert bpe.encode_decode(spark, df.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_op6_digests(spark, tmp_path):
    df, rows = table(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, str(tmp_path)).collect())
    want = []
    for _, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(packed(library, t)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 3)))
def test_simple8b_round_trip(ids):
    a = np.array(ids, dtype=np.uint64)
    words, escapes = simple8b.encode(a)
    assert simple8b.decode(words, escapes).tolist() == ids


def test_simple8b_words():
    assert len(simple8b.encode(np.zeros(60))[0]) == 1
    assert len(simple8b.encode(np.full(3, 50_000))[0]) == 1
    assert len(simple8b.encode(np.array([2**61], dtype=np.uint64))[0]) == 2


def test_op8_file(spark, tmp_path):
    df, rows = table(spark)
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = simple8b.op8_simple8b(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = sorted(zlib.crc32(packed(library, t) + bytes(4)) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    to = f"{tmp_path}/none"
    simple8b.write_ids(spark, df.limit(0), path("byte_bpe_50k.json"), to)
    assert simple8b.read_ids(spark, to).count() == 0
