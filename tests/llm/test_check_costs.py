"""What the check tool found to cost too much: the quick ways give what the plain ones give, and are taken."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from vellumlake.llm import attention, lm, tokens


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_letters_skip_the_pre_tokeniser(file):
    from public_tokenizers import path

    enc = tokens.Encoder(tokens.read_file(path(file)))
    slow, joint = [], enc._joint
    enc._joint = lambda keys: slow.extend(keys.to_pylist()) or joint(keys)
    r = random.Random(5)
    letters = "abcxyzéüßñÿàö" + ("" if enc.bare else "ABZÀÖ")
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 20))) for _ in range(3000)})
    odd = sorted({"".join(r.choice("abzéÿÀ×÷ĀŞµªº'.,-0١1Aİ") for _ in range(r.randrange(1, 12))) for _ in range(3000)})
    ended = [w + "," for w in words]
    for some, quick in ((words, True), (ended, True), (odd, False)):
        slow.clear()
        want = [x.tolist() for x in enc._ids([w if enc.bare else " " + w for w in some])]
        flat, starts, n = enc.table.find(pa.array([w.encode() for w in some], pa.binary()))
        assert [flat[a : a + k].tolist() for a, k in zip(starts.tolist(), n.tolist(), strict=True)] == want
        assert bool(slow) != quick


def a_block(r, docs=40):
    """A block of documents in columns as lm reads them, and the ids of those that teach."""
    lengths = r.integers(0, 4, 50)
    flat, n = r.integers(0, 90, lengths.sum()), r.integers(0, 200, docs)
    codes, held = r.integers(0, 50, n.sum()), r.random(docs) < 0.2
    starts, borders = np.cumsum(lengths) - lengths, np.concatenate([[0], np.cumsum(n)])
    texts = [[int(i) for c in codes[a:b] for i in flat[starts[c] : starts[c] + lengths[c]]] + [99] for a, b in zip(borders[:-1], borders[1:], strict=True)]
    pack = zstandard.ZstdCompressor().compress
    columns = [held.astype(np.uint8).tobytes(), borders[1:].astype("<i8").tobytes(), *(pack(x.astype("<i4").tobytes()) for x in (codes, flat, lengths))]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], list(lm.BLOCK)), [t for t, out in zip(texts, held, strict=True) if not out]


def test_a_round_puts_together_its_own_documents(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 1000)
    made, gather = [], tokens.gather
    monkeypatch.setattr(tokens, "gather", lambda *a: made.append(gather(*a)) or made[-1])
    batch, want = a_block(np.random.default_rng(3))
    got = [[seq[a:b].tolist() for seq, docs in lm._taught([batch], 99, k, 3) for a, b in zip(docs[:-1], docs[1:], strict=True)] for k in range(3)]
    assert sorted(t for g in got for t in g) == sorted(want) and all(got)
    assert sum(len(ids) for ids, _ in made) == sum(len(t) - 1 for t in want)  # all rounds together, each once


def test_neighbours_are_counted_in_a_table_or_sorted(monkeypatch):
    for ids in (60, 100_000):
        r = np.random.default_rng(4)
        w = r.integers(0, ids, (300, attention.WINDOW + 1)).astype(np.int32)
        w[::3, 20:] = attention.PAD
        place = np.full(ids, -1)
        place[:40] = np.arange(40)
        want: dict = {}
        for row in w.tolist():
            for a, b in zip(row[:-1], row[1:], strict=True):
                for here, there, shift in ((a, b, 0), (b, a, 40)):
                    if b >= 0 and place[there] >= 0:
                        key = here * 80 + int(place[there]) + shift
                        want[key] = want.get(key, 0) + 1
        with monkeypatch.context() as m:
            if ids == 60:  # few ids: nothing is sorted
                m.setattr(np, "unique", None)
            keys, n = attention.neighbours(w, place)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and keys.tolist() == sorted(want)


def test_a_block_looks_its_words_up_once(monkeypatch):
    import types

    import pyspark
    from public_tokenizers import path

    spec, found, run = tokens.read_file(path("word_bpe_49k.json")), [], []
    column = types.SimpleNamespace(cast=lambda *a: column, alias=lambda *a: column)
    docs = types.SimpleNamespace(select=lambda *a: docs, mapInArrow=lambda f, _: run.append(f))
    spark = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x)))
    monkeypatch.setattr(lm, "F", types.SimpleNamespace(col=lambda *a: column))
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm, "TEXT_BATCH", 2)
    find = tokens.Table.find
    monkeypatch.setattr(tokens.Table, "find", lambda self, keys: found.extend(keys.to_pylist()) or find(self, keys))
    lm._scan(spark, docs, spec, 50_000)
    texts = ["The tree", None, "tree the river", "", "a river", "tree"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None, 5, 6]), pa.array([False, False, True, False, False, False]), pa.array(texts)], ["doc_id", "held_out", "text"])
    rows = [r for b in run[0](iter([batch])) for r in b.to_pylist()]
    assert found == [b"the", b"tree", b"river", b"a"]
    assert [(r["word"], r["n"], r["idx"]) for r in rows if r["kind"] == lm.WORDS] == [(b"the", 1, 0), (b"tree", 2, 1), (b"river", 1, 2), (b"a", 1, 3)]
    block = next(r for r in rows if r["kind"] == lm.DOCS)
    assert np.frombuffer(zstandard.ZstdDecompressor().decompress(block["codes"]), "<i4").tolist() == [0, 1, 1, 0, 2, 3, 2, 1]


def test_kept_keys_are_found_again():
    learnt: list = []
    table = tokens.Table(lambda keys: learnt.extend(keys.to_pylist()) or (np.arange(2 * len(keys), dtype=np.uint32), np.full(len(keys), 2)), most=2)
    keys = pa.array([b"a", b"b" * 65, b"c", b"d"], pa.large_binary())
    flat, starts, lengths = table.find(keys)
    table.keep(keys, tokens.gather(flat, starts, lengths, np.arange(4))[0], lengths)
    learnt.clear()
    flat, starts, lengths = table.find(keys)
    assert learnt == [b"b" * 65, b"d"]  # too long, and one too many
    assert [flat[a : a + k].tolist() for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)] == [[0, 1], [0, 1], [4, 5], [2, 3]]


def test_words_are_summed_over_blocks():
    batches = [([7, 2], [0, 1], [3, 0], [b"x", b"y"]), ([2, 7, 7], [0, 4, 9], [2, 0, 0], [b"x", b"y", b"z"])]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    made = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(b, kinds, strict=True)], ["block", "idx", "n", "word"]) for b in batches]
    got = [r for b in lm._summed(iter(made)) for r in b.to_pylist()]
    read = [(r["block"], r["n"], r["v"], sorted(zip(np.frombuffer(r["idx"], "<i4").tolist(), np.frombuffer(r["c"], "<i8").tolist(), strict=True))) for r in got]
    assert read == [(2, 2, 1, [(0, 5), (1, 0)]), (7, 3, 0, [(0, 5), (4, 0), (9, 0)])]  # words that aren't taught aren't counted
    assert list(lm._summed(iter([]))) == []


def test_mixtures_in_single_precision():
    by_ids = np.array([-0.5, -3.0, -35.0, -60.0, -60.0, -1e6])
    unigram = np.array([0.1, 0.0, 0.0, 0.0, 1e-7, 0.0])
    raised = np.exp(by_ids.astype(np.float32) * np.float32(np.log(10)))
    low = np.flatnonzero((by_ids < lm.LOW) & (unigram == 0))
    for weight in lm.WEIGHTS:
        rest = by_ids + np.log10(1 - weight)
        want = np.where(unigram > 0, np.log10(np.maximum(weight * unigram + (1 - weight) * 10.0**by_ids, 1e-300)), rest) if weight else rest
        got = lm.mixed(unigram.astype(np.float32), by_ids, weight, raised, low)
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
