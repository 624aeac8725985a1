"""op5: the attention model, what it learns from, and scores against plain loops."""

import collections
import math
import re

import numpy as np
import pytest

from vellumlake.llm import attention, langid, lm, tokens
from vellumlake.llm.attention import CLASSES, STRIDE, WIDTH, WINDOW, Attention, drawn, fitted, gradients, windows_of

SF = "/root/testdata/sf0.001"


def plain_power(y):
    """Two to y, linear between whole exponents."""
    y = max(-100.0, min(100.0, y))
    return 2.0 ** math.floor(y) * (1 + y - math.floor(y))


def by_hand(model, ids, begin):
    """log10 of the probability of each id's class, one id at a time, from the window that scores it."""
    out, d = [], WIDTH
    before = [begin, *ids]
    for i, id_ in enumerate(ids):
        w = 0 if i < WINDOW else (i - WINDOW) // STRIDE + 1
        t = [model.table[x] + model.place[k] for k, x in enumerate(before[w * STRIDE : i + 1])]
        a = [plain_power(float(t[-1][:d] @ x[d : 2 * d])) for x in t]
        u = sum(y * x[2 * d : 3 * d] for y, x in zip(a, t, strict=True)) / sum(a) + t[-1][3 * d :]
        z = (u / (1 + abs(u))) @ model.o + model.b
        z = [plain_power(float(x)) for x in z]
        out.append(math.log10(z[model.cls[id_]] / sum(z)))
    return out


def windows(seed=0):
    # ids alternate between two sets, so what comes next depends on what came before
    rng = np.random.default_rng(seed)
    return np.where(np.arange(WINDOW + 1) % 2, rng.integers(0, 20, (800, WINDOW + 1)), rng.integers(20, 40, (800, WINDOW + 1)))


def test_powers_and_gradients():
    y = np.linspace(-30, 30, 1001).astype(np.float32)
    assert np.allclose(attention.powers(y.copy()), [plain_power(float(x)) for x in y], rtol=1e-4)
    rng = np.random.default_rng(1)
    cls, count = rng.integers(0, CLASSES, 50), np.ones(50)
    p = drawn(cls, count, np.zeros(50, bool))
    w = windows_of(np.concatenate([rng.integers(0, 48, 70)]), np.array([0, 40, 70]), 49)
    at = lambda p: gradients(p, p["e"][np.maximum(w[:, :-1], 0)], cls[w[:, 1:]], w[:, 1:] >= 0)
    g, dx, _ = at(p)
    for name in ("m", "o", "p", "b"):
        for j in np.argsort(-np.abs(g[name]).ravel())[:3]:
            j = np.unravel_index(j, g[name].shape)
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][j] += 0.02
            down[name][j] -= 0.02
            assert (at(up)[2] - at(down)[2]) * math.log(2) / 0.04 == pytest.approx(g[name][j], rel=0.2)


def test_attention_learns_and_scores_once():
    x = windows()
    cls = np.where(np.arange(202) < 20, 0, 1)
    p = fitted(x, drawn(cls, np.ones(202), np.zeros(202, bool)), cls, 300)
    model = Attention(cls, p)
    ids = np.concatenate([w[1:] for w in x[:5]])
    log = model.score(ids, np.array([0, len(ids)]), begin=200)
    assert log.mean() > math.log10(0.8)
    assert np.allclose(log, by_hand(model, ids.tolist(), 200), atol=2e-3)
    cuts = np.array([0, 1, 33, 33, 34, len(ids)])  # one text is empty
    parts = model.score(ids, cuts, 200)
    want = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in by_hand(model, ids[a:b].tolist(), 200)]
    assert np.allclose(parts, want, atol=2e-3)


def fit(spark, docs):
    from public_tokenizers import path

    from vellumlake.llm.common import Scratch

    spec, scratch = tokens.read_file(path("word_bpe_49k.json")), Scratch(spark, "lm")
    docs = docs.selectExpr("cast(1 as long) as doc_id", "false as held_out", "text")
    return lm.fit(spark, scratch.table(lm._scan(spark, docs, spec, lm.n_ids_of(spec))), spec, scratch), tokens.encoder(spec).tok


def test_attention_learns_tails_and_short_texts(spark):
    seq, borders = np.arange(WINDOW + 6), np.array([0, 1, WINDOW + 2, WINDOW + 6])
    w = windows_of(seq, borders, 99)
    assert w.shape == (4, WINDOW + 1) and w[:, 1:][w[:, 1:] >= 0].tolist() == seq.tolist()
    assert w[:, 0].tolist() == [99, 99, WINDOW, 99] and w[0, 2:].tolist() == [attention.PAD] * (WINDOW - 1)
    # texts all shorter than a window: the model knows that a text ends after its second word
    m, tok = fit(spark, spark.createDataFrame([("the end",)] * 60, "text string"))
    ids = np.array([*tok.encode("the end", add_special_tokens=False).ids, m.end])
    log = m.attention.score(ids, np.array([0, len(ids)]), m.begin)
    assert log[-1] > math.log10(0.5)


def test_lm_learns_from_every_document(spark, monkeypatch):
    # the first fit sees hardly any window; words of other blocks get a class and an embedding of their own
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 1)
    words = "cat dog house tree river stone light water"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.createDataFrame([(f"the {w} is here",) for w in words.split() for _ in range(6)], "text string"))
    m, tok = fit(spark, docs)
    own = [tok.encode(w, add_special_tokens=False).ids[0] for w in words.split()]
    rows = [r.tobytes() for r in m.attention.table]
    unseen = {r for r, n in collections.Counter(rows).most_common(2)}  # ids that no text holds, within words and at their end
    assert not unseen & {rows[i] for i in own}
    assert set(m.attention.cls[own]) - {CLASSES - 2, CLASSES - 1}


def odd(spark):
    return spark.createDataFrame([(5000, None), (5001, ""), (5002, " \t"), (5003, "The the"), (3, "again"), (3, "again"), (None, "no id")], "doc_id long, text string")


def test_lm_scores_against_plain_loops(spark, monkeypatch):
    from public_tokenizers import path

    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(lm, "SLICE", 2000)
    models, fit_ = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit_(*a)) or models[-1])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd(spark))
    docs = docs.select("*", (langid.part(7) == 2).alias("held_out")).selectExpr("*", "1 as n", "2 as block")
    got = lm.score(spark, docs, path("word_bpe_49k.json")).collect()
    texts = [(r.doc_id, [*(w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or "").encode())), None], bool(r.held_out)) for r in docs.collect()]
    c = collections.Counter(w for _, t, out in texts if not out for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t, out in texts)
    assert sorted((str(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want

    # scores, from the model's tables: classes in context, shares within classes, and the mixture with the words' shares
    m, tok = models[0], tokens.encoder(tokens.read_file(path("word_bpe_49k.json"))).tok
    few = sorted((x for x in texts if len(x[1]) < 60), key=lambda x: str(x[0]))
    assert len(few) > 20
    ids_of = {w: tok.encode(w, add_special_tokens=False).ids if w is not None else [m.end] for _, t, _ in few for w in t}

    def scored(t, weight):
        ids = [i for w in t for i in ids_of[w]]
        logs, at, total = by_hand(m.attention, ids, m.begin), 0, 0.0
        for w in t:
            log, before = 0.0, CLASSES
            for i in ids_of[w]:
                log += logs[at] + float(m.share[before, i])
                before, at = m.attention.cls[i], at + 1
            total += math.log10(weight * c[w] / n + (1 - weight) * 10**log)
        return total

    mine = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in got if r.n_tokens < 60), key=lambda x: x[0])
    fits = [all(abs(scored(t, weight) - x[2]) < 0.02 + 1e-3 * abs(x[2]) for (_, t, _), x in zip(few, mine, strict=True) if x[0] != "3") for weight in lm.WEIGHTS]
    assert sum(fits) == 1
    assert np.allclose((10.0 ** m.share)[:, :].sum(1), len(set(m.attention.cls)), atol=0.02 * CLASSES)  # shares of a class add up to one
    assert lm.score(spark, docs.limit(0), path("word_bpe_49k.json")).count() == 0


def test_lm_without_training_texts_and_long_texts(spark):
    from public_tokenizers import path

    none = lm.score(spark, odd(spark).selectExpr("*", "true as held_out"), path("word_bpe_49k.json")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.score < 0 for r in none)
    long = spark.createDataFrame([(1, "tree and river " * 200_000), (2, "x" * 1_000_000), (3, "tree")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(spark, long.selectExpr("*", "cast(null as boolean) as held_out"), path("word_bpe_49k.json")).collect()}
    assert got[1].n_tokens == 600_001 and got[2].n_tokens == 2 and all(math.isfinite(r.score) for r in got.values())
    assert got[1].score / got[1].n_tokens > -0.3


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lm_beats_base_on_held_out_texts(spark, sf):
    assert WINDOW - STRIDE >= 8
    r = lm.op5_lm_scoring(spark, f"/root/testdata/{sf}").where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert r.s >= r.b
