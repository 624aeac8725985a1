"""op3 against plain loops: statistics, paths node by node, the threshold, and the query's verdicts."""

import math
import re
from collections import Counter

import numpy as np

from vellumlake.llm import rules

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def harmonic(n):
    """Mean path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def plain_score(forest, row):
    """2 to the minus mean path length over that of an unsuccessful search in a tree of as many points."""
    total = 0.0
    for feature, cut, left, right, size in forest.grown:
        at = 0
        while left[at] != at:
            at = left[at] if row[feature[at]] < cut[at] else right[at]
        total += size[at]
    return 2 ** (-total / len(forest.grown) / forest.norm)


def test_query_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in rules.op3_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        n, chars, symbols, dup, repeated = plain_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        failed = n < 50 or 100 * repeated > 50 * n
        assert r.base_failed == failed
        if model.forest is None:
            assert r.kept == (not failed)
            continue
        x = np.array([rules.statistics(t.encode())], np.int64).reshape(-1, 6)
        score = plain_score(model.forest, rules.features(x, model.view)[0])
        assert abs(score - r.anomaly) < 1e-9
        assert r.kept == (not failed and r.anomaly <= model.threshold)


def test_threshold_is_calibrated():
    """Rows far from the others are labelled bad: most are rejected, and no more of the good ones than the allowed share."""
    rng = np.random.default_rng(3)
    n = rng.integers(100, 400, 1200)
    x = np.column_stack([n, n * 5 + rng.integers(0, 50, 1200), rng.integers(0, 3, 1200), rng.integers(0, 2, 1200), np.zeros(1200, int), rng.integers(0, 10, 1200)])
    good = np.ones(1200, bool)
    bad = rng.choice(1200, 20, replace=False)
    good[bad] = False
    x[bad, 2], x[bad, 3] = n[bad] * rng.uniform(0.2, 4, 20), n[bad] * rng.uniform(0.1, 0.9, 20)
    model = rules.calibrate(x, good)
    assert math.isclose(model.forest.norm, harmonic(256))
    kept = np.array([k for _, _, k in model.judge(x)])
    assert kept[~good].sum() < 10 and (~kept[good]).sum() <= rules.CLEAN_LOSS * good.sum()
    scores = np.array([plain_score(model.forest, f) for f in rules.features(x[good], model.view)])
    assert (scores > model.threshold).sum() == (~kept[good]).sum()
    # no labels of one kind: base rules alone
    assert rules.calibrate(x, np.ones(1200, bool)).forest is None
