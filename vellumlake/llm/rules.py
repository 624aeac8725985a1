"""Quality rules: a document fails on base rules, or if an isolation forest finds its rule statistics anomalous.

The forest's trees split the statistics of a bounded sample of labelled documents at random; few splits set an anomaly
apart. The threshold on its score is the one with the best recall of labelled bad documents among those that reject at
most a set share of the labelled good ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate
from .forest import Forest

#: The forest and its threshold are fitted on at most so many labelled documents, those of the smallest hash of doc_id.
SAMPLE = 25_000
#: The threshold may reject so much of the labelled good documents.
CLEAN_LOSS = 0.002
#: Fixed values of the contract.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 50, 50

STATS = "n_words long, word_chars long, n_symbols long, n_symbol_words long, n_dup_lines long, n_repeat_words long"


def statistics(text: bytes) -> tuple[int, ...]:
    """The statistics of STATS. Words are what ASCII's six white-space characters separate."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 6
    joined = b"".join(words)
    bare = len(joined.translate(None, SYMBOLS))
    n_symbols = len(joined) - bare
    marked = sum(1 for w in words if len(w.translate(None, SYMBOLS)) != len(w)) if n_symbols else 0
    dup = 0
    if b"\n" in text:
        seen = set()
        for line in text.split(b"\n"):
            if line.strip():
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    return n, len(joined.decode("utf-8", "replace")), n_symbols, marked, dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    m = len(number)
    if m == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * m + ids[2:]
    order = np.argsort(codes)
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def base_failed(x: np.ndarray) -> np.ndarray:
    return (x[:, 0] < LEAST_WORDS) | (100 * x[:, 5] > MOST_REPEATED * x[:, 0])


#: The statistics a forest may see, none of which depends on a text's length: by word, by character, as a share.
VIEWS = (("word length", "symbols a word", "marked"), ("symbols a word", "symbols a character", "marked"), ("symbols a word", "marked", "repeated", "repeated lines"))


def features(x: np.ndarray, view: tuple[str, ...]) -> np.ndarray:
    n, chars = np.maximum(x[:, 0], 1).astype(float), np.maximum(x[:, 1], 1).astype(float)
    found = {
        "word length": np.log(chars / n),
        "symbols a word": np.log1p(x[:, 2] / n),
        "symbols a character": x[:, 2] / chars,
        "marked": x[:, 3] / n,
        "repeated lines": x[:, 4] / n,
        "repeated": x[:, 5] / n,
    }
    return np.column_stack([found[v] for v in view])


class Model:
    """forest is None if there is nothing to learn from; then only base rules hold."""

    def __init__(self, forest: Forest | None = None, threshold: float = 1.0, view: tuple[str, ...] = ()):
        self.forest, self.threshold, self.view = forest, threshold, view

    def judge(self, x: np.ndarray) -> list[tuple]:
        """Of rows of statistics: (base_failed, anomaly score, kept)."""
        failed = base_failed(x)
        score = self.forest.score(features(x, self.view)) if self.forest is not None and len(x) else np.zeros(len(x))
        kept = ~failed & (score <= self.threshold)
        return list(zip(failed.tolist(), score.tolist(), kept.tolist(), strict=True))


def calibrate(x: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> Model:
    """Fits on rows of statistics and their labels; rows that fail the base rules teach nothing. Of the views, the one
    whose threshold rejects most labelled bad rows is taken; if none rejects any, there is no forest."""
    passed = ~base_failed(x)
    x, good = x[passed], good[passed]
    best, most = Model(), 0
    if not good.any() or good.all():
        return best
    for view in VIEWS:
        forest = Forest().fit(features(x, view))
        score = forest.score(features(x, view))
        right = np.sort(score[good])
        # at most clean_loss of the good rows may lie above
        threshold = float(right[len(right) - 1 - int(clean_loss * len(right))])
        caught = int((score[~good] > threshold).sum())
        if caught > most:
            best, most = Model(forest, threshold, view), caught
    return best


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labels (doc_id, quality) of docs (doc_id, text). Of a doc_id labelled twice the worse label counts;
    of one with several texts the smallest statistics; null labels and labels without a document are left out."""
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(own), "doc_id")  # at most `sample` rows of two numbers
    stats, names = annotate(found, "text", STATS, lambda: _rows, ["doc_id", "quality"])
    stats = stats.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct(*names)).alias("x"))
    got = stats.select("doc_id", "quality", "x.*").orderBy("doc_id").toPandas()
    return calibrate(got[names].to_numpy(dtype=np.int64).reshape(-1, 6), got["quality"].to_numpy(dtype=np.int64) > 0)


def _rows(texts: list) -> list[tuple]:
    return [statistics(t or b"") for t in texts]


def judge(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs with the statistics, base_failed, anomaly and kept appended, and the names of these columns.

    docs needs text; all rows stay, and all columns, or those of `keep`, as they are. A null or empty text has statistics of 0 and fails.
    """
    shared = spark.sparkContext.broadcast(model)

    def make():
        def work(texts):
            x = [statistics(t or b"") for t in texts]
            return [a + b for a, b in zip(x, shared.value.judge(np.array(x, dtype=np.int64).reshape(-1, 6)), strict=True)]

        return work

    return annotate(docs, "text", f"{STATS}, base_failed boolean, anomaly double, kept boolean", make, keep)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, _ = judge(spark, docs, model, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
