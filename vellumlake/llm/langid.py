"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams, counted over all training documents. A document is a
mixture: expectation-maximisation estimates the languages' shares, and a language joins the set only if it lifts the
log-likelihood by more than a penalty. The document's language is the one with the largest share.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate

#: Trigram buckets; a language's table has so many numbers.
BUCKETS = 1 << 15
SMOOTHING = 0.1
#: A language's share below this doesn't count.
LEAST_SHARE = 0.03
#: A language joins if it gains more log-likelihood than this times the logarithm of the number of trigrams.
PENALTY = 3.0
STEPS = 30
UNKNOWN = "und"
#: Bytes of a text that are counted at once.
STRETCH = 1 << 20

#: ASCII letters and all bytes of other characters stand for themselves, everything else for a space.
_table = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _parts(text: bytes):
    """The text in stretches, cut behind a space or line end where there is one, else between characters."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
            while not cut and end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            end = cut or end
        yield text[at:end]
        at = end


def grams(text: bytes) -> np.ndarray | None:
    """How often each bucket's trigrams are in the text, whose runs of other characters than letters count as one space; None
    if it has no letter (Unicode category L). Memory is that of a stretch, however long the text is."""
    n, letter = np.zeros(BUCKETS, np.int64), False
    ahead = np.array([32], np.uint8)  # the last two bytes so far
    for part in itertools.chain(_parts(text), [b" "]):
        s = part.decode("utf-8", "replace").lower()
        letter = letter or any(map(str.isalpha, s))
        b = np.concatenate([ahead, np.frombuffer(s.encode().translate(_table), np.uint8)])
        twice = np.zeros(len(b), bool)
        twice[len(ahead) :] = (b[len(ahead) :] == 32) & (b[len(ahead) - 1 : -1] == 32)
        b = b[~twice]
        ahead = b[-2:]
        b = b.astype(np.uint32)
        code = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
        n += np.bincount((code * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    return n if letter else None


class Model:
    """langs and p: a row of bucket probabilities for each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c = counts + SMOOTHING
        self.p = c / c.sum(1, keepdims=True)
        self.log = np.log(self.p)

    def shares(self, n: np.ndarray) -> list[tuple[str, float]]:
        """The languages of a document with trigram counts n, and their shares, largest first."""
        at = np.flatnonzero(n)
        c, p = n[at].astype(float), self.p[:, at]
        total = c.sum()
        single = self.log[:, at] @ c
        best = int(single.argmax())
        chosen, share, q, like = [best], np.ones(1), p[best], float(single[best])
        penalty = PENALTY * np.log(total + 1)
        while len(chosen) < len(self.langs):
            found = None
            for m in range(len(self.langs)):
                # the likelihood is concave in a new language's share: no rise at the least share, no larger share
                mixed = (1 - LEAST_SHARE) * q + LEAST_SHARE * p[m]
                if m in chosen or c @ ((p[m] - q) / mixed) <= 0:
                    continue
                got = self._em(c, p[[*chosen, m]], np.append(share * 0.8, 0.2), total)
                if got[2] > like + penalty and got[0].min() >= LEAST_SHARE and (found is None or got[2] > found[3]):
                    found = (m, *got)
            if found is None:
                break
            m, share, q, like = found
            chosen.append(m)
        order = np.argsort(-share, kind="stable")
        return [(self.langs[chosen[i]], float(share[i])) for i in order]

    def _em(self, c, p, share, total):
        q = share @ p
        like = float(c @ np.log(q))
        for _ in range(STEPS):
            share = share * (p @ (c / q)) / total
            q = share @ p
            last, like = like, float(c @ np.log(q))
            if like - last < 1e-3:
                break
        return share, q, like

    def predict(self, texts: list) -> list[tuple[str, float, list[str]]]:
        """(language, its share, the set's languages) of each text."""
        out = []
        for t in texts:
            n = grams(t) if t and self.langs else None
            found = self.shares(n) if n is not None else [(UNKNOWN, 0.0)]
            out.append((found[0][0], min(1.0, found[0][1]), [x for x, _ in found]))
        return out


def fit(docs: DataFrame) -> Model:
    """The model from all rows of docs (text, lang); null texts and languages are left out. Tasks count in tables of a
    fixed size for each language, so what the driver gets is bounded by the number of languages."""

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.common import utf8
        from vellumlake.llm.langid import BUCKETS, grams

        counts: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                n = grams(text)
                if n is not None:
                    counts[lang] = counts[lang] + n if lang in counts else n
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy(dtype=object)) if langs else [], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts)


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs with lang_pred, score and lang_set appended, and the names of these columns. docs needs text; all rows stay, and
    all columns, or those of `keep`. A text that is null or has no letter is `und` with score 0, as is any text if no language is known."""
    shared = spark.sparkContext.broadcast(model)
    return annotate(docs, "text", "lang_pred string, score double, lang_set array<string>", lambda: shared.value.predict, keep)


def part(mod: int):
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learnt from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(part(3) != 1))
    out, _ = predict(spark, docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (part(3) == 1).alias("held_out"), "lang_pred", "score")
