"""Phrase collocations by contiguous pattern growth over projected occurrences, after PrefixSpan.

Words are counted first. Then each occurrence of a frequent word that another frequent word follows is projected: what
goes to the prefix's task is the stretch of words that the pattern can still grow by. A task has its prefix's stretches
in order, so that growing to the right, depth first, is one pass along them: a pattern's occurrences are a run, its
extensions are runs within that. A prefix that holds many of all occurrences is dealt to several tasks by what follows it,
and its patterns' counts are added up after. On the way words are 64-bit hashes of language and word; a collision with a
frequent word is looked for among all words, and another seed is taken if there is one.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back

#: Bytes of a text that are split at once, and word occurrences (over all languages) that a task counts before it puts them out.
STRETCH, BLOCK = 1 << 20, 1 << 20
#: The filter of frequent words is a broadcast bitmap of at most so many bits (16 MB); more words let more infrequent ones
#: through, whose patterns then fail their own counts.
MOST_BITS = 1 << 27
#: A prefix with more than one in so many of all occurrences is split; at most as many can be, so their list is broadcast.
SHARES = 512
UNKNOWN = "und"

_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Borders of pieces become line feeds, tabs blanks.
_table = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else _lower[b] for b in range(256))


def tokens(text: bytes):
    """Lists of the words in order, a stretch of the text at a time; a border between pieces is a line feed, blanks are empty."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text):  # no word is cut
            cut = max(text.rfind(b, at, end) for b in (b" ", b"\t", b"\n"))
            if cut >= 0:
                end = cut + 1
                break
            end += STRETCH
        yield text[at:end].translate(_table).replace(b"\n", b" \n ").split(b" ")
        at = end


def _word_counts(batches):
    """(lang, word, n) of a task's blocks; the row without a word has the number of all occurrences."""
    import pyarrow as pa

    from collections import Counter

    from vellumlake.llm.common import give_back, utf8
    from vellumlake.llm.phrases import BLOCK, tokens

    held: dict = {}
    size = 0

    def flush():
        for lang, counts in held.items():
            counts.pop(b"", None)
            counts.pop(b"\n", None)
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.binary()).cast(pa.string()), pa.array(np.append(n, n.sum()))], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            counts = held.setdefault(lang, Counter())
            for part in tokens(text):
                counts.update(part)
                size += len(part)
                if size >= BLOCK:
                    yield from flush()
                    size, counts = 0, held.setdefault(lang, Counter())
    yield from flush()
    give_back()


def _windows(bitmap, hot, most: int, seed: int):
    """The task that projects: (part, w1, ..., n) of a task's blocks, the hashes of the words that follow an occurrence of w1 up
    to `most` in all; 0 is where a pattern can't go on. part is -1 but for split prefixes."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        from vellumlake.llm.common import give_back, utf8
        from vellumlake.llm.phrases import BLOCK, tokens

        filter_, split = bitmap.value, hot.value
        names = ["part", *(f"w{k + 1}" for k in range(most)), "n"]
        numbers: dict = {}  # by language: word -> number, from 1
        held: dict = {}  # by language: arrays of numbers; 0 is a border
        size = 0

        def flush(last: bool):
            for lang, arrays in held.items():
                seen = numbers[lang]
                words = list(seen)
                ids = np.concatenate([*arrays, np.zeros(most - 1, np.int64)] if last else arrays)
                ahead = f"{seed}\t{lang}\t".encode()
                h = np.fromiter((xxhash.xxh64_intdigest(ahead + w, seed=42) for w in words), np.uint64, len(words))
                at = h & np.uint64(64 * len(filter_) - 1)
                known = (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                known[:2] = 0  # the border and the empty word
                # frequent words get numbers of their own from 1, in place of all others 0
                place = np.flatnonzero(known)
                new = np.zeros(len(words), np.int64)
                new[place] = np.arange(1, len(place) + 1)
                cur = new[ids]
                n = len(cur) - most + 1
                first = np.flatnonzero((cur[:n] > 0) & (cur[1 : n + 1] > 0)) if n > 0 else np.empty(0, np.int64)
                columns = [cur[first], cur[first + 1]]
                for k in range(2, most):
                    columns.append(np.where(columns[-1] > 0, cur[first + k], 0))
                wide = len(place) + 1
                key, top = columns[0], wide
                for c in columns[1:]:
                    if top > (1 << 62) // wide:  # numbered anew, so that keys stay within 62 bits
                        got, key = np.unique(key, return_inverse=True)
                        top = len(got)
                    key, top = key * wide + c, top * wide
                _, at_first, count = np.unique(key, return_index=True, return_counts=True)
                columns = [c[at_first] for c in columns]
                own = np.concatenate([np.zeros(1, np.uint64), h[place]])
                part = np.full(len(count), -1, np.int32)
                shares = np.array([split.get(x, 0) for x in own.view(np.int64).tolist()])
                many = np.flatnonzero(shares[columns[0]])
                columns = [own[c] for c in columns]
                if len(many):
                    mixed = np.zeros(len(many), np.uint64)
                    for c in columns[1:]:
                        mixed = (mixed ^ c[many]) * np.uint64(0x9E3779B97F4A7C15)
                    part[many] = (mixed >> np.uint64(33)) % np.array([split[x] for x in columns[0][many].view(np.int64).tolist()], np.uint64)
                for s in range(0, len(count), 1 << 16):
                    e = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(part[e]), *(pa.array(c[e].view(np.int64)) for c in columns), pa.array(count[e])], names)
                held[lang] = [ids[max(n, 0) :]] if not last else []
                if not last:  # what windows of the next block begin with keeps its words
                    tail = [words[i] for i in held[lang][0].tolist()]
                    numbers[lang] = seen = {b"\n": 0, b"": 1}
                    held[lang] = [np.array([seen.setdefault(w, len(seen)) for w in tail], np.int64)]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for part in tokens(text):
                    seen = numbers.setdefault(lang, {b"\n": 0, b"": 1})
                    for w in part:
                        if w not in seen:
                            seen[w] = len(seen)
                    ids = np.fromiter(map(seen.__getitem__, part), np.int64, len(part))
                    held.setdefault(lang, []).append(ids[ids != 1])
                    size += len(part)
                    if size >= BLOCK:
                        yield from flush(False)
                        size = 0
                held.setdefault(lang, []).append(np.zeros(most - 1, np.int64))
                numbers.setdefault(lang, {b"\n": 0, b"": 1})
        yield from flush(True)
        give_back()

    return run


def _grow(most: int, least: int):
    """The task of prefixes: rows (part, w1, ..., n) in order to (p, f), the patterns that are frequent, as arrays of hashes. Of
    a split prefix, patterns to which other tasks may add come out whatever their counts."""

    def run(batches):
        import pyarrow as pa

        last = None  # the row before: part and hashes
        going: list = [None] * (most + 1)  # by depth: [row, count] of the run that isn't over

        def out(depth, part, words, count):
            """Of runs that are over, those that come out; words: a row each."""
            fits = (words[:, depth - 1] != 0) & ((count >= least) | ((part >= 0) & (depth < most)))
            if fits.any():
                n = int(fits.sum())
                flat = pa.array(words[fits, :depth].ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), flat), pa.array(count[fits])], ["p", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            part, words, n = columns[0], np.column_stack(columns[1 : most + 1]), columns[most + 1]
            new = np.zeros(len(n), bool)  # where a run of this depth begins
            for k in range(most + 1):
                new[1:] |= columns[k][1:] != columns[k][:-1]
                new[0] |= last is None or last[k] != columns[k][0]
                if k < 2:
                    continue
                starts = np.flatnonzero(new)
                if not len(starts):
                    going[k][1] += int(n.sum())
                    continue
                if going[k]:
                    (p, w), count = going[k][0], going[k][1] + int(n[: starts[0]].sum())
                    yield from out(k, p, w, np.array([count]))
                count = np.add.reduceat(n, starts)
                going[k] = [(part[starts[-1:]], words[starts[-1:]]), int(count[-1])]
                yield from out(k, part[starts[:-1]], words[starts[:-1]], count[:-1])
            last = [c[-1] for c in columns[: most + 1]]
        for k in range(2, most + 1):
            if going[k]:
                (p, w), count = going[k]
                yield from out(k, p, w, np.array([count]))
        give_back()

    return run


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = 10, most: int = 3, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Of docs (text, lang): the table of words (lang, word, n, h), n `least` or more and h the word's hash, with a row without
    word for all occurrences of the language; and that of phrases (p, f), arrays of the hashes of 2 to `most` words that occur
    `least` times or more."""
    scratch = scratch or Scratch(spark, "phrases")
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = own.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted, "counted")
    for seed in itertools.count():
        h = F.xxhash64(F.concat(F.lit(f"{seed}\t"), "lang", F.lit("\t"), "word"))
        hashed = counted.withColumn("h", h)
        twice = hashed.where("word is not null").groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("most"))
        if twice.where(f"(words > 1 or h = 0) and most >= {int(least)}").isEmpty():
            break
    words = scratch.table(hashed.where(f"word is null or n >= {int(least)}"), "words")
    frequent = words.where("word is not null")
    scratch.drop(counted)
    total = words.where("word is null").agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * frequent.count()).bit_length()))
    at = frequent.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    set_ = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[set_.column("k").to_numpy()] = set_.column("v").to_numpy().view(np.uint64)
    share = max(1, total // SHARES)
    hot = {r["h"]: r["parts"] for r in frequent.where(f"n > {share}").select("h", F.ceil(F.col("n") / share).alias("parts")).collect()}

    task = _windows(spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(hot), most, seed)
    follow = [f"w{k + 1}" for k in range(most)]
    windows = own.mapInArrow(task, f"part int, {', '.join(f'{w} long' for w in follow)}, n long")
    windows = windows.repartition("w1", "part").sortWithinPartitions("w1", "part", *follow[1:]).select("part", *follow, "n")
    grown = windows.mapInArrow(_grow(most, least), "p array<long>, f long").groupBy("p").agg(F.sum("f").alias("f")).where(f"f >= {int(least)}")
    return words, scratch.table(grown, "phrases")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 10, most: int = 3, percent: int = 50, top: int = 2000, scratch: Scratch | None = None) -> DataFrame:
    """The phrases of docs (text, lang) whose words go together: lang, rank (from 1), phrase, a, l, r, n and score.

    Words are what blanks and tabs separate, A-Z lower-cased; phrases don't reach over `.,;:!?` or line ends. Everything is
    by language (null: `und`): n counts all words, a the phrase. Of its cuts in two, the one of the least score counts, that
    with the shorter first part if there are several: l and r are the parts' counts, the score floor(1000000 a a / (l r)). A
    phrase within a longer one that occurs in `percent` of a or more goes. The first `top` of a language by score, a, both
    falling, and phrase come out. Null texts are empty; repeated rows all count; an empty table gives no rows; other columns
    are ignored.
    """
    scratch = scratch or Scratch(spark, "phrases")
    words, phrases = frequent_phrases(spark, docs, least, most, scratch)
    frequent = words.where("word is not null")
    known = frequent.select(F.array("h").alias("q"), F.col("n").alias("q_f")).union(phrases)
    size = F.size("p")

    # each cut's two parts, and each longer phrase's parts of two words and more, are looked up by one key
    cuts = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("head"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select(F.col("q").alias("head"), F.col("q_f").alias("l")), "head").join(known.select(F.col("q").alias("rest"), F.col("q_f").alias("r")), "rest")
    big = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"above": F.lit(1000000).cast("decimal(7,0)") * (big("a") * big("a")), "below": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("p").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("p", "a", "m.l", "m.r", "m.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("p", at, n))))
    longer = phrases.where("size(p) > 2").select(F.explode(inner).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    kept = best.join(longer, "p", "left").where(f"longer is null or 100 * longer < {int(percent)} * a").drop("longer")

    # hashes to words
    named = kept.withColumn("id", F.monotonically_increasing_id())
    named = scratch.table(named, "kept")
    spelt = named.select("id", F.posexplode("p").alias("at", "h")).join(frequent.select("h", "lang", "word"), "h").groupBy("id")
    spelt = spelt.agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = named.drop("p").join(spelt, "id").withColumn("rank", rank).where(f"rank <= {int(top)}")
    n = words.where("word is null").select("lang", "n")
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's first 2000 collocations of all documents."""
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
places AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS t FROM words),
next AS (SELECT lang, t[1] AS w1, t[2] AS w2, t[3] AS w3 FROM places),
grams AS (
  SELECT lang, w1 AS phrase, 1 AS size FROM next
  UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM next WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cands AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cands)),
cuts AS (
  SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cands WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cands WHERE size = 3)
  GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
