"""Scoring documents with a language model, next to a base score from word counts.

The model: causal self-attention over subword ids predicts the next id's class; corpus counts give an id's share of its
class, for which the class of the id before it in its word counts too. That is a distribution over words and a text's end;
it is mixed with the words' shares of the training tokens. Classes, counts, attention and the weight of the mixture are all
learnt from all training documents.

One pass tokenises: each task numbers its distinct words and keeps blocks of documents as word numbers beside the words'
ids. All else reads these blocks. The words' corpus counts are summed over blocks and come back to each block by the words'
numbers, so texts are never moved and a very common word is one row for each block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import BATCH, CLASSES, COMMON, LEAST, SPACE, WIDTH, WINDOW, Attention, Learner, clustered, drawn, few, fitted, neighbours, places, spanned, windows_of
from .common import Scratch, give_back
from .langid import part

#: The first fit, at the driver, is of about so many windows, drawn from all blocks: so many passes over them, in steps within these; then all
#: windows are learnt, in rounds, from this rate downwards.
FIRST_WINDOWS, FIRST_PASSES, LEAST_STEPS, MOST_STEPS, ROUNDS, AGAIN_RATE = 40_000, 20, 200, 4000, 3, 0.003
#: Parts that ids' embeddings are summed over tasks in.
BUCKETS = 64
#: Bytes of text after which a task closes a block of documents, and ids of whole documents that are worked on at once.
BLOCK_BYTES, SLICE = 32 << 20, 1 << 20
#: Rows of blocks and of their words' counts that a worker takes at once.
WIDE = 16
#: Added to an id's count within its class, and to what is known with the class before.
SMOOTHING, BACKING = 0.5, 10
#: Weights of the words' own shares that are tried.
WEIGHTS = (0.0, 0.03, 0.1, 0.2, 0.4)
#: log10 of probabilities that single precision takes for 0, or is inexact for.
LOW = -36

ROWS = "kind int, block long, idx int, word binary, n long, doc_ids binary, has_id binary, held binary, ends binary, codes binary, subs binary, sizes binary, counts binary"
DOCS, WORDS, IDS = 0, 1, 2
#: What a block of documents is read from.
BLOCK = ("held", "ends", "codes", "subs", "sizes")
#: Rows of texts that a task cuts into words at once, and words of its last block whose ids it remembers.
TEXT_BATCH, CACHE = 1000, 250_000


def classes_before(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """For each id of words, laid end to end, the class of the id before it in its word; CLASSES for a word's first."""
    before = np.full(len(ids), CLASSES, np.int64)
    before[1:] = cls[ids[:-1]]
    before[starts[lengths > 0]] = CLASSES
    return before


def shares(count: np.ndarray, cls: np.ndarray, begin: int) -> np.ndarray:
    """log10 of each id's share of its class, given the class before it in its word (last row: none), from the counts of
    both; BACKING counts are shared out as the ids are without regard to what comes before."""
    alone = count.sum(0, dtype=np.float64) + SMOOTHING
    alone[begin] = 0
    mass = np.bincount(cls, weights=alone, minlength=CLASSES)
    alone = alone / np.maximum(mass, SMOOTHING)[cls]
    out = np.empty(count.shape, np.float32)
    with np.errstate(divide="ignore"):
        for k, c in enumerate(count):
            out[k] = np.log10((c + BACKING * alone) / (np.bincount(cls, weights=c, minlength=CLASSES)[cls] + BACKING))
    return out


def mixed(unigram: np.ndarray, by_ids: np.ndarray, weight: float, raised: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 of weight parts of the probabilities unigram and the rest of those that by_ids has the log10 of, in single precision.
    raised: the latter; low: where these are too low for it and unigram is 0."""
    if not weight:
        return by_ids
    out = unigram * np.float32(weight)
    out += raised * np.float32(1 - weight)
    out[low] = 1
    np.log(out, out=out)
    out *= np.float32(np.log10(np.e))
    out[low] = by_ids[low] + np.log10(1 - weight)
    return out


class Lm:
    """Attention, the ids' shares of their classes, the weights' sums, and the ids that begin and end a text (after the tokenizer's own)."""

    def __init__(self, attention: Attention, share: np.ndarray, n_ids: int):
        self.attention, self.share, self.begin, self.end = attention, share, n_ids, n_ids + 1


class Block:
    """A block of documents: where each begins among the word numbers, and each word's ids."""

    def __init__(self, row: dict):
        import zstandard

        self.held = np.frombuffer(row["held"], np.uint8) != 0
        self.borders = np.concatenate([[0], np.frombuffer(row["ends"], "<i8")])
        self.codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), "<i4")
        self.flat, self.lengths = words_of_block(row)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.ones(len(self.held), np.int64)  # of each document, with its end
        if len(self.codes):
            words = np.concatenate([[0], np.cumsum(self.lengths[self.codes], dtype=np.int64)])
            self.ids += words[self.borders[1:]] - words[self.borders[:-1]]

    def slices(self, which: np.ndarray, end: int, words: bool = True):
        """Of the documents with these numbers, some at a time: the numbers, the ids (each document's with an end), the borders
        of documents and (if asked for) of words (the end is one) in them, and the words' numbers."""
        from vellumlake.llm.tokens import gather

        n, ids = np.diff(self.borders)[which], self.ids[which]
        group = (np.cumsum(ids) - ids) // SLICE
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(which)]]) if len(which) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some, k = which[a:b], n[a:b]
            if len(some) == some[-1] - some[0] + 1:
                codes = self.codes[self.borders[some[0]] : self.borders[some[-1] + 1]]
            else:
                codes = np.concatenate([self.codes[self.borders[i] : self.borders[i + 1]] for i in some.tolist()])
            seq, ends = gather(self.flat, self.starts, self.lengths, codes)
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(k)])]
            seq = np.insert(seq.astype(np.int64) if words else seq, cut[1:], end)
            docs = cut + np.arange(len(cut))
            if not words:
                yield some, seq, docs, None, codes
                continue
            last = np.cumsum(k)  # the ends are words after each document's last
            sizes = np.insert(self.lengths[codes], last, 1)
            yield some, seq, docs, np.concatenate([[0], np.cumsum(sizes)]), codes


def words_of_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct words' ids, laid end to end, and how many each has."""
    import zstandard

    undo = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(undo(row["subs"]), "<i4"), np.frombuffer(undo(row["sizes"]), "<i4").astype(np.int64)


def _scan(spark: SparkSession, docs: DataFrame, spec: str, begin: int) -> DataFrame:
    """Rows of three kinds: a block's documents, its distinct words with their counts in training documents, and ids with
    theirs. docs: doc_id, held_out, text."""
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        from vellumlake.llm import lm as own
        from vellumlake.llm.common import give_back
        from vellumlake.llm.tokens import encoder, words_of

        enc, number = encoder(shared.value, own.CACHE), TaskContext.get().partitionId() << 20
        pack = zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in own.ROWS.split(", ")])
        ids = np.zeros(begin + 2, np.int64)
        held: list = []
        distinct: list = []
        size = 0

        def rows(size_, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size_, f.type) for f in schema], schema=schema)

        def flush():
            nonlocal number, held, distinct, size, ids
            # the batches' distinct words are told apart once for the block, and looked up once
            coded = pa.chunked_array(distinct).combine_chunks().dictionary_encode()
            words, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            upto = np.cumsum([0, *map(len, distinct)])
            distinct = []
            taught = np.concatenate([x[4] for x in held])
            counts = np.bincount(numbers, weights=taught, minlength=len(words)).astype(np.int64)
            codes = np.concatenate([numbers[a:b][x[5]] for a, b, x in zip(upto[:-1], upto[1:], held, strict=True)])
            doc_ids, has_id, out, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
            held = []
            del coded, numbers, taught
            found, starts, lengths = enc.table.find(words)
            flat, lengths = own.gathered(found, starts, lengths, np.arange(len(words))).astype("<i4"), lengths.astype("<i4")
            enc.table.keep(words, flat, lengths)
            del found, starts
            ids += np.bincount(flat, weights=np.repeat(counts, lengths), minlength=len(ids)).astype(np.int64)
            ids[begin + 1] += int((out == 0).sum())
            small = {"doc_ids": doc_ids, "has_id": has_id, "held": out, "ends": np.cumsum(n).astype("<i8")}
            large = {"codes": codes.astype("<i4"), "subs": flat, "sizes": lengths, "counts": counts.astype("<i8")}
            yield rows(1, kind=[own.DOCS], block=[number], idx=[-1], **{k: [x.tobytes()] for k, x in small.items()}, **{k: [pack(x.tobytes())] for k, x in large.items()})
            del small, large, codes, flat, lengths
            for at in range(0, len(words), 20_000):
                some = words.slice(at, 20_000).cast(pa.binary())
                k = len(some)
                yield rows(k, kind=np.full(k, own.WORDS), block=np.full(k, number), idx=np.arange(at, at + k), word=some, n=counts[at : at + k])
            number, size = number + 1, 0
            del words, counts
            give_back()

        for whole in batches:
            for at in range(0, whole.num_rows, own.TEXT_BATCH):
                batch = whole.slice(at, own.TEXT_BATCH)
                out = batch.column(1).to_numpy(zero_copy_only=False)
                some, codes, borders = words_of(batch.column(2))
                n = np.diff(borders)
                taught = np.bincount(codes[np.repeat(~out, n)], minlength=len(some))
                doc = batch.column(0)
                held.append((doc.fill_null(0).to_numpy().astype("<i8"), np.array(doc.is_valid(), np.uint8), out.astype(np.uint8), n, taught, codes.astype(np.int32)))
                distinct.append(some)
                size += batch.column(2).nbytes
                if size >= own.BLOCK_BYTES:
                    yield from flush()
        if held:
            yield from flush()
        known = np.flatnonzero(ids)
        give_back()
        yield rows(len(known), kind=np.full(len(known), own.IDS), idx=known, n=ids[known])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, ROWS)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    from .tokens import gather

    return gather(flat, starts, lengths, codes)[0]


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({k: batch.column(c)[i].as_py() for c, k in enumerate(BLOCK)})


def _taught(batches, end: int, number: int = 0, of: int = 1):
    """Of blocks, the training documents some at a time: ids and borders. number, of: of so many shares of each block's
    documents, this one."""
    for b in _blocks(batches):
        for _, seq, docs, _, _ in b.slices(np.flatnonzero(~b.held)[number::of], end, words=False):
            yield seq, docs
        del b


def classes(blocks: DataFrame, count: np.ndarray, closing: np.ndarray, begin: int, scratch: Scratch, seed: int = 3) -> np.ndarray:
    """A class for each id, from the ids before and after it in all training documents. Tasks count neighbours, so tables
    that are summed are bounded by ids times common ids; the driver gets SPACE numbers for each id."""
    rng = np.random.default_rng(seed)
    seen = np.flatnonzero(count >= LEAST)
    if len(seen) < CLASSES:
        return few(seen, closing)
    top = np.argsort(-count, kind="stable")[:COMMON]
    place = np.full(len(count), -1)
    place[top] = np.arange(len(top))
    wide = 2 * len(top)
    rare = count < LEAST

    def pairs(batches):
        import pyarrow as pa

        keys, n, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged():
            # sorted as keys and counts in one number: quicker than sorting an order
            both = np.concatenate([keys, *(x[0] for x in waiting)]).astype(np.int64) << 32
            both |= np.concatenate([n, *(x[1] for x in waiting)])
            both.sort()
            k, m = both >> 32, both & 0xFFFFFFFF
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[: len(k)]
            return k[starts], np.add.reduceat(m, starts) if len(k) else m

        for seq, docs in _taught(batches, begin + 1):
            k, m = neighbours(windows_of(seq, docs, begin), place)
            ok = ~rare[k // wide]
            waiting.append((k[ok], m[ok]))
            if len(waiting) == 4:
                keys, n = merged()
                waiting = []
        keys, n = merged()
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // wide), pa.array((k % wide).astype(np.int32)), pa.array(n[at : at + 100_000])], ["id", "place", "n"])
        del keys, n, waiting
        give_back()

    found = blocks.mapInArrow(pairs, "id long, place int, n long").repartition("id").groupBy("id", "place").agg(F.sum("n").alias("n"))
    found = scratch.table(found, "neighbours")
    norms = found.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    norm = np.ones(len(count), np.float32)
    norm[norms["id"]] = np.sqrt(norms["n"])

    def product(of, by, into):
        """Sums of the roots of counts, over the norm of their id, times rows of a matrix."""

        def run(batches):
            import pyarrow as pa

            total, hit = np.zeros((into, SPACE), np.float32), np.zeros(into, bool)
            for batch in batches:
                id_, at, n = (batch.column(k).to_numpy() for k in range(3))
                key, other = (id_, at) if by == "id" else (at, id_)
                order = np.argsort(key, kind="stable")
                key, starts = np.unique(key[order], return_index=True)
                if len(key):
                    total[key] += np.add.reduceat(((np.sqrt(n) / norm[id_])[:, None] * of[other]).astype(np.float32)[order], starts)
                    hit[key] = True
            k = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([x.tobytes() for x in total[k]], pa.binary())], ["k", "v"])

        out = np.zeros((into, SPACE), np.float32)
        got = found.mapInArrow(run, "k long, v binary").toPandas().sort_values(["k", "v"])
        if len(got):
            np.add.at(out, got["k"].to_numpy(), np.frombuffer(b"".join(got["v"]), "<f4").reshape(-1, SPACE))
        return out

    x = product(rng.standard_normal((wide, SPACE)).astype(np.float32), "id", len(count))
    x = product(spanned(product(x, "place", wide)), "id", len(count))
    scratch.drop(found)
    return clustered(x[seen], seen, count, closing, rng)


def counted(rows: DataFrame, cls: np.ndarray, end: int) -> np.ndarray:
    """How often each id follows each class in words of training documents (last row: begins a word). The driver gets a row
    for each id and class that are there: at most classes times the tokenizer's ids."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        n = np.zeros((CLASSES + 1, len(cls)), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                flat, lengths = words_of_block(row)
                taught = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), "<i8")
                before = classes_before(flat, np.cumsum(lengths) - lengths, lengths, cls)
                n += np.bincount(before * len(cls) + flat, weights=np.repeat(taught, lengths), minlength=n.size).reshape(n.shape).astype(np.int64)
                n[CLASSES, end] += int((np.frombuffer(row["held"], np.uint8) == 0).sum())
        k, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(n[k, i])], ["k", "i", "n"])

    got = rows.where(F.col("kind") == DOCS).select("held", "subs", "sizes", "counts").mapInArrow(run, "k long, i long, n long")
    got = got.groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((CLASSES + 1, len(cls)), np.float32)
    count[got["k"].to_numpy(), got["i"].to_numpy()] = got["n"].to_numpy()
    return count


def some_windows(blocks: DataFrame, begin: int, share: float) -> np.ndarray:
    """About this share of the training documents' windows, drawn from all blocks."""

    def run(batches):
        import pyarrow as pa

        for number, b in enumerate(_blocks(batches)):
            rng = np.random.default_rng([number, len(b.codes), int(b.codes[:WINDOW].sum())])
            which = np.flatnonzero(~b.held)
            text, at = places(np.concatenate([[0], np.cumsum(b.ids[which])]), WINDOW)
            chosen = np.flatnonzero(rng.random(len(text)) < share)
            held, own = np.unique(text[chosen], return_inverse=True)  # only documents of these windows are put together
            first = 0
            for some, seq, docs, _, _ in b.slices(which[held], begin + 1, words=False):
                here = np.flatnonzero((own >= first) & (own < first + len(some)))
                w = windows_of(seq, docs, begin, (own[here] - first, at[chosen[here]]))
                first += len(some)
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])
            del b

    got = sorted(blocks.mapInArrow(run, "w binary").toPandas()["w"])
    w = np.frombuffer(b"".join(got), "<i4").reshape(-1, WINDOW + 1)
    return w[np.random.default_rng(7).permutation(len(w))]


def learnt(spark: SparkSession, blocks: DataFrame, p: dict, cls: np.ndarray, begin: int) -> dict:
    """Goes on from p over all windows of training documents, each once. In a round each task learns from its share of
    its documents; then parameters are averaged over tasks by their windows, an id's row by the steps that held it."""
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((p, cls.astype(np.int64), AGAIN_RATE * (1 - number / ROUNDS)))

        def run(batches, number=number, shared=shared):
            import pyarrow as pa
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([number, task])
            m = Learner(*shared.value)
            for seq, docs in _taught(batches, begin + 1, number, ROUNDS):
                text, at = places(docs, WINDOW)
                order = rng.permutation(len(text))
                for k in range(0, len(order), BATCH):
                    some = order[k : k + BATCH]
                    m.learn(windows_of(seq, docs, begin, (text[some], at[some])))
            if not m.steps:
                return
            own = [(-1, task, m.weight, b"", (m.weight * np.concatenate([m.p[k].ravel() for k in sorted(m.p) if k != "e"]).astype(np.float64)).tobytes())]
            ids = np.flatnonzero(m.seen)
            for bucket in range(BUCKETS):
                some = ids[ids % BUCKETS == bucket]
                if len(some):
                    rows = np.concatenate([m.p["e"][some] * m.seen[some][:, None], m.seen[some][:, None]], 1)
                    own.append((bucket, task, 0, some.astype("<i4").tobytes(), rows.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*own, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "task", "weight", "ids", "rows"])
            del m, own, rows
            give_back()

        def summed(batches):
            import pyarrow as pa

            total, dense, weight = {}, 0.0, 0
            for batch in batches:
                for r in batch.to_pylist():
                    if r["bucket"] < 0:
                        dense, weight = dense + np.frombuffer(r["rows"], "<f8"), weight + r["weight"]
                    else:
                        t = total.setdefault(r["bucket"], np.zeros((len(cls) // BUCKETS + 1, WIDTH + 1)))
                        t[np.frombuffer(r["ids"], "<i4") // BUCKETS] += np.frombuffer(r["rows"], "<f4").reshape(-1, WIDTH + 1)
            out = [(b, 0, t.tobytes()) for b, t in total.items()] + ([(-1, weight, dense.tobytes())] if weight else [])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "weight", "rows"])

        made = blocks.mapInArrow(run, "bucket int, task int, weight long, ids binary, rows binary")
        made = made.repartition("bucket").sortWithinPartitions("bucket", "task").mapInArrow(summed, "bucket int, weight long, rows binary")
        p = {k: v.copy() for k, v in p.items()}
        for bucket, weight, rows in made.toPandas().itertuples(index=False):
            if bucket < 0:
                dense, at = np.frombuffer(rows, "<f8") / weight, 0
                for k in sorted(p):
                    if k != "e":
                        p[k] = dense[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
                        at += p[k].size
            else:
                t = np.frombuffer(rows, "<f8").reshape(-1, WIDTH + 1)
                hit = np.flatnonzero(t[:, -1])
                p["e"][hit * BUCKETS + bucket] = t[hit, :-1] / t[hit, -1:]
        shared.unpersist()
    return p


def n_ids_of(spec: str) -> int:
    """How many ids the tokenizer has."""
    import json

    j = json.loads(spec)
    return max([*j["model"]["vocab"].values(), *(x["id"] for x in j["added_tokens"])]) + 1


def fit(spark: SparkSession, rows: DataFrame, spec: str, scratch: Scratch) -> Lm:
    """The model from all training documents of the rows that _scan gave. A first fit at the driver, from some of the
    windows, is where learning from all of them starts. Without training documents every id is as likely."""
    import json

    n_ids = n_ids_of(spec)
    closing = np.zeros(n_ids + 2, bool)
    closing[[i for s, i in json.loads(spec)["model"]["vocab"].items() if s.endswith("</w>")]] = True
    found = rows.where(F.col("kind") == IDS).groupBy("idx").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(n_ids + 2, np.int64)
    count[found["idx"].to_numpy(int)] = found["n"].to_numpy(int)
    if not count.any():
        cls = np.zeros(n_ids + 2, np.int64)
        p = {"e": np.zeros((n_ids + 2, WIDTH), np.float32), "p": np.zeros((WINDOW, WIDTH), np.float32), "m": np.zeros((WIDTH, 4 * WIDTH), np.float32)}
        p |= {"o": np.zeros((WIDTH, CLASSES), np.float32), "b": np.where(np.arange(CLASSES), -200, 0).astype(np.float32)}
        return Lm(Attention(cls, p), shares(np.zeros((CLASSES + 1, n_ids + 2), np.float32), cls, n_ids), n_ids)
    blocks = rows.where(F.col("kind") == DOCS).select(*BLOCK)
    cls = classes(blocks, count, closing, n_ids, scratch)
    first = some_windows(blocks, n_ids, FIRST_WINDOWS / max(1, count.sum() / WINDOW))
    p = drawn(cls, count, closing)
    if len(first):
        p = fitted(first, p, cls, min(MOST_STEPS, max(LEAST_STEPS, FIRST_PASSES * len(first) // 64)))
    p = learnt(spark, blocks, p, cls, n_ids)
    return Lm(Attention(cls, p), shares(counted(rows, cls, n_ids + 1), cls, n_ids), n_ids)


def score(spark: SparkSession, docs: DataFrame, tokenizer: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text,
    held_out boolean); only rows that are not held out teach.

    A null text counts as empty and is its end alone; repeated rows and ids stay, and count as often; null doc_ids stay; a
    null held_out teaches. Other columns are ignored; an empty table gives no rows. Without any training text the base
    score is 0 counts' smoothing and the model is uniform over its ids.
    """
    from .tokens import read_file

    scratch = scratch or Scratch(spark, "lm")
    spec = read_file(tokenizer)
    own = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    rows = scratch.table(_scan(spark, own, spec, n_ids_of(spec)), "rows")
    model = fit(spark, rows, spec, scratch)
    n_ends = int(rows.where((F.col("kind") == IDS) & (F.col("idx") == model.end)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    blocks = max(1, rows.where(F.col("kind") == DOCS).count())  # of bounded size each, so a task's share doesn't grow
    known = rows.where(F.col("kind") == WORDS).select("block", "idx", "n", "word").repartition(blocks, "word")
    known = scratch.table(known.mapInArrow(_summed, "block long, n long, v long, idx binary, c binary"), "known")
    n, v = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + n_ends, v + (n_ends > 0)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm import lm as own

        m, held, counts = shared.value, None, []

        def done():
            b = own.Block(held)
            held.update(codes=None, subs=None, sizes=None)
            c = np.zeros(len(b.lengths) + 1, np.int64)
            for idx, k in counts:
                c[np.frombuffer(idx, "<i4")] = np.frombuffer(k, "<i8")
            c[-1] = n_ends
            # by word: what doesn't depend on the words around it
            base_of = np.log10((c + 1) / (n + v + 1))
            share_of, less_of = (c / max(n, 1)).astype(np.float32), (np.maximum(c - 1, 0) / max(n - 1, 1)).astype(np.float32)
            by_id = np.concatenate([[0.0], np.cumsum(m.share[own.classes_before(b.flat, b.starts, b.lengths, m.attention.cls), b.flat], dtype=np.float64)])
            within = np.append(by_id[b.starts + b.lengths] - by_id[b.starts], m.share[own.CLASSES, m.end])
            doc_ids, has_id = np.frombuffer(held["doc_ids"], "<i8"), np.frombuffer(held["has_id"], np.uint8) != 0
            for which, seq, docs, cuts, codes in b.slices(np.arange(len(b.held)), m.end):
                log = m.attention.score(seq, docs, m.begin)
                total = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
                sizes = np.diff(b.borders)[which] + 1
                ends = np.cumsum(sizes)
                number = np.insert(codes, ends - sizes + np.diff(b.borders)[which] - np.arange(len(sizes)), len(c) - 1)
                by_ids = total[cuts[1:]] - total[cuts[:-1]] + within[number]
                found = c[number]
                starts = ends - sizes
                summed = lambda x: np.add.reduceat(x, starts, dtype=np.float64 if x.dtype.kind == "f" else None)
                base = summed(base_of[number])
                single = by_ids.astype(np.float32)
                share, raised = share_of[number], np.exp(single * np.float32(np.log(10)))
                under = single < own.LOW
                scores, others = [], []
                taught = np.flatnonzero(np.repeat(~b.held[which], sizes))
                less, by_taught, raised_taught = less_of[number[taught]], by_ids[taught], raised[taught]
                low, low_taught = np.flatnonzero(under & (share == 0)), np.flatnonzero(under[taught] & (less == 0))
                for weight in own.WEIGHTS:
                    scores.append(summed(own.mixed(share, by_ids, weight, raised, low)))
                    others.append(float(own.mixed(less, by_taught, weight, raised_taught, low_taught).sum(dtype=np.float64)))
                k = len(which)
                columns = [pa.array(doc_ids[which], mask=~has_id[which]), pa.array(b.held[which]), pa.array(sizes), pa.array(summed((found > 0).astype(np.int64))), pa.array(base)]
                columns.append(pa.array(np.stack(scores, 1).tolist(), pa.list_(pa.float64())))
                columns.append(pa.array([others] + [None] * (k - 1), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "others"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(c)[i].as_py() for c, k in enumerate(batch.schema.names)}
                if row["codes"] is not None:
                    if held is not None:
                        yield from done()
                        give_back()
                    held, counts = row, []
                else:
                    counts.append((row["idx"], row["c"]))
        if held is not None:
            yield from done()
        held, counts = None, []
        give_back()

    texts = ("doc_ids", "has_id", *BLOCK)
    none = lambda names: [F.lit(None).cast("binary").alias(x) for x in names]
    docs_ = rows.where(F.col("kind") == DOCS).select("block", F.lit(0).alias("part"), *texts, *none(("idx", "c")))
    parts_ = known.select("block", F.lit(1).alias("part"), *none(texts), "idx", "c")
    both = docs_.unionByName(parts_).repartition(blocks, "block").sortWithinPartitions("block", "part").drop("block", "part")
    made = scratch.table(both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, others array<double>"), "scores", batch=WIDE)
    # each weight's log probability of the training documents, a word's own place not counted
    sums = made.agg(*(F.sum(F.col("others")[k]).alias(f"w{k}") for k in range(len(WEIGHTS)))).first()
    best = max(range(len(WEIGHTS)), key=lambda k: sums[k]) if sums[0] is not None else 0
    scratch.drop(rows, known)
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))


def _summed(batches):
    """Rows of all blocks' words, those of a word in one task, as a row for each block: its words' numbers and their counts in all
    blocks, the sum of its own counts, and how many words it is the first to have of those that are counted."""
    import pyarrow as pa

    from vellumlake.llm.common import give_back

    columns: list = [[], [], []]
    words: list = []
    for batch in batches:
        for k, x in enumerate(columns):
            x.append(batch.column(k).to_numpy(zero_copy_only=False))
        words.append(batch.column(3).cast(pa.large_binary()).dictionary_encode())  # few bytes for words of many blocks
    if not words:
        return
    number = pa.chunked_array(words).unify_dictionaries().chunks
    number = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in number])
    del words
    block, idx, n = map(np.concatenate, columns)
    del columns
    c = np.bincount(number, weights=n).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, idx, n, number = block[order], idx[order], n[order], number[order]
    first = np.zeros(len(block), np.int64)
    first[np.unique(number, return_index=True)[1]] = 1
    c = c[number]
    first[c == 0] = 0
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    rows = [(int(block[a]), int(n[a:b].sum()), int(first[a:b].sum()), idx[a:b].astype("<i4").tobytes(), c[a:b].astype("<i8").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "n", "v", "idx", "c"])
    del rows, block, idx, n, number, first, c, order
    give_back()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and score; a seventh of the documents teach nothing."""
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (part(7) == 2).alias("held_out"))
    return score(spark, docs, path("word_bpe_49k.json"))
