"""Byte-level BPE encoding and decoding from the vocabulary and merge ranks alone.

A pretoken's bytes are a doubly linked list of symbols; a priority queue holds the mergeable neighbours by rank and
position. An entry whose pair is no longer there is stale and is skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Table, by_pieces, gather, packed, plain

SCHEMA = "doc_id long, ids binary, decoded binary"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others, in order, for the characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, spec: str):
        import public_tokenizers
        import regex

        j = json.loads(spec)
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        alphabet = byte_alphabet()
        vocab = j["model"]["vocab"]
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.strings[i] = s.encode() if s in self.special else to_bytes(s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.flat = np.frombuffer(b"".join(self.strings), np.uint8)
        self.lengths = np.fromiter(map(len, self.strings), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.single = [0] * 256
        for c, b in alphabet.items():
            self.single[b] = vocab[c]
        #: pair of ids -> (rank, merged id), as one number
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(j["model"]["merges"])}
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = Table(self._learn)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        single, merges = self.single, self.merges
        sym = [single[b] for b in data]
        n = len(sym)
        if n == 1:
            return sym
        nxt, prev, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m is not None:
                heap.append((m >> 32, i, m & 0xFFFFFFFF, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue  # stale
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                m = merges.get((new, sym[k]))
                if m is not None:
                    heapq.heappush(heap, (m >> 32, i, m & 0xFFFFFFFF, new, sym[k]))
            p = prev[i]
            if p >= 0:
                m = merges.get((sym[p], new))
                if m is not None:
                    heapq.heappush(heap, (m >> 32, p, m & 0xFFFFFFFF, sym[p], new))
        return [s for s in sym if s >= 0]

    def piece(self, text: str) -> bytes:
        ids = []
        for k, part in enumerate(self.splits.split(text) if self.splits else [text]):
            if k % 2:
                ids.append(self.special[part])
            else:
                for t in self.pretokens.findall(part):
                    ids += self.merge(t.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct keys and how many each has. A stop or comma after letters is a pretoken of its own."""
        out, stems = [], {}
        for key in keys.to_pylist():
            if key[-1:] in (b",", b".") and key[:1] > b" " and key[:-1].isalpha():
                stem = stems.get(key[:-1])
                if stem is None:
                    stem = stems[key[:-1]] = self.piece(plain(key[:-1]).decode())
                out.append(stem + self.piece(key[-1:].decode()))
            else:
                ids = stems.get(key)
                if ids is None:
                    ids = stems[key] = self.piece(plain(key).decode("utf-8", "replace"))
                out.append(ids)
        return packed(out)

    def encode(self, column) -> list[bytes]:
        """The ids of each text of an Arrow column, as little-endian unsigned 32-bit bytes."""
        return by_pieces(column, False, self.table, lambda t: self.piece(t.decode("utf-8", "replace")))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """For each document the vocabulary strings of its ids, put together; what isn't UTF-8 becomes the replacement
        character."""
        codes = np.frombuffer(b"".join(ids), "<u4")
        flat, ends = gather(self.flat, self.starts, self.lengths, codes)
        borders = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        raw = flat.tobytes()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(borders[:-1], borders[1:], strict=True)]


_loaded: dict = {}


def bpe(spec: str) -> Bpe:
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (UTF-8) of every row's whole text.

    A null text counts as empty and gives no ids; repeated rows and ids stay; other columns are ignored; an empty table
    gives no rows. Special tokens' strings in a text become their ids, as the library does by default.
    """
    from .tokens import read_file

    spec = spark.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        import pyarrow as pa

        from vellumlake.llm.bpe import bpe
        from vellumlake.llm.common import give_back
        from vellumlake.llm.tokens import TEXT_BATCH

        own = bpe(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_BATCH):
                batch = whole.slice(at, TEXT_BATCH)
                ids = own.encode(batch.column(1))
                texts = own.decode(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    from public_tokenizers import path

    out = encode_decode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
