"""Tokenising whole texts with public tokenizer files, one remembered piece at a time.

Neither supported pre-tokeniser lets a token reach over the border between text and following white space, so a text
can be cut there, and each piece encoded once and remembered. Results equal encoding the whole text. A text with white
space that engines don't agree on goes to the tokenizer whole.

A piece is kept under a short key: what follows a single space stands for itself, a line's first piece starts with the
line break, NUL stands before a piece without white space in front, SOH before any other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows of whole texts that are cut at once.
TEXT_BATCH = 2000
#: Pieces remembered by a worker (some 30 bytes each); when full, only those of the last batch stay.
CACHE = 600_000
#: Longer pieces are not remembered.
LONGEST = 64
#: So many pieces are encoded in one text.
JOINED = 4000

PIECE = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space in Unicode (and separators that some engines count) beyond ASCII's six.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Letters of which words are told from what is around them in every pre-tokeniser; those that lower-casing leaves as they are.
LETTERS, LOWER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Bytes of ASCII texts that the quick way of cutting doesn't know.
UNUSUAL = bytes([0, 1, 9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F])


def read_file(path: str) -> str:
    """The tokenizer file's text, read once by the driver; executors get it in a broadcast (a file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_only(text: bytes) -> bool:
    """Must the text go to the tokenizer whole?"""
    if text.isascii():
        return len(text.translate(None, b"\x00\x01\x1c\x1d\x1e\x1f")) != len(text)
    return b"\x00" in text or b"\x01" in text or OTHER_SPACE.search(text.decode("utf-8", "replace")) is not None


def cut(text: bytes) -> list[bytes]:
    """The keys of the text's pieces, whatever its white space."""
    return [_key(p) for p in PIECE.findall(text)]


def _key(piece: bytes) -> bytes:
    space = len(piece) - len(piece.lstrip(b" \t\n\r\x0b\x0c"))
    if not space:
        return b"\x00" + piece
    if piece[:1] == b" " and (space == 1):
        return piece[1:]
    return piece if piece[:1] == b"\n" and space == 1 and len(piece) > 1 else b"\x01" + piece


def plain(key: bytes) -> bytes:
    """The piece of a key."""
    if key[:1] in (b"\x00", b"\x01"):
        return key[1:]
    return key if key[:1] == b"\n" else b" " + key


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[c] : starts[c] + lengths[c]] for all codes c, put together, and where each run ends."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    small = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts[codes] - (ends - n)).astype(small), n)
    at += np.arange(ends[-1], dtype=small)
    return flat[at], ends


class Table:
    """Ids of pieces, kept in arrays. learn: gives the ids of an Arrow array of distinct keys, as one array, and how many
    each has."""

    def __init__(self, learn, most: int = CACHE):
        self.learn, self.most = learn, most
        self.keys = None
        self.flat, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def find(self, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, starts and lengths: the ids of distinct key k are flat[starts[k] : starts[k] + lengths[k]]."""
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = keys.cast(pa.large_binary())
        if self.keys is None:
            self.keys = keys.slice(0, 0)
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(at.is_null())
        flat, lengths = self.learn(new) if len(new) else (self.flat[:0], self.lengths[:0])
        whole, counts = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        row = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row[row < 0] = len(self.keys) + np.arange(len(new))
        begins = np.cumsum(counts) - counts
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        if len(self.keys) > self.most:
            self.keys, self.flat, self.lengths = new.slice(0, 0), self.flat[:0], self.lengths[:0]
        if pc.all(short).as_py() is not False:
            self.keys, self.flat, self.lengths = pa.concat_arrays([self.keys, new]), np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        else:
            ok = short.to_numpy(zero_copy_only=False)
            self.keys = pa.concat_arrays([self.keys, new.filter(short)])
            self.flat, self.lengths = np.concatenate([self.flat, flat[np.repeat(ok, lengths)]]), np.concatenate([self.lengths, lengths[ok]])
        return whole, begins[row], counts[row]

    def keep(self, keys, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Remembers the first of these distinct keys, whose ids lie end to end in flat, and no others."""
        import pyarrow as pa
        import pyarrow.compute as pc

        short = pc.less_equal(pc.binary_length(keys), LONGEST).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(short)[: self.most]
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        self.keys, self.lengths = keys.cast(pa.large_binary()).take(pa.array(at)), lengths[at].astype(np.int64)
        self.flat = gather(flat, starts, lengths, at)[0].astype(np.uint32)


def together(pieces, before: bytes) -> bytes:
    """The pieces of an Arrow array of bytes as one, `before` in front of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if before:
        pieces = pc.binary_join_element_wise(pa.scalar(before, pa.large_binary()), pieces, pa.scalar(b"", pa.large_binary()))
    if not len(pieces):
        return b""
    upto = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return pieces.buffers()[2][int(upto[0]) : int(upto[-1])].to_pybytes()


def byte_letters() -> np.ndarray:
    """The code point of the letter that stands for each byte in byte-level vocabularies: printable ones for themselves,
    others from U+0100 on. Not for 32, which stays, and 255, which is in no text of UTF-8 and stands for a space."""
    own = np.array([33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)])
    out = np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")
    out[255], out[32] = out[32], 32
    return out


def packed(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids given as bytes, as one array, and how many each has."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def by_pieces(column, bare: bool, table: Table, whole) -> list[bytes]:
    """Each text's ids, as little-endian unsigned 32-bit bytes, from those of its pieces.

    column: an Arrow column of strings (null counts as empty). bare: pieces are words, in lower case; otherwise they keep
    their white space. whole: gives the ids of a text that can't be cut. Cutting and telling pieces apart is Arrow's work,
    so that Python sees only pieces that are new to the table.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = fresh(column)
    out: list = [b""] * len(column)
    quick = range(len(column))
    if not bare:
        texts = column.cast(pa.large_binary()).to_pylist()
        slow = [i for i, t in enumerate(texts) if unusual(t)]
        for i in slow:
            t = texts[i]
            if whole_only(t):
                out[i] = whole(t)
                continue
            keys = cut(t)
            distinct = list(dict.fromkeys(keys))
            number = {k: n for n, k in enumerate(distinct)}
            flat, starts, lengths = table.find(pa.array(distinct, pa.large_binary()))
            out[i] = gather(flat, starts, lengths, np.fromiter(map(number.__getitem__, keys), np.int64, len(keys)))[0].tobytes()
        if slow:
            skip = set(slow)
            quick = [i for i in quick if i not in skip]
            column = column.take(pa.array(quick, pa.int64()))
        column = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\x00", pc.replace_substring(column, "\n", " \n"), "")))
        cuts = pc.split_pattern(column, " ")
    else:
        cuts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    if not len(cuts):
        return out
    coded = cuts.flatten().dictionary_encode()
    flat, ends = gather(*table.find(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
    borders = cuts.offsets.to_numpy() - cuts.offsets[0].as_py()
    borders = np.concatenate([[0], ends])[borders] * 4
    raw = flat.tobytes()
    for i, a, b in zip(quick, borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        out[i] = raw[a:b]
    return out


def fresh(column):
    """A copy of an Arrow column of strings as large strings that start at the buffer's start, null as empty: some string
    functions of Arrow misread slices. What isn't UTF-8 becomes the replacement character."""
    import pyarrow as pa

    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    try:
        return pa.array(texts, pa.large_binary()).cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())


def words_of(column):
    """The distinct words (A-Z lower-cased, cut at ASCII white space) of an Arrow column of strings (null counts as empty)
    as an Arrow array, each word's number among them in order, and the borders of the texts in that order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cuts = pc.ascii_split_whitespace(pc.ascii_lower(fresh(column)))
    coded = cuts.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy(zero_copy_only=False)
    borders = (cuts.offsets.to_numpy() - cuts.offsets[0].as_py()).astype(np.int64) if len(cuts) else np.zeros(1, np.int64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # white space at a text's ends
        real = ~empty[codes]
        borders = np.concatenate([[0], np.cumsum(real)])[borders]
        codes = (np.cumsum(~empty) - 1)[codes[real]]
        words = words.filter(pa.array(~empty))
    return words, codes, borders


def unusual(text: bytes) -> bool:
    """Is there white space that cutting at single spaces and line breaks doesn't do right?"""
    if b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or len(text.translate(None, UNUSUAL)) != len(text):
        return True
    return not text.isascii() and OTHER_SPACE.search(text.decode("utf-8", "replace")) is not None


class Encoder:
    """Encodes whole texts as the tokenizers library does, without added special tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.table = Table(self._learn)
        self.stops = np.array([self.tok.encode(c, add_special_tokens=False).ids[0] for c in ".,"], np.uint32)
        # drops white space: pieces are words, told apart by a word between them; otherwise by the white space in front
        self.bare = self.tok.normalizer is not None
        vocab = self.tok.get_vocab()
        if self.bare:
            # for texts that the normalizer would leave as they are
            self.normal = Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None}))
            self.normal.no_truncation()
            self.normal.no_padding()
            self.between = vocab["0</w>"]
        else:
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for s, i in vocab.items() if s[:1] in ("Ġ", "Ċ")]] = True
        # for words of letters alone, given as the model's own letters: normalising and telling words apart is done
        self.quick, self.letters = Tokenizer(self.tok.model), byte_letters()
        self.quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.first = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word (bare) or begin one
        self.first[[i for s, i in vocab.items() if (s.endswith("</w>") if self.bare else s[:1] == "Ġ")]] = True

    def _ids(self, texts: list[str], tok=None) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct keys and how many each has. A stop or comma after letters is a token of its own, so such keys
        are put together from what comes before it, which is often known."""
        import pyarrow as pa
        import pyarrow.compute as pc

        strings = keys.cast(pa.large_string())
        two = pc.match_substring_regex(strings, f"^[{LETTERS}]+[.,]$").to_numpy(zero_copy_only=False)
        if not two.any():
            return self._encoded(keys)
        ended = strings.filter(pa.array(two))
        stems = pc.utf8_rtrim(ended, characters=".,").cast(pa.large_binary())
        stop = pc.ends_with(ended, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.index_in(stems, value_set=self.table.keys)
        needed = pc.unique(pa.concat_arrays([keys.filter(pa.array(~two)), stems.filter(known.is_null())]))
        flat, lengths = self._encoded(needed)
        # runs: those of the table, those encoded now, a stop and a comma
        whole = np.concatenate([self.table.flat, flat, self.stops])
        counts = np.concatenate([self.table.lengths, lengths, [1, 1]])
        starts = np.cumsum(counts) - counts
        first = len(self.table.lengths)
        run = np.empty(len(keys), np.int64)
        at = lambda x: pc.index_in(x, value_set=needed).to_numpy(zero_copy_only=False).astype(np.int64) + first
        run[~two] = at(keys.filter(pa.array(~two)))
        of_stem = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        of_stem[of_stem < 0] = at(stems.filter(known.is_null()))
        run[two] = of_stem
        place = np.arange(len(keys)) + np.cumsum(two) - two
        runs = np.empty(len(keys) + int(two.sum()), np.int64)
        runs[place] = run
        runs[place[two] + 1] = len(counts) - 2 + stop
        return gather(whole, starts, counts, runs)[0], counts[run] + two

    def _encoded(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct keys and how many each has. Most keys are encoded many in one text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(keys):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.bare:
            alone = pc.match_substring(keys, "0")
        else:
            alone = pc.or_(pc.starts_with(keys, "\x00"), pc.starts_with(keys, "\x01"))
        alone = alone.to_numpy(zero_copy_only=False)
        words = pc.match_substring_regex(keys.cast(pa.large_string()), f"^[{LOWER if self.bare else LETTERS}]+$").to_numpy(zero_copy_only=False)
        lengths, parts = np.zeros(len(keys), np.int64), []
        order = []
        at = np.flatnonzero(alone)
        if len(at):
            one = [(k if self.bare else plain(k)).decode("utf-8", "replace") for k in keys.take(pa.array(at)).to_pylist()]
            ids = self._ids(one)
            lengths[at] = [len(x) for x in ids]
            parts += ids
            order.append(at)
        at = np.flatnonzero(~alone & ~words)
        if self.bare and len(at):
            plain_ = pc.string_is_ascii(keys.take(pa.array(at)).cast(pa.large_string())).to_numpy(zero_copy_only=False)
            at = np.concatenate([at[plain_], at[~plain_]])
        for at, encoded in ((at, self._joint), (np.flatnonzero(words), self._words)):
            for a in range(0, len(at), JOINED):
                some = at[a : a + JOINED]
                ids, n = encoded(keys.take(pa.array(some)))
                lengths[some] = n
                parts.append(ids)
                order.append(some)
        # the ids are in the order of encoding; back to that of the keys
        order = np.concatenate(order)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        n = lengths[order]
        starts = np.empty(len(keys), np.int64)
        starts[order] = np.cumsum(n) - n
        return gather(flat, starts, lengths, np.arange(len(keys)))[0], lengths

    def _words(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, encoded in one text, and how many each has."""
        text = self.letters[np.frombuffer(together(keys, b" " if self.bare else b" \xff"), np.uint8)].tobytes().decode("utf-32-le")
        ids = self._ids([text], self.quick)[0]
        at = np.flatnonzero(self.first[ids])
        n = np.diff(np.concatenate([[-1], at])) if self.bare else np.diff(np.concatenate([at, [len(ids)]]))
        if len(n) != len(keys):
            raise ValueError("words and their ids don't match")
        return ids, n

    def _joint(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys that are encoded in one text, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        value = lambda x: pa.scalar(x, pa.large_binary())
        if self.bare:
            pieces = pc.binary_join_element_wise(keys, value(b" 0 "), value(b""))
        else:
            space = pc.if_else(pc.starts_with(keys, "\n"), value(b""), value(b" "))
            pieces = pc.binary_join_element_wise(space, keys, value(b""))
        text = together(pieces, b"").decode("utf-8", "replace")
        if self.bare:
            # lower-case Latin-1 without its white space is in normal form
            as_is = text.isascii() or (max(text) < "\u0100" and "\x85" not in text and "\xa0" not in text and text == text.lower())
            ids = self._ids([text], self.normal if as_is else None)[0]
            ends = np.flatnonzero(ids == self.between)
            n = np.diff(np.concatenate([[-1], ends])) - 1
            ids = ids[ids != self.between]
        else:
            ids = self._ids([text])[0]
            n = np.diff(np.concatenate([np.flatnonzero(self.opens[ids]), [len(ids)]]))
        if len(n) != len(keys):
            raise ValueError("pieces and their ids don't match")
        return ids, n

    def encode(self, column) -> list[bytes]:
        """The ids of each text of an Arrow column."""
        return by_pieces(column, self.bare, self.table, lambda t: self._ids([t.decode("utf-8", "replace")])[0].tobytes())


_loaded: dict = {}


def encoder(spec: str, most: int = CACHE) -> Encoder:
    """The worker's encoder for this file, kept between tasks. most: pieces that it remembers."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Encoder(spec)
    _loaded[key].table.most = most
    return _loaded[key]
