"""SentencePiece byte-pair encoding and decoding in rounds over flat arrays.

A model's merges depend on nothing but two neighbouring symbols, so texts are
cut wherever no piece holds the two characters at a seam: first before white
space, then (inside words that weren't met before) between any such characters.
The symbols of all new words of a batch lie in one flat array. Each round takes
the smallest rank among the pairs of every word (a segmented minimum), merges
its occurrences from the left at once, and closes the array up; words without a
pair that merges leave it. The library merges one pair at a time, best rank
first and from the left: where a merge makes a pair that would come before the
word's next occurrence, the word's round ends with that merge, so both orders
give the same symbols. Characters that end up in no piece become byte pieces.

Decoding gathers the bytes of all ids of a batch at once. One leading space, the
mark that encoding puts before a text, goes.

Defined results: a null text is encoded like an empty one, without ids; null ids
are decoded like none; U+2581 counts as a space, as it does in the library; bytes
that aren't UTF-8 become U+FFFD each; ids that the vocabulary doesn't have raise an error;
a model with other normalisation than the dummy prefix, with user-defined or
unused pieces or without byte pieces raises an error; further columns are kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, release
from .tokens import default_path

SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Ids of words that a worker remembers, about.
REMEMBERED = 1 << 19
#: Characters that are encoded at once, about; a longer text is encoded whole.
CHUNK = 1 << 19
NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces, ranks of merges and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if (t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or n.precompiled_charsmap or n.remove_extra_whitespaces
                or not n.add_dummy_prefix or not n.escape_whitespaces or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError(f"{path}: not a byte-pair model with byte pieces, an identity normaliser and a dummy prefix")
        self.size = len(kinds)
        texts = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
        self._symbols(texts)
        self._merges(texts, {i: model.pieces[i].score for i in texts.values()})
        self._bytes(model.pieces)

    def _symbols(self, texts: dict[str, int]) -> None:
        """A number for each character: its piece's id, or one from ``size`` on; all that no piece holds share the last."""
        chars = sorted({c for t in texts for c in t})
        self.number = {c: texts[c] if c in texts else self.size + i for i, c in enumerate(chars)}
        self.of_char = np.full(0x110000, self.size + len(chars), np.int32)
        for c, i in self.number.items():
            self.of_char[ord(c)] = i
        seams = {-1} | {ord(a) << 32 | ord(b) for t in texts for a, b in zip(t, t[1:])}
        self.beside = np.array(sorted(seams), np.int64)
        # a word starts with its white space if no piece goes on with white space after another character
        inside = any(a != SPACE and b == SPACE for t in texts for a, b in zip(t, t[1:]))
        self.word = re.compile(".+" if inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)

    def _merges(self, texts: dict[str, int], scores: dict[int, float]) -> None:
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = {-1: (NEVER, 0)}  # there is always a key
        for t, i in texts.items():
            for k in range(1, len(t)):
                pair = [self.number[p] if len(p) == 1 else texts.get(p) for p in (t[:k], t[k:])]
                if None not in pair:
                    found[pair[0] << 32 | pair[1]] = (order[scores[i]], i)
        self.keys = np.array(sorted(found), np.int64)
        self.ranks, self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32).reshape(-1, 2).T.copy()

    def _bytes(self, pieces) -> None:
        shown = [b"" if p.type == CONTROL else UNKNOWN_TEXT.encode() if p.type == UNKNOWN else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE
                 else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.lengths = np.array([len(b) for b in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.kind = np.array([p.type for p in pieces], np.int8)
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in pieces])

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the merges of pairs of symbols (``NEVER`` if there is none), and what they make."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], NEVER), self.merged[at]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and the place in ``symbols`` of the first character of each.

    ``words`` numbers the words from 0 on, rising: symbols of different words don't merge.
    """
    place = np.arange(len(symbols))
    rank = np.full(len(symbols), NEVER)  # of a symbol and the next one of its word
    made = np.zeros(len(symbols), np.int32)
    at = np.flatnonzero(words[:-1] == words[1:])
    rank[at], made[at] = v.pair(symbols[at], symbols[at + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        own = np.diff(np.r_[starts, len(words)])
        least = np.repeat(np.minimum.reduceat(rank, starts), own)
        over = least == NEVER
        if over.any():  # words without a pair leave
            done.append((place[over], symbols[over]))
            symbols, words, place, rank, made, least = (x[~over] for x in (symbols, words, place, rank, made, least))
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == least)
        head = np.r_[True, hit[1:] != hit[:-1] + 1]
        run = np.flatnonzero(head)
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]  # of overlapping ones, the first, third, ...
        hit = hit[~_after_unsafe(v, symbols, words, made, least, hit)]
        symbols[hit] = made[hit]
        left = np.ones(len(symbols), bool)
        left[hit + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[hit] = True
        symbols, words, place, rank, made, fresh = (x[left] for x in (symbols, words, place, rank, made, fresh))
        at = np.flatnonzero(fresh | np.r_[fresh[1:], False])
        inner = at[at + 1 < len(symbols)]
        inner = inner[words[inner] == words[inner + 1]]
        rank[at] = NEVER
        rank[inner], made[inner] = v.pair(symbols[inner], symbols[inner + 1])
    if not done:
        return symbols, place
    place, symbols = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place)
    return symbols[order], place[order]


def _after_unsafe(v: Vocabulary, symbols, words, made, least, hit) -> np.ndarray:
    """Which merges follow, in their word, one that makes a pair of their own or a smaller rank."""
    new = made[hit]
    joined = np.r_[False, hit[1:] == hit[:-1] + 2] & np.r_[False, words[hit[1:]] == words[hit[:-1]]]
    before = symbols[np.maximum(hit - 1, 0)].copy()
    before[joined] = new[:-1][joined[1:]]
    first = (hit == 0) | (words[np.maximum(hit - 1, 0)] != words[hit])
    last = hit + 2 >= len(symbols)
    beyond = np.minimum(hit + 2, len(symbols) - 1)
    last |= words[beyond] != words[hit]
    limit = least[hit]
    unsafe = ~first & (v.pair(before, new)[0] <= limit) | ~last & (v.pair(new, symbols[beyond])[0] <= limit)
    if not unsafe.any():
        return unsafe
    count = np.cumsum(unsafe) - unsafe  # unsafe ones before this one, in all words
    own = np.r_[True, words[hit[1:]] != words[hit[:-1]]]
    start = np.maximum.accumulate(np.where(own, np.arange(len(hit)), 0))
    return count > count[start]


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    beside = code[:-1] << 32 | code[1:]
    at = np.minimum(np.searchsorted(v.beside, beside), len(v.beside) - 1)
    seam = np.r_[True, (v.beside[at] != beside) | (word[1:] != word[:-1])][:len(code)]
    symbols, place = merge_rounds(v, v.of_char[code], np.cumsum(seam) - 1)
    owner = word[place]
    bare = np.flatnonzero(symbols >= v.size)  # single characters without a piece
    raw = code[place[bare]]
    many = np.ones(len(symbols), np.int64)
    many[bare] = 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)
    ids = np.repeat(symbols, many)
    where = np.cumsum(many) - many
    ids[ranges(where[bare], many[bare])] = v.byte_id[np.frombuffer(raw.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
    return ids, np.bincount(owner, many, len(words)).astype(np.int64)


class Encoder:
    """Encodes batches of texts; remembers the words it met, up to a bound."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, lengths = encode_words(self.v, words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths) - lengths]
        self.lengths, self.ids = np.r_[self.lengths, lengths], np.r_[self.ids, ids]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.ids) > REMEMBERED:
            self._forget()
        find = self.v.word.findall
        words = [find((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        every = [w for own in words for w in own]
        fresh = [w for w in dict.fromkeys(every) if w not in self.known]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        lengths = self.lengths[at]
        ends = np.r_[0, np.cumsum(lengths)]
        edge = np.r_[0, np.cumsum([len(own) for own in words])].astype(np.int64)
        return self.ids[ranges(self.starts[at], lengths)], np.diff(ends[edge])


def _characters(run: bytes) -> str:
    """A run of byte pieces: whole UTF-8 characters, and U+FFFD for each byte that is in none."""
    out, i = [], 0
    while i < len(run):
        n = 1 + (run[i] >= 0xC0) + (run[i] >= 0xE0) + (run[i] >= 0xF0)
        try:
            out.append(run[i:i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each list of ids; the lists lie one after the other."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError("ids that the vocabulary doesn't have")
    lengths, starts = v.lengths[ids], v.starts[ids].copy()
    edge = np.r_[0, np.cumsum(counts)]
    shown = np.flatnonzero(v.kind[ids] != CONTROL)
    first = np.searchsorted(shown, edge[:-1])
    first = shown[np.minimum(first, len(shown) - 1)][(first < len(shown))] if len(shown) else shown
    lead = np.unique(first[v.spaced[ids[first]]]) if len(first) else first
    starts[lead] += 1
    lengths[lead] -= 1
    raw = v.flat[ranges(starts, lengths)].tobytes()
    ends = np.r_[0, np.cumsum(lengths)]
    before = np.r_[0, np.cumsum(v.kind[ids] == CONTROL)][edge]  # a control piece ends a run of bytes
    out = []
    for a, b, whole in zip(edge[:-1].tolist(), edge[1:].tolist(), (before[1:] == before[:-1]).tolist()):
        own = raw[ends[a]:ends[b]]
        try:
            out.append(own.decode() if whole else None)
        except UnicodeDecodeError:
            out.append(None)
        if out[-1] is None:
            is_byte = v.kind[ids[a:b]] == BYTE
            cuts = a + np.r_[0, np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1, b - a]
            out[-1] = "".join(_characters(raw[ends[p]:ends[q]]) if is_byte[p - a] else raw[ends[p]:ends[q]].decode() for p, q in zip(cuts[:-1], cuts[1:]))
    return out


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column in runs of about ``CHUNK`` characters, and where each run starts."""
    own, size, start = [], 0, 0
    for i, text in enumerate(column):
        own.append(text.as_py())
        size += len(own[-1] or "")
        if size >= CHUNK or i + 1 == len(column):
            yield start, own
            own, size, start = [], 0, i + 1


def listed(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with an array of ids in place of the column ``text`` (and of a column named ``ids``)."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*others, F.col(text).alias("_text"))

    def run(batches):
        own = Encoder(path or default_path("piece_bpe_32k.model"))
        for b in batches:
            for start, texts in chunks(b.column(len(others))):
                rest = [c.slice(start, len(texts)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, listed(*own.encode(texts))], names=[*others, ids])
        release()

    return rows.mapInArrow(run, docs.select(*others).schema.add(ids, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with the text of the array of ids added as the column ``text``."""
    bound_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != text]
    at = others.index(ids)

    def run(batches):
        v = vocabulary(path or default_path("piece_bpe_32k.model"))
        for b in batches:
            column = b.column(at)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            out = decode_ids(v, column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*others, text])
        release()

    return rows.select(*others).mapInArrow(run, rows.select(*others).schema.add(text, "string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``docs(doc_id, text)``.

    Encodes and decodes in one pass, with one Python worker for a task."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def run(batches):
        own = Encoder(path or default_path("piece_bpe_32k.model"))
        for b in batches:
            for start, texts in chunks(b.column(1)):
                flat, counts = own.encode(texts)
                back = pa.array(decode_ids(own.v, flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), listed(flat, counts), back], names=["doc_id", "ids", "text"])
        release()

    both = docs.mapInArrow(run, docs.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())).add("text", "string"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
