"""Ids and texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest

from kinloom.llm import pieces

PATH = pieces.default_path("piece_bpe_32k.model")
CHARS = "abcdeeeiostnr     \n\t▁.,<>/\\'\"0123456789éßñ漢字的한글अनु😀\0　�ABCDE"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(library, n=1500):
    rng = random.Random(5)
    known = [library.id_to_piece(i) for i in range(300, 32000)]
    any_char = lambda: chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)]))
    out = ["", " ", "  a", "a  b ", "▁a", "a" * 5000, " " * 3001, "ab" * 2000, "▁" * 77, "=-" * 3000 + "=" * 999, "<s></s><unk><0x41>", "\0", "﻿"]
    for _ in range(n):
        kind, k = rng.random(), rng.randint(0, 40)
        out.append("".join(
            rng.choice(CHARS) if kind < 0.5 else rng.choice(known) if kind < 0.8 else rng.choice("ab") if kind < 0.9 else any_char() for _ in range(k)))
    return out


def split(flat, counts):
    at = np.r_[0, np.cumsum(counts)]
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_same_ids_and_texts_as_the_library(library):
    texts = odd_texts(library)
    own, got = pieces.Encoder(PATH), []
    for a in range(0, len(texts), 400):
        got += split(*own.encode(texts[a:a + 400]))
    want = library.encode(texts)
    assert got == want
    flat, counts = np.array(sum(want, []), np.int64), np.array([len(w) for w in want])
    assert pieces.decode_ids(own.v, flat, counts) == [library.decode(w) for w in want]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    own = pieces.Encoder(PATH)
    for t in ("one two three four", "two three", "five one", None, ""):
        assert split(*own.encode([t])) == [library.encode(t or "")]


def test_any_ids_decode_like_the_library(library):
    rng = random.Random(6)
    ids = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 28705, 259, 264]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    ids += [[], [1], [1, 2], [28705], [1, 28705, 28705], [3 + 0xEF, 3 + 0xBF, 3 + 0xBD], [3 + 0xED, 3 + 0xA0, 3 + 0x80]]
    got = pieces.decode_ids(pieces.vocabulary(PATH), np.array(sum(ids, []), np.int64), np.array([len(x) for x in ids]))
    assert got == [library.decode(x) for x in ids]
    with pytest.raises(ValueError):
        pieces.decode_ids(pieces.vocabulary(PATH), np.array([32000]), np.array([1]))


class Toy(pieces.Vocabulary):
    """Merges alone, in the order of the list."""

    def __init__(self, merges):
        self.size = len(merges)
        texts = {t: i for i, t in enumerate(merges)}
        self._symbols(texts)
        self._merges(texts, {i: -float(i) for i in texts.values()})


def one_by_one(text, merges):
    """Best rank first, then from the left."""
    s = list(text)
    while True:
        able = [(merges.index(a + b), i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in merges]
        if not able:
            return s
        _, i = min(able)
        s[i:i + 2] = [s[i] + s[i + 1]]


def test_rounds_equal_single_merges():
    """Small alphabets and random ranks, where a merge often makes a pair of a better rank."""
    rng = random.Random(7)
    for _ in range(300):
        merges = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 14))))
        v = Toy(merges)
        words = ["".join(rng.choice("abc") if rng.random() < 0.1 else rng.choice("ab") for _ in range(rng.randint(1, 25))) for _ in range(8)]
        number = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, place = pieces.merge_rounds(v, np.concatenate([v.of_char[[ord(c) for c in w]] for w in words]), number)
        want = [one_by_one(w, merges) for w in words]
        lengths = np.diff(np.r_[place, sum(map(len, words))])
        assert lengths.tolist() == [len(p) for w in want for p in w]


def test_tables(spark, odd_docs, no_docs, library):
    rows = pieces.round_trip(odd_docs).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(no_docs).collect() == []


def test_other_columns_stay(spark, odd_docs):
    clash = odd_docs.withColumn("ids", odd_docs["n_chars"])
    out = pieces.encode(clash)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "score", "block", "part", "chunk", "g", "ids"]
    assert pieces.decode(out, text="g").where("doc_id = 5").first().g == "one"
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.text for r in pieces.decode(nulls).orderBy("k").collect()] == ["", ""]


def test_other_models_raise(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(tmp_path / "m"))


def test_operators_give_what_the_pass_over_both_gives(spark, odd_docs):
    import hashlib as h

    both = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(odd_docs).collect()}
    rows = pieces.decode(pieces.encode(odd_docs)).collect()
    assert both == {(r.doc_id, len(r.ids), h.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), h.sha256(r.text.encode()).hexdigest()) for r in rows}
