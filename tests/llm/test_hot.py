"""Passages that many chunks hold."""

import random

import pytest
from llm_helpers import brute_repeats

from kinloom.llm import repeats


@pytest.mark.parametrize("hot", [0, 2, 5, 1000])
def test_passages_of_many_chunks(spark, monkeypatch, hot):
    """Hot and other strings beside each other, whatever the number of chunks from which on they are hot."""
    for name, size in (("CHUNK_BYTES", 2000), ("ANCHOR_BUCKET_BYTES", 4000), ("PART_BUCKET_BYTES", 3000), ("HOT_CHUNKS", hot)):
        monkeypatch.setattr(repeats, name, size)
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    everywhere, often, seldom = words(40), words(30), words(30)
    texts = []
    for i in range(60):
        own = [words(rng.randint(1, 20)), everywhere]
        if i % 4 == 0:
            own.append(often)
        if i % 20 == 3:
            own += [seldom, everywhere[60:150]]
        rng.shuffle(own)
        texts.append(rng.choice((" ", "")).join(own))
    texts += ["", "x" * 49, texts[5], everywhere + often + seldom]
    docs = spark.createDataFrame([(7 * i % 641, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute_repeats([(7 * i % 641, t) for i, t in enumerate(texts)], 50)
    assert {r.doc_id: tuple(r)[1:] for r in repeats.removals(docs).collect()} == want
