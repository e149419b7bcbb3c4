"""Small tables with the odd cases that every operator meets."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block bigint, part string, chunk int, g string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and wordless texts, repeated rows, a long text, columns with clashing names."""
    long = " ".join(f"w{i * i % 977} x{i % 13}" for i in range(20_000))
    texts = [
        (0, "the cat sat on the mat and then the cat ran off to see the very big dog in the yard"),
        (1, "the cat sat on the mat and then the cat ran off to see the very big dog in the yard"),
        (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "One"), (7, "éa ñandú \U0001f600 straße"), (8, long), (9, long + " end"),
        (10, "12 34 !!"), (10, "12 34 !!"), (None, "no id at all here"), (12, " nbsp wide")]
    return spark.createDataFrame(
        [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), 0.5, k, "p", k, "g") for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def some_texts(seed, n=60, sources=("a", "b")):
    """Random documents, with near copies, shared passages and exact copies."""
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)
        elif out and kind < 0.4:
            own = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
            if rng.random() < 0.3:
                text = text[:len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2:]
        out.append(text)
    return out


@pytest.fixture(scope="session")
def random_docs(spark):
    texts = some_texts(7)
    return spark.createDataFrame([(3 * i, t, "en", f"s{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
