"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.
The letter runs of a text are scored by the forward algorithm: the probability
of a run is the sum over all ways to cut it into pieces, whatever its length. Runs of up to
``RUN_LETTERS`` letters are summed in batches of equally long ones and remembered; the forward pass of a longer
one keeps only as many sums as the longest piece has letters. Piece probabilities
are learned by expectation maximisation over the same sums, from a bounded
sample of labelled documents (``SAMPLE`` for each language, by hash of the id).

Letters are Unicode's (categories L), with the marks that follow them; number signs such as ``½`` are none.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the first language by name; repeated rows are scored alike; without
any labelled document every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, release

#: Training documents for each language, about.
SAMPLE = 2500
ROUNDS = 2
SMOOTH = 0.1
#: Letters of the runs that are summed in batches; letters of the longest piece of the usual vocabulary.
RUN_LETTERS, PIECE_LETTERS = 24, 16
#: Letters of any script, and the marks that go with them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words whose scores a task remembers.
CACHE = 150_000
_LEAST = 1e-9
_START = "\u2581"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[dict[str, int], list[int], int]:
    """Pieces with their ids, the ids of the 256 byte pieces, the number of ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n


@functools.lru_cache(maxsize=1)
def longest(path: str) -> int:
    """Letters of the longest piece."""
    return max(map(len, vocabulary(path)[0]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lattice:
    """All segmentations of equally long words: for each cut (i, j) the piece ids, -1 for none."""

    def __init__(self, same: list[str], pieces: dict[str, int], byte_ids: list[int], extra: dict[str, int], first: int, reach: int = PIECE_LETTERS):
        self.n, self.reach = len(same[0]), reach
        self.edges: dict[tuple[int, int], np.ndarray] = {}
        get = pieces.get
        for i in range(self.n):
            for j in range(i + 1, min(self.n, i + reach) + 1):
                ids = [get(w[i:j], -1) for w in same]
                if j == i + 1 and -1 in ids:
                    ids = [extra.setdefault(w[i], first + len(extra)) if x < 0 else x for w, x in zip(same, ids)]
                a = np.array(ids, dtype=np.int64)
                if (a >= 0).any():
                    self.edges[i, j] = a

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """p: rows of piece probabilities, the last all 0."""
        at = [np.ones((len(next(iter(self.edges.values()))), p.shape[1]))]
        for j in range(1, self.n + 1):
            at.append(sum(at[i] * p[self.edges[i, j]] for i in range(max(0, j - self.reach), j) if (i, j) in self.edges))
        return at

    def backward(self, p: np.ndarray) -> list[np.ndarray]:
        at = [np.ones((1, 1))] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            at[i] = sum(at[j] * p[self.edges[i, j]] for j in range(i + 1, min(self.n, i + self.reach) + 1) if (i, j) in self.edges)
        return at


def lattices(found: list[str], path: str):
    """Batches ``(places, lattice, extra)``; extra: letters without a piece and their ids."""
    pieces, byte_ids, n = vocabulary(path)
    by: dict[int, list[int]] = {}
    for k, w in enumerate(found):
        by.setdefault(len(w), []).append(k)
    for places in by.values():
        for at in range(0, len(places), 4096):
            part = places[at:at + 4096]
            extra: dict[str, int] = {}
            yield part, Lattice([_START + found[k] for k in part], pieces, byte_ids, extra, n, longest(path)), extra


def padded(p: np.ndarray, extra: dict[str, int], byte_ids: list[int]) -> np.ndarray:
    """Rows for letters that are spelled in byte pieces, then one of zeros for index -1."""
    return np.vstack([p, *(spelled(c, p, byte_ids) for c in extra), np.zeros((1, p.shape[1]))])


def spelled(letter: str, p: np.ndarray, byte_ids: list[int]) -> np.ndarray:
    """Probabilities of a letter without a piece: those of its bytes."""
    return np.maximum(np.prod(p[[byte_ids[b] for b in letter.encode()]], axis=0), _LEAST)


def steps_of(run: str, p: np.ndarray, path: str):
    """For each end in the run, the pieces ``(start, id or -1, probabilities)`` that end there."""
    pieces, byte_ids, _ = vocabulary(path)
    reach = longest(path)
    for j in range(1, len(run) + 1):
        out = [(i, k, p[k]) for i in range(max(0, j - reach), j) if (k := pieces.get(run[i:j], -1)) >= 0]
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, -1, spelled(run[j - 1], p, byte_ids)))
        yield j, out


def long_score(run: str, p: np.ndarray, path: str) -> np.ndarray:
    """Log probability of a run of any length in each language, by as many sums as the longest piece has letters."""
    run, reach = _START + run, longest(path)
    at = np.zeros((reach + 1, p.shape[1]))  # a ring: the sum up to place j is in row j modulo its size
    at[0] = 1.0
    logs = np.zeros(p.shape[1])
    for j, pieces in steps_of(run, p, path):
        total = sum(at[i % (reach + 1)] * q for i, _, q in pieces)
        at[j % (reach + 1)] = total
        if total.min() < 1e-100:  # all sums of a language go up together
            up = 1 / np.maximum(total, 1e-290)
            at *= up
            logs -= np.log(up)
    return logs + np.log(np.maximum(at[len(run) % (reach + 1)], 1e-300))


def long_counts(run: str, weight: float, p: np.ndarray, path: str, total: np.ndarray) -> None:
    """Adds the pieces expected over all segmentations of a run of any length, for one language."""
    run, (_, byte_ids, _) = _START + run, vocabulary(path)
    n = len(run)
    edges = [(i, j, k, math.log(max(float(q[0]), 1e-300))) for j, pieces in steps_of(run, p, path) for i, k, q in pieces]

    def add(x: float, y: float) -> float:
        high, low = (x, y) if x > y else (y, x)
        return high + math.log1p(math.exp(low - high)) if low > -math.inf else high

    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, _, q in edges:
        ahead[j] = add(ahead[j], ahead[i] + q)
    for i, j, _, q in reversed(edges):
        behind[i] = add(behind[i], behind[j] + q)
    for i, j, k, q in edges:
        share = weight * math.exp(min(0.0, ahead[i] + q + behind[j] - ahead[n]))
        for at in (k,) if k >= 0 else (byte_ids[b] for b in run[i].encode()):
            total[at] += share


def word_scores(found: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language."""
    _, byte_ids, _ = vocabulary(path)
    out = np.zeros((len(found), p.shape[1]))
    short = [k for k, w in enumerate(found) if len(w) <= RUN_LETTERS]
    for places, lattice, extra in lattices([found[k] for k in short], path):
        out[[short[k] for k in places]] = np.log(np.maximum(lattice.forward(padded(p, extra, byte_ids))[-1], 1e-300))
    for k, w in enumerate(found):
        if len(w) > RUN_LETTERS:
            out[k] = long_score(w, p, path)
    return out


def expected_counts(found: list[str], weights: np.ndarray, p: np.ndarray, path: str) -> np.ndarray:
    """Pieces expected over all segmentations of the words, each counted ``weights`` times."""
    _, byte_ids, n = vocabulary(path)
    total = np.zeros(n)
    short = [k for k, w in enumerate(found) if len(w) <= RUN_LETTERS]
    for places, lattice, extra in lattices([found[k] for k in short], path):
        q = padded(p, extra, byte_ids)
        ahead, behind = lattice.forward(q), lattice.backward(q)
        share = weights[[short[k] for k in places]] / np.maximum(ahead[-1][:, 0], 1e-300)
        sums = np.zeros(len(q))
        for (i, j), ids in lattice.edges.items():
            np.add.at(sums, ids, share * ahead[i][:, 0] * q[ids, 0] * behind[j][:, 0])
        total += sums[:n]
        for c, k in extra.items():
            for b in c.encode():
                total[byte_ids[b]] += sums[k]
    for w, weight in zip(found, weights):
        if len(w) > RUN_LETTERS:
            long_counts(w, float(weight), p, path, total)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_words(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``lang, word, n`` of about ``sample`` labelled documents for each language."""
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    size = docs.where(usable).groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # One row for each language: the model itself has a column for each.
    drawn = docs.where(usable).join(F.broadcast(size), F.col("lang") == F.col("_lang")).where(place * F.col("_n") < sample).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for w in words(text.as_py()):
                    by[lang, w] = by.get((lang, w), 0) + 1
            keys = list(by)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(by.values()), pa.int64())],
                names=["lang", "word", "n"])

    return drawn.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, one column each."""
    table = cut(training_words(docs, sample))
    langs = sorted(r[0] for r in table.select("lang").distinct().collect())
    where = path or default_path()
    size = vocabulary(where)[2]
    p = np.full((size, max(1, len(langs))), 1.0 / size)
    for _ in range(rounds if langs else 0):
        known = p

        def count(batches):
            local = path or default_path()
            total = {}
            for b in batches:
                name = np.array(b.column(0).to_pylist(), dtype=object)
                found, n = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy().astype(float)
                for lang in set(name):
                    mine, k = name == lang, langs.index(lang)
                    got = expected_counts(list(found[mine]), n[mine], known[:, k:k + 1], local)
                    total[k] = total.get(k, 0) + got
            for k, t in total.items():
                ids = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), k, np.int32)), pa.array(ids.astype(np.int32)), pa.array(t[ids])], names=["k", "piece", "n"])

        sums = table.mapInArrow(count, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros_like(p)
        got = sums.toArrow()  # a bounded table: languages times pieces
        np.add.at(counts, (got["piece"].to_numpy(), got["k"].to_numpy()), got["n"].to_numpy())
        counts += SMOOTH
        p = counts / counts.sum(axis=0)
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, path: str | None = None,
            added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds a language and its score to the columns of ``docs``; reads only ``text``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(p)  # languages times pieces
    names = [*docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    text_at = names.index("text")

    def run(batches):
        local, q = path or default_path(), shared.value
        known: dict[str, int] = {}
        scores = np.zeros((1024, q.shape[1]))
        for b in batches:
            pred, sure, texts = [], [], b.column(text_at)
            for at in range(0, len(texts), 256):
                split = [words(t or "") for t in texts.slice(at, 256).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for ws in split for w in ws if len(w) <= RUN_LETTERS and w not in known})
                if new:
                    first = len(known)
                    known.update(zip(new, range(first, first + len(new))))
                    if len(known) > len(scores):
                        scores = np.vstack([scores[:first], np.zeros((2 * len(known) - first, q.shape[1]))])
                    scores[first:first + len(new)] = word_scores(new, q, local)
                for ws in split:
                    if not ws or not langs:
                        pred.append("und")
                        sure.append(0.0)
                        continue
                    short = [w for w in ws if len(w) <= RUN_LETTERS]
                    total = scores[np.fromiter(map(known.__getitem__, short), np.int64, len(short))].sum(axis=0)
                    if len(short) < len(ws):
                        total = total + sum(long_score(w, q, local) for w in ws if len(w) > RUN_LETTERS)
                    k = int(total.argmax())
                    pred.append(langs[k])
                    sure.append(1.0 / float(np.exp(np.maximum(total - total[k], -700.0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names, *added])
        known.clear()
        scores = None
        release()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """Learns from the labelled part of ``docs(doc_id, text, lang)`` and predicts every row."""
    langs, p = train(docs.select("doc_id", "text", "lang"), sample, rounds, path)
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, langs, p, path).drop("text")


def accepted(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text has a language; their columns unchanged."""
    langs, p = train(docs.select("doc_id", "text", "lang"), **how)
    found = predict(docs, langs, p, added=("__lang_pred", "__score"))
    return found.where("__lang_pred <> 'und'").select(*docs.columns)
