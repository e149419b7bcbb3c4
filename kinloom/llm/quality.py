"""Quality classification by co-training two views of a document.

One classifier reads the words of a text, the other its metadata: language,
source, length and layout. Both start from the same labelled rows; in each round
each of them scores all unlabelled documents on the executors and hands those it
is surest of to the other: the share above a quantile of all scores. Both then
go on learning by gradients that the executors sum over all rows handed so far.
At last each view is calibrated on labelled rows that neither has learned from, a
combination of the two is fitted there, and every document is scored.

Of the labelled rows ``LABELLED`` are used, drawn by hash of the id; other rows
with a label count as unlabelled. Ids whose crc32 modulo 3 is 1 are held out of
training. Everything else covers all rows and whole texts.

Defined results: a null or empty text has no words and is scored by the
intercepts and its metadata; null metadata are a value of their own; several
labels of one id count as the lowest; repeated rows are scored alike; if either
class has no labelled row, every score is the share of good labels, or 1
without labels; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import bound_batches, cut

LABELLED = 6000
ROUNDS = 3
#: Steps of learning after each exchange.
STEPS, RATE, DECAY = 10, 0.1, 1e-4
#: Share of the unlabelled documents that a view hands over in a round, and the least certainty.
HANDED, CERTAIN = 0.05, 0.9
WORD_BITS, LANGS, SOURCES = 14, 8, 64
_CLASSES = {"lines": b"\n", "digits": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
            "stops": b".,;:!?", "marks": b"|#$%&*<>{}[]()=+_/\\^~@\"", "other": bytes(range(128, 256))}
META = LANGS + SOURCES + 2 + len(_CLASSES)


def _name(value: str | None, n: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (n - 1)


def views(texts: pa.Array, langs: list, sources: list):
    """``(word numbers, weights, metadata)`` of each document."""
    i = 0
    for _, data, bounds in bytehash.slices(texts):
        h, at = bytehash.words(data, bounds)
        number = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        sums = {}
        for k, chars in _CLASSES.items():
            table = np.zeros(256, np.int64)
            table[list(chars)] = 1
            sums[k] = np.diff(np.r_[0, np.cumsum(table[data])][bounds])
        for j, (a, b) in enumerate(zip(at[:-1], at[1:])):
            ids, n = np.unique(number[a:b], return_counts=True)
            w = np.log1p(n)
            meta = np.zeros(META)
            meta[_name(langs[i], LANGS)] = 1
            meta[LANGS + _name(sources[i], SOURCES)] = 1
            size = int(bounds[j + 1] - bounds[j])
            meta[LANGS + SOURCES:] = [np.log1p(size), np.log1p(b - a), *(sums[k][j] / max(1, size) for k in _CLASSES)]
            yield ids, w / max(1e-9, float(np.sqrt((w * w).sum()))), meta
            i += 1


@dataclass
class Linear:
    """Logistic regression: weights, intercept, and its calibration."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, x: Rows) -> np.ndarray:
        return self.scale * (x.dot(self.weights) + self.bias) + self.shift


class Rows:
    """Sparse rows."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray], width: int):
        self.bounds = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0)
        self.of = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.values * w[self.ids], minlength=len(self.bounds) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.values * r[self.of], minlength=self.width)

    def take(self, keep: np.ndarray) -> Rows:
        part = lambda x: [x[self.bounds[i]:self.bounds[i + 1]] for i in keep]
        return Rows(part(self.ids), part(self.values), self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, y: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = DECAY) -> Linear:
    """Full-batch Adam on the mean log loss with a quadratic penalty."""
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        r = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / max(1, len(y))
        g = np.r_[x.back(r) + decay * w[:-1], r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Linear(w[:-1], float(w[-1]))


def calibrate(model: Linear, x: Rows, y: np.ndarray) -> None:
    z = x.dot(model.weights) + model.bias
    line = fit(dense(z[:, None]), y, steps=300, rate=0.1, decay=1e-3)
    model.scale, model.shift = float(line.weights[0]), line.bias


def dense(a: np.ndarray) -> Rows:
    return Rows([np.arange(a.shape[1])] * len(a), list(a), a.shape[1])


@dataclass
class Model:
    content: Linear | None
    metadata: Linear | None
    both: Linear | None
    mean: np.ndarray
    deviation: np.ndarray
    prior: float

    def meta_rows(self, meta: np.ndarray) -> Rows:
        return dense((meta - self.mean) / self.deviation)

    def scores(self, words: Rows, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.both is None:
            return (np.full(len(meta), self.prior),) * 3
        a, b = self.content.logit(words), self.metadata.logit(self.meta_rows(meta))
        return sigmoid(a), sigmoid(b), sigmoid(self.both.logit(dense(np.stack([a, b], axis=1))))


def packed(found: list, first: list[pa.Array]) -> list[pa.Array]:
    """Columns ``ids, weights, meta`` of views after other columns."""
    short = [np.r_[m[:LANGS].argmax(), m[LANGS:LANGS + SOURCES].argmax(), m[LANGS + SOURCES:]] for _, _, m in found]
    return [*first, pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()),
            pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), pa.array([m.tobytes() for m in short], pa.binary())]


def unpacked(t) -> tuple[Rows, np.ndarray]:
    """Words and metadata from the columns of :func:`packed`."""
    arrays = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t[c]]
    short = np.array(arrays("meta", "<f8")).reshape(-1, META - LANGS - SOURCES + 2)
    meta = np.zeros((len(short), META))
    at = np.arange(len(short))
    meta[at, short[:, 0].astype(int)] = 1
    meta[at, LANGS + short[:, 1].astype(int)] = 1
    meta[:, LANGS + SOURCES:] = short[:, 2:]
    return Rows([x.astype(np.int64) for x in arrays("ids", "<u2")], [x.astype(float) for x in arrays("weights", "<f4")], 1 << WORD_BITS), meta


_PACKED = "ids binary, weights binary, meta binary"


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the metadata of all rows."""

    def run(batches):
        total = np.zeros((3, META))
        for b in batches:
            for at in range(0, len(b), 512):
                meta = unpacked(b.slice(at, 512))[1]
                total += [np.full(META, len(meta)), meta.sum(axis=0), (meta * meta).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(META), 3)), pa.array(np.repeat(np.arange(3), META)), pa.array(total.ravel())], names=["i", "k", "v"])

    got = rows.select("ids", "weights", "meta").mapInArrow(run, "i bigint, k bigint, v double").groupBy("i", "k").agg(F.sum("v").alias("v")).toArrow()
    n, one, two = total = np.zeros((3, META))
    total[got["k"].to_numpy(), got["i"].to_numpy()] = got["v"].to_numpy()
    if not n[0]:
        return np.zeros(META), np.ones(META)
    mean = one / n
    return mean, np.maximum(np.sqrt(np.maximum(two / n - mean * mean, 0)), 1e-3)


def labels_of(x: tuple[Rows, Rows], n: int, history: list) -> np.ndarray:
    """What each view has been handed by the other: a row of labels for each view, -1 for none.

    ``history`` has, for each exchange, the views and the least logit for a label 0 and a label 1 of each.
    """
    label = np.full((2, n), -1)
    for views, least in history:
        free = label < 0
        for k in (0, 1):
            z = views[k].logit(x[k])
            label[1 - k][free[1 - k] & (-z >= least[k][0])] = 0
            label[1 - k][free[1 - k] & (z >= least[k][1])] = 1
    return label


def least_logits(pool: DataFrame, model: Model, views: list[Linear], history: list, good: float) -> list[list[float]]:
    """For each view, the least logits of the share of all documents that it is surest are bad or good and the other hasn't got."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                words, meta = unpacked(b.slice(at, 512))
                x = (words, model.meta_rows(meta))
                free = labels_of(x, len(meta), history) < 0
                z = [views[k].logit(x[k]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(free[1 - k], sign * z[k], -1e9)) for k in (0, 1) for sign in (-1, 1)], names=["z00", "z01", "z10", "z11"])

    scored = pool.select("ids", "weights", "meta").mapInArrow(run, "z00 double, z01 double, z10 double, z11 double")
    part = (1 - good, good)
    got = scored.agg(*(F.percentile_approx(f"z{k}{y}", 1 - HANDED * part[y], 20_000) for k in (0, 1) for y in (0, 1))).first()
    certain = float(np.log(CERTAIN / (1 - CERTAIN)))
    return [[max(certain, certain if got[2 * k + y] is None else got[2 * k + y]) for y in (0, 1)] for k in (0, 1)]


def handed_rows(pool: DataFrame, model: Model, history: list) -> DataFrame:
    """The documents that a view has been handed so far, with the labels ``l0`` and ``l1`` for each view."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                own = b.slice(at, 512)
                words, meta = unpacked(own)
                label = labels_of((words, model.meta_rows(meta)), len(meta), history)
                keep = pa.array((label >= 0).any(axis=0))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*own.columns, *map(pa.array, label))], names=["ids", "weights", "meta", "l0", "l1"])

    return pool.select("ids", "weights", "meta").mapInArrow(run, f"{_PACKED}, l0 bigint, l1 bigint")


def learn_more(views: list[Linear], x: tuple[Rows, Rows], y: np.ndarray, handed: DataFrame, model: Model) -> list[Linear]:
    """Goes on with both views by Adam on the labelled rows, which are here, and all handed rows, which aren't."""
    sizes = handed.agg(F.count("*"), *(F.count(F.when(F.col(f"l{k}") >= 0, 1)) for k in (0, 1))).first()
    if not sizes[0]:
        return views
    few = handed.coalesce(1 + sizes[0] // 2000)
    w = [np.r_[v.weights, v.bias] for v in views]
    m, v = [[np.zeros_like(a) for a in w] for _ in (0, 1)]
    for t in range(1, STEPS + 1):
        now = [a.copy() for a in w]

        def run(batches, now=now):
            total = [np.zeros_like(a) for a in now]
            for b in batches:
                words, meta = unpacked(b)
                both = (words, model.meta_rows(meta))
                for k in (0, 1):
                    label = b.column(3 + k).to_numpy()
                    r = np.where(label >= 0, sigmoid(both[k].dot(now[k][:-1]) + now[k][-1]) - label, 0)
                    total[k] += np.r_[both[k].back(r), r.sum()]
            for k in (0, 1):
                i = np.flatnonzero(total[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(total[k][i])], names=["k", "i", "g"])

        got = few.mapInArrow(run, "k bigint, i bigint, g double").groupBy("k", "i").agg(F.sum("g").alias("g")).toArrow()  # as many rows as weights
        of, at, value = (got[c].to_numpy() for c in ("k", "i", "g"))
        for k in (0, 1):
            r = sigmoid(x[k].dot(w[k][:-1]) + w[k][-1]) - y
            g = np.r_[x[k].back(r), r.sum()]
            g[at[of == k]] += value[of == k]
            g /= len(y) + sizes[1 + k]
            g[:-1] += DECAY * w[k][:-1]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] -= RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
    return [Linear(a[:-1], float(a[-1])) for a in w]


def cotrain(words: Rows, meta: np.ndarray, y: np.ndarray, calibration: np.ndarray, rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """``y``: labels of the rows at hand, of which ``calibration`` are those to calibrate on; ``rows``: all of training, unlabelled where ``y`` is null."""
    model = Model(None, None, None, np.zeros(META), np.ones(META), float(y.mean()) if len(y) else 1.0)
    learn, held = np.flatnonzero(~calibration), np.flatnonzero(calibration)
    if any(len(set(y[k])) < 2 for k in (learn, held)):
        return model
    model.mean, model.deviation = moments(rows)
    x = (words, model.meta_rows(meta))
    own = tuple(x[k].take(learn) for k in (0, 1))
    pool = rows.where("y IS NULL")
    views = [fit(own[k], y[learn]) for k in (0, 1)]
    history: list = []
    for _ in range(rounds):
        history = [*history, (views, least_logits(pool, model, views, history, model.prior))]
        views = learn_more(views, own, y[learn], cut(handed_rows(pool, model, history)), model)
    for k in (0, 1):
        calibrate(views[k], x[k].take(held), y[held])
    model.content, model.metadata = views
    pair = np.stack([views[k].logit(x[k].take(held)) for k in (0, 1)], axis=1)
    model.both = fit(dense(pair), y[held], steps=300, rate=0.1, decay=1e-3)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Co-trains on all of ``docs(doc_id, text, lang, source)`` and a bounded sample of ``labels(doc_id, quality)``."""
    bound_batches(docs.sparkSession)
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    good = labels.where(usable & F.col("quality").isNotNull())
    n = max(1, good.count())
    some = good.where(place * n < labelled).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    lean = docs.select("doc_id", "text", "lang", "source").where(usable)
    marked = lean.join(F.broadcast(some), "doc_id", "left")  # about `labelled` rows

    def run(batches):
        for b in batches:
            found = list(views(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays(packed(found, [b.column(0), b.column(4)]), names=["doc_id", "y", "ids", "weights", "meta"])

    rows = cut(marked.select("doc_id", "text", "lang", "source", "y").mapInArrow(run, f"doc_id bigint, y int, {_PACKED}"))
    t = rows.where("y IS NOT NULL").orderBy("doc_id", "y").toArrow()
    words, meta = unpacked(t)
    y = np.array([int(v > 0) for v in t["y"].to_pylist()], np.int64)
    calibration = np.array([zlib.crc32(f"calibrate {i}".encode()) % 4 == 0 for i in t["doc_id"].to_pylist()], bool)
    return cotrain(words, meta, y, calibration, rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, content_score, metadata_score, score, keep`` of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kilobytes, whatever the corpus

    def run(batches):
        own = shared.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                found = list(views(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()))
                words = Rows([f[0] for f in found], [f[1] for f in found], 1 << WORD_BITS)
                for column, v in zip(out, own.scores(words, np.array([f[2] for f in found]))):
                    column.append(v)
            a, c, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(a), pa.array(c), pa.array(s), pa.array(s >= 0.5)],
                names=["doc_id", "held_out", "content_score", "metadata_score", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", "lang", "source").mapInArrow(
        run, "doc_id bigint, held_out boolean, content_score double, metadata_score double, score double, keep boolean")
