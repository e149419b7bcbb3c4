"""Models that score segments: a small neural network and gradient-boosted trees.

Files are parsed on the driver. A few small trees are walked in the JVM, over arrays
of their nodes; many trees and networks score Arrow batches, which is faster for
them. The results are the same.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the weights file: its mark and version.
MAGIC, VERSION = 0x4E4E5754, 1
LEAK = 0.01
#: Trees times their depth up to which rows are scored in the JVM; more steps are faster over Arrow batches.
JVM_STEPS = 64


@dataclass
class Network:
    """Layers of weights ``[out][in]`` and biases."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @staticmethod
    def parse(raw: bytes) -> Network:
        magic, version, n = struct.unpack_from("<3I", raw)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("no weights of a known version")
        at, weights, biases = 12, [], []
        for _ in range(n):
            fan_in, fan_out = struct.unpack_from("<2I", raw, at)
            at += 8
            for into, shape in ((weights, (fan_out, fan_in)), (biases, (fan_out,))):
                size = int(np.prod(shape))
                if at + 4 * size > len(raw):
                    raise ValueError("the weights end early")
                into.append(np.frombuffer(raw, "<f4", size, at).reshape(shape))
                at += 4 * size
        return Network(weights, biases)

    def pack(self) -> bytes:
        out = [struct.pack("<3I", MAGIC, VERSION, len(self.weights))]
        for w, b in zip(self.weights, self.biases):
            out += [struct.pack("<2I", w.shape[1], w.shape[0]), np.asarray(w, "<f4").tobytes(), np.asarray(b, "<f4").tobytes()]
        return b"".join(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Leaky rectifiers between the layers, a logistic function after the last."""
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w.T.astype(np.float64) + b
            if k + 1 < len(self.weights):
                x = np.where(x > 0, x, LEAK * x)
        return 1 / (1 + np.exp(-x[:, 0]))


# Number markers of UBJSON and their big-endian layouts.
_NUMBERS = {"i": ">i1", "U": ">u1", "I": ">i2", "l": ">i4", "L": ">i8", "d": ">f4", "D": ">f8"}
_CONSTANTS = {"Z": None, "T": True, "F": False}


def ubjson(raw: bytes):
    """The value of a UBJSON text; arrays of one number type become NumPy arrays."""
    at = 0

    def mark() -> str:
        nonlocal at
        at += 1
        while raw[at - 1:at] == b"N":  # no operation
            at += 1
        return raw[at - 1:at].decode("latin-1")

    def number(kind: str):
        return numbers(kind, 1)[0].item()

    def numbers(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, _NUMBERS[kind], n, at)
        at += out.nbytes
        return out

    def string() -> str:
        nonlocal at
        n = number(mark())
        at += n
        return raw[at - n:at].decode()

    def container() -> tuple[str | None, int | None]:
        """The type and the count that a container may give for all it holds."""
        nonlocal at
        kind = count = None
        if raw[at:at + 1] == b"$":
            at += 1
            kind = mark()
        if raw[at:at + 1] == b"#":
            at += 1
            count = number(mark())
        return kind, count

    def items(end: bytes, count: int | None):
        nonlocal at
        n = 0
        while n < count if count is not None else raw[at:at + 1] != end:
            if count is None and at >= len(raw):
                raise ValueError("the model ends early")
            yield n
            n += 1
        at += count is None

    def value(kind: str):
        if kind in _NUMBERS:
            return number(kind)
        if kind in _CONSTANTS:
            return _CONSTANTS[kind]
        if kind in "SH":
            return string()
        if kind == "C":
            return chr(number("U"))
        if kind == "[":
            of, count = container()
            if of in _NUMBERS and count is not None:
                return numbers(of, count)
            return [value(of or mark()) for _ in items(b"]", count)]
        if kind == "{":
            of, count = container()
            return {string(): value(of or mark()) for _ in items(b"}", count)}
        raise ValueError(f"no UBJSON: {kind!r}")

    return value(mark())


@dataclass
class Trees:
    """Boosted trees with one array of nodes for each."""

    trees: list[dict[str, np.ndarray]]
    margin: float

    @staticmethod
    def parse(text: str | bytes) -> Trees:
        """A model file, as JSON or as UBJSON (an object whose first key has a length before it)."""
        raw = text.encode() if isinstance(text, str) else bytes(text)
        learner = (json.loads(raw) if raw[1:].lstrip()[:1] in (b'"', b"}") else ubjson(raw))["learner"]
        base = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
        base = min(max(base, 1e-15), 1 - 1e-15)
        trees = [
            {k: np.asarray(t[k], kind) for k, kind in (
                ("left_children", np.int64), ("right_children", np.int64), ("split_indices", np.int64), ("split_conditions", np.float32), ("default_left", bool))}
            for t in learner["gradient_booster"]["model"]["trees"]]
        return Trees(trees, float(np.log(base / (1 - base))))

    @property
    def depth(self) -> int:
        """Steps to the deepest leaf."""
        most = 0
        for t in self.trees:
            level, steps = np.zeros(1, np.int64), 0
            while len(level := level[t["left_children"][level] >= 0]):
                level, steps = np.r_[t["left_children"][level], t["right_children"][level]], steps + 1
            most = max(most, steps)
        return most

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; a missing value takes a node's default side."""
        x = x.astype(np.float32)
        total = np.full(len(x), self.margin)
        row = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := t["left_children"][node] >= 0).any():
                v = x[row, t["split_indices"][node]]
                left = np.where(np.isnan(v), t["default_left"][node], v < t["split_conditions"][node])
                node = np.where(inner, np.where(left, t["left_children"][node], t["right_children"][node]), node)
            total += t["split_conditions"][node]
        return 1 / (1 + np.exp(-total))


def _content(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path).select("content").head(2)
    if len(found) != 1:
        raise ValueError(f"not one file: {path}")
    return bytes(found[0][0])


def load_network(spark: SparkSession, path: str) -> Network:
    return Network.parse(_content(spark, path))


def load_trees(spark: SparkSession, path: str) -> Trees:
    return Trees.parse(_content(spark, path))


def scored(features: DataFrame, names: list[str], model: Network | Trees, out: str = "score") -> DataFrame:
    """Adds the model's P(false positive) of the features ``names``; a null is a missing value."""
    if isinstance(model, Trees) and len(model.trees) * model.depth <= JVM_STEPS:
        x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("float"), F.lit(float("nan")).cast("float")) for n in names])
        # a column of its own: inside the walk the array would be made for each node
        return features.withColumn("_x", x).withColumn(out, tree_columns(F.col("_x"), model)).drop("_x")
    shared = features.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.predict(x.to_numpy(np.float64, na_value=np.nan)))

    return features.withColumn(out, score(F.struct(*(F.col(f"`{n}`") for n in names))))


def tree_columns(x: Column, model: Trees) -> Column:
    """The trees' score of an array of floats (NaN for a missing value): walks over arrays of all nodes.

    Every walk takes as many steps as the deepest leaf is away; a leaf is its own child, so walks that are there stay there.
    """
    if not model.trees:
        return F.lit(1 / (1 + math.exp(-model.margin)))
    sizes = [len(t["left_children"]) for t in model.trees]
    roots = np.cumsum([0, *sizes[:-1]])
    joined = lambda column: np.concatenate([column(t) for t in model.trees])
    inner = joined(lambda t: t["left_children"] >= 0)
    child = lambda side: np.where(inner, joined(lambda t: t[side]) + np.repeat(roots, sizes), np.arange(len(inner)))
    left, right = child("left_children"), child("right_children")
    left_of, right_of = _literal(left, "int"), _literal(right, "int")
    index, default = _literal(np.where(inner, joined(lambda t: t["split_indices"]), 0), "int"), _literal(joined(lambda t: t["default_left"]).astype(int), "int")
    condition = _literal(joined(lambda t: t["split_conditions"]).astype(np.float64), "float")

    def step(node: Column, _: Column) -> Column:
        v = x[index[node]]
        goes_left = F.when(F.isnan(v), default[node] == 1).otherwise(v < condition[node])
        return F.when(goes_left, left_of[node]).otherwise(right_of[node])

    leaf = lambda root: condition[F.aggregate(_literal(np.arange(max(model.depth, 1)), "int"), root, step)].cast("double")
    return 1 / (1 + F.exp(-F.aggregate(_literal(roots, "int"), F.lit(float(model.margin)), lambda a, root: a + leaf(root))))


def _literal(values: np.ndarray, kind: str) -> Column:
    """An array that the optimizer folds to one literal, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")


def both_predictions(features: DataFrame, scaled: DataFrame, key: list[str], names: list[str], boosted: Trees, network: Network) -> DataFrame:
    """``features`` with ``xgb_pred`` (on the features) and ``nn_pred`` (on the scaled ones): 1 for a false segment."""
    nn = scored(scaled, names, network, "_nn").select(*key, (F.col("_nn") > 0.5).cast("int").alias("nn_pred"))
    own = scored(features, names, boosted, "_xgb").withColumn("xgb_pred", (F.col("_xgb") > 0.5).cast("int")).drop("_xgb")
    return own.join(nn, key)


def kept(scores: DataFrame, score: str = "score", below: float = 0.5) -> DataFrame:
    return scores.where(F.col(score) < below)
