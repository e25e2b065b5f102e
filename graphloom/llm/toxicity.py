"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the sets of words, neighbouring pairs and pairs with one word between, hashed into 2^BITS
coordinates. Learning reads a bounded sample of the labelled rows (SAMPLE of them, about, with SAMPLE_FEATURES
features in all; the smallest hashes of their ids) in one task, in the order of those hashes. L1 leaves a few hundred coordinates of 2^BITS, whose
weights are fitted again without it and broadcast; every document is then scored, whole, where it lies.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import fresh, slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Coordinates are 2^BITS; weights take 4 bytes each at most.
BITS = 20
#: Labelled rows that learning reads, about (the sample is drawn by hash), and the features of all of them (4 bytes
#: each): learning holds them in memory.
SAMPLE, SAMPLE_FEATURES = 16384, 32_000_000
#: Passes over the sample: with L1, and then over the coordinates that it chose.
EPOCHS, REFITS = 6, 20
ALPHA, BETA, L2 = 1.0, 1.0, 0.01
#: L1 for a sample of n rows is L1_ROOT * sqrt(n), as the noise in a sum of n gradients grows.
L1_ROOT = 0.28
THRESHOLD = 0.7

_BREAKS = bytes(32 if chr(i) in ".,;:!?\"'()[]{}<>|*#_-/\\" else i for i in range(256))


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct coordinates of a text; none for a null or a text without words."""
    words = (text or b"").lower().translate(_BREAKS).split()
    if not words:
        return np.empty(0, np.int32)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    kinds = [h]
    for gap, factor in ((1, 0x94D049BB133111EB), (2, 0xD6E8FEB86659FD93)):
        if len(h) > gap:
            kinds.append(h[:-gap] * np.uint64(factor) + h[gap:])
    mixed = np.concatenate(kinds) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


class Ftrl:
    """FTRL-proximal for a logistic loss over sets of coordinates, with an unpenalised intercept."""

    def __init__(self, l1: float, size: int = 1 << BITS):
        self.l1, self.z, self.n, self.bias = l1, np.zeros(size), np.zeros(size), np.zeros(2)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def intercept(self) -> float:
        return float(-self.bias[0] * ALPHA / (BETA + self.bias[1] ** 0.5))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.intercept()
        g = float(sigmoid(w.sum() + b)) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias += g - ((self.bias[1] + g * g) ** 0.5 - self.bias[1] ** 0.5) / ALPHA * b, g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _featured(batches):
    for b in slices(batches):
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        sets = [features(t) for t in texts]
        lists, ties = pa.array(sets, pa.list_(pa.int32())), pa.array([zlib.crc32(x.tobytes()) for x in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("at"), b.column("label"), ties, lists], ["at", "label", "tie", "found"])


def _learned(l1: float):
    def run(batches):
        rows = []
        for b in batches:
            labels = b.column("label").to_pylist()
            rows += [(y, x.values.to_numpy()) for y, x in zip(labels, b.column("found"), strict=True)]
        model = Ftrl(l1)
        for _ in range(EPOCHS):
            for label, found in rows:
                model.learn(found, label)
        at = np.flatnonzero(model.weights(slice(None)))
        # L1 chooses the coordinates, and shrinks what it keeps: those are fitted again without it
        place = np.full(1 << BITS, -1, np.int32)
        place[at] = np.arange(len(at))
        rows = [(label, (x := place[found])[x >= 0]) for label, found in rows]
        model = Ftrl(0.0, len(at))
        for _ in range(REFITS):
            for label, found in rows:
                model.learn(found, label)
        w = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w, np.float32(model.intercept())), pa.float32())], ["at", "weight"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, intercept) from rows (doc_id, text, label 0/1); rows with null labels are left out.

    Without any rows, no weights and an intercept of 0.
    """
    rows = labelled.filter("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    n = rows.count()
    rate = min(1.0, sample / n) if n else 1.0
    at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11)
    drawn = rows.withColumn("at", at).filter(F.col("at") < F.lit(int(rate * (1 << 53)))).select("at", "label", "text")
    lists = written(drawn.mapInArrow(_featured, "at long, label int, tie long, found array<int>"), "sample")
    total = 0
    for r in lists.select("at", F.size("found").alias("n")).orderBy("at").collect():  # SAMPLE rows, about
        total += r["n"]
        if total > SAMPLE_FEATURES:
            lists = lists.filter(F.col("at") < r["at"])
            break
    lists = lists.repartition(1).sortWithinPartitions("at", "label", "tie")
    got = lists.mapInArrow(_learned(L1_ROOT * min(n, sample) ** 0.5), "at int, weight float").toPandas()
    bias = got.loc[got["at"] < 0, "weight"]
    got = got[got["at"] >= 0]
    return got["at"].to_numpy(), got["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", to: str = "score") -> DataFrame:
    """docs with a column of scores (0 to 1) of the whole text; a null text counts as empty."""
    at, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, weights, bias))  # 8 * 2^BITS bytes at most
    schema = T.StructType([*docs.schema, T.StructField(to, T.DoubleType())])

    def run(batches):
        at, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
            sums = np.array([dense[features(t)].sum() for t in texts], float) + bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(sums))], [*b.schema.names, to])

    return docs.mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out third; one label per document, the highest."""
    toxic = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    toxic = toxic.filter(remainder(F.col("doc_id"), 3) != 1)
    n = toxic.count()
    if n > SAMPLE:  # the sample is drawn before texts are joined: the ids drawn are few
        at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11)
        toxic = toxic.filter(at < F.lit(int(SAMPLE / n * (1 << 53))))
    return docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels (doc_id, toxic) train the model.

    Null and empty texts get the score of a text without words. Documents of the held-out third (crc32 of the
    id mod 3 = 1; a null id is none) train nothing. Repeated rows are scored alike. Without labels every
    score is 0.5.
    """
    model = fit(train_rows(docs, labels))
    rows = score(docs.select("doc_id", "text"), model).drop("text")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all of docs' columns, whatever their names.

    Null and empty texts, long ones, repeated rows and missing labels: as in score_documents().
    """
    (to,) = fresh(docs, "_toxicity")
    scored = score(docs, fit(train_rows(docs, labels)), to=to)
    return scored.filter(F.col(to) < THRESHOLD).drop(to)
