"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the sets of its words, of its pairs of neighbours, of
its pairs with one word between and of its words' first four and five letters
(so that other endings of a word seen in training count), hashed to ``BITS``
bits.  Training goes
through a bounded sample of labelled rows, one at a time, with a learning rate
for each coordinate; the L1 term leaves few weights, which go to the workers
as one sorted array.

Edge cases: a null or empty text scores what the bias alone gives; without
labelled rows of both classes every score is 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galenic.llm import labelled

BITS = 22
STEMS = (4, 5)
WORDS = re.compile(r"\w+")
#: Odd multipliers that spread the hash of a word, of a pair and of a skip pair.
SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD))


class WordHash(dict):
    """Word -> 32-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) + 1
        return value


def features(text: str, known: WordHash) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    found = WORDS.findall(text.lower())
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    stems = [np.fromiter((known[w[:k]] for w in found), dtype=np.uint64, count=len(found)) for k in STEMS]
    a, b, c, d, e = SPREAD
    with np.errstate(over="ignore"):
        mixed = np.concatenate([h * a, (h[:-1] * b) ^ (h[1:] * c), (h[:-2] * d) ^ (h[2:] * e), stems[0] * b + c, stems[1] * d + e])
        return ((mixed ^ (mixed >> np.uint64(29))) * a) >> np.uint64(64 - BITS)


@dataclass(frozen=True)
class Model:
    bias: float | None
    index: np.ndarray
    weight: np.ndarray


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, and the indices and values of the weights that are not 0."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for x, label in zip(rows, y, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    return bias, live, (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = 4000,
    chars_per_class: int = 16_000_000,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.1,
) -> Model:
    """Weights from at most ``per_class`` labelled rows, and about ``chars_per_class`` characters of them, of each class, trained in one task."""
    rows = labelled.sample(docs, labels, label, per_class, chars_per_class)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, labelled.SLICE):
                part = batch.slice(at, labelled.SLICE)
                sets = [np.unique(features(t or "", known)).astype("uint32").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(sets, pa.binary())], ["doc_id", "label", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = rows.select("doc_id", "text", "label").mapInArrow(hashed, f"doc_id {kind}, label int, features binary")

    def train(found: pd.DataFrame) -> pd.DataFrame:
        order = found["doc_id"].map(lambda x: zlib.crc32(f"order{x}".encode()))
        found = found.assign(order=order).sort_values(["order", "doc_id"])
        y = found["label"].to_numpy()
        if len(set(y)) < 2:
            return pd.DataFrame({"bias": [], "index": [], "weight": []})
        x = [np.frombuffer(b, dtype="uint32").astype("int64") for b in found["features"]]
        bias, index, weight = ftrl(x, y, epochs, alpha, beta, l1, l2)
        return pd.DataFrame({"bias": [bias], "index": [index.astype("int32").tobytes()], "weight": [weight.astype("float64").tobytes()]})

    model = sets.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "bias double, index binary, weight binary").collect()
    if not model:
        return Model(None, np.zeros(0, "int32"), np.zeros(0))
    return Model(model[0]["bias"], np.frombuffer(model[0]["index"], dtype="int32"), np.frombuffer(model[0]["weight"], dtype="float64"))


def scorer(model: Model) -> Callable[[], Callable[[str], float]]:
    def make() -> Callable[[str], float]:
        if model.bias is None:
            return lambda text: 0.0
        known, dense = WordHash(), np.zeros(1 << BITS, dtype="float32")
        dense[model.index] = model.weight

        def score(text: str) -> float:
            x = features(text, known)
            x = np.unique(x[dense[x] != 0])
            return float(1 / (1 + np.exp(-np.clip(float(dense[x].sum(dtype="float64")) + model.bias, -500, 500))))

        return score

    return make


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return labelled.scored(docs, scorer(fit(docs, labels, **options)), threshold)
