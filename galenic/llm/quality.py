"""Quality classifier: how much better a text compresses with a dictionary of good text than of bad text.

Two zstandard dictionaries are built from labelled good and bad texts.  A whole
text is cut into blocks, each compressed with either dictionary.  The difference
of the summed sizes, normalised by their sum, is the measure.  Beside it stand
the measure weighed by the length of the text (a short text tells less) and, as
an addition to the method, the smaller size normalised by the text's own, with
its square: text that repeats itself shrinks to nothing with any dictionary.  A
logistic curve fitted on other labelled rows makes them a probability; the
README says how much of it the addition carries.

Edge cases: a null or empty text measures 0 and gets the curve's value there;
without labelled rows of both classes every score is 1 (nothing is rejected);
ids may be of any type; rows that repeat a doc_id are scored by their own
texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galenic.llm import labelled

#: Bytes of a text that are compressed at once, and of a piece that dictionaries are trained on.
BLOCK, PIECE = 4096, 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: of the logistic curve: intercept, and the weights of what ``measures`` gives
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)

    @property
    def known(self) -> bool:
        return bool(self.good and self.bad)


def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, ...]:
    return tuple(
        zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        for d in (model.good, model.bad)
    )


def measures(text: str, pair: tuple[zstandard.ZstdCompressor, ...]) -> tuple[float, ...]:
    """The normalised difference (positive: good), it times a weight that grows
    with the length up to 1024 bytes, and the logarithm of the normalised
    smaller size, with its square."""
    raw = text.encode("utf-8", "replace")
    good = bad = 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        good += len(pair[0].compress(block))
        bad += len(pair[1].compress(block))
    diff = (bad - good) / max(1, bad + good)
    left = math.log(min(good, bad) / len(raw)) if raw else 0.0
    return diff, diff * min(1.0, (len(raw) / 1024) ** 0.5), left, left * left


def pieces(raw: bytes) -> list[bytes]:
    """A whole text in the pieces that a dictionary is trained on."""
    return [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]


def dictionary(windows: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train, the text itself."""
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, chars_per_class: int = 16_000_000, dictionary_bytes: int = 65536) -> Model:
    """Dictionaries from half of a sample of at most ``per_class`` rows and about
    ``chars_per_class`` characters of each class, the curve from the other half.
    The driver gets the whole texts of the one half and two numbers for each row of the other."""
    rows = labelled.sample(docs, labels, label, per_class, chars_per_class)
    pick = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    texts = rows.where(pick == 1).select(F.col("doc_id").cast("string").alias("id"), "label", "text").where("text <> ''").toPandas().sort_values(["id", "text"])
    parts = [[piece for t in texts["text"][texts["label"] == k] for piece in pieces(t.encode("utf-8", "replace"))] for k in (1, 0)]
    if not all(parts):
        return Model(b"", b"")
    model = Model(*(dictionary(p, dictionary_bytes) for p in parts))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        for batch in batches:
            kept = [(mark, *measures(text or "", pair)) for text, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"label": pa.array([k[0] for k in kept], pa.int32()), "x": pa.array([list(k[1:]) for k in kept], pa.list_(pa.float64()))})

    points = rows.where(pick == 0).select("text", "label").mapInArrow(numbers, "label int, x array<double>").toPandas()
    x = np.array([list(v) for v in points["x"]]).reshape(len(points), -1)
    order = np.lexsort([*x.T, points["label"].to_numpy()])
    return Model(model.good, model.bad, logistic(x[order], points["label"].to_numpy()[order]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and weights of a shrunk logistic curve, both classes weighing as they occur.

    Newton's method on scaled columns. Each step is halved until the loss
    falls, so classes that separate cleanly do not send the weights astray.
    """
    if not len(y):
        return (0.0, 20.0, 20.0, 0.0, 0.0)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    shrink = ridge * np.diag([1e-3, *np.ones(x.shape[1])])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ shrink @ w / 2)

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    weights = w[1:] / scale
    return (float(w[0] - weights @ centre), *map(float, weights))


def scorer(model: Model) -> Callable[[], Callable[[str], float]]:
    def make() -> Callable[[str], float]:
        if not model.known:
            return lambda text: 1.0
        pair, b, w = compressors(model), model.curve[0], np.array(model.curve[1:])

        def score(text: str) -> float:
            return float(1 / (1 + np.exp(-np.clip(b + w @ np.array(measures(text, pair)), -500, 500))))

        return score

    return make


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return labelled.scored(docs, scorer(fit(docs, labels, **options)), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return labelled.passing(docs, scorer(fit(docs, labels, **options)), threshold)
