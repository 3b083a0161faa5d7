"""Quality classification by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into blocks,
every block is compressed with either dictionary, and the difference of the two sums, divided by the larger of
them, tells which kind of text it is closer to. A logistic curve over that difference gives a calibrated score.
Added to it are the compressed share of the text, as text that repeats itself shrinks to little with either
dictionary, and what of that share lies below 0.3, a knee that was set by hand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_odds, labelled_sample, logistic, texts_of


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    block: int
    level: int


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes, level: int):
    return [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad)]


def _sizes(model_key: tuple[bytes, bytes, int, int], text: str) -> tuple[int, int, int]:
    good, bad, block, level = model_key
    by_good, by_bad = _compressors(good, bad, level)
    data = text.encode("utf-8", "surrogatepass")
    g = b = 0
    for at in range(0, max(1, len(data)), block):
        piece = data[at : at + block]
        g += len(by_good.compress(piece))
        b += len(by_bad.compress(piece))
    return g, b, len(data)


def _features(sizes: np.ndarray) -> np.ndarray:
    """Of rows of compressed size by the good and the bad dictionary and plain size."""
    g, b, n = sizes.T.astype(float)
    difference, share = (b - g) / np.maximum(np.maximum(b, g), 1), np.minimum(g / (n + 20), 1.5)
    low = np.maximum(0.3 - share, 0)
    return np.stack([np.ones_like(g), difference * 10, difference**2 * 10, share, low * 10, low * difference * 10], axis=1)


def train_quality(rows: list[tuple[str, int]], block: int = 512, dictionary_bytes: int = 65536, level: int = 3, seed: int = 7, odds: float | None = None) -> QualityModel | None:
    """Of labelled texts; None if they don't hold texts of both classes.

    ``odds``: the log odds of a good text among all texts, if those of the sample differ.

    Half of the texts build the dictionaries and the other half calibrates, as a dictionary shrinks the very
    texts it was built from too well.
    """
    rows = sorted(rows)
    order = np.random.default_rng(seed).permutation(len(rows))
    build, fit = [rows[i] for i in order[::2]], [rows[i] for i in order[1::2]]
    built = []
    for y in (1, 0):
        pieces = [d[i : i + block] for t, v in build if v == y for d in [t.encode("utf-8", "surrogatepass")] for i in range(0, len(d), block)]
        if not pieces or len({v for _, v in fit}) < 2:
            return None
        try:
            built.append(zstandard.train_dictionary(dictionary_bytes, pieces).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: its end serves as a raw dictionary
            built.append(b"".join(pieces)[-dictionary_bytes:])
    key = (*built, block, level)
    x = _features(np.array([_sizes(key, t) for t, _ in fit]))
    y = np.array([v for _, v in fit], float)
    penalty = np.array([1e-6, *[0.1] * (x.shape[1] - 1)])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + 0.5 * penalty @ (w * w))

    w = np.zeros(x.shape[1])
    for _ in range(100):  # Newton's method with halved steps
        p = logistic(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty)
        step, size, at = np.linalg.solve(h, x.T @ (y - p) - penalty * w), 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > at:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    if odds is not None:
        w[0] += odds - np.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(built[0], built[1], tuple(float(v) for v in w), block, level)


def quality_score(text: Column, model: QualityModel | None) -> Column:
    """The score of a text, 0 to 1. Null and empty texts get the score of the empty text; without a model 0.5."""
    if model is None:
        return F.lit(0.5)
    key, weights = (model.good, model.bad, model.block, model.level), np.array(model.weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        sizes = np.array([_sizes(key, t) for t in texts_of(texts)], dtype=np.int64).reshape(-1, 3)
        return pa.array(logistic(_features(sizes) @ weights))

    return score(text)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 1500) -> QualityModel | None:
    """Trains on at most ``bound`` texts of each class; rows that are held out are never learned from."""
    return train_quality(labelled_sample(docs, labels, "quality", bound), odds=label_odds(labels, "quality"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 1500) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of ``docs``.

    Null and empty texts are scored as empty texts; repeated rows and null ids stay; a table without labels of
    both classes gives the score 0.5 throughout. Other columns are neither read nor returned.
    """
    model = fit_quality(docs, labels, bound)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 1500) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject.

    Null and empty texts stand or fall with the score of the empty text; repeated rows are judged alike and stay
    together, and null ids stay. Without labels of both classes there is no model, every score is 0.5, and at the
    given threshold all rows stay.
    """
    return docs.where(quality_score(F.col("text"), fit_quality(docs, labels, bound)) >= threshold)
