"""Toxicity by a factorization machine over hashed terms.

The score is the logistic of ``w0 + sum w_i + sum over pairs <v_i, v_j>`` over the distinct hashed terms of a
text, so a pair of terms (an insult beside the mention of a group) can count for more than the two apart. All
terms of the labelled texts take part; only the number of texts is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, held_out, label_odds, labelled_sample, logistic, texts_of


@dataclass(frozen=True)
class ToxicityModel:
    """``terms`` are the hashes, ascending, that have weights; all others weigh nothing."""

    bits: int
    w0: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray


def hashed_terms(text: str, bits: int) -> set[int]:
    """The hashes of the distinct words of a whole text."""
    mask, digest = (1 << bits) - 1, xxhash.xxh32_intdigest
    return {digest(w) & mask for w in set(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())}


def _raw(rows: list[np.ndarray], w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the logistic; also the flat term positions, the row of each, and the sums of factors."""
    sizes = np.array([len(r) for r in rows])
    flat, row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    linear = np.bincount(row, w[flat], len(rows)) if len(w) else np.zeros(len(rows))
    sums, squares = np.zeros((len(rows), v.shape[1])), np.zeros(len(rows))
    for f in range(v.shape[1]):
        x = v[flat, f]
        sums[:, f] = np.bincount(row, x, len(rows))
        squares += np.bincount(row, x * x, len(rows))
    return w0 + linear + 0.5 * ((sums**2).sum(1) - squares), flat, row, sums


class _Texts:
    """The terms of the training texts: sums of a term's value over texts, and of a text's value over terms."""

    def __init__(self, sets: list[np.ndarray], terms: np.ndarray):
        at = [np.searchsorted(terms, s) for s in sets]
        self.flat = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        self.row, self.n, self.n_terms = np.repeat(np.arange(len(at)), [len(x) for x in at]), len(at), len(terms)

    def over_terms(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.flat], self.n)

    def over_texts(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, e[self.row], self.n_terms)

    def only(self, kept: np.ndarray) -> _Texts:
        """The same texts with some of the terms."""
        place, out = np.full(self.n_terms, -1), object.__new__(_Texts)
        place[kept] = np.arange(len(kept))
        there = place[self.flat] >= 0
        out.flat, out.row, out.n, out.n_terms = place[self.flat[there]], self.row[there], self.n, len(kept)
        return out


def _first_factors(texts: _Texts, error: np.ndarray, noise: np.ndarray, factors: int, rng: np.random.Generator) -> np.ndarray:
    """Where the pairs' gradient leads from nothing: sparse eigenvectors of the matrix that has, for each two terms,
    the summed errors of the texts with both. The matrix is never made.

    Power iteration finds the largest; then each product is cut at what chance gives a term (``noise`` times the
    size of the texts' sums), so a factor without a significant pair ends at zero.
    """
    own = texts.over_texts(error)
    times = lambda m: np.stack([texts.over_texts(error * texts.over_terms(c)) - own * c for c in m.T], 1)
    q = np.linalg.qr(rng.normal(size=(texts.n_terms, min(2 * factors, texts.n_terms))))[0]
    for _ in range(8):
        q = np.linalg.qr(times(times(q)))[0]  # twice: by the size of the eigenvalue, whatever its sign
    values, vectors = np.linalg.eigh(q.T @ times(q))
    q = q @ vectors[:, np.argsort(-values)[:factors]]
    for _ in range(12):
        level = noise[:, None] * np.array([np.sqrt((texts.over_terms(c) ** 2).mean()) for c in q.T])
        m = times(q)
        m = np.sign(m) * np.maximum(np.abs(m) - level, 0)
        q = m / np.maximum(np.linalg.norm(m, axis=0), 1e-300)
    return q if q.shape[1] == factors else np.pad(q, ((0, 0), (0, factors - q.shape[1])))


def train_toxicity(rows: list[tuple[str, int]], bits: int = 22, factors: int = 4, strict: float = 0.3, strict_pairs: float = 3.0, steps: int = 180, seed: int = 11, odds: float | None = None) -> ToxicityModel | None:
    """Of labelled texts; None if they don't hold texts of both classes.

    All hashed terms of all given texts take part. Weights and factors follow proximal gradient steps with soft
    thresholds (for a term's factors as a group) of so many standard deviations of what chance gives the term's
    gradient: ``strict`` for weights, ``strict_pairs`` for factors. So what doesn't tell the classes apart ends
    at exactly zero, and long texts gather no noise. A third of the steps is for weights alone; factors begin at
    the sparse eigenvectors of the pairs' errors that the weights leave. ``factors`` of 0 leaves a linear model.
    ``odds``: the log odds of a toxic text among all texts, if those of the sample differ.
    """
    rows = sorted(rows)
    y = np.array([v for _, v in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    sets = [np.sort(np.fromiter(hashed_terms(t, bits), np.int64)) for t, _ in rows]
    terms, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
    if not len(terms):
        terms, counts = np.zeros(1, np.int64), np.ones(1, np.int64)
        sets = [np.zeros(0, np.int64) for _ in sets]
    texts, n = _Texts(sets, terms), len(rows)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # either class has half of the loss
    deviation = 0.5 * np.sqrt((share**2).mean() * counts)  # of a term's gradient by chance
    w0, w, g0, gw = 0.0, np.zeros(len(terms)), 1e-6, (strict * deviation) ** 2 + 1e-12

    def weighed(at: np.ndarray, texts: _Texts, error: np.ndarray) -> np.ndarray:
        """A step of the weights; their gradient."""
        nonlocal w0, g0
        d0, dw = error.sum(), texts.over_texts(error)
        g0, gw[at] = g0 + d0 * d0, gw[at] + dw * dw
        w0 -= 0.5 * d0 / np.sqrt(g0)
        a = 0.5 / np.sqrt(gw[at])
        moved = w[at] - a * dw
        w[at] = np.sign(moved) * np.maximum(np.abs(moved) - a * strict * deviation[at], 0)
        return dw

    whole = np.arange(len(terms))
    for _ in range(steps // 3):
        weighed(whole, texts, share * (logistic(w0 + texts.over_terms(w)) - y))
    v = np.zeros((len(terms), factors))
    if factors:
        noise = strict_pairs * deviation
        v = 0.5 * _first_factors(texts, share * (y - logistic(w0 + texts.over_terms(w))), noise, factors, np.random.default_rng(seed))
        gv, rounds = np.full((len(terms), 1), 1e-12), 4
        for _ in range(rounds):
            # terms at zero are left out of a round's steps, and looked at again before the next
            sums = np.stack([texts.over_terms(c) for c in v.T], 1)
            size = np.sqrt((sums**2).sum(1).mean())
            raw = w0 + texts.over_terms(w) + 0.5 * ((sums**2).sum(1) - texts.over_terms((v * v).sum(1)))
            error = share * (logistic(raw) - y)
            pulled = np.linalg.norm(np.stack([texts.over_texts(error * s) for s in sums.T], 1), axis=1) > noise * size
            at = np.flatnonzero((w != 0) | v.any(1) | pulled | (np.abs(texts.over_texts(error)) > strict * deviation))
            some = texts.only(at)
            for _ in range(max(1, (steps - steps // 3) // rounds)):
                u = v[at]
                sums = np.stack([some.over_terms(c) for c in u.T], 1)
                size = np.sqrt((sums**2).sum(1).mean())
                raw = w0 + some.over_terms(w[at]) + 0.5 * ((sums**2).sum(1) - some.over_terms((u * u).sum(1)))
                error = share * (logistic(raw) - y)
                dw = weighed(at, some, error)
                dv = np.stack([some.over_texts(error * s) for s in sums.T], 1) - u * dw[:, None]
                gv[at] += (dv * dv).mean(1, keepdims=True)
                level = (noise[at] * size)[:, None]
                a = 0.2 / np.sqrt(gv[at] + level**2)
                u = u - a * dv
                v[at] = u * np.maximum(1 - a * level / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), 0)
    keep = (w != 0) | v.any(1)
    model = ToxicityModel(bits, float(w0), terms[keep], w[keep], v[keep])
    slope, offset = _calibrated(raw_scores(model, sets), y, np.log(y.sum() / (n - y.sum())) if odds is None else odds)
    # a text without known terms keeps its raw score; thresholds have shrunk all others
    return ToxicityModel(bits, float(slope * w0 + offset), terms[keep], slope * w[keep], np.sqrt(slope) * v[keep])


def _calibrated(raw: np.ndarray, y: np.ndarray, odds: float) -> tuple[float, float]:
    """Slope, 1 to 8, and offset of the logistic curve over raw scores at the odds of label 1 among all texts."""
    p1 = float(logistic(np.array([np.clip(odds, -6, 6)]))[0])
    weight = np.where(y == 1, p1 / max(1.0, y.sum()), (1 - p1) / max(1.0, (1 - y).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(400):
        error = weight * (logistic(slope * raw + offset) - y)
        slope = float(np.clip(slope - 2.0 * (error @ raw + 1e-4 * (slope - 1)), 1, 8))
        offset -= 4.0 * float(error.sum())
    return slope, offset


def raw_scores(model: ToxicityModel, sets: list) -> np.ndarray:
    """Scores before the logistic of texts given by their hashed terms."""
    known = {int(t): i for i, t in enumerate(model.terms)}
    return _raw([np.array([known[t] for t in s if t in known], np.int64) for s in sets], model.w0, model.w, model.v)[0]


def toxicity_score(text: Column, model: ToxicityModel | None) -> Column:
    """0 to 1. Null and empty texts have the score of a text without terms; without a model 0.5."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        sets = [hashed_terms(x, model.bits) for x in texts_of(texts)]
        return pa.array(logistic(raw_scores(model, sets)) if sets else np.zeros(0))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = 1500) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of ``docs``.

    Trains on at most ``bound`` texts of each class; rows that are held out are never learned from. Null and
    empty texts are scored as texts without terms; repeated rows and null ids stay; a table without labels of
    both classes gives the score 0.5 throughout. Other columns are neither read nor returned.
    """
    model = train_toxicity(labelled_sample(docs, labels, "toxic", bound), odds=label_odds(labels, "toxic"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
