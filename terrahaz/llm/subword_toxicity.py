"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, a text the mean of
its words, and a linear softmax on that mean tells toxic from harmless.  Vectors
and softmax are trained jointly in numpy on a bounded sample of labelled rows.
Words never seen in training still share n-gram vectors with seen ones.

Because everything before the softmax is a mean, a trained model folds into one
number per n-gram bucket, which is all that scoring needs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import documents, text_key, without, written

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
WIDTH = 4
FIT_ROWS = 2000  # of each class, at most
FIT_CHARS = 20_000  # longer texts are not drawn into the sample
EPOCHS = 16
RATE = 0.03
MIN_TEXTS = 5
DECAY = 0.0
SHARPNESS = 6.0  # few passes leave the softmax hesitant; this is its inverse temperature
CUT = 0.7
CACHE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """``weight``: the folded logit of every bucket; ``bias``: the logit of an empty text."""

    weight: np.ndarray
    bias: float
    vectors: np.ndarray
    softmax: np.ndarray


def grams(word: str) -> list[int]:
    """Buckets of a word: its letters with borders, whole and as n-grams."""
    w = f"<{''.join(_LETTERS.findall(word))}>"
    if len(w) == 2:
        return []
    parts = {w} | {w[i:i + n] for n in SIZES for i in range(len(w) - n + 1)}
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class _Bags:
    """Rows of weighted entries; multiplies vectors forwards (rows) and backwards (entries).

    Entries are kept sorted both ways and multiplied ``STEP`` at a time, so that
    no product of all entries is ever held.  ``weights`` are given per entry or,
    where the entries of a row weigh the same, per row.
    """

    STEP = 1 << 17

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n_rows: int, n_cols: int):
        self.shape = n_rows, n_cols
        self.by_row = len(weights) != len(rows)
        self.weights = weights.astype(np.float32)
        self.sides = [self._sorted(rows, cols, n_rows), self._sorted(cols, rows, n_cols)]

    def _sorted(self, to: np.ndarray, frm: np.ndarray, n: int) -> tuple:
        order = np.argsort(to, kind="stable").astype(np.int32)
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(to, minlength=n), out=ends[1:])
        return ends, frm[order], None if self.by_row else self.weights[order]

    def _times(self, side: int, x: np.ndarray) -> np.ndarray:
        ends, frm, weights = self.sides[side]
        n = self.shape[side]
        out = np.zeros((n, x.shape[1]), np.float32)
        at = 0
        while at < n:  # whole segments, one at least
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.STEP, "right")) - 1)
            lo, hi = ends[at], ends[to]
            filled = at + np.flatnonzero(ends[at + 1:to + 1] > ends[at:to])
            if len(filled):
                part = x[frm[lo:hi]]
                if weights is not None:
                    part *= weights[lo:hi, None]
                elif side:
                    part *= self.weights[frm[lo:hi], None]
                out[filled] = np.add.reduceat(part, ends[filled] - lo, axis=0)
            at = to
        if self.by_row and not side:
            out *= self.weights[:, None]
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._times(0, x)

    def entries(self, x: np.ndarray) -> np.ndarray:
        return self._times(1, x)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE,
        min_texts: int = MIN_TEXTS, decay: float = DECAY, sharpness: float = SHARPNESS, seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax by Adam over the whole sample."""
    if not texts or len(set(labels)) < 2:  # nothing to learn from: every text gets the class share
        share = min(max(float(np.mean(labels)) if labels else 0.0, 0.01), 0.99)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), np.zeros((1, WIDTH)), np.zeros((WIDTH, 2)))
    index: dict[str, int] = {}
    buckets, starts = array("i"), array("q", [0])  # n-grams of all words, one after another
    rows, cols, weights = [], [], []
    for i, text in enumerate(texts):
        split = text.lower().split()
        for w in split:
            if w not in index:
                index[w] = len(index)
                buckets.extend(grams(w))
                starts.append(len(buckets))
        if split:
            found, n = np.unique(np.fromiter(map(index.__getitem__, split), np.int32), return_counts=True)
            rows.append(np.full(len(found), i, np.int32))
            cols.append(found)
            weights.append((n / len(split)).astype(np.float32))
    n_words = len(index)
    del index
    buckets, starts = np.array(buckets, np.int32), np.array(starts)
    lengths = np.diff(starts)
    held = np.zeros((2, BUCKETS), np.float32)
    for text_rows, found in zip(rows, cols, strict=True):
        n = lengths[found]
        at = np.arange(n.sum()) + np.repeat(starts[found] - np.r_[0, np.cumsum(n)[:-1]], n)
        held[labels[text_rows[0]], np.unique(buckets[at])] += 1
    # n-grams of fewer than ``min_texts`` texts can only be learnt by heart
    common = held.sum(0)[buckets] >= min_texts
    owner = np.repeat(np.arange(n_words, dtype=np.int32), lengths)[common]
    used = np.flatnonzero(held.sum(0) >= min_texts)
    local = np.searchsorted(used, buckets[common]).astype(np.int32)
    share = (1 / np.maximum(lengths, 1)).astype(np.float32)
    del buckets, common, starts
    # texts -> words -> n-grams: the two means as two tables of weights
    words = _Bags(owner, local, share, n_words, len(used))
    del owner, local
    texts_ = _Bags(np.concatenate(rows), np.concatenate(cols), np.concatenate(weights), len(texts), n_words)
    del rows, cols, weights
    rng = np.random.default_rng(seed)
    # start: the first dimension holds how much more often toxic texts hold the n-gram, the others are noise
    share = (held + 1) / (np.bincount(labels, minlength=2)[:, None] + 1)
    vectors = rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32)
    vectors[:, 0] = np.log(share[1] / share[0])[used]
    means = texts_.rows(words.rows(vectors))[:, 0]
    slope = 1.5 / max(float(means.std()), 1e-6)
    softmax = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    softmax[0] = -slope, slope
    middle = slope * np.mean([means[np.asarray(labels) == c].mean() for c in (0, 1)])
    params = [vectors, softmax, np.array([middle, -middle], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y = np.eye(2, dtype=np.float32)[np.asarray(labels)]
    each = (y / y.sum(0) * 0.5).sum(1, keepdims=True)  # both classes weigh the same
    for step in range(1, epochs + 1):
        vectors, softmax, bias = params
        means = texts_.rows(words.rows(vectors))
        logits = means @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - y) * each
        grads = [words.entries(texts_.entries(d @ softmax.T)), means.T @ d, d.sum(0)]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if k == 0:
                params[k] *= 1 - decay
    vectors, softmax, bias = params[0], params[1] * sharpness, params[2] * sharpness
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0]), vectors, softmax)


class _WordLogits(dict):
    """Logit of a word, computed once; emptied when it holds ``CACHE`` words."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        g = grams(word)
        weight = self.weight
        value = sum([weight[b] for b in g]) / len(g) if g else 0.0
        self[word] = value
        return value


def text_logit(text: str | None, logits: dict, bias: float) -> float:
    words = text.lower().split() if text else []
    return bias + (sum(map(logits.__getitem__, words)) / len(words) if words else 0.0)


def sample_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[list[str], list[int]]:
    """Labelled rows to fit on: none whose crc32(doc_id as text) mod 3 is 1, at most ``rows`` of each class
    by hash of the id, none longer than ``chars``."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    drawn = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * rows rows
    got = (docs.select("doc_id", "text").where(F.length("text") <= chars).join(chosen, "doc_id")
           .dropDuplicates(["doc_id"]).collect())
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, plus ``_id`` and ``_th``.

    Null and empty texts get the score of an empty bag; a null doc_id is not held
    out; repeated rows get the same score each; an empty table gives an empty
    result; without two classes of labels every text gets the share of the class;
    columns other than doc_id and text are not looked at.
    """
    model = fit(*sample_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weight, bias = shared.value
        logits = _cached(weight)
        z = np.array([text_logit(t, logits, bias) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return (docs.select("doc_id", held.alias("held_out"), score("text").alias("score"),
                        *[c.alias(n) for n, c in text_key().items()])
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


_CACHES: dict[int, _WordLogits] = {}


def _cached(weight: np.ndarray) -> _WordLogits:
    """One cache per worker and model."""
    key = hash(weight.tobytes())
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = _WordLogits(weight)
    return _CACHES[key]


def harmless(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows not predicted toxic, all columns."""
    scored = score_toxicity(docs, labels, cut)
    bad = written(scored.where("predicted = 1").select("_id", "_th").distinct(), "toxic-rows")
    return without(docs, bad)


def op1_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("_id", "_th")
