"""Text quality by votes of the most similar labelled documents in a latent space.

A text becomes counts of terms that tell how it is written: trigrams of character classes, and how often its
words and word pairs come back. A truncated decomposition of labelled documents gives latent vectors;
labelled vectors are broadcast, and every document is compared with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty, without

#: Labelled rows that are read, at most: they bound the model (rows x DIMENSIONS numbers are broadcast).
SAMPLE, DIMENSIONS = 4000, 48
NEIGHBOURS, BLOCK = 15, 512

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?'\"()-",
           "!", "|", "#", "$%&", "*+=~^", "<>[]{}\\/", "_@`")
CLASSES = len(_GROUPS) + 2  # and other bytes: control signs, and parts of letters beyond ASCII
_CLASS = np.full(256, CLASSES - 1, np.int32)
_CLASS[:128] = CLASSES - 2
for _k, _signs in enumerate(_GROUPS):
    _CLASS[list(_signs.encode())] = _k
TRIGRAMS = CLASSES ** 3
#: Shares of words that repeat: next to each other, anywhere, as pairs; and how long words and lines are.
_SHARES, _STEPS = 6, 12
TERMS = TRIGRAMS + _SHARES * _STEPS
_PART = 4 << 20


def _shares(text: bytes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    pairs = list(zip(words, words[1:], strict=False))
    lines = text.split(b"\n")
    expected = 1 + 20 * np.log1p(n)  # distinct words grow slowly with length: compare like with like
    return [sum(a == b for a, b in pairs) / n, 1 - len(set(words)) / n, 1 - len(set(pairs)) / max(1, len(pairs)),
            1 - len(set(lines)) / len(lines), min(1.0, len(text) / n / 24), min(1.0, len(set(words)) / expected / 4)]


def terms(text: bytes) -> np.ndarray:
    """Weights of the terms of one text, of length 1 in all; zeros for an empty text."""
    count = np.zeros(TRIGRAMS, np.int64)
    for at in range(0, len(text), _PART):
        c = _CLASS[np.frombuffer(text, np.uint8, min(_PART + 2, len(text) - at), at)]
        if len(c) > 2:
            count += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=TRIGRAMS)
    out = np.zeros(TERMS, np.float32)
    if text:
        out[:TRIGRAMS] = np.sqrt(count / max(1, count.sum()))
        for k, share in enumerate(_shares(text)):
            out[TRIGRAMS + k * _STEPS + min(_STEPS - 1, int(share * _STEPS))] = 0.4
    return out


@dataclass
class QualityModel:
    mean: np.ndarray      # of the terms
    axes: np.ndarray      # terms x dimensions
    vectors: np.ndarray   # labelled rows x dimensions, of length 1
    labels: np.ndarray
    rate: float           # share of label 1: the score where nothing is similar

    def latent(self, weights: np.ndarray) -> np.ndarray:
        v = (weights - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Votes of the NEIGHBOURS most similar labelled rows, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(weights), self.rate)
        similar = self.latent(weights) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(similar, near, axis=1), 0.0) ** 4
        total = vote.sum(axis=1) + 1e-3
        return np.clip((np.einsum("ij,ij->i", vote, self.labels[near]) + 1e-3 * self.rate) / total, 0.0, 1.0)


def _rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            packed = [terms(t.as_buffer().to_pybytes()).astype(np.float16).tobytes() for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column(1)], ["terms", "quality"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn from labels (doc_id, quality) of documents outside the held-out third, at most `sample` of them.

    The rows are those with the smallest hashes of their ids. Labels, language, source and id are never
    part of a vector. Without usable labels every score is 0.5; with one kind only, that kind.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = (docs.select(docs["doc_id"], text_or_empty(docs["text"]).cast("binary").alias("content"))
           .join(chosen, "doc_id").orderBy("doc_id", "content").limit(sample).select("content", "quality")
           .mapInArrow(_rows, "terms binary, quality bigint").collect())
    y = np.array([r.quality for r in got], np.float32)
    x = np.array([np.frombuffer(r.terms, np.float16) for r in got], np.float32).reshape(len(got), TERMS)
    mean = x.mean(axis=0) if len(y) else np.zeros(TERMS, np.float32)
    centred = x - mean
    used = np.flatnonzero((centred ** 2).sum(axis=0) > 0)
    axes = np.zeros((TERMS, DIMENSIONS), np.float32)
    if len(used):
        _, turned = np.linalg.eigh((centred[:, used].T @ centred[:, used]).astype(np.float64))
        top = turned[:, ::-1][:, :DIMENSIONS]
        axes[used, :top.shape[1]] = top
    model = QualityModel(mean, axes, np.zeros((0, DIMENSIONS), np.float32), y, float(y.mean()) if len(y) else 0.5)
    model.vectors = model.latent(x).astype(np.float32) if len(y) else model.vectors
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Every input row with `out`, from 0 to 1: the higher, the likelier label 1.

    Whole texts are read; null counts as empty, and empty texts have the vector of no terms. A column
    called like `out` is replaced; other columns pass through, and only the text goes to Python. The model
    is broadcast: its size is bounded by SAMPLE, DIMENSIONS and TERMS, whatever the corpus.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [held.value.score(np.array([terms(bytes(t)) for t in texts.iloc[at:at + BLOCK]]))
                 for at in range(0, len(texts), BLOCK)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0), dtype=float)

    return docs.select(*without(docs, out), score(text_or_empty(docs[f"`{text}`"]).cast("binary")).alias(out))
