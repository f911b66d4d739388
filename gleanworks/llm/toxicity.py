"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs, and pairs with one or two words between them, each once
a text, hashed into ``2 ** bits`` places. Every coordinate has its own learning rate, and the
L1 part keeps most weights at exactly 0: the weights left over are few, and only they are
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gleanworks.llm.arrow import lists_of, map_batches, utf8
from gleanworks.llm.langid import remainder
from gleanworks.session import table

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Distances of the two words of a pair: 1 is an n-gram, 2 and 3 are skip-grams.
STEPS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """``rows`` labelled documents at most are learned from, those with the smallest hashes of doc_id.

    ``l1`` is the L1 strength for one row; it grows with the square root of the rows learned from,
    as the summed gradients of a useless feature do.
    """

    rows: int = 8192
    bits: int = 20
    epochs: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.0


@dataclass(frozen=True)
class Model:
    """Weights other than 0, by feature, and the constant."""

    at: np.ndarray
    weight: np.ndarray
    constant: float
    bits: int


class Hasher:
    """Feature numbers of texts."""

    def __init__(self, bits: int):
        self.bits = bits

    def words(self, text: bytes) -> np.ndarray:
        words = text.translate(_FOLD).split()
        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))

    def features(self, h: np.ndarray) -> np.ndarray:
        """Feature numbers of word hashes, with repeats."""
        parts = [self._fold(h)]
        for step in STEPS:
            if len(h) > step:
                parts.append(self._fold((h[:-step] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) ^ (h[step:] * np.uint64(0xC2B2AE3D27D4EB4F))))
        return np.concatenate(parts)

    def _fold(self, h: np.ndarray) -> np.ndarray:
        k = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (k >> np.uint64(64 - self.bits)).astype(np.int64)


def train(rows: list[tuple[int, np.ndarray]], settings: Settings) -> Model:
    """FTRL-proximal over (label, distinct features) rows, in the order given."""
    n = (1 << settings.bits) + 1  # the last one is the constant, which L1 spares
    z, g2 = np.zeros(n), np.zeros(n)
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1 * max(1, len(rows)) ** 0.5, settings.l2

    def weights(zi: np.ndarray, gi: np.ndarray, spared: np.ndarray) -> np.ndarray:
        shrunk = np.where(spared, zi, np.sign(zi) * np.maximum(np.abs(zi) - l1, 0))
        return -shrunk / ((beta + np.sqrt(gi)) / alpha + l2)

    for _ in range(settings.epochs):
        for label, at in rows:
            at = np.append(at, n - 1)
            zi, gi = z[at], g2[at]
            spared = at == n - 1
            w = weights(zi, gi, spared)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha
            z[at] = zi + g - sigma * w
            g2[at] = gi + g * g
    w = weights(z, g2, np.arange(n) == n - 1)
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]), settings.bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from documents that ``labels`` marks 0 or 1 (any mark of 1 counts for repeated ids)."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)
    bits = settings.bits

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = Hasher(bits)
        found = [np.unique(hasher.features(hasher.words(text or b""))).astype(np.int32) for text in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    # at most settings.rows ids: a proven bound
    sample = map_batches(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), features, "doc_id bigint, toxic int, at array<int>").toArrow()
    ids, toxic = sample.column("doc_id").to_pylist(), sample.column("toxic").to_pylist()
    lists = lists_of(sample.column("at"))
    order = sorted(range(len(ids)), key=lambda i: ((ids[i] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 11, ids[i], len(lists[i])))
    model = train([(toxic[i], lists[i]) for i in order], settings)
    del sample, lists
    pa.default_memory_pool().release_unused()
    return model


def _scores(texts: list[bytes | None], model: Model) -> np.ndarray:
    weight, hasher, scores = _dense(model), _hasher(model.bits), []
    for text in texts:
        at = hasher.features(hasher.words(text or b""))
        at = at[weight[at] != 0]
        total = model.constant + float(weight[np.unique(at)].sum())
        scores.append(1 / (1 + np.exp(-max(-35.0, min(35.0, total)))))
    return np.array(scores, float)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights other than 0, 2 ** bits at most
    at = docs.columns.index("text")
    return map_batches(docs, lambda batch: batch.filter(pa.array(_scores(utf8(batch.column(at)), shared.value) < 0.5)), docs.schema)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0 to 1 and predicted (1 from 0.5 on), from the whole text alone.

    A null or empty text gets the constant's score. Repeated rows give a row each; an empty
    table an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights other than 0, 2 ** bits at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = _scores(utf8(batch.column(1)), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, score double, predicted int")


_CACHE: dict = {}


def _dense(model: Model) -> np.ndarray:
    if _CACHE.get("model") is not model:
        weight = np.zeros(1 << model.bits)
        weight[model.at] = model.weight
        _CACHE.update(model=model, weight=weight)
    return _CACHE["weight"]


def _hasher(bits: int) -> Hasher:
    return _CACHE.setdefault(("hasher", bits), Hasher(bits))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labelled ids."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_toxicity(docs, fit_toxicity(docs, labels)).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
