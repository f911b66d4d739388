"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 2 to 4 bytes of a word, its
borders included, hashed into buckets); a linear layer and a softmax follow. Embeddings and
layer are trained by stochastic gradient descent in numpy on a bounded sample. One part of
the sample is held back: it sets the softmax temperature and the level under which a
prediction is rejected. As the mean is linear, embeddings and layer fold into one table of
scores by bucket, which is all that executors receive: ``buckets * languages`` floats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.llm.arrow import BLOCK_BYTES, lists_of, map_batches, utf8
from gleanworks.session import table

ORDERS = (2, 3, 4)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLAIN_LETTER = re.compile("[A-Za-z]")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of training.

    ``per_language`` rows of each language, and ``languages`` languages at most (those with
    the most rows), are the training sample. ``false_rejections`` is the share of held-back
    texts that the rejection level may reject; the level never exceeds ``most_level``, and is
    0 only where nothing is held back to set it by.
    """

    per_language: int = 400
    languages: int = 200
    bits: int = 16
    dims: int = 16
    epochs: int = 6
    rate: float = 0.5
    held_back: float = 0.25
    false_rejections: float = 0.0005
    most_level: float = 0.5
    seed: int = 7


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers of any kind are none."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def subwords(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every subword in folded bytes, where 32 stands between words."""
    gap = data == 32
    h = data.astype(np.uint32)
    places, buckets = [], []
    inside = np.zeros(len(data), bool)  # a gap among the inner bytes of a run
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) ^ data[n - 1 :].astype(np.uint32)
        inside = inside[: len(h)] | gap[n - 2 : n - 2 + len(h)] if n > 2 else inside[: len(h)]
        if n in ORDERS:
            at = np.flatnonzero(~(inside | (gap[: len(h)] & gap[n - 1 :])))
            k = (h[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            k ^= k >> np.uint32(15)
            k *= np.uint32(0x85EBCA77)
            places.append(at)
            buckets.append((k >> np.uint32(32 - bits)).astype(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(buckets)


def _pieces(text: bytes) -> list[bytes]:
    """A text in blocks cut at word borders; a word longer than a block is cut, too."""
    if len(text) <= BLOCK_BYTES:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        if end < len(text):
            space = text.rfind(b" ", at, end)
            end = space + 1 if space > at else end
        out.append(text[at:end])
        at = end
    return out


def blocks_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as blocks of about BLOCK_BYTES: (numbers of the texts, their starts, bytes)."""
    out, own, starts, parts, size = [], [], [], [], 0

    def close() -> None:
        nonlocal own, starts, parts, size
        if own:
            out.append((np.array(own), np.array(starts), np.frombuffer(b"".join(parts), np.uint8)))
        own, starts, parts, size = [], [], [], 0

    for k, text in enumerate(texts):
        for piece in _pieces(text.translate(_FOLD)):
            if size and size + len(piece) > BLOCK_BYTES:
                close()
            own.append(k)
            starts.append(size)
            parts.append(b" " + piece + b" ")
            size += len(piece) + 2
    close()
    return out


def bucket_counts(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their counts."""
    counts = np.zeros(1 << bits, np.int64)
    for _, _, data in blocks_of([text]):
        counts += np.bincount(subwords(data, bits)[1], minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Model:
    """A trained model: scores of every language by bucket, temperature and rejection level."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    level: float
    bits: int

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the calibrated probabilities; equal ones where no subword is."""
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        for own, starts, data in blocks_of(texts):
            at, bucket = subwords(data, self.bits)
            row = own[np.searchsorted(starts, at, side="right") - 1]
            counts += np.bincount(row, minlength=len(texts))
            for c in range(len(self.languages)):
                sums[:, c] += np.bincount(row, weights=self.scores[bucket, c], minlength=len(texts))
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits[counts == 0] = 0
        return _softmax(logits)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _finite(name: str, values: np.ndarray) -> np.ndarray:
    if not np.isfinite(values).all():
        raise ArithmeticError(f"language training gave {name} that are not finite")
    return values


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """Fits a model to (language, buckets, counts) rows, in an order given by the seed.

    Steps are normalized: a text's mean moves by the same distance however many subwords it
    has, and no step moves the logits by more than ``rate`` times the error, so training
    can't diverge on long texts. Results that are not finite raise.
    """
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((1 << settings.bits, 0)), np.zeros(0), 1.0, 0.0, settings.bits)
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(settings.seed)
    items = [(number[lang], at, (n / n.sum()).astype(np.float32)) for lang, at, n in rows if len(at)]
    rng.shuffle(items)
    back = int(len(items) * settings.held_back)
    held, fit = items[:back], items[back:]
    table_ = rng.normal(0, 1 / settings.dims, (1 << settings.bits, settings.dims)).astype(np.float32)
    layer = np.zeros((settings.dims, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = max(1, settings.epochs * len(fit)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(fit)):
            lang, at, share = fit[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            mean = share @ table_[at]
            p = _softmax(mean @ layer + bias)
            p[lang] -= 1
            rate /= max(1.0, float(mean @ mean + (layer * layer).sum()))
            back_to = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            table_[at] -= (rate / float(share @ share)) * np.outer(share, back_to)
    scores = _finite("scores", (table_ @ layer).astype(np.float32))
    logits = _finite("logits", np.array([n @ scores[at] + bias for _, at, n in held]).reshape(len(held), len(languages)))
    right = np.array([lang for lang, _, _ in held], int)
    temperature, level = 1.0, 0.0
    if len(held):
        grid = np.exp(np.linspace(np.log(0.05), np.log(200), 81))
        # n right texts prove no more than 1 - 1 / (n + 2): the rest is spread over the languages
        doubt = 1 / (len(held) + 2)
        wanted = np.full(logits.shape, doubt / len(languages))
        wanted[np.arange(len(right)), right] += 1 - doubt
        loss = [-(wanted * _log_softmax(logits / t)).sum(axis=1).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        best = _finite("probabilities", _softmax(logits / temperature).max(axis=1))
        level = float(min(settings.most_level, np.quantile(best, settings.false_rejections)))
    return Model(languages, scores, bias.astype(float), temperature, level, settings.bits)


def fit_languages(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Trains on a bounded sample of the rows of ``docs`` that have a text and a lang.

    The sample has the rows of each language with the smallest hashes of doc_id. Hashes under
    a bound that leaves a little more than the sample are ranked, so few rows of a language
    meet in a task, whatever its size. Whole texts are reduced to bucket counts on the
    executors: a long text brings no more than ``2 ** bits`` counts to the driver.
    """
    named = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    common = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") * F.lit(2.0**-53)
    # 12 standard deviations over the rows wanted: fewer are never left
    wanted = settings.per_language + 12 * settings.per_language**0.5 + 72
    drawn = named.select("doc_id", "lang").join(F.broadcast(common), "lang").withColumn("draw", draw).where(F.col("draw") * F.col("count") <= wanted)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    ids = drawn.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= settings.per_language).select("doc_id", "lang")
    bits = settings.bits

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [bucket_counts(text or b"", bits) for text in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))],
            ["doc_id", "lang", "at", "n"],
        )

    # at most languages * per_language ids: a proven bound
    sample = map_batches(named.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text"), counts, "doc_id bigint, lang string, at array<int>, n array<int>").toArrow()
    sample = sample.combine_chunks()
    ids, langs = sample.column(0).to_pylist(), sample.column(1).to_pylist()
    at, n = lists_of(sample.column(2)), lists_of(sample.column(3))
    rows = [(langs[i], at[i], n[i]) for i in sorted(range(len(ids)), key=lambda i: (ids[i], langs[i], len(at[i])))]
    model = train(rows, settings)
    del sample, at, n, rows
    pa.default_memory_pool().release_unused()
    return model


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Columns lang_pred, score and rejected beside doc_id, from the whole text alone.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter, or when
    nothing was learned. ``rejected`` holds for those and for scores under the model's level.
    Repeated rows give a row each; an empty table an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * languages floats

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        values = batch.column(1).to_pylist()
        known = [bool(model.languages) and has_letter(v) for v in values]
        p = model.probabilities([v.encode() if k else b"" for v, k in zip(values, known, strict=True)]) if model.languages else np.zeros((len(values), 1))
        best, score = p.argmax(axis=1), p.max(axis=1)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]),
                pa.array([float(min(1.0, s)) if k else 0.0 for s, k in zip(score, known, strict=True)], pa.float64()),
                pa.array([not k or bool(s < model.level) for s, k in zip(score, known, strict=True)]),
            ],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * languages floats
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        values = batch.column(at).to_pylist()
        known = np.array([bool(model.languages) and has_letter(v) for v in values], bool)
        p = model.probabilities([v.encode() if k else b"" for v, k in zip(values, known, strict=True)]) if model.languages else np.zeros((len(values), 1))
        return batch.filter(pa.array(known & (p.max(axis=1) >= model.level)))

    return map_batches(docs, run, docs.schema)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(remainder(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify_languages(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "rejected")
