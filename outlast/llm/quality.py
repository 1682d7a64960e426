"""Quality of documents by logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, fold_of, hashed_words, pair_hash, text_column, text_slices

BITS = 18
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


@dataclass
class QualityModel:
    """Weights of 2^bits hashed n-grams and one more for the bias; ``trained`` is False without labels."""

    weights: np.ndarray
    trained: bool


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text: words and word pairs, root counts scaled to unit length, and a bias."""
    hashes, starts = hashed_words(texts)
    shift = np.uint64(64 - bits)
    ones = (hashes * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    twos = (pair_hash(hashes[:-1], hashes[1:]) >> shift).astype(np.int64) if len(hashes) > 1 else ones[:0]
    bias = np.array([1 << bits]), np.array([1.0])
    for low, high in zip(starts[:-1], starts[1:]):
        slots, counts = np.unique(np.concatenate((ones[low:high], twos[low:max(low, high - 1)])), return_counts=True)
        values = np.sqrt(counts)
        norm = np.sqrt(counts.sum()) or 1.0
        yield np.concatenate((slots, bias[0])), np.concatenate((values / norm, bias[1]))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 4,
               alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.001, seed: int = 3) -> np.ndarray:
    """Per-coordinate FTRL-proximal on log loss, one row at a time."""
    z, n, w = (np.zeros((1 << bits) + 1) for _ in range(3))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            slots, values = rows[i]
            zi, ni = z[slots], n[slots]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ values, -35, 35)))
            g = (p - labels[i]) * values
            more = ni + g * g
            z[slots] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * wi
            n[slots] = more
    np.divide(-(z - np.sign(z) * l1), (beta + np.sqrt(n)) / alpha + l2, out=w, where=np.abs(z) > l1)
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 8192, bits: int = BITS, **training) -> QualityModel:
    """Learn ``labels.quality`` (0 or 1) from labelled rows with crc32(doc_id as text) mod 4 other than 2.

    The sample is bounded: of the labels whose documents are in ``docs``, the ``most`` of smallest hash. It
    is small enough to be sent to every task that reads the texts, and one task does the updates.
    """
    sample = (labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
              .select("doc_id", F.col("quality").cast("int").alias("quality"))
              .join(docs.select("doc_id"), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            slots, values = zip(*features(text_column(batch), bits)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "quality"), pa.array(list(slots), pa.list_(pa.int32())),
                 pa.array(list(values), pa.list_(pa.float32()))], ["doc_id", "quality", "slots", "weights"])

    found = chosen.mapInArrow(extract, "doc_id bigint, quality int, slots array<int>, weights array<float>")

    def learn(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
        rows = [(np.asarray(s, np.int64), np.asarray(v, float))
                for s, v in zip(table["slots"].to_numpy(), table["weights"].to_numpy())]
        w = train_ftrl(rows, table["quality"].to_numpy(), bits, **training)
        return pa.table({"model": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    model = found.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "model binary").first()
    if model is None:
        return QualityModel(np.zeros((1 << bits) + 1, np.float32), False)
    return QualityModel(np.frombuffer(model["model"], "<f4"), True)


def score_batch(model: QualityModel, texts: pa.Array) -> np.ndarray:
    bits = (len(model.weights) - 1).bit_length() - 1
    dots = np.array([float(model.weights[slots] @ values) for slots, values in features(texts, bits)])
    return 1 / (1 + np.exp(-np.clip(dots, -35, 35)))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts get the score of the bias alone (0.5 without labels). A null doc_id is
    kept and not held out; repeated rows get equal results; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            scores = score_batch(model, text_column(batch))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(
        score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns; all rows if untrained."""
    if not model.trained:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(score_batch(model, text_column(batch)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
