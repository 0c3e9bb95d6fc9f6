"""Operator 4: toxicity scores by FTRL-proximal logistic regression.

Features are presence of hashed word 1-grams, word stems (first ``STEM`` bytes),
2-grams and skip-grams (two words with one between) in ``2**bits`` coordinates.
Every coordinate has its own learning rate, and L1 leaves most of them at zero,
so the weights are a compact list that is broadcast (its size has the bound
``2**bits``). Training runs in one task over at most ``max_train`` labelled texts,
a documented bound taken by hash; scoring is a map over all whole texts.

Defined results: a null or empty text gets the score of the bias; a null id is
never held out and carries no label; of several labels for one id the largest
counts, a null label is none; of rows that repeat an id one text is learned from;
without labels every score is 0; repeated rows get
equal scores. Only ids, texts and labels are read, and only texts make scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS, STEM, MAX_TRAIN, EPOCHS = 20, 4, 16_384, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.5
THRESHOLD = 0.3


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, bits: int):
    """Yield (coordinates, rows) of each feature family over the words of a chunk."""
    hashed = K.word_hashes(data, starts, ends, lower=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = K.U64(64 - bits)
    yield hashed >> shift, row
    stems = K.word_hashes(data, starts, np.minimum(ends, starts + STEM), lower=True)
    yield K.mix(stems + K.U64(1)) >> shift, row
    for gap, salt in ((1, 3), (2, 5)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        pair = K.mix(hashed[: len(same)] * K.U64(salt * 0x9E3779B1 | 1) + K.mix(hashed[gap:] + K.U64(salt)))
        yield pair[same] >> shift, row[: len(same)][same]


def _encoded(bits: int):
    """(id, label, packed sorted coordinates) of labelled texts."""

    def rows(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                starts, ends, first = K.words(data, offsets)
                coords, rows_ = zip(*_features(data, starts, ends, first, bits), strict=True)
                key = np.unique((np.concatenate(rows_).astype(np.int64) << bits) | np.concatenate(coords).astype(np.int64))
                cut = np.searchsorted(key >> bits, np.arange(hi - lo + 1))
                feats = (key & ((1 << bits) - 1)).astype(np.int32)
                out.extend(feats[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo))
            if batch.num_rows:
                yield pa.record_batch([batch.column("turn"), batch.column("label"), pa.array(out, pa.binary())], ["turn", "label", "feats"])

    return rows


def ftrl(examples: list[tuple[int, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (the last is the bias) after ``epochs`` passes over (label, coordinates)."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for label, at in examples:
            at = np.append(at, size - 1)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] = ni + g * g
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero, learned from ``docs(id, text)`` and ``labels(id, label)``."""
    known = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("turn", F.xxhash64(F.lit("turn"), F.col("id")))
    total = known.count()
    share = min(1.0, max_train / max(total, 1))
    # max_train ids at most, so the broadcast has a bound, and no more texts: of rows that repeat an id the one of least hash
    some = known.where(F.pmod(F.xxhash64(F.lit("train"), F.col("id")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("turn").limit(max_train)
    texts = docs.join(F.broadcast(some), "id").groupBy("turn", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    encoded = texts.mapInArrow(_encoded(bits), "turn long, label int, feats binary")

    def fit(batches):
        got = []
        for batch in batches:
            got.extend(zip(batch.column("turn").to_pylist(), batch.column("label").to_pylist(), batch.column("feats").to_pylist(), strict=True))
        got.sort()
        w = ftrl([(y, np.frombuffer(x, np.int32)) for _, y, x in got], bits, epochs, ALPHA, BETA, L1, L2)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(w[at])], ["at", "w"])

    got = encoded.repartition(1).mapInArrow(fit, "at long, w double").toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def _scorer(weights: tuple[np.ndarray, np.ndarray], bits: int):
    """A function from a text column to its scores."""
    dense = np.zeros((1 << bits) + 1)
    dense[weights[0]] = weights[1]
    used = dense != 0

    def score(column: pa.Array) -> np.ndarray:
        if len(weights[0]) == 0:
            return np.zeros(len(column))
        total = np.full(len(column), dense[-1])
        for lo, hi, data, offsets in K.chunks(column):
            starts, ends, first = K.words(data, offsets)
            keys = []
            for coords, row in _features(data, starts, ends, first, bits):
                hit = used[coords]
                keys.append((row[hit].astype(np.int64) << bits) | coords[hit].astype(np.int64))
            key = np.unique(np.concatenate(keys))
            total[lo:hi] += np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=hi - lo)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))

    return score


def score_texts(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """``docs(id, text)`` as (id, score)."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        score = _scorer(held.value, bits)
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(score(batch.column("text")))], ["id", "score"])

    return docs.mapInArrow(rows, f"id {docs.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")))
    return train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    weights = fit_toxicity(docs, labels, id_col, text_col)
    scored = score_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), weights)
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _scorer(held.value, BITS)
        for text in texts:
            yield pd.Series(of(pa.Array.from_pandas(text, type=pa.string())))

    return docs.where(score(F.col(text_col)) < threshold)
