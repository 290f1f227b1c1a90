"""Document quality: logistic regression on hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fold_of, map_batches, row_blocks, text_bytes
from .words import SIGN_CUT, find_words, hash_words, joined_hash


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the classifier; sample_rows bounds the labelled rows it learns from."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 3
    learners: int = 4
    sample_rows: int = 12_000


def sparse_rows(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bin and value of the hashed one- and two-word features; each row has length 1.

    Words are runs of letters and digits or runs of signs, case kept.  A word after itself
    gives one common feature, so repetition shows whatever is repeated.
    """
    starts, ends, rows = find_words(raw, offsets, SIGN_CUT)
    if not len(starts):
        return rows, rows, np.zeros(0)
    words = hash_words(raw, starts, ends)
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), joined_hash(words[:-1], words[1:]))
    within = rows[1:] == rows[:-1]
    hashes = np.concatenate([words, pairs[within]])
    keys = np.concatenate([rows, rows[1:][within]]) << bits | (joined_hash(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    rows, bins, values = keys >> bits, keys & (1 << bits) - 1, np.log1p(counts)
    length = np.sqrt(np.bincount(rows, values**2, len(offsets) - 1))
    return rows, bins, values / length[rows]


def train_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], p: Ftrl) -> np.ndarray:
    """Weights after several passes over (label, bins, values); the last weight is the constant."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= p.l1, 0.0, -(own - np.sign(own) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for label, bins, values in examples:
            at, x = np.append(bins, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    return weights(np.arange(size))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id and label 0 or 1; of labels that disagree the more frequent, 1 if even; nulls are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg((F.col(name) > 0).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def sampled(labels: DataFrame, most: int, learners: int) -> DataFrame:
    """About so many of the rows at most, chosen by a hash of the id, and dealt to learners of 2,000 rows or more."""
    total = labels.count()
    share = min(1 << 20, (most << 20) // max(total, 1))
    learners = max(1, min(learners, min(total, most) // 2000))
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return some.withColumn("learner", F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(learners)))


def train_quality(docs: DataFrame, labels: DataFrame, parameters: Ftrl = Ftrl()) -> np.ndarray:
    """Weights learned from labelled texts; zeros when there are none.

    Each of a few learners passes over its part of the sample, and their weights
    are averaged.  Only the bounded sample of ids is broadcast; texts stay where they are read.
    """
    p = parameters
    sample = sampled(labels, p.sample_rows, p.learners)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        bins, values = [], []
        for a, b in row_blocks(offsets):
            rows, own, x = sparse_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.bits)
            cuts = np.searchsorted(rows, np.arange(1, b - a))
            bins += np.split(own, cuts)
            values += np.split(x, cuts)
        arrays = [batch.column("doc_id"), batch.column("label"), batch.column("learner"), pa.array(bins, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
        return pa.record_batch(arrays, ["doc_id", "label", "learner", "bins", "values"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = map_batches(texts, features, "doc_id long, label int, learner long, bins array<int>, values array<double>")

    def learn(part: pa.Table) -> pa.Table:
        ids, marks = (part.column(c).to_pylist() for c in ("doc_id", "label"))
        bins, values = (part.column(c).combine_chunks() for c in ("bins", "values"))
        cuts = bins.offsets.to_numpy()
        cuts, bins, values = cuts - cuts[0], bins.flatten().to_numpy(), values.flatten().to_numpy()
        rows = [(i, y, bins[a:b], values[a:b]) for i, y, a, b in zip(ids, marks, cuts, cuts[1:])]  # views of the columns
        # mixed, and the same in every run
        rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1], r[2].tobytes(), r[3].tobytes()))
        weights = train_ftrl([r[1:] for r in rows], p)
        at = np.append(np.flatnonzero(weights), len(weights))  # the last row counts the learner
        return pa.table({"bin": pa.array(at, pa.int64()), "weight": np.append(weights, 1.0)[at]})

    learned = (
        rows.groupBy("learner")
        .applyInArrow(learn, "bin long, weight double")
        .groupBy("bin")
        .agg(F.sum("weight").alias("weight"))
        .toPandas()  # at most one row for each bin
    )
    weights = np.zeros((1 << p.bits) + 2)
    weights[learned["bin"].to_numpy(np.int64)] = learned["weight"].to_numpy()
    return weights[:-1] / max(weights[-1], 1.0)


def text_scores(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    """Scores of a column of texts; null and empty texts score by the constant alone."""
    raw, offsets = text_bytes(texts)
    scores = np.zeros(len(texts))
    for a, b in row_blocks(offsets):
        rows, bins, values = sparse_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
        scores[a:b] = np.bincount(rows, weights[bins] * values, b - a)
    return 1 / (1 + np.exp(-scores - float(weights[-1])))


def score_quality(docs: DataFrame, weights: np.ndarray, bits: int = Ftrl.bits) -> DataFrame:
    """doc_id and score of every whole text."""
    small = weights.astype(np.float32)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(text_scores(batch.column("text"), small, bits))
        return pa.record_batch([batch.column("doc_id"), scores], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), score, "doc_id long, score double")


def learned_from(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fold."""
    return one_label(labels, "quality").where(fold_of(F.col("doc_id"), 5) != 0)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parameters: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Rows of the fold with crc32(doc_id) mod 5 = 0 are never learned from.  Without any
    label all scores are 0.5.  Repeated rows get equal scores.
    """
    weights = train_quality(docs, learned_from(labels), parameters)
    return score_quality(docs, weights, parameters.bits).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, bits: int = Ftrl.bits) -> DataFrame:
    """docs whose text scores at least the threshold, all columns kept; nothing is shuffled."""
    small = weights.astype(np.float32)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(text_scores(batch.column("text"), small, bits) >= threshold))

    return map_batches(docs, keep, docs.schema)
