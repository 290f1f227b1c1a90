"""Toxic spans by a linear-chain conditional random field over words.

Labels come for whole documents, so the labelled tokens are derived: in the learning sample
a word counts as toxic where it stands in toxic documents far more often than elsewhere.
The field learns from word, prefix and suffix features and so reaches words it never met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import one_label, sampled
from .tables import fold_of, map_batches, row_blocks, text_bytes
from .words import LETTER_CUT, LOWER, find_words, hash_words, joined_hash


@dataclass(frozen=True)
class Field:
    """Parameters of the field; sample_rows bounds the labelled documents it learns from."""

    bits: int = 18
    segment: int = 32  # words worked on at a time; learning takes them as chains, tagging carries messages over them
    rate: float = 0.5
    l2: float = 1e-6
    epochs: int = 6
    batch: int = 500  # chains of one update
    learners: int = 4
    sample_rows: int = 16_000
    least_docs: int = 5  # toxic documents that a word must stand in to be labelled
    least_odds: float = 20.0
    clean_chains: int = 20  # chains without a toxic word for each with one, in each epoch


#: Bytes from the start (positive) or the end (negative) of a word that make a feature; 0: the whole word.
PARTS = (0, 4, 5, 6, -3)


def token_features(raw: np.ndarray, offsets: np.ndarray, bits: int):
    """Starts, ends and rows of the words, their hashes and their bins of each feature."""
    raw = LOWER[raw]
    starts, ends, rows = find_words(raw, offsets, LETTER_CUT)
    bins, words = [], None
    for kind, part in enumerate(PARTS):
        a = np.maximum(starts, ends + part) if part < 0 else starts
        b = np.minimum(ends, starts + part) if part > 0 else ends
        hashes = hash_words(raw, a, b)
        words = hashes if part == 0 else words
        hashes = joined_hash(hashes, np.full(len(hashes), kind, np.uint64))
        bins.append((hashes >> np.uint64(64 - bits)).astype(np.int64))
    return starts, ends, rows, words, np.array(bins).reshape(len(PARTS), -1)


def chains(rows: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain of each word, its place there, and the number of chains; no chain reaches over documents."""
    if not len(rows):
        return rows, rows, 0
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    within = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
    place = within % segment
    chain = np.cumsum(place == 0) - 1
    return chain, place, int(chain[-1]) + 1


def messages(emission: np.ndarray, present: np.ndarray, links: np.ndarray, first: np.ndarray):
    """What reaches each segment from the words before it and after it in its text.

    first: the first segment of each text; its segments follow.  The paths through a segment are a
    2 x 2 matrix, so a text of any length needs one product for each segment and direction.
    """
    count, size = emission.shape
    e, t = np.exp(np.clip(emission, -30, 30)), np.exp(links)
    through = np.zeros((count, 2, 2))
    through[:, 0, 0], through[:, 1, 1] = 1, e[:, 0]
    for k in range(1, size):
        on = np.flatnonzero(present[:, k])
        step = through[on] @ t
        step[:, :, 1] *= e[on, k, None]
        through[on] = step / step.sum((1, 2), keepdims=True)
    before, after = np.ones((count, 2)), np.ones((count, 2))
    parts = np.diff(np.append(first, count))
    for j in range(1, parts.max(initial=0)):
        own = first[parts > j] + j
        come = np.einsum("ni,nij->nj", before[own - 1], through[own - 1]) @ t
        before[own] = come / come.sum(1, keepdims=True)
        own = (first + parts)[parts > j] - j
        go = np.einsum("nij,nj->ni", through[own], after[own]) @ t.T
        after[own - 1] = go / go.sum(1, keepdims=True)
    return before, after


def marginals(emission: np.ndarray, present: np.ndarray, links: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Forward-backward over padded chains.

    emission: chains x places, score of state 1 over state 0.  links: 2 x 2 transition scores.
    before, after: messages from the rest of a text of which a chain is a part.
    Returns the probability of state 1 everywhere and the expected transitions of each kind.
    """
    count, size = emission.shape
    e, t = np.exp(np.clip(emission, -30, 30)), np.exp(links)
    forward = np.empty((size, 2, count))
    state0, state1 = (np.ones(count), e[:, 0]) if before is None else (before[:, 0], before[:, 1] * e[:, 0])
    for k in range(size):
        if k:
            state0, state1 = state0 * t[0, 0] + state1 * t[1, 0], (state0 * t[0, 1] + state1 * t[1, 1]) * e[:, k]
        total = state0 + state1
        state0, state1 = state0 / total, state1 / total
        forward[k] = state0, state1
    probability, expected = np.zeros((count, size)), np.zeros((2, 2))
    back0, back1 = (np.ones(count), np.ones(count)) if after is None else (after[:, 0], after[:, 1])
    for k in range(size - 1, -1, -1):
        if k < size - 1:
            on = present[:, k + 1]
            go = np.array([back0, back1 * e[:, k + 1]])
            pairs = forward[k][:, None, :] * t[:, :, None] * go[None, :, :]
            expected += (pairs / pairs.sum((0, 1)) * on).sum(2)
            new0, new1 = t[0, 0] * go[0] + t[0, 1] * go[1], t[1, 0] * go[0] + t[1, 1] * go[1]
            total = new0 + new1
            back0, back1 = np.where(on, new0 / total, 1.0), np.where(on, new1 / total, 1.0)
        joint0, joint1 = forward[k, 0] * back0, forward[k, 1] * back1
        probability[:, k] = joint1 / (joint0 + joint1)
    return probability * present, expected


def word_labels(words: np.ndarray, rows: np.ndarray, toxic: np.ndarray, p: Field) -> np.ndarray:
    """True for words in toxic documents that are far more frequent there than elsewhere."""
    kinds, number = np.unique(words, return_inverse=True)
    seen = np.unique(rows * len(kinds) + number)
    there = np.bincount(seen % len(kinds), toxic[seen // len(kinds)], len(kinds))
    elsewhere = np.bincount(seen % len(kinds), ~toxic[seen // len(kinds)], len(kinds))
    odds = (there + 0.5) / max(toxic.sum(), 1) / ((elsewhere + 0.5) / max((~toxic).sum(), 1))
    return ((there >= p.least_docs) & (odds >= p.least_odds))[number] & toxic[rows]


def no_field(p: Field) -> np.ndarray:
    """Weights before any learning."""
    weights = np.zeros((1 << p.bits) + 5)
    weights[-5] = -3.0
    return weights


def document_marginals(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, p: Field):
    """Starts, ends and rows of the words, and each word's probability of being toxic given its whole text."""
    starts, ends, rows, _, bins = token_features(raw, offsets, p.bits)
    chain, place, count = chains(rows, p.segment)
    emission, present = np.zeros((count, p.segment)), np.zeros((count, p.segment), bool)
    emission[chain, place] = weights[bins].sum(0) + weights[-5]
    present[chain, place] = True
    if not count:
        return starts, ends, rows, np.zeros(0)
    links, heads = weights[-4:].reshape(2, 2), rows[np.flatnonzero(place == 0)]
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    probability = marginals(emission, present, links, *messages(emission, present, links, first))[0]
    return starts, ends, rows, probability[chain, place]


def evidence(rows: np.ndarray, probability: np.ndarray, count: int) -> np.ndarray:
    """What a document's score is made of: a constant, the largest log odds, the number of words found."""
    most = np.zeros(count)
    np.maximum.at(most, rows, probability)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    found = np.bincount(rows, probability * (probability >= 0.5), count)
    return np.stack([np.ones(count), np.log(most / (1 - most)), np.log1p(found)], 1)


def calibrated(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression, lightly penalised, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (q - y) + 0.1 * w)
    return w


def train_field(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, p: Field) -> np.ndarray:
    """Weights of the bins, of the constant, and the four transitions, by AdaGrad on the likelihood."""
    weights = no_field(p)
    squares = np.full(len(weights), 1e-8)
    _, _, rows, words, bins = token_features(raw, offsets, p.bits)
    if not len(rows) or not toxic.any():
        return weights
    labels = word_labels(words, rows, toxic, p)
    chain, place, count = chains(rows, p.segment)
    at = np.searchsorted(chain, np.arange(count + 1))
    marked = np.flatnonzero(np.bincount(chain, labels, count) > 0)
    order = np.random.default_rng(0)
    for _ in range(p.epochs):
        # all chains with a toxic word and a multiple of others, drawn anew each time
        clean = np.setdiff1d(np.arange(count), marked)
        picked = order.permutation(np.concatenate([marked, order.choice(clean, min(len(clean), p.clean_chains * len(marked) + 500), replace=False)]))
        for first in range(0, len(picked), p.batch):
            own = np.sort(picked[first : first + p.batch])
            sizes = at[own + 1] - at[own]
            words_at = np.repeat(at[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            row, column = np.repeat(np.arange(len(own)), sizes), place[words_at]
            emission, present, y = np.zeros((len(own), p.segment)), np.zeros((len(own), p.segment), bool), np.zeros((len(own), p.segment), np.int64)
            emission[row, column] = weights[bins[:, words_at]].sum(0) + weights[-5]
            present[row, column], y[row, column] = True, labels[words_at]
            probability, expected = marginals(emission, present, weights[-4:].reshape(2, 2))
            off = (probability - y)[row, column] / len(own)
            gradient = np.bincount(bins[:, words_at].ravel(), np.tile(off, len(PARTS)), len(weights))
            gradient[-5] = off.sum()
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][present[:, 1:]], y[:, 1:][present[:, 1:]]), 1)
            gradient[-4:] = ((expected - seen) / len(own)).ravel()
            gradient += p.l2 * weights
            squares += gradient**2
            weights -= p.rate * gradient / np.sqrt(squares)
    return weights


def _scattered(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def train_toxicity(docs: DataFrame, labels: DataFrame, parameters: Field = Field()) -> np.ndarray:
    """Averaged weights of a few learners, each over its part of the bounded sample."""
    p = parameters
    sample = sampled(labels, p.sample_rows, p.learners)

    def learn(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(_scattered(part.column("doc_id").to_numpy()), kind="stable")))
        raw, offsets = text_bytes(part.column("text").combine_chunks())
        # three rows of four teach the field, the others its calibration
        toxic, cut = part.column("label").to_numpy().astype(bool), part.num_rows * 3 // 4
        first = offsets[cut]
        field = train_field(raw[:first], offsets[: cut + 1], toxic[:cut], p)
        _, _, rows, probability = document_marginals(raw[first:], offsets[cut:] - first, field, p)
        weights = np.append(field, calibrated(evidence(rows, probability, part.num_rows - cut), toxic[cut:]))
        at = np.append(np.flatnonzero(weights), len(weights))
        return pa.table({"bin": pa.array(at, pa.int64()), "weight": np.append(weights, 1.0)[at]})

    learned = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("learner")
        .applyInArrow(learn, "bin long, weight double")
        .groupBy("bin")
        .agg(F.sum("weight").alias("weight"))
        .toPandas()  # at most one row for each bin
    )
    weights = np.zeros((1 << p.bits) + 9)
    weights[learned["bin"].to_numpy(np.int64)] = learned["weight"].to_numpy()
    return weights[:-1] / weights[-1] if weights[-1] else np.append(no_field(p), [0.0, 1.0, 0.0])


def tag_toxicity(docs: DataFrame, weights: np.ndarray, p: Field = Field(), span_at: float = 0.5) -> DataFrame:
    """doc_id, score and spans of every whole text.

    The chain runs over the whole text, so marginals don't depend on where in it a span stands.
    The score comes from the largest marginal of a word and the number of words found.  spans
    lists the words of a marginal of at least span_at as start:end in code points,
    comma-joined.  Texts without a word, and null, have the lowest score and no span.
    """
    field, calibration = weights[:-3].astype(np.float32), weights[-3:]

    def tag(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        scores, spans = np.zeros(batch.num_rows), [""] * batch.num_rows
        for a, b in row_blocks(offsets):
            own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, rows, probability = document_marginals(own, at, field, p)
            scores[a:b] = 1 / (1 + np.exp(-evidence(rows, probability, b - a) @ calibration))
            before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points
            for k in np.flatnonzero(probability >= span_at).tolist():
                row = rows[k]
                span = f"{before[starts[k]] - before[at[row]]}:{before[ends[k]] - before[at[row]]}"
                spans[a + row] = f"{spans[a + row]},{span}" if spans[a + row] else span
        return pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    return map_batches(docs.select("doc_id", "text"), tag, "doc_id long, score double, spans string")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, parameters: Field = Field()) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document.

    Rows of the fold with crc32(doc_id) mod 5 = 0 are never learned from.  Without a toxic
    label all words score as the constant does.  Repeated rows get equal scores.
    """
    known = one_label(labels, "toxic").where(fold_of(F.col("doc_id"), 5) != 0)
    weights = train_toxicity(docs, known, parameters)
    return tag_toxicity(docs, weights, parameters).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )
