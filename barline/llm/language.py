"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1.  A three-letter sequence is the product of
the letters' vectors, the first rotated twice and the second once; a text is the sum of its
sequences; a language is the sum of its texts.  The nearest language by cosine wins.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BLOCK_BYTES, fold_of, map_batches
from .words import mixed

DIMENSIONS = 1024
SCORES = "doc_id long, lang_pred string, score double"


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_vectors(letters: np.ndarray, size: int) -> np.ndarray:
    """-1 and 1 at random, fixed for each code point; 0 stands for a gap between words."""
    seeds = letters.astype(np.uint64)[:, None] << np.uint64(16) | np.arange(size // 64, dtype=np.uint64)
    bits = np.unpackbits(mixed(mixed(seeds)).view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every run of three letters or gaps; rows without a letter have none.

    Letters are lower-cased; anything else is a gap, several are one, and each text begins
    and ends with one.  A key holds three code points of 21 bits.
    """
    parts = [f" {t.lower()} " if t else "" for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(parts)), sizes)
    points = np.where(_is_letter()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0) | (rows[1:] != rows[:-1])
    points, rows = points[keep], rows[keep]
    whole = rows[2:] == rows[:-2]
    return rows[2:][whole], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[whole]


def key_vectors(keys: np.ndarray, size: int) -> np.ndarray:
    """The vectors of sequences."""
    letters, place = np.unique(np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]), return_inverse=True)
    vectors, place = letter_vectors(letters, size), place.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[place[0]] * np.roll(vectors, 1, axis=1)[place[1]] * vectors[place[2]]


def text_vectors(texts: list[str | None], size: int) -> np.ndarray:
    """One vector for each text; zeros where there is no letter."""
    rows, keys = sequences(texts)
    kinds, number = np.unique(keys, return_inverse=True)
    out = np.zeros((len(texts), size), np.float32)
    if not len(kinds):
        return out
    vectors = key_vectors(kinds, size)
    step = max(1, (16 << 20) // len(kinds) // 4)  # texts whose counts fill 16 MB
    for a in range(0, len(texts), step):
        own = slice(*np.searchsorted(rows, [a, a + step]))
        count = min(step, len(texts) - a)
        counts = np.bincount((rows[own] - a) * len(kinds) + number[own], minlength=count * len(kinds))
        out[a : a + count] = counts.reshape(count, -1).astype(np.float32) @ vectors
    return out


def _blocks(batch: pa.RecordBatch):
    texts, first, size = batch.column("text").to_pylist(), 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_BYTES or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0


def train_profiles(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors, from all rows with a lang.

    Counts of sequences are summed by language first, so a text of any length and a language
    of any share of the rows are reduced before the shuffle.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column("lang").dictionary_encode()
        names, of_row = langs.dictionary, np.asarray(langs.indices, np.int64)
        found = []
        for first, texts in _blocks(batch):
            rows, keys = sequences(texts)
            kinds, number = np.unique(keys, return_inverse=True)
            sums = np.bincount(of_row[rows + first] * len(kinds) + number, minlength=len(names) * len(kinds))
            at = np.flatnonzero(sums)
            if len(at):
                found.append((at // len(kinds), kinds[at % len(kinds)], sums[at]))
        if not found:
            return None
        lang, key, total = (np.concatenate(x) for x in zip(*found))
        return pa.record_batch([names.take(pa.array(lang)), pa.array(key, pa.int64()), pa.array(total, pa.int64())], ["lang", "key", "n"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            n = batch.column("n").to_numpy().astype(float)
            vectors = key_vectors(batch.column("key").to_numpy(), dimensions)
            for name in set(lang.tolist()):
                own = lang == name
                sums[name] = sums.get(name, 0) + n[own] @ vectors[own]
        for name, vector in sums.items():
            yield pa.record_batch([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], ["lang", "place", "x"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = map_batches(known, count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rows = counts.mapInArrow(bundle, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    learned = rows.toPandas()  # one row for each language and dimension
    names = sorted(set(learned["lang"]))
    profiles = np.zeros((len(names), dimensions))
    profiles[learned["lang"].map(names.index).to_numpy(int), learned["place"].to_numpy(int)] = learned["x"].to_numpy()
    return names, profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)


def predict_language(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    The score is the cosine moved into 0 to 1.  A text that is null or has no letter, and any
    text when no language was learned, is "und" with score 0; of equal languages the first
    by name wins.
    """
    profiles = profiles.astype(np.float32)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        for _, texts in _blocks(batch):
            vectors = text_vectors(texts, profiles.shape[1])
            length = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ profiles.T / np.maximum(length, 1e-12)[:, None]
            letters = _has_letter(texts)
            for k in range(len(texts)):
                known = letters[k] and len(names)
                langs.append(names[int(cosines[k].argmax())] if known else "und")
                scores.append(min(1.0, max(0.0, (1 + float(cosines[k].max())) / 2)) if known else 0.0)
        return pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), predict, SCORES)


def _has_letter(texts: list[str | None]) -> list[bool]:
    return [bool(t) and any(map(str.isalpha, t)) for t in texts]


def languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Rows of the fold with crc32(doc_id) mod 4 = 2 are never learned from.  Repeated rows count
    each in learning and get equal predictions.
    """
    held_out = fold_of(F.col("doc_id"), 4) == 2
    names, profiles = train_profiles(docs.where(~held_out), dimensions)
    found = predict_language(docs, names, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
