"""Benchmark passages in documents, found by spaced seeds and confirmed along their alignment.

A seed mask picks some of several consecutive words and ignores the others.  The masks are
chosen so that every 16 words with at most three of them replaced keep one mask's words
intact (a test tries all cases), so no such overlap is missed.  Hashes under the masks meet
in a join of documents and test items; each alignment that a hit gives is then compared word
by word.  Items of 8 to 15 words bear one or two replaced or cut-off words and have shorter masks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Scratch
from .tables import map_batches, row_blocks, text_bytes
from .words import LETTER_CUT, LOWER, find_words, hash_words, joined_hash

#: Found by a greedy search over all masks of six words.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 8, 10, 11), (0, 1, 2, 4, 5, 6))
#: For items of 8 to 11 words with any one of them gone, and of 12 to 15 words with any two (tested likewise).
SHORT_MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))


@dataclass(frozen=True)
class Overlap:
    """An overlap is window words of which least are equal; items of fewer than exact_below words
    must occur whole.  With exact_below under window, items between the two miss one word, from
    12 words on two, and where a text begins or ends inside a longer item, least equal words suffice."""

    window: int = 16
    least: int = 13
    exact_below: int = 16
    filter_bits: int = 24  # of a bitmap of test hashes that all tasks get, whatever the number of items
    broadcast_bytes: int = 32 << 20  # of alignments to confirm; more are joined by a shuffle

    def least_of(self, n: int) -> int:
        """Equal words that an overlap with an item of n words needs."""
        return self.least if n >= self.window else n if n < self.exact_below else n - max(n // 4 - 1, 0)


#: What the query and the pipeline look for.
TOLERANT = Overlap(exact_below=8)

def word_hashes(raw: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows and hashes of the words: runs of letters and digits, A-Z lower-cased."""
    raw = LOWER[raw]
    starts, ends, rows = find_words(raw, offsets, LETTER_CUT)
    return starts, ends, rows, hash_words(raw, starts, ends)


def shapes_of(lengths: list[int], p: Overlap) -> list[tuple[int, tuple[int, ...]]]:
    """Number and mask of every seed for items of the given lengths; exact ones are their whole length without gaps."""
    out = []
    if any(n >= p.window for n in lengths):
        out += list(enumerate(MASKS))
    if any(p.exact_below <= n < p.window for n in lengths):
        out += list(enumerate(SHORT_MASKS, 50))
    return out + [(100 + n, tuple(range(n))) for n in lengths if n < min(p.window, p.exact_below)]


def seeds(rows: np.ndarray, words: np.ndarray, shapes: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and hash of each seed under the given masks."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for kind, mask in shapes:
        count = len(words) - mask[-1]
        if count <= 0:
            continue
        first = np.flatnonzero(rows[:count] == rows[mask[-1] :])
        at.append(first)
        hashes.append(joined_hash(np.full(len(first), kind, np.uint64), *(words[first + k] for k in mask)))
    return np.concatenate(at), np.concatenate(hashes)


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n and words (bytes of 64-bit hashes) of each test item."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        _, _, rows, words = word_hashes(raw, offsets)
        parts = np.split(words, np.searchsorted(rows, np.arange(1, batch.num_rows)))
        return pa.record_batch(
            [batch.column("item"), batch.column("item_id"), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["item", "item_id", "n", "words"],
        )

    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), "text").dropDuplicates(["item"])
    return map_batches(items, read, "item long, item_id long, n long, words binary").where("n > 0")


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """key, doc_id, item_id, matched, start and end of each item found in each document.

    key is a hash of id and text, so null and repeated ids are told apart.  matched counts equal
    words in the overlap, start and end are its code points in the document; of several overlaps
    with an item the one with most equal words counts, then the first.  Null, empty and wordless
    texts overlap with nothing.  Extra columns are not read.
    """
    scratch = Scratch(spark)
    items = scratch.write(_items(benchmark))
    lengths = [r.n for r in items.select(F.least("n", F.lit(p.window)).alias("n")).distinct().collect()]  # window numbers at most
    shapes = shapes_of(lengths, p)

    def item_seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
            words = np.frombuffer(raw, np.uint64)
            at, hashes = seeds(np.zeros(len(words), np.int64), words, shapes_of([len(words)], p))
            found.append((np.full(len(at), item), at, hashes.view(np.int64)))
        item, at, hashes = (np.concatenate(x) for x in zip(*found))
        return pa.record_batch([pa.array(hashes), pa.array(item), pa.array(at, pa.int64())], ["hash", "item", "place"])

    tests = scratch.write(map_batches(items.select("item", "words"), item_seeds, "hash long, item long, place long"))
    slot = F.shiftrightunsigned("hash", 64 - p.filter_bits)
    marks = tests.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - p.filter_bits}) & 63 as int))")).alias("bits"))
    marks = marks.toPandas()  # a row for each 64 bits of the bitmap at most
    bitmap = np.zeros(1 << p.filter_bits - 6, np.int64)
    bitmap[marks["at"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    bitmap = np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        keys, found = batch.column("key").to_numpy(), []
        for a, b in row_blocks(offsets):
            _, _, rows, words = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at, hashes = seeds(rows, words, shapes)
            near = bitmap[(hashes >> np.uint64(64 - p.filter_bits)).astype(np.int64)]
            at, hashes = at[near], hashes[near]
            first = np.searchsorted(rows, rows[at])
            found.append((hashes.view(np.int64), keys[rows[at] + a], at - first))
        if not found:
            return None
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["hash", "key", "at"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    met = map_batches(keyed.select("key", "text"), hits, "hash long, key long, at long").join(tests, "hash")
    lines = met.select("key", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lines = scratch.write(lines.join(items, "item").groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("lines")))
    size = lines.agg(F.sum(F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["words"]) + 32))).first()[0] or 0

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            raw, offsets = text_bytes(row.column("text"))
            starts, ends, _, words = word_hashes(raw, offsets)
            before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points
            best: dict = {}
            for line in row.column("lines")[0].as_py():
                span = aligned(words, np.frombuffer(line["words"], np.uint64), line["shift"], p)
                if span and (line["item_id"] not in best or (span[0], -span[1]) > (best[line["item_id"]][0], -best[line["item_id"]][1])):
                    best[line["item_id"]] = span
            head = row.column("key")[0].as_py(), row.column("doc_id")[0].as_py()
            out += [(*head, item, int(m), int(before[starts[a]]), int(before[ends[b - 1]])) for item, (m, a, b) in best.items()]
        columns = list(zip(*out)) or [[]] * 6
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["key", "doc_id", "item_id", "matched", "start", "end"])

    texts = keyed.join(F.broadcast(lines) if size <= p.broadcast_bytes else lines, "key")
    schema = "key long, doc_id long, item_id long, matched long, start long, end long"
    return map_batches(texts.select("key", F.col("doc_id").cast("long"), "text", "lines"), confirm, schema)


def aligned(words: np.ndarray, item: np.ndarray, shift: int, p: Overlap) -> tuple[int, int, int] | None:
    """Equal words, first and last word of the overlap with the item's word j at words[shift + j]."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    least, size = p.least_of(len(item)), min(p.window, len(item))
    if p.exact_below < p.window:
        size = min(size, b - a)
    if b - a < max(size, least):
        return None
    equal = words[shift + a : shift + b] == item[a:b]
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(total[size:] - total[:-size] >= least)
    if not len(good):
        return None
    within = np.zeros(len(equal) + 1, np.int64)
    np.add.at(within, good, 1)
    np.add.at(within, good + size, -1)
    covered = np.cumsum(within[:-1]) > 0
    return int((equal & covered).sum()), shift + a + int(good[0]), shift + a + int(good[-1]) + size


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """docs without the documents that overlap with a test item, all columns kept."""
    found = Scratch(spark).write(overlaps(spark, docs, benchmark, p).select("key").distinct())
    # the documents travel as one struct, so that none of their names meets the key
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("doc"))
    return keyed.join(found, "key", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
