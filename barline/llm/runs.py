"""Periodic runs of words inside a document.

A run is a stretch of words with smallest period q, of at least max(least, 2 q) words, that no
neighbouring word extends.  Positions that agree at a lag form diagonals of matches.  The words
are read in order; each one looks up its earlier occurrences, lengthens the diagonals of their
lags, and a diagonal that isn't lengthened ends and gives its run at once if it is long enough.

What keeps that sparse: a diagonal long enough for a run has at least `seed` matches in a row, so
an occurrence counts once its last `seed` words agree.  And where the nearest occurrence has lag
q all along a stretch, the further ones inside the stretch have lags that are multiples of q;
their diagonals belong to the same stretch, whose smallest period divides q, and are not followed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, row_blocks, text_bytes
from .words import find_words, hash_words, joined_hash, places


@dataclass(frozen=True)
class Runs:
    """Least length of a run in words; pairs of a word and an occurrence looked at in one step."""

    least: int = 12
    step_pairs: int = 1 << 20

    @property
    def seed(self) -> int:
        """Matches in a row that any diagonal of a run has: its lag q, or least - q, at least."""
        return max(1, (self.least + 1) // 2)


def _occurrences(words: np.ndarray, rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their last `seed` words, and each one's place and number of earlier ones.

    Only positions whose last words occur more than once in their row are listed.
    """
    none = np.zeros(0, np.int64)
    if len(words) < seed:
        return none, none, none
    ends = np.arange(seed - 1, len(words))
    whole = rows[seed - 1 :] == rows[: len(rows) - seed + 1]
    last = joined_hash(rows[seed - 1 :].astype(np.uint64), *(words[k : len(words) - seed + 1 + k] for k in range(seed)))[whole]
    ends = ends[whole]
    order = np.argsort(last, kind="stable")
    last = last[order]
    new = np.ones(len(last), bool)
    new[1:] = last[1:] != last[:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(last)) - np.repeat(first, np.diff(np.append(first, len(last))))
    several = ~new
    several[:-1] |= ~new[1:]
    return ends[order][several], np.arange(several.sum()), rank[several]


def _looked_up(at: np.ndarray, place: np.ndarray, rank: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of words in order: first and last position, then position and lag of each match.

    The nearest occurrence comes first; those that its stretch implies are left out.
    """
    later = rank > 0
    here, sorted_place, earlier = at[later], place[later], rank[later]
    lag = here - at[sorted_place - 1]
    order = np.argsort(here, kind="stable")
    here, sorted_place, earlier, lag = here[order], sorted_place[order], earlier[order], lag[order]
    begins = np.ones(len(here), bool)
    begins[1:] = (here[1:] != here[:-1] + 1) | (lag[1:] != lag[:-1])
    begin = here[np.maximum.accumulate(np.where(begins, np.arange(len(here)), 0))]
    implied = np.minimum((here - begin) // np.maximum(lag, 1) + 1, earlier)
    total = np.concatenate([[0], np.cumsum(1 + earlier - implied)])
    first = 0
    while first < len(here):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        own = slice(first, last)
        more = earlier[own] - implied[own]
        who = np.repeat(np.arange(first, last), more)
        found = at[sorted_place[who] - places(implied[own] + 1, more)]
        yield int(here[first]), int(here[last - 1]), np.concatenate([here[own], here[who]]), np.concatenate([lag[own], here[who] - found])
        first = last


def _diagonals(at: np.ndarray, place: np.ndarray, rank: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lag, first and last position of the diagonals, as they end.

    A word may have matches in two steps only if the steps share no position, so a step hands
    on just the diagonals that reach its last position.
    """
    none = np.zeros(0, np.int64)
    active, active_from, before = none, none, -1
    for first, last, position, lag in _looked_up(at, place, rank, most):
        order = np.lexsort((position, lag))
        position, lag = position[order], lag[order]
        new = np.ones(len(position), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (position[1:] != position[:-1] + 1)
        begin = np.flatnonzero(new)
        lags, begins, ends = lag[begin], position[begin], position[np.append(begin[1:], len(position)) - 1]
        if len(active):
            goes_on = np.zeros(len(active), bool)
            if first == before + 1:
                at_first = np.flatnonzero(begins == first)
                found = np.searchsorted(active, lags[at_first])
                found[found == len(active)] = 0
                same = active[found] == lags[at_first]
                begins[at_first[same]] = active_from[found[same]]
                goes_on[found[same]] = True
            yield active[~goes_on], active_from[~goes_on], np.full((~goes_on).sum(), before)
        open_ = ends == last
        yield lags[~open_], begins[~open_], ends[~open_]
        active, active_from, before = lags[open_], begins[open_], last
    yield active, active_from, np.full(len(active), before)


def find_runs(words: np.ndarray, rows: np.ndarray, p: Runs = Runs()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and period of all runs in the rows' words, by first word, then period.

    words are 64-bit hashes; rows tell which text holds each word, in ascending order.
    """
    at, place, rank = _occurrences(words, rows, p.seed)
    starts, ends, periods = [], [], []
    edge = np.concatenate([[True], rows[1:] != rows[:-1], [True]]) if len(rows) else np.ones(1, bool)
    for lag, begin, last in _diagonals(at, place, rank, p.step_pairs):
        start, end = begin - (p.seed - 1) - lag, last + 1
        long = end - start >= np.maximum(p.least, 2 * lag)
        lag, start, end = lag[long], start[long], end[long]
        # a piece of a diagonal that wasn't followed throughout has a match beside it
        left = edge[start] | (words[start - 1] != words[start - 1 + lag])
        right = edge[end] | (words[np.minimum(end, len(words) - 1)] != words[end - lag])
        starts.append(start[left & right])
        ends.append(end[left & right])
        periods.append(lag[left & right])
    none = np.zeros(0, np.int64)
    start, end, period = (np.concatenate([none, *x]).astype(np.int64) for x in (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # one stretch, several periods: the smallest divides the others
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _block(raw: np.ndarray, offsets: np.ndarray, p: Runs) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and the collapsed text of each row of a block."""
    begins, stops, rows = find_words(raw, offsets)
    start, end, period = find_runs(hash_words(raw, begins, stops), rows, p)
    count = len(offsets) - 1
    first_word = np.searchsorted(rows, np.arange(count + 1))
    runs: list[list[dict]] = [[] for _ in range(count)]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        row = int(rows[s])
        runs[row].append({"start": s - int(first_word[row]), "length": e - s, "period": q})
    change = np.zeros(len(rows) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    begins, sizes, rows = begins[kept], stops[kept] - begins[kept], rows[kept]
    # every kept word with one blank after it; the last blank of a row is cut off again
    ends = np.cumsum(sizes + 1)
    text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    text[places(ends - sizes - 1, sizes)] = raw[places(begins, sizes)]
    cut = np.searchsorted(rows, np.arange(count + 1))
    edge = np.concatenate([[0], ends])[cut]
    whole = text.tobytes()
    return runs, [whole[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, p: Runs = Runs()) -> DataFrame:
    """doc_id, runs (start word, length, period; by start, then period) and collapsed text.

    The collapsed text keeps of every run its first period only: words joined by one blank.  Words
    are runs of anything but blanks and the control characters from tab to carriage return.
    Rows are independent, so repeated rows and ids give equal rows each; a null text is an empty
    one, without runs and with an empty collapsed text; a null id stays null.  Other columns of
    docs, whatever their names, are not read.  A text longer than a block is worked on alone.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        runs, texts = [], []
        for first, last in row_blocks(offsets):
            part, own = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            found, collapsed = _block(part, own, p)
            runs += found
            texts += collapsed
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
        )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents repeats a part of itself to its end.

    With h the crc32 of the id as text (null: empty) and g its tenth, rounded down, documents with
    h divisible by 10 have each word from a = g mod n on replaced by word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8).  Texts without words stay.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    planted = planted.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    planted = planted.withColumn("a", F.expr("cast(g % greatest(n, 1) as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    moved = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one (ties: smallest start, then period), digests."""
    # the greatest struct: longest, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
