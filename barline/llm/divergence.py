"""How far the sources of a language differ in their words.

A group is a language and a source.  A term's price in a group is its smoothed share in parts per
thousand million, and two prices p, q differ by floor((p - q)^2 / (p + q)).  Groups of a language
are compared in pairs: a task gets the sorted (term number, count) arrays of two blocks of groups
for one block of terms, and merges each unordered pair of arrays.  Searching the shorter array in
the longer one finds the terms of both; terms of one side only, and the terms of the language that
neither has, are priced from the counts alone.  Differences have no direction, so a pair's sum
serves both ways.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Scratch
from .tables import map_batches, row_blocks, text_bytes
from .words import LOWER, find_words, hash_words

#: Kinds of bytes: 1 ASCII letters and all of UTF-8 beyond ASCII, 0 anything else.
TERM_CUT = np.array([1 if b >= 128 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """least_docs: documents of a language that a kept term occurs in; most_terms: the ranks listed.

    A task compares groups_per_block groups with as many over terms_per_block terms.
    """

    least_docs: int = 10
    most_terms: int = 10
    groups_per_block: int = 32
    terms_per_block: int = 4_096
    block_bytes: int = 8 << 20


def counted_terms(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of every group and term."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        langs, sources = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
        group_of = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        parts = []
        for first, last in row_blocks(offsets, p.block_bytes):
            text, own = LOWER[raw[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
            starts, ends, rows = find_words(text, own, TERM_CUT)
            if not len(starts):
                continue
            _, at, code = np.unique(hash_words(text, starts, ends), return_index=True, return_inverse=True)
            of_doc, n = np.unique(rows * len(at) + code, return_counts=True)
            of_group, inverse = np.unique(group_of[first:last][of_doc // len(at)] * len(at) + of_doc % len(at), return_inverse=True)
            group, term = of_group // len(at), at[of_group % len(at)]
            begin, stop, whole = starts[term].tolist(), ends[term].tolist(), text.tobytes()
            parts.append(
                pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                        sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                        pa.array([whole[a:b] for a, b in zip(begin, stop)], pa.binary()).cast(pa.string()),
                        pa.array(np.bincount(inverse, n).astype(np.int64)),
                        pa.array(np.bincount(inverse)),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            )
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = map_batches(text, run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, p: Audit) -> DataFrame:
    """lang, term, n and sources (source, n) of terms in enough documents; one entry a source."""
    terms = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    return terms.where(F.col("docs") >= p.least_docs).drop("docs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), divided in three steps that stay below 2^63."""
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, total), rest * 1000 % total
    return out + 1


def prices(counts: np.ndarray, total: int) -> np.ndarray:
    rest, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def difference(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    return (x - y) ** 2 // (x + y)


def merged(ids_x: np.ndarray, p_x: np.ndarray, absent_x: int, ids_y: np.ndarray, p_y: np.ndarray, absent_y: int, terms: int) -> int:
    """Sum of the differences of two groups over so many terms; ids are sorted."""
    if len(ids_x) > len(ids_y):
        ids_x, p_x, absent_x, ids_y, p_y, absent_y = ids_y, p_y, absent_y, ids_x, p_x, absent_x
    at = np.searchsorted(ids_y, ids_x)
    both = at < len(ids_y)
    both[both] = ids_y[at[both]] == ids_x[both]
    only_y = np.ones(len(ids_y), bool)
    only_y[at[both]] = False
    total = difference(p_x[both], p_y[at[both]]).sum() + difference(p_x[~both], absent_y).sum() + difference(p_y[only_y], absent_x).sum()
    neither = terms - len(ids_x) - int(only_y.sum())
    return int(total) + neither * ((absent_x - absent_y) ** 2 // (absent_x + absent_y))


def _merge_task(part: pa.Table) -> pa.Table:
    """Partial sums of all unordered pairs of one task; a pair is made where its blocks meet."""
    low, high, terms = (part.column(c)[0].as_py() for c in ("low", "high", "terms"))
    columns = {c: part.column(c).to_pylist() for c in ("lang", "source", "block", "n_group", "kept")}
    prepared = []
    for k, (ids, counts) in enumerate(zip(part.column("ids"), part.column("counts"))):
        total = columns["n_group"][k] + 2 * columns["kept"][k]
        ids, counts = (np.zeros(0, np.int64) if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in (ids, counts))
        prepared.append((ids, prices(counts, total), int(prices(np.zeros(1, np.int64), total)[0])))
    out = []
    for i, left in enumerate(prepared):
        for j in range(i + 1, len(prepared)):
            if sorted((columns["block"][i], columns["block"][j])) == [low, high]:
                out.append((columns["lang"][i], columns["source"][i], columns["source"][j], merged(*left, *prepared[j], terms)))
    lang, one, other, value = zip(*out) if out else ((),) * 4
    return pa.table([pa.array(lang, pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(value, pa.int64())], ["lang", "one", "other", "value"])


def pair_sums(terms: DataFrame, groups: DataFrame, p: Audit) -> DataFrame:
    """lang, one, other, value: summed differences of every unordered pair of groups with kept terms.

    terms: lang, term, sources, kept (terms of the language); groups: lang, source, block, blocks, n_group, kept.
    """
    cut = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / p.terms_per_block)).cast("int")
    numbered = terms.withColumn("cut", cut).withColumn("id", F.row_number().over(Window.partitionBy("lang", "cut").orderBy("term")))
    sizes = terms.groupBy("lang", cut.alias("cut")).agg(F.count("*").alias("terms"))
    arrays = numbered.select("lang", "cut", "id", F.explode("sources").alias("s")).groupBy("lang", "cut", "s.source").agg(
        F.sort_array(F.collect_list(F.struct("id", "s.n"))).alias("pairs")
    )
    arrays = arrays.select("lang", "cut", "source", F.col("pairs.id").alias("ids"), F.col("pairs.n").alias("counts"))
    # groups without a term of the block take part, too
    whole = groups.join(sizes, "lang").join(arrays, ["lang", "cut", "source"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other_block")
    dealt = whole.select("*", other).select(
        "lang", "cut", "source", "block", "n_group", "kept", "terms", "ids", "counts",
        F.least("block", "other_block").alias("low"), F.greatest("block", "other_block").alias("high"),
    )
    sums = dealt.groupBy("lang", "cut", "low", "high").applyInArrow(_merge_task, "lang string, one string, other string, value bigint")
    return sums.groupBy("lang", F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).agg(F.sum("value").alias("value"))


def divergence(spark: SparkSession, docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank of the audit of every group of docs.

    Part `pair`: item is every other source of the language, value the sum of differences over all
    kept terms (0 where the language keeps none).  Part `term`: item is a kept term that the group
    has and that costs more there than in the language as a whole, down to rank `most_terms`.  Ranks
    count from 1 within a group and part, value descending, then item ascending by its bytes.
    Null lang, source and text are ''.  Groups whose texts hold no term take part in all pairs; a
    language with one source has none.  Repeated rows count as documents of their own.  Other
    columns, whatever their names, are not read; an empty table gives an empty result.
    Terms are told apart by their text; within one batch by a 64-bit hash.
    """
    scratch = Scratch(spark)
    terms = scratch.write(kept_terms(counted_terms(docs, p), p))
    # written: their size is known then, and terms aren't dealt by language to meet them
    langs = scratch.write(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("n_lang")))
    totals = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n_group"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = F.ceil(F.count("*").over(Window.partitionBy("lang")) / p.groups_per_block)
    groups = groups.withColumn("block", _div(place.cast("long"), F.lit(p.groups_per_block))).withColumn("blocks", blocks)
    groups = scratch.write(groups.na.fill(0, ["n_group", "kept", "n_lang"]))

    sums = pair_sums(terms.join(langs.select("lang", "kept"), "lang"), groups, p)
    both = sums.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value").unionByName(
        sums.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "value")
    )
    named = groups.select("lang", "source")
    pairs = named.join(named.withColumnRenamed("source", "item"), "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.na.fill(0, ["value"]).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))

    own = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("n_term"), F.explode("sources").alias("s"))
    own = own.select("lang", "item", "n_term", "s.source", "s.n").join(groups, ["lang", "source"])
    own = own.withColumn("p", price(F.col("n"), F.col("n_group") + 2 * F.col("kept"))).withColumn("q", price(F.col("n_term"), F.col("n_lang") + 2 * F.col("kept")))
    own = own.where("p > q").withColumn("value", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")))
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.most_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(own.select(columns))
