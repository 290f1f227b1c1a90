"""Mixing documents of overlapping sources to target weights.

Documents that belong to the same sources form a pattern.  Patterns are few, so routing their
words to the sources is a small min-cost flow: an arc into a pattern for each pass over its
documents, dearer with every pass, arcs to its sources, and an arc out of each source as wide as
its quota.  What the flow takes of a pattern is laid along its documents in a seeded order; places
in that order are found by histograms of the documents' hashes, so no task sorts a pattern.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Scratch
from .tables import map_batches, row_blocks, text_bytes
from .words import find_words

#: Bits of a document's place in the seeded order, and of one step of the search for a place.
ORDER_BITS, STEP_BITS = 60, 12


@dataclass(frozen=True)
class Mix:
    """percent of all words is shared by the weights, given in turn to the sources in order.

    No document is taken more than `passes` times.  Patterns and sources are held on the driver:
    more than most_patterns are an error.  fill_rounds single documents a pattern close what the
    order leaves open at its last place.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    passes: int = 2
    seed: int = 12
    fill_rounds: int = 3
    most_patterns: int = 100_000


def target_words(sizes: list[int], p: Mix = Mix()) -> list[Fraction]:
    """Words wanted of each source; none above `passes` times its size, the excess shared anew."""
    weight = [p.weights[k % len(p.weights)] for k in range(len(sizes))]
    target = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes) * p.percent, 100), set(range(len(sizes)))
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if unit * weight[k] > p.passes * sizes[k]}
        for k in full or open_:
            target[k] = Fraction(p.passes * sizes[k]) if full else unit * weight[k]
        left -= sum((target[k] for k in full), Fraction(0))
        open_ = open_ - full if full else set()
    return target


def route(sizes: list[int], members: list[tuple[int, ...]], quotas: list[int], passes: int) -> list[dict[int, int]]:
    """Words of each pattern to each of its sources, as many as possible in as few passes as possible.

    Only the arcs into patterns cost, more with each pass, and a path uses just one of them.  So
    shortest augmenting paths take all paths of the first pass before any of the second.
    """
    flow = [dict.fromkeys(m, 0) for m in members]
    left = list(quotas)
    users: list[list[int]] = [[] for _ in quotas]
    for pattern, own in enumerate(members):
        for k in own:
            users[k].append(pattern)
    for _ in range(passes):
        for begin, spare in enumerate(sizes):
            while spare:
                path = _path(begin, flow, users, left)
                if not path:
                    break
                # sources on the way give back what another pattern sent them
                most = min(spare, left[path[-1][1]], *(flow[nxt][k] for (_, k), (nxt, _) in zip(path, path[1:])))
                for (pattern, k), (nxt, _) in zip(path, path[1:]):
                    flow[pattern][k] += most
                    flow[nxt][k] -= most
                pattern, k = path[-1]
                flow[pattern][k] += most
                left[k] -= most
                spare -= most
    return flow


def _path(begin: int, flow: list[dict[int, int]], users: list[list[int]], left: list[int]) -> list[tuple[int, int]]:
    """Shortest way from a pattern to a source with room: (pattern, source it sends to) in turn."""
    reached_from: dict[int, int] = {}
    seen, queue = {begin: None}, deque([begin])
    while queue:
        pattern = queue.popleft()
        for k in flow[pattern]:
            if k in reached_from:
                continue
            reached_from[k] = pattern
            if left[k]:
                path = [(pattern, k)]
                while seen[path[-1][0]] is not None:
                    before = seen[path[-1][0]]
                    path.append((reached_from[before], before))
                return path[::-1]
            for other in users[k]:
                if other not in seen and flow[other][k]:
                    seen[other] = k
                    queue.append(other)
    return []


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with text replaced by size, its number of words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        size = np.zeros(batch.num_rows, np.int64)
        for first, last in row_blocks(offsets):
            rows = find_words(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])[2]
            size[first:last] = np.bincount(rows, minlength=last - first)
        rest = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(size)], [*rest, "size"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return map_batches(docs, run, f"{schema}, size bigint")


def _places(spark: SparkSession, units: DataFrame, cuts: list[tuple[str, int]]) -> dict[tuple[str, int], tuple[int, int]]:
    """For each pattern and number of words: the place that many words lie before, and how many do.

    Every step looks only at the slice of the order that holds the place; the last slice holds a
    2^24th of a pattern's documents.  Rows gathered on the driver: one for each cut.
    """
    found = {cut: (0, 0) for cut in cuts}
    for step in range(3 if cuts else 0):
        shift = ORDER_BITS - STEP_BITS * (step + 1) if step < 2 else 0
        width = STEP_BITS * step
        wanted = [(pattern, words, words - before, place >> (ORDER_BITS - width)) for (pattern, words), (place, before) in found.items()]
        wanted = spark.createDataFrame(wanted, "pattern string, words long, rest long, part long")
        part = F.shiftright("place", ORDER_BITS - width)
        slices = units.select("*", part.alias("part")).join(F.broadcast(wanted.select("pattern", "part").distinct()), ["pattern", "part"])
        sums = slices.groupBy("pattern", "part", F.shiftright("place", shift).alias("at")).agg(F.sum("size").alias("size"))
        ordered = Window.partitionBy("pattern", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("size").over(ordered)).join(F.broadcast(wanted), ["pattern", "part"])
        first = sums.where("upto > rest").groupBy("pattern", "words").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("size")).alias("before")), "at").alias("m"))
        for row in first.collect():
            key = (row.pattern, row.words)
            found[key] = (row.m.at << shift, found[key][1] + row.m.before)
    return found


@dataclass
class Plan:
    """sources: (name, size, target, quota) in order; pieces: of each pattern (source, first, end place), one pass each."""

    sources: list[tuple[str | None, int, float, int]]
    pieces: dict[str, list[tuple[str | None, int, int]]]


def plan_mix(spark: SparkSession, rows: DataFrame, p: Mix) -> Plan:
    """Flow over the patterns of rows(pattern, size, place), and where its parts begin and end."""
    scratch = Scratch(spark)
    units = scratch.write(rows.where("size > 0").groupBy("pattern", "place").agg(F.sum("size").alias("size")))
    seen = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(p.most_patterns + 1).collect()
    if len(seen) > p.most_patterns:
        raise ValueError(f"more than {p.most_patterns} combinations of sources")
    patterns = {r.pattern: r.size for r in sorted(seen, key=lambda r: r.pattern)}
    members = {x: json.loads(x) for x in patterns}
    names = sorted({s for own in members.values() for s in own}, key=lambda s: (s is None, s or ""))
    number = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for x, own in members.items():
        for s in own:
            sizes[number[s]] += patterns[x]
    targets = target_words(sizes, p)
    quotas = [round(t) for t in targets]
    flows = route(list(patterns.values()), [tuple(number[s] for s in members[x]) for x in patterns], quotas, p.passes)

    end = 1 << ORDER_BITS
    parts: dict[str, list[tuple[int, int, int]]] = {}  # source, from word, to word; of one pass
    for (x, size), flow in zip(patterns.items(), flows):
        at, parts[x] = 0, []
        for k, words in flow.items():
            while words:
                own = min(words, size - at % size)
                parts[x].append((k, at % size, at % size + own))
                at, words = at + own, words - own
    cuts = sorted({(x, w) for x, own in parts.items() for _, *ends in own for w in ends if 0 < w < patterns[x]})
    found = _places(spark, units, cuts)
    place = lambda x, w: 0 if not w else end if w == patterns[x] else found[x, w][0]
    pieces = {x: [(names[k], place(x, a), place(x, b)) for k, a, b in own] for x, own in parts.items()}
    gaps = {x: own[-1][2] - found[x, own[-1][2]][1] for x, own in parts.items() if own and own[-1][2] < patterns[x]}
    added: dict[str, list[int]] = {x: [] for x in gaps}
    for _ in range(p.fill_rounds):
        gaps = {x: gap for x, gap in gaps.items() if gap > 0}
        if not gaps:
            break
        # documents of the pass that isn't full: those behind its last place and not added yet
        wanted = [(x, gap, found[x, parts[x][-1][2]][0], added[x]) for x, gap in gaps.items()]
        wanted = spark.createDataFrame(wanted, "pattern string, gap long, behind long, added array<long>")
        rest = units.join(F.broadcast(wanted), "pattern").where("place >= behind and not array_contains(added, place) and size < 2 * gap")
        best = rest.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "place", "size")).alias("m"))
        chosen = {r.pattern: r.m for r in best.collect()}
        for x, m in chosen.items():
            added[x].append(m.place)
            pieces[x].append((pieces[x][-1][0], m.place, m.place + 1))
        gaps = {x: gaps[x] - m.size for x, m in chosen.items()}
    scratch.drop(units)
    return Plan([(s, sizes[k], float(targets[k]), quotas[k]) for k, s in enumerate(names)], pieces)


def mixed_documents(spark: SparkSession, docs: DataFrame, sources: Column, p: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sources, size, passes, taken) of every row of docs, and (source, size, target, quota).

    sources: the array of names that a row belongs to; a name given twice counts once, null is a
    source of its own and the last in order, and a row without any is never taken.  passes lists
    the source that each pass over the document goes to; taken is size times their number.  Rows
    equal in id and text go together.  Reruns agree, however the table is dealt.  Null and empty
    texts have size 0.  Other columns of docs, whatever their names, are not read.
    """
    scratch = Scratch(spark)
    names = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), "doc_id", "text"), 64 - ORDER_BITS)
    rows = docs.select("doc_id", F.to_json(names).alias("pattern"), place.alias("place"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(with_sizes(rows))
    plan = plan_mix(spark, rows, p)
    listed = [(x, own) for x, own in plan.pieces.items()]
    pieces = spark.createDataFrame(listed, "pattern string, pieces array<struct<source:string,first:bigint,end:bigint>>")
    own = F.filter("pieces", lambda r: (r["first"] <= F.col("place")) & (F.col("place") < r["end"]))
    out = rows.join(F.broadcast(pieces), "pattern", "left").withColumn("own", F.coalesce(own, F.array().cast("array<struct<source:string,first:bigint,end:bigint>>")))
    out = out.select(
        "doc_id",
        F.from_json("pattern", "array<string>").alias("sources"),
        "size",
        F.transform("own", lambda r: r["source"]).alias("passes"),
        (F.col("size") * F.size("own")).alias("taken"),
    )
    return out, spark.createDataFrame(plan.sources, "source string, size long, target double, quota long")
