"""Mixing and the audit of sources against plain versions."""

from __future__ import annotations

import collections
import itertools
import random
from fractions import Fraction

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import divergence, mixing
from barline.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_targets_stop_at_twice_the_size_and_reshare_the_rest():
    assert mixing.target_words([100, 100]) == [200, 100]
    assert mixing.target_words([10, 100, 1000]) == [20, 200, 1445]
    assert mixing.target_words([0, 0]) == [0, 0] and mixing.target_words([]) == []
    random_ = random.Random(3)
    for _ in range(50):
        sizes = [random_.randint(0, 1000) for _ in range(random_.randint(1, 9))]
        got = mixing.target_words(sizes)
        assert sum(got) == Fraction(sum(sizes) * 3, 2)
        open_ = [k for k in range(len(sizes)) if got[k] < 2 * sizes[k]]
        assert all(t <= 2 * s for t, s in zip(got, sizes))
        assert len({got[k] / (3, 1, 2)[k % 3] for k in open_}) <= 1


def test_routes_are_as_cheap_as_the_best_of_all():
    """Most words in all, and the fewest of them in a second pass, against every integer flow."""
    random_ = random.Random(5)
    for _ in range(60):
        members = random_.sample([(0,), (1,), (0, 1), (2,), (0, 2), (0, 1, 2)], 3)
        sizes, quotas = [random_.randint(0, 2) for _ in members], [random_.randint(0, 4) for _ in range(3)]
        flows = mixing.route(sizes, members, quotas, 2)
        into = [sum(f[k] for f in flows if k in f) for k in range(3)]
        used = [sum(f.values()) for f in flows]
        assert all(w <= 2 * s for w, s in zip(used, sizes)) and all(a <= b for a, b in zip(into, quotas))
        options = [[dict(zip(m, x)) for x in itertools.product(range(2 * s + 1), repeat=len(m)) if sum(x) <= 2 * s] for m, s in zip(members, sizes)]
        best = (0, 0)
        for choice in itertools.product(*options):
            if all(sum(f.get(k, 0) for f in choice) <= quotas[k] for k in range(3)):
                own = [sum(f.values()) for f in choice]
                best = max(best, (sum(own), -sum(max(0, w - s) for w, s in zip(own, sizes))))
        assert (sum(used), -sum(max(0, w - s) for w, s in zip(used, sizes))) == best


def _of_source(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_reaches_the_targets_with_seeded_whole_documents(spark):
    random_ = random.Random(9)
    rows = [(i, "w " * random_.randint(1, 60), f"s{i % 4}" if i % 9 else "s0") for i in range(2_000)]
    docs, sources = mixing.mixed_documents(spark, _of_source(spark, rows).repartition(7), F.array("source"))
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all(got[i].size == len(t.split()) and got[i].taken in (0, got[i].size, 2 * got[i].size) for i, t, _ in rows)
    taken = collections.Counter()
    for r in got.values():
        taken[r.sources[0]] += r.taken
    assert all(abs(taken[s.source] - s.target) <= 1 for s in sources.collect())
    again = mixing.mixed_documents(spark, _of_source(spark, rows[::-1]).repartition(3), F.array("source"))[0]
    assert {r.doc_id: r for r in again.collect()} == got
    other = mixing.mixed_documents(spark, _of_source(spark, rows), F.array("source"), mixing.Mix(seed=13))[0]
    assert {r.doc_id: r for r in other.collect()} != got


def test_overlapping_sources_share_their_documents(spark):
    """Documents of both sources go to the one that has too few words of its own."""
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(100 + i, "w " * 10, ["a", "b", "a"]) for i in range(40)] + [(200, "w", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    got, sources = mixing.mixed_documents(spark, docs, F.col("names"), mixing.Mix(weights=(1, 1), percent=100))
    got = {r.doc_id: r for r in got.collect()}
    wanted = {s.source: s.quota for s in sources.collect()}
    words = collections.Counter(s for r in got.values() for s in r.passes for _ in range(r.size))
    assert got[200].passes == [] and got[200].taken == 0 and got[105].sources == ["a", "b"]
    assert all(abs(words[s] - quota) <= 10 for s, quota in wanted.items())
    assert max(len(r.passes) for r in got.values()) <= 2


def test_mix_of_missing_empty_repeated_and_wide_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z " * 5, "b"), (4, "v " * 30_000, "c"), (5, "u " * 100, "c")]
    docs = _of_source(spark, rows).withColumns({c: F.lit("q") for c in ("size", "place", "pattern", "own", "passes", "target")})
    got, sources = mixing.mixed_documents(spark, docs, F.array("source"))
    got = sorted(((r.doc_id, r.size, r.taken) for r in got.collect()), key=str)
    assert [s.source for s in sources.orderBy(F.expr("source is null"), "source").collect()] == ["a", "b", "c", None]
    assert {(i, n) for i, n, _ in got} == {(1, 0), (2, 0), (3, 2), (None, 5), (4, 30_000), (5, 100)} and len(got) == 7
    assert all(0 <= t <= 2 * n for _, n, t in got) and len({x for x in got if x[0] == 3}) == 1
    empty = mixing.mixed_documents(spark, docs.limit(0), F.array("source"))
    assert empty[0].collect() == [] and empty[1].collect() == []
    with pytest.raises(ValueError):
        mixing.mixed_documents(spark, docs, F.array("source"), mixing.Mix(most_patterns=2))


def test_mixing_query_on_the_given_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op12_mixing"](spark, FOLDER).collect()
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        source = docs[r.doc_id].source
        sizes[source] += len(brute.words(docs[r.doc_id].text))
        taken[source] += r.taken
        targets[source] = r.target
        assert r.size == len(brute.words(docs[r.doc_id].text)) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    assert len(got) == len(docs) and all(r.source_size == sizes[docs[r.doc_id].source] for r in got)
    names = sorted(sizes)
    assert [targets[s] for s in names] == [float(t) for t in mixing.target_words([sizes[s] for s in names])]
    largest = {s: max(r.size for r in got if docs[r.doc_id].source == s) for s in names}
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in names)
    assert sum(abs(taken[s] - targets[s]) for s in names) < 0.03 * sum(targets.values())


def _duck(docs):
    duck = duckdb.connect()
    duck.register("documents", docs)
    return sorted(duck.sql(SQL["op13_source_divergence"]).fetchall(), key=str)


def test_audit_equals_its_sql_in_blocks_of_any_size(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = _duck(docs.toPandas())
    for p in (divergence.Audit(), divergence.Audit(groups_per_block=3, terms_per_block=20, block_bytes=10_000), divergence.Audit(groups_per_block=1)):
        assert sorted(map(tuple, divergence.divergence(spark, docs, p).collect()), key=str) == want
    assert any(r[2] == "pair" for r in want) and any(r[2] == "term" for r in want)


def test_audit_of_missing_empty_repeated_and_wide_rows(spark):
    rows = [("Äpfel über aB ab", "de", "x")] * 12 + [("ab", "de", "y"), (None, "de", "z"), ("1 2 3", "de", None), ("ab " * 50_000, "de", "long")]
    rows += [("few", "en", "x"), ("", "en", "y"), ("all", None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = _duck(docs.toPandas())
    docs = docs.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "rank", "part", "value")})
    got = divergence.divergence(spark, docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r.value for r in got.where("lang = 'en'").collect()} == {0} and got.where("lang = ''").count() == 0
    assert divergence.divergence(spark, docs.limit(0)).collect() == []


def test_prices_of_huge_counts_are_exact(spark):
    counts, total = [0, 1, 10**12, 4 * 10**15], 9 * 10**15
    want = [1 + 10**9 * (c + 2) // total for c in counts]
    assert divergence.prices(np.array(counts), total).tolist() == want
    rows = spark.createDataFrame([(c,) for c in counts], "c long").select(divergence.price(F.col("c"), F.lit(total)).alias("p")).collect()
    assert [r.p for r in rows] == want
