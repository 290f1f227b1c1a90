"""Periodic runs against all lags of each text, and the query's digests on the given table."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from barline.llm import runs
from barline.llm.queries import QUERIES
from barline.llm.words import mixed

FOLDER = "/root/testdata/sf0.001"


def _texts(random_):
    for _ in range(random_.randint(1, 4)):
        words = []
        while len(words) < random_.randint(0, 120):
            words += [random_.randrange(7) for _ in range(random_.randint(1, 20))] * random_.randint(1, 6)
            if random_.random() < 0.3:
                words[random_.randrange(len(words))] = 9
        yield [w % random_.choice([1, 2, 7]) for w in words] if random_.random() < 0.3 else words


def test_runs_of_random_texts_equal_all_lags():
    random_ = random.Random(7)
    for _ in range(400):
        texts, least = list(_texts(random_)), random_.choice([2, 3, 4, 7, 12])
        rows = np.array([r for r, t in enumerate(texts) for _ in t], np.int64)
        words = mixed(np.array([w + 1 for t in texts for w in t], np.uint64))
        got = runs.find_runs(words, rows, runs.Runs(least, random_.choice([1, 3, 50, 1 << 20])))
        want, first = [], 0
        for t in texts:
            want += [(first + s, first + e, q) for s, e, q in brute.periodic_runs(t, least)]
            first += len(t)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_a_text_of_one_word_and_a_long_repeated_line_take_few_steps():
    for text, period in (([1] * 200_000, 1), (list(range(100)) * 2_000, 100)):
        start, end, q = runs.find_runs(mixed(np.array(text, np.uint64)), np.zeros(len(text), np.int64))
        assert (start.tolist(), end.tolist(), q.tolist()) == ([0], [200_000], [period])


def test_query_on_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = brute.planted_words(doc_id, text)
        if len(words) < 2_500:  # all lags of the longest texts take minutes
            assert got[doc_id] == brute.run_digests(words), doc_id


def test_missing_empty_repeated_and_wide_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (4, "a b " * 9), (4, "a b " * 9), (5, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("runs", "collapsed", "start", "n")})
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    same = [(0, 18, 2)]
    assert sorted(got, key=str) == sorted(
        [(1, [], ""), (2, [], ""), (3, [], ""), (None, same, "a b"), (4, same, "a b"), (4, same, "a b"), (5, [], "x" * 50_000)], key=str
    )
    digests = runs.run_digests(runs.periodic_runs(docs.where("doc_id = 1"))).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digests) == (1, 0, None, None, None, None, empty, empty)
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_period(docs.limit(0)))).collect() == []
    planted = {r.doc_id: r.text for r in runs.with_planted_period(docs).collect()}
    assert planted[1] is None and planted[2] == "" and planted[3] == " \t\n"
