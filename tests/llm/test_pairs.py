"""Near duplicates, lines, vectors and benchmark overlaps against plain versions."""

from __future__ import annotations

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import decontamination, embedding_dup, lines, near_dup
from barline.llm.banding import linked
from barline.llm.cover_tree import Links, Node, traverse
from barline.llm.graph import Scratch, components


def _texts(seed=3, copies=60):
    """Random texts, exact and near copies of one of them, chains of small changes, and odd rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [draw.choice(vocabulary) for _ in range(60)]
    rows = [" ".join(base)] * 5
    for _ in range(copies):
        changed = list(base)
        for _ in range(draw.randint(0, 4)):
            changed[draw.randrange(60)] = draw.choice(vocabulary)
        rows.append(" ".join(changed))
    chain = [draw.choice(vocabulary) for _ in range(40)]
    for k in range(12):  # each step is near the one before it, not the first
        chain = [*chain[2:], f"x{k}", f"y{k}"]
        rows.append(" ".join(chain))
    rows += [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 80))) for _ in range(40)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "One Two", "long " * 20_000, "long " * 19_000 + "end", "é É ç"]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    texts = _texts()
    rows = [(k * 3, t, "x", -1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, registers string, n long")
    got = near_dup.near_duplicates(spark, docs, near_dup.Near(words=width, task_shingles=500)).collect()
    sets = {i: brute.shingles(t, width) for i, t, *_ in rows}
    want = brute.like_sets(sets)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want) - (50 if width == 2 else 15)


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], brute.DOCS)
    assert near_dup.near_duplicates(spark, empty).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    kept = near_dup.one_of_each(spark, spark.createDataFrame([*rows, (9, "a b c d e f")], "doc_id long, text string"))
    assert kept.where("doc_id = 9").isEmpty() and kept.count() == 5


def test_registers_estimate_similarity():
    p = near_dup.Near()
    draw = np.random.default_rng(0)
    both, a, b = (draw.integers(0, 1 << 64, n, np.uint64) for n in (8000, 1000, 1000))
    packed = near_dup.registers(np.repeat([0, 1], 9000), np.concatenate([both, a, both, b]), 2, p)
    similar, used = near_dup.estimates(packed[:1], packed[1:], p)
    assert abs(similar[0] - 0.8) < 0.12 and used[0] == p.bands * p.registers


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(200, 260)] + [(3, 5)]
    links = spark.createDataFrame(path + star + [(7, 7)], "u long, v long")
    got = {r.id: r.component for r in components(links, Scratch(spark)).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 3 for k in (3, 5, *range(200, 260))}}
    assert components(links.limit(0), Scratch(spark)).collect() == []


def test_shuffle_files_go_once_a_table_is_written(spark):
    """So the disk never holds those of all steps; the setting is the session's own again afterwards."""

    def shuffle_files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = manager.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, before = spark.conf.get(name), shuffle_files()
    groups = spark.range(20_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    written = Scratch(spark).write(groups)
    assert not shuffle_files() - before
    assert written.count() == 100 and spark.conf.get(name) == own


def test_line_dedup_equals_all_pairs(spark):
    draw = random.Random(1)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(120)) for _ in range(8)]
    docs = []
    for k in range(60):
        own = []
        for _ in range(draw.randint(0, 6)):
            line = list(draw.choice(base))
            for _ in range(draw.randint(0, 3)):
                line[draw.randrange(len(line))] = draw.choice("xyzé")
            own.append("".join(line))
        docs.append((k, "\n".join([*own, draw.choice(["", "  ", "short", "Short", "ü"])])))
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, "z" * 50_000), (94, "z" * 49_000)]
    table = spark.createDataFrame([(i, t, "k", i) for i, t in docs], "doc_id long, text string, key string, n_chars long")
    want = brute.removed_lines(docs)
    got = {(r.doc_id, int(k)) for r in lines.line_report(spark, table).collect() for k in r.removed.split(",") if k}
    assert got == want and len(want) > 50
    texts = {r.doc_id: r.text for r in lines.without_repeated_lines(spark, table).select("doc_id", "text").collect()}
    for i, t in docs:
        expected = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
        assert texts[i] == expected
    assert lines.without_repeated_lines(spark, table).columns == table.columns


def test_line_dedup_of_odd_tables(spark):
    assert lines.line_report(spark, spark.createDataFrame([], brute.DOCS)).collect() == []
    rows = [(None, "the same line of text"), (4, "the same line of text"), (4, "the same line of text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.removed) for r in lines.line_report(spark, docs).collect())
    assert got == [(0, 1, ""), (4, 1, "0")]
    assert sorted(r.text or "" for r in lines.without_repeated_lines(spark, docs).collect()) == ["", "", "", "the same line of text"]


def test_bitmaps_leave_out_no_like_pair_and_most_others(spark):
    draw = random.Random(3)
    texts = ["", "short", "aé", "z" * 900, "z" * 800, "ab" * 300]
    for _ in range(12):
        line = [draw.choice("abcdefgh ") for _ in range(draw.randint(20, 400))]
        texts.append("".join(line))
        for changes in (1, 3, 8):
            for _ in range(changes):
                line[draw.randrange(len(line))] = draw.choice("xyz")
            texts.append("".join(line))
    p = lines.Lines()
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    every = [(i, k) for i in range(len(texts)) for k in range(i)]
    left = {tuple(r) for r in lines.may_be_alike(spark.createDataFrame(every, "u long, v long"), lines.bitmaps(table, p), p).collect()}
    sets = [set(brute.line_shingles(text)) for text in texts]
    like = {(i, k) for i, k in every if 100 * len(sets[i] & sets[k]) >= p.percent * len(sets[i] | sets[k])}
    assert like <= left and len(like) > 10
    assert len(left) < len(every) / 10


def test_lines_rather_alike_are_never_pairs_of_rows(spark, monkeypatch):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    docs = []
    for family in range(4):
        base = [word() for _ in range(60)]
        for k in range(40):  # any two differ in about 12 of 60 words and have a similarity of about 0.5
            own = [word() if draw.random() < 0.1 else w for w in base]
            docs.append((100 * family + k, " ".join(own)))
    pairs, alike = [], lines.alike
    monkeypatch.setattr(lines, "alike", lambda *args: (pairs.append(args[1].count()), alike(*args))[1])
    got = {(r.doc_id, int(k)) for r in lines.line_report(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect() for k in r.removed.split(",") if k}
    assert got == brute.removed_lines(docs)
    assert sum(pairs) < len(docs)  # more than ten times as many without bounds in the join


def test_lines_that_share_a_shingle_or_two_hardly_meet(spark):
    draw = random.Random(9)
    rows = [(k, "of and the " + "".join(draw.choice("abcdefghijklmnop ") for _ in range(90))) for k in range(600)]
    bands = lines.line_bands(spark.createDataFrame(rows, "id long, line string"), lines.Lines())
    met = bands.alias("a").join(bands.alias("b"), "key").where("a.id < b.id").select("a.id", "b.id").distinct()
    assert met.count() < len(rows) / 2


def test_pairs_of_lines_are_dealt_by_number(spark):
    table = spark.createDataFrame([(k, f"a line of some forty bytes, number {k}, and {k}") for k in range(6)], "id long, line string")
    pairs = spark.createDataFrame([(i, k) for i in range(6) for k in range(i + 1, 6)], "u long, v long")
    p, scratch = lines.Lines(task_pairs=2, percent=1), Scratch(spark)
    found = lines.alike(table, pairs, p, scratch)
    assert found.rdd.getNumPartitions() == 8 and found.count() == 15


@pytest.mark.parametrize("at_once", [0, 40, 100_000])
def test_rounds_of_pairs_connect_what_all_pairs_do(spark, at_once):
    draw = random.Random(4)
    at = {k: draw.random() for k in range(300)}
    bands = [(key, k, 1) for k in at for key in {int(at[k] * 12), 100 + int(at[k] * 7 + 0.4), 200 + int(at[k] * 5 + 0.7)}]
    values = spark.createDataFrame(list(at.items()), "id long, at double")
    seen = []

    def confirm(pairs, scratch):
        seen.append(pairs.count())
        both = pairs.join(values.toDF("u", "a"), "u").join(values.toDF("v", "b"), "v")
        return both.where("abs(a - b) < 0.004").select("u", "v")

    found = linked(spark.createDataFrame(bands, "key long, id long, n long"), confirm, 80, Scratch(spark), at_once=at_once)
    group = {r.id: r.component for r in found.collect()}
    order = sorted(at, key=at.get)
    cut = [0, *[k for k in range(1, len(order)) if at[order[k]] - at[order[k - 1]] >= 0.004], len(order)]
    want = {k: min(order[a:b]) for a, b in zip(cut, cut[1:]) for k in order[a:b]}
    assert {k: group.get(k, k) for k in at} == want
    assert len(seen) == 2 if at_once == 100_000 else len(seen) > 2


def test_line_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "some line"), (2, "some line")], "doc_id long, text string")
    for df in (lines.line_bands(lines.all_lines(docs).withColumn("id", F.xxhash64("line")), lines.Lines()), lines.line_report(spark, docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("spread", [0.001, 0.02, 0.1, 1.0])
def test_dual_traversal_equals_all_pairs(spread):
    draw = np.random.default_rng(int(spread * 1000))
    centres = draw.normal(size=(6, 8))
    x = centres[draw.integers(0, 6, 700)] + draw.normal(size=(700, 8)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weights, links = draw.integers(1, 4, 700), None
    links = Links(weights)
    first, second = Node(x, np.arange(350), 0), Node(x, np.arange(350, 700), 350)
    for a, b in ((first, first), (second, second), (first, second)):
        traverse(x, a, b, 0.98, links)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert (near @ weights == links.counts).all()
    groups = brute.Groups(range(700))
    for i, j in zip(*np.nonzero(near)):
        groups.join(int(i), int(j))
    assert [links.root(i) for i in range(700)] == [groups.root(i) for i in range(700)]


def test_near_vectors_equal_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows, base = [], draw.normal(size=(5, 12))
    for k in range(240):
        v = base[k % 5] + draw.normal(size=12) * (0.04 if k % 3 else 1.0)
        rows.append((k * 2, v.astype(np.float32).tolist(), k % 2, "x"))
    rows += [(1000 + k, rows[3][1], rows[3][2], "copy") for k in range(6)]
    rows += [(2000, None, 1, ""), (2001, rows[0][1], None, ""), (2002, [0.0] * 12, 0, ""), (2003, [float("nan")] * 12, 0, ""), (2004, [1.0, None], 0, ""), (2005, [], 0, ""), (2006, [float("inf")] * 12, 1, ""), (2007, [1.0, 0.0], 0, ""), (2008, [2.0, 0.0], 0, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string")
    want = brute.near([r[:3] for r in rows])
    for p in (embedding_dup.Cover(), embedding_dup.Cover(cell_rows=30, centres=4)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.near_vectors(spark, table, p).collect()}
        assert got == want
    assert embedding_dup.near_vectors(spark, table.limit(0)).collect() == []
    null = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = embedding_dup.near_vectors(spark, null).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (3, 0, 3, True)}


def test_masks_miss_no_three_substitutions():
    for gone in itertools.combinations(range(16), 3):
        assert any(not any(at + k in gone for k in mask) for mask in decontamination.MASKS for at in range(16 - mask[-1]))


def test_overlaps_equal_all_alignments(spark):
    draw = random.Random(4)
    vocabulary = [f"v{k}" for k in range(60)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(draw.choice([1, 6, 15, 16, 17, 30])))) for k in range(20)] + [(30, None), (31, ""), (32, "...")]
    docs = []
    for k in range(80):
        own = text(draw.randint(0, 40))
        if k % 3:
            piece = draw.choice(items[:20])[1].upper().split(" ")
            for _ in range(draw.randint(0, 4)):
                piece[draw.randrange(len(piece))] = "new"
            own[3:3] = piece[draw.randint(0, 2) :]
        docs.append((k, ", ".join(own)))
    docs += [(200, None), (201, ""), (None, items[3][1] + " tail")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.overlaps(spark, table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute.overlapping(docs, items)
    texts = dict(docs)
    for r in got:
        inside = brute.tokens(texts[r.doc_id][r.start : r.end])
        assert len(set(inside) & set(brute.tokens(dict(items)[r.item_id]))) > 0 and inside
    clean = decontamination.decontaminated(spark, table, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}
    assert clean.columns == table.columns
    for a, b in ((table.limit(0), bench), (table, bench.limit(0))):
        assert decontamination.overlaps(spark, a, b).collect() == []
    assert decontamination.decontaminated(spark, table, bench.limit(0)).count() == len(docs)


def test_short_masks_miss_nothing():
    for n in range(8, 16):
        for gone in itertools.combinations(range(n), n - decontamination.TOLERANT.least_of(n)):
            assert any(not any(at + k in gone for k in mask) for mask in decontamination.SHORT_MASKS for at in range(n - mask[-1]))
    assert [decontamination.TOLERANT.least_of(n) for n in (1, 7, 8, 11, 12, 15, 16, 40)] == [1, 7, 7, 10, 10, 13, 13, 13]


def test_short_items_and_edges_bear_changes(spark):
    draw = random.Random(14)
    lengths = [3, 7, 8, 10, 12, 13, 15, 16, 20, 30]
    items = [(k, " ".join(f"v{draw.randrange(60)}" for _ in range(n))) for k, n in enumerate(lengths)]
    docs = []
    for k in range(300):
        piece = draw.choice(items)[1].split(" ")
        for _ in range(draw.randint(0, 3)):
            piece[draw.randrange(len(piece))] = "new"
        piece = piece[draw.choice([0, 0, 1, 2, len(piece) // 2]) :]
        piece = piece[: len(piece) - draw.choice([0, 0, 1, 2])]
        before, after = (["x"] * draw.choice([0, 0, 5]) for _ in range(2))
        docs.append((k, " ".join(before + piece + after)))
    docs += [(900 + k, " ".join(items[8][1].split(" ")[:n])) for k, n in enumerate((12, 13, 15))]
    want = set()
    for i, text in docs:
        d = brute.tokens(text)
        for j, other in items:
            t = brute.tokens(other)
            least = len(t) if len(t) < 8 else len(t) - 1 if len(t) < 12 else len(t) - 2 if len(t) < 16 else 13
            for shift in range(-len(t) + 1, len(d)):
                equal = [0 <= shift + m < len(d) and d[shift + m] == t[m] for m in range(len(t))]
                if max(sum(equal[m : m + 16]) for m in range(len(t))) >= least:
                    want.add((i, j))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.overlaps(spark, table, bench, decontamination.TOLERANT).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {i for i, _ in want if i >= 900} == {901, 902}
    assert want > brute.overlapping(docs, items)


def test_common_shingles_are_counted():
    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 900, draw.integers(0, 400))).astype(np.uint64) for _ in range(40)]
    both = near_dup.common_shingles(sets, 64)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(40), 2))


def test_families_that_are_hardly_linked(spark):
    """Many documents of a similarity around the bound, compared in blocks."""
    draw = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(150):
        changed = list(base)
        for _ in range(draw.randint(3, 8)):
            changed[draw.randrange(100)] = f"n{draw.random()}"
        rows.append((k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.like_sets({i: brute.shingles(t, 2) for i, t in rows})
    assert 20 < len(set(want.values())) < 150
    for p in (near_dup.Near(words=2, block_shingles=2_000), near_dup.Near(words=2, broadcast_ids=0)):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, docs, p).collect()}
        assert got == want


def test_parallel_vectors_end_and_link(spark):
    """More vectors of one direction than a cell holds, exact multiples and rounded ones."""
    random_ = np.random.default_rng(3)
    v = random_.normal(size=8)
    exact = [(k, [float(k + 1), 0.0, 0.0, 0.0], 1) for k in range(300)]
    rounded = [(1000 + k, (v * (k + 1)).tolist(), 2) for k in range(300)]
    other = [(2000 + k, random_.normal(size=8).tolist(), 2) for k in range(60)]
    table = spark.createDataFrame(exact + rounded + other, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.near_vectors(spark, table, embedding_dup.Cover(cell_rows=40, centres=4)).collect()}
    assert all(got[k] == (299, 0) for k in range(300))
    x = np.array([r[1] for r in rounded + other], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[r[0]][0] for r in rounded + other] == links.tolist() and got[1299][1] == 1000


def test_borrowed_registers_agree_as_often_as_sets_are_alike():
    p = near_dup.Near()
    random_ = np.random.default_rng(5)
    for size, common in ((5, 4), (20, 16), (300, 240), (10, 1)):
        met, same = 0, []
        for _ in range(60):
            both, a, b = (random_.integers(0, 1 << 63, n, dtype=np.uint64) for n in (common, (size - common) // 2, size - common - (size - common) // 2))
            rows = np.repeat([0, 1], [common + len(a), common + len(b)])
            packed = near_dup.registers(rows, np.concatenate([both, a, both, b]), 2, p)
            dense = near_dup.densified(packed)
            assert (dense != near_dup.EMPTY).all() and (dense[packed != near_dup.EMPTY] == packed[packed != near_dup.EMPTY]).all()
            same.append((dense[0] == dense[1]).mean())
            keys = near_dup.band_keys(packed, p)
            met += len(np.unique(keys[1])) < len(keys[1])
        assert abs(np.mean(same) - common / size) < 0.05
        assert met == 60 if common / size >= 0.8 else met <= 6


@pytest.mark.parametrize("name", ["key", "_key", "gone", "_gone", "doc", "text2", "line_no"])
def test_documents_keep_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta\nalpha beta gamma delta", "own"), (2, "alpha beta gamma delta", "own"), (None, None, None)], f"doc_id long, text string, `{name}` string")
    out = lines.without_repeated_lines(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.text, r[name]) for r in out if r.doc_id) == [(1, "alpha beta gamma delta", "own"), (2, "", "own")]
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen")], "item_id long, text string")
    kept = decontamination.decontaminated(spark, docs, items)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
