"""Encoding, classifiers, language model and secret scan."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from barline.llm import language, lm_score, maxent, pieces, quality, secret_net, secret_scan, toxicity
from barline.llm.tables import map_batches, row_blocks, text_bytes
from barline.llm.words import SIGN_CUT, find_words, hash_words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "▁", "tab\tnew\nline\x00", "日本語 テキスト", "🙂é²½", "0123 45", "end ", " start", "ab" * 30_000, " " * 3000, "x\n\n y"]


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as file:
        return pieces.PieceCodec(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_codec_equals_the_library(codec, library):
    draw = random.Random(0)
    pool = [*codec.ids, *["▁", "  ", "\n", "€", "\t", "7", "é"] * 400, *"abcdefghij ,." * 800]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    texts += [t.replace("▁", " ") for t in texts[:2000]] + [t for t in ODD if t]
    ids, offsets = codec.encode(texts)
    mine = [x.tolist() for x in np.split(ids, offsets[1:-1])]
    theirs = library.encode(texts)
    assert mine == theirs
    assert [raw.decode() for raw in codec.decode(ids, offsets)] == [library.decode(x) for x in theirs]
    some = [[draw.randrange(32_000) if draw.random() < 0.6 else draw.randrange(259) for _ in range(draw.randint(0, 6))] for _ in range(4000)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    got = codec.decode(np.array([i for x in some for i in x], np.int64), offsets)
    assert [raw.decode() for raw in got] == [library.decode(x) for x in some]


def test_pair_check_equals_merging(codec):
    draw = random.Random(1)
    usable = list(codec.usable.values())
    for k in range(20_000):
        a, b = (draw.choice(usable[:3000] if k % 2 else usable) for _ in range(2))
        assert codec._check(a, b) == (codec._merged(codec.texts[a] + codec.texts[b]) == [a, b])


def test_forgetting_words_changes_nothing(codec, monkeypatch):
    texts = ["some words to forget", "others to meet", "some words to forget"]
    before = codec.encode(texts)[0].tolist()
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    assert codec.encode(texts)[0].tolist() == before


def test_piece_tables(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "same row", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, pieces.piece_digests(docs, PIECES).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or ""), 2]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert got == sorted(want, key=str)
    ids = pieces.piece_ids(docs, PIECES)
    back = {r.doc_id: r.text for r in pieces.piece_texts(ids, PIECES).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t, _ in rows)
    assert pieces.piece_digests(docs.limit(0), PIECES).collect() == []


def test_words_and_hashes_do_not_depend_on_the_block():
    texts = ["", None, " a bé\tc", "x!!y", "a"]
    raw, offsets = text_bytes(pa.array(texts))
    starts, ends, rows = find_words(raw, offsets)
    assert [(bytes(raw[a:b]).decode(), int(r)) for a, b, r in zip(starts, ends, rows)] == [("a", 2), ("bé", 2), ("c", 2), ("x!!y", 3), ("a", 4)]
    hashes = hash_words(raw, starts, ends)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    assert [bytes(raw[a:b]) for a, b, _ in zip(*find_words(raw, offsets, SIGN_CUT))][3:6] == [b"x", b"!!", b"y"]
    assert list(row_blocks(np.array([0, 5, 5, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]


def _labelled(spark, count, good, bad, name):
    draw = random.Random(5)
    rows, labels = [], []
    for k in range(count):
        flag = draw.random() < 0.5
        rows.append((k, (good if flag else bad)(draw), "en", "s", 0))
        labels.append((k, int(flag)))
    labels += [(3, None), (None, 1), (7, labels[7][1]), (10**9, 1)]
    return spark.createDataFrame(rows, brute.DOCS), spark.createDataFrame(labels, f"doc_id long, {name} int"), dict(labels[:count])


def _prose(draw):
    return " ".join("".join(draw.choice("aeioustr") for _ in range(draw.randint(2, 7))) for _ in range(60))


def test_batches_of_long_texts_are_bounded(spark):
    """Spark's own limit would put all of these 32 MB into one batch."""
    table = spark.range(8000, numPartitions=1).select("id", F.repeat(F.lit("word "), 800).alias("text"))

    def held(batch):
        return pa.record_batch([pa.array([batch.column("text").buffers()[2].size])], ["bytes"])

    got = [r.bytes for r in map_batches(table, held, "bytes long").collect()]
    assert max(got) <= 8 << 20 and sum(got) >= 8000 * 4000


def test_quality_held_out(spark):
    junk = lambda draw: " ".join(f"{w}!!" for w in _prose(draw).upper().split()) if draw.random() < 0.5 else "Go " * 50
    docs, labels, truth = _labelled(spark, 500, _prose, junk, "quality")
    got = quality.quality(docs, labels).collect()
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, label int")
    scores = {round(r.score, 9) for r in quality.quality(odd, labels.limit(0)).collect()}
    assert scores == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_sparse_rows_are_bins_of_counts():
    raw, offsets = text_bytes(pa.array(["b b b a", "", None, "a"]))
    rows, bins, values = quality.sparse_rows(raw, offsets, 18)
    assert sorted(set(rows.tolist())) == [0, 3] and (rows == 0).sum() == 4  # b, a, b after itself, b a
    assert np.allclose(np.bincount(rows, values**2)[[0, 3]], 1)
    alone = quality.sparse_rows(*text_bytes(pa.array(["a"])), 18)
    assert alone[1][0] in bins[rows == 0]


def test_toxicity_held_out_and_spans(spark):
    def toxic(draw):
        w = _prose(draw).split()
        for _ in range(3):
            w[draw.randrange(len(w))] = "grub" + draw.choice(["ox", "ix", "ax"])
        return " é ".join(w)

    docs, labels, truth = _labelled(spark, 600, toxic, lambda draw: " é ".join(_prose(draw).split()), "toxic")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [(texts[r.doc_id], *map(int, s.split(":"))) for r in held if truth[r.doc_id] for s in r.spans.split(",") if s]
    assert spans and sum(t[a:b].startswith("grub") for t, a, b in spans) / len(spans) > 0.9
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "grubox " * 30_000)], "doc_id long, text string")
    rows = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_marginals_equal_all_taggings():
    draw = np.random.default_rng(0)
    scores, links = draw.normal(size=(3, 5)), draw.normal(size=(2, 2))
    present = np.ones((3, 5), bool)
    present[1, 3:] = False
    got, expected = toxicity.marginals(np.where(present, scores, 0), present, links)
    pairs = np.zeros((2, 2))
    for c in range(3):
        n, total, ones, seen = present[c].sum(), 0.0, np.zeros(5), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(scores[c, k] * t for k, t in enumerate(tags)) + sum(links[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            ones[:n] += weight * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                seen[a, b] += weight
        assert np.allclose(ones / total, got[c])
        pairs += seen / total
    assert np.allclose(pairs, expected)


@pytest.mark.parametrize("segment", [1, 8, 32])
def test_marginals_do_not_depend_on_where_a_text_is_cut(segment):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(["aa", "bbbb", "cc", "ddddd"], n)) for n in (1, 31, 32, 33, 0, 65, 777, 5)]
    raw, offsets = text_bytes(pa.array(texts))
    weights = draw.normal(size=(1 << 10) + 5) * 2
    weights[-4:] = 2, -3, -2, 3  # neighbours like to be equal, so messages reach far
    whole = toxicity.document_marginals(raw, offsets, weights, toxicity.Field(bits=10, segment=1000))[3]
    cut = toxicity.document_marginals(raw, offsets, weights, toxicity.Field(bits=10, segment=segment))[3]
    assert len(cut) == 944 and np.allclose(whole, cut, atol=1e-12)


def test_language_vectors_and_held_out(spark):
    texts = ["Ab, çd.", None, "", "1 2"]
    vectors = language.text_vectors(texts, 128)
    letter = lambda c: language.letter_vectors(np.array([0 if c == "_" else ord(c)]), 128)[0]
    plain = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in ("_ab", "ab_", "b_ç", "_çd", "çd_"))
    assert np.array_equal(vectors[0], plain) and not vectors[1:].any()
    draw = random.Random(8)
    make = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(draw.randint(10, 60)))
    rows = [(k, make("aeiounst") if k % 2 else make("öüäzwkch"), "l1" if k % 2 else "l2", "s", 0) for k in range(300)]
    rows += [(1000, None, "l1", "s", 0), (1001, "", None, "s", 0), (1002, "12 !", "l2", "s", 0), (None, "aest oun", None, None, None), (5, rows[5][1], "l1", "", 0)]
    got = language.languages(spark.createDataFrame(rows, brute.DOCS)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:300]}
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) for r in got)
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in got if r.doc_id in truth)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert language.languages(spark.createDataFrame([], brute.DOCS)).collect() == []
    alone = spark.createDataFrame([(1, "abc", None, "s", 0)], brute.DOCS)
    assert [r.lang_pred for r in language.languages(alone).collect()] == ["und"]


def test_next_word_chances_sum_to_one_and_learn():
    s = maxent.Shape(classes=2, members=3, pair_rows=16, word_rows=16)
    by_class, by_word = maxent.start(np.array([5, 4, 3, 2, 1, 1.0]), s)
    draw = np.random.default_rng(0)
    for table in (by_class, by_word):
        table += draw.normal(size=table.shape).astype(np.float32) * 0.3
    total = sum(np.exp(maxent.log_chances(by_class, by_word, np.array([3, *two]), np.zeros(3, int), s)[1:].sum()) for two in itertools.product(range(6), repeat=2))
    assert abs(total - 1) < 1e-5
    ids = np.tile([0, 2, 4], 3000)
    before = maxent.log_chances(by_class, by_word, ids, np.zeros(9000, int), s).mean()
    maxent.train(by_class, by_word, ids, np.zeros(9000, int), s, batch=256)
    assert maxent.log_chances(by_class, by_word, ids, np.zeros(9000, int), s).mean() > before + 0.5


def test_language_model_scores(spark):
    draw = random.Random(2)
    grammar = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["sat", "ran"], "sat": ["the"], "ran": ["the"]}
    docs = []
    for k in range(400):
        w = ["the"]
        for _ in range(draw.randint(0, 40)):
            w.append(draw.choice(grammar[w[-1]]) if draw.random() < 0.95 else f"rare{draw.randrange(500)}x" * 0 + "the")
        docs.append((k, " ".join(w).replace("the cat", f"The Cat{draw.randrange(30) or ''}")))
    docs += [(900, None), (901, ""), (None, "the dog"), (902, "the dog " * 5000), (5, docs[5][1])]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_tokens int")
    model = lm_score.Model(shape=maxent.Shape(classes=4, members=4, pair_rows=256, word_rows=512), block_tokens=800, rounds=2, learners=2)
    got = lm_score.lm_scores(spark, table, model).collect()
    assert len(got) == len(docs)
    show = lambda i, *x: (i is None, i, *x[:-1], round(x[-1], 6))
    want = sorted(map(str, (show(*x) for x in brute.base_scores(docs))))
    assert sorted(str(show(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (brute.fold(r.doc_id, 7) == 2) and r.score <= 0 for r in got)
    assert lm_score.lm_scores(spark, table.limit(0), model).collect() == []


def test_language_model_starts_at_its_base_and_beats_it_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where(lm_score.fold_of(F.col("doc_id"), 7) != 2)
    counts = lm_score.word_counts(train)
    total = counts.agg(F.sum("n")).first()[0]
    start = lm_score.start_model(counts, total, lm_score.Model())
    used = len(start.words) + len(start.shared)
    ids = np.arange(start.shape.words)
    chances = np.exp(maxent.log_chances(start.by_class, start.by_word, ids, ids, start.shape))
    assert abs(chances.sum() - 1) < 1e-3 and chances[used:].sum() < 1e-4
    assert len(start.shared) * 500 <= total
    held = lm_score.lm_scores(spark, docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.985 * held[0]


def _pair_gain(trained, chances, pairs):
    """How much likelier, in nats, the second word of each pair is after its first than after that of another pair."""
    hashes = lambda *w: lm_score.document_tokens(*text_bytes(pa.array([" ".join(w)])))[1][:2]
    after = lambda a, b: chances(trained, hashes(a, b))[1]
    return [after(a, b) - after(pairs[k - 1][0], b) for k, (a, b) in enumerate(pairs)]


def test_language_model_learns_from_every_training_document(spark):
    ids = [k for k in range(9000) if brute.fold(k, 7) != 2]
    pairs = [(f"first{j}", f"second{j}") for j in range(24)]
    texts = {k: "plain words here" for k in ids} | {ids[300 * j + 7]: " ".join(pairs[j] * 300) for j in range(24)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    model = lm_score.Model(shape=maxent.Shape(classes=8, members=16, pair_rows=4096, word_rows=1 << 14), learner_tokens=8_000)
    counts = lm_score.word_counts(docs)
    trained = lm_score.train_model(docs, counts, sum(r.n for r in counts.collect()), model)
    chances = lambda t, words: maxent.log_chances(t.by_class, t.by_word, t.ids_of(words), np.zeros(2, int), t.shape, words=words)
    gains = _pair_gain(trained, chances, pairs)
    assert min(gains) > 0.05, gains
    assert [lm_score.Model().rounds_of(n) for n in (0, 9_000, 20_000_000)] == [2, 2, 4]


def test_language_model_has_features_of_rare_words(spark):
    draw = random.Random(11)
    common = [f"w{k}" for k in range(1500)] * 30
    draw.shuffle(common)
    pairs = [(f"rarefirst{j}", f"raresecond{j}") for j in range(6)]
    texts = [" ".join(common[k : k + 50]) for k in range(0, len(common), 50)] + [" ".join(w for p in pairs for w in [*p, draw.choice(common)]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = lm_score.word_counts(docs)
    total = sum(r.n for r in counts.collect())
    trained = lm_score.train_model(docs, counts, total, lm_score.Model())
    assert trained.shape.words >= 2 * 1500
    hashes = lm_score.document_tokens(*text_bytes(pa.array([" ".join(w for p in pairs for w in p)])))[1][:-1]
    assert len(set(trained.ids_of(hashes).tolist())) == 12
    chances = lambda t, words: maxent.log_chances(t.by_class, t.by_word, t.ids_of(words), np.zeros(2, int), t.shape, words=words)
    assert min(_pair_gain(trained, chances, pairs)) > 0.05
    # all words of a small tree together have the chance of one, those that share leaves among them
    small = lm_score.start_model(counts, total, lm_score.Model(shape=maxent.Shape(classes=3, members=4, pair_rows=8, word_rows=64, levels=3)))
    small.by_class += np.random.default_rng(0).normal(size=small.by_class.shape).astype(np.float32)
    small.by_word += np.random.default_rng(1).normal(size=small.by_word.shape).astype(np.float32)
    rows = counts.collect()
    words, n = np.array([r.word for r in rows]), np.array([r.n for r in rows])
    ids, own = small.ids_of(words), len(small.words)
    chance = maxent.log_chances(small.by_class, small.by_word, ids, np.arange(len(ids)), small.shape, words=words)
    share = np.where(ids < own, 1.0, (n + 1) / small.shared[np.maximum(ids - own, 0)])
    unseen = [maxent.log_chances(small.by_class, small.by_word, np.array([own + k]), np.zeros(1, int), small.shape)[0] for k in range(len(small.shared))]
    assert abs((np.exp(chance) * share).sum() + (np.exp(unseen) / small.shared).sum() - 1) < 1e-4
    assert [maxent.shape_of(n, n * 30).levels for n in (100, 10_000, 300_000)] == [2, 3, 4]


def _secrets():
    draw = random.Random(6)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    odd = ['token = "abc"', "PassWord: abcdefghijkl=x", "api_key='AKIA" + upper(20) + "'", "é password=" + hexes(18), "ſecret=abcdefghijklmn", "token=token=abcdefghijkl", "AKIA123", "ABCDEF0123456789" * 2, hexes(16) + "g" + hexes(15), "x" * 40_000 + hexes(5000)]
    rows = [(k, t) for k, t in enumerate(odd)]
    for k in range(100, 500):
        middle = draw.choice([f"password={hexes(16)}", f"AKIA{upper(16)}", hexes(32), f"mail{k}.example.com", f"12.{k}.3.44.55", "plain words only"])
        rows.append((k, f"{_prose(draw)[:80]} {middle} {_prose(draw)[:50]}"))
    return rows + [(600, None), (601, ""), (None, "secret: 0123456789ab"), (100, dict(rows)[100])]


def test_secret_scan_equals_patterns_and_keeps_recall(spark):
    rows = _secrets()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = secret_scan.secrets(docs).collect()
    show = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = []
    for i, t in rows:
        spans = brute.base_secrets(t or "")
        want.append((i, *(sum(k == kind for _, k, _ in spans) for kind in range(3)), hashlib.sha256(show(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    texts = dict(rows[:-1])
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("learned")]
        assert ",".join(base) == show(brute.base_secrets(texts.get(r.doc_id) or ""))
    empty = secret_scan.secrets(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_network_learns_and_holds_its_recall():
    rows = [t for _, t in _secrets() if t]
    windows, labels = [], []
    raw, offsets = text_bytes(pa.array(rows))
    for spans, candidates, own in secret_scan.scan_rows(rows, raw, offsets, secret_scan.Scan()):
        windows += own
        labels += [[k >> b & 1 for b in range(3)] for k in secret_scan.kinds_of(candidates, spans)]
    labels = np.array(labels, float)
    net = secret_net.train(windows[::2], labels[::2])
    net = secret_net.calibrate(net, windows[1::2], labels[1::2], 0.9)
    positive = labels[1::2].any(1)
    found = secret_net.flagged(net, windows[1::2])
    assert found[positive].mean() >= 0.85 and found[~positive].mean() <= 0.1
    together = secret_net.logits(net, windows[:50])
    alone = np.concatenate([secret_net.logits(net, [w]) for w in windows[:50]])
    assert np.allclose(together, alone)


def test_network_finds_secrets_that_no_rule_matches(spark):
    draw = random.Random(13)
    upper = lambda n, letters="0123456789ABCDEF": "".join(draw.choice(letters) for _ in range(n))
    rows = _secrets()
    extra = [(1000 + k, f"{_prose(draw)[:80]} {upper(32)} {_prose(draw)[:50]}") for k in range(20)]
    plain = [(2000 + k, f"{_prose(draw)[:80]} mail{k + 700}.example.com {_prose(draw)[:50]}") for k in range(20)]
    docs = spark.createDataFrame(rows + extra + plain, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secrets(docs).collect()}
    texts = dict(extra + plain)
    right = lambda i: any(re.fullmatch("[0-9A-F]{32}", texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i].split(",") if s)
    assert sum(right(i) for i, _ in extra) >= 18
    assert sum("learned" in got[i] for i, _ in plain) <= 2
    window = np.array([*b" x password=", *(256 + np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.int64))])
    changed = bytes((secret_scan.hidden(window, 5, np.random.default_rng(0)) & 255).astype(np.uint8))
    assert not secret_scan.ASSIGN.search(changed.decode()) and changed.endswith(b"=0123456789ABCDEF")
    assert secret_scan.covered_whole([(0, 5), (4, 9), (7, 8)], [(0, 0, 6), (5, 2, 8)]) == [True, False, True]


def test_limits_keep_recall_and_letters_are_candidates(monkeypatch):
    scores = np.linspace(-6, 0, 100)[:, None]
    monkeypatch.setattr(secret_net, "logits", lambda net, windows: scores[: len(windows)])
    labels = (np.arange(100) % 10 == 5).astype(float)[:, None]
    net = secret_net.calibrate(secret_net.new_net(2, 1), [None] * 100, labels, 0.98)
    assert secret_net.flagged(net, [None] * 100)[labels[:, 0] > 0].all()
    text = "key QwErTyUiOpAsDfGh short"
    rows = list(secret_scan.scan_rows([text], *text_bytes(pa.array([text])), secret_scan.Scan()))
    assert rows[0][1] == [(4, 20)]


def test_network_learns_from_every_window(spark):
    draw = random.Random(17)
    words = ["".join(draw.choice("GHJKLMNPQRSTghjklmnpqrst") for _ in range(14)) for _ in range(3100)]
    keys = [f"password={word}" for word in words[:60]]
    docs = spark.createDataFrame(list(enumerate(words + keys)), "doc_id long, text string")
    window = F.udf(lambda t: (np.frombuffer(t.encode(), np.uint8).astype(np.int16) + 256).tobytes(), "binary")
    last = docs.where(F.col("doc_id") < len(words)).orderBy(F.xxhash64(window("text")).desc()).first().doc_id
    whole, less = secret_scan.train_scan(docs), secret_scan.train_scan(docs.where(F.col("doc_id") != last))
    assert abs(whole.tables - less.tables).max() > 0
    # many learners: all rows count, and where they lie doesn't matter
    p = secret_scan.Scan(learner_windows=100, few=10)
    nets = [secret_scan.train_scan(docs.repartition(n), p) for n in (1, 5)]
    assert (nets[0].tables == nets[1].tables).all() and (nets[0].limits == nets[1].limits).all()
    assert nets[0].limits[0] != 0.5


def test_network_learns_from_long_windows(spark):
    draw = random.Random(18)
    rows = ["".join(draw.choice("0123456789abcdef") for _ in range(1100)) for _ in range(150)] + [f"plain{k}.example.com" for k in range(400)]
    net = secret_scan.train_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert net.limits[2] != 0.5  # long findings were there to calibrate on


def test_gradients_of_parts_equal_those_of_whole_windows():
    random_ = np.random.default_rng(5)
    windows = [random_.integers(97, 100, n) for n in (3, 40, 700, 12)]
    labels, net = np.eye(3)[[0, 1, 2, 0]], secret_net.new_net(16, 3)
    whole, parts = (secret_net._gradients(net, windows, labels, np.ones(3), n) for n in (1 << 16, 50))
    assert all(np.allclose(whole[k], parts[k], atol=1e-6) for k in whole)
    step = 1e-4
    loss = lambda n: np.log1p(np.exp(np.where(labels > 0, -1, 1) * secret_net.logits(n, windows))).sum() / len(windows)
    for at in ((2, 97, 3), (0, 98, 7)):
        net.tables[at] += step
        more = loss(net)
        net.tables[at] -= 2 * step
        assert abs((more - loss(net)) / (2 * step) - whole["tables"][at]) < 1e-3
        net.tables[at] += step


def test_gradients_of_a_row_are_added_in_their_order():
    random_ = np.random.default_rng(8)
    kinds = np.sort(np.concatenate([np.arange(300), random_.integers(0, 200, 700), np.full(500, 7)]))
    x, first = random_.normal(size=(len(kinds), 32)), np.flatnonzero(np.diff(kinds, prepend=-1))
    want = np.stack([np.bincount(kinds, column) for column in x.T], 1)
    assert (maxent._sums(x, first) == want).all()
