"""The stages against plain versions, and the registered queries' columns."""

from __future__ import annotations

import re

import brute
import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from __spark_entry__ import queries
from barline.llm import quality
from barline.llm.graph import Scratch
from barline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": ["doc_id", "item_id"],
    "op2_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_": ["doc_id", "held_out", "score", "predicted"],
    "op4_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op9_": ["vec_id", "n_links", "component_id", "kept"],
    "op10_": ["doc_id", "n_lines", "n_removed", "removed"],
    "op11_": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_": ["lang", "source", "part", "item", "value", "rank"],
}


def test_every_operator_is_registered():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(names) == sorted(QUERIES) and "pipeline" in queries()
    assert {n.split("_")[0] + "_" for n in names} == set(COLUMNS)


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_near_duplicates", "op10_line_dedup"])
def test_queries_on_the_given_tables(spark, name):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0] + "_"]) <= set(got.columns)
    if name.startswith("op10"):
        assert {(r.doc_id, int(k)) for r in got.collect() for k in r.removed.split(",") if k} == brute.removed_lines(docs)
    elif name.startswith("op7"):
        want = brute.like_sets({i: brute.shingles(t, 2) for i, t in docs})
        assert {(r.doc_id, r.component_id) for r in got.collect()} == set(want.items())
    else:
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
        likely = {r.doc_id for r in got.collect()}
        some = [d for d in docs if d[0] in likely or d[0] % 10 == 0]  # all alignments of all documents take minutes
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute.overlapping(some, items)


def test_stages_equal_plain_versions(spark):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = quality.learned_from(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            weights = quality.train_quality(docs, labels)
            scores = {r.doc_id: r.score for r in quality.score_quality(docs, weights).collect()}
        docs = scratch.write(stage(spark, docs, FOLDER))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            assert after == {i: t for i, t in before.items() if scores[i] >= 0.3} and len(after) > 0.7 * len(before)
        elif k == 1:
            gone = brute.removed_lines(before.items())
            assert after == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before.items()}
        elif k == 2:
            want = brute.like_sets({i: brute.shingles(t, 5) for i, t in before.items()})
            assert set(after) == {i for i, c in want.items() if i == c}
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            gone = {i for i, _ in brute.overlapping([(i, before[i]) for i in before if i not in after], items)}
            assert gone == set(before) - set(after)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: r.n_tokens for r in docs.collect()} == {i: len(library.encode(t)) + 1 for i, t in before.items()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
